"""Joins of keyed series: as-of, higher time frames, shifted and permuted joins."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof(left: DataFrame, right: DataFrame, key: str, time: str, values: list[str]) -> DataFrame:
    """The latest right row at or before each left row of the key (J1), with its time as
    <time>_matched (J2). One shuffle by key: union, order by time, last non-null."""
    both = left.withColumn("_side", F.lit(1)).withColumn("_match", F.lit(None).cast(right.select(F.struct(time, *values)).schema[0].dataType))
    other = right.select(key, time, F.lit(0).alias("_side"), F.struct(time, *values).alias("_match"))
    both = both.unionByName(other, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_m", F.last("_match", ignorenulls=True).over(w)).filter("_side = 1")
    return out.select(*left.columns, F.col(f"_m.{time}").alias(f"{time}_matched"), *[F.col(f"_m.{v}").alias(v) for v in values])


def higher_frame(bars: DataFrame, coarse: DataFrame, key: str, time: str, label: Column, values: list[str]) -> DataFrame:
    """The last finished coarse bar for each fine bar: coarse values lag one coarse bar, join on
    the label of the coarse bar that holds the fine one, and carry forward (J5)."""
    w = Window.partitionBy(key).orderBy("_label")
    c = coarse.withColumnRenamed(time, "_label").select(key, "_label", *[F.lag(v).over(w).alias(v) for v in values])
    out = bars.withColumn("_label", label).join(c, [key, "_label"], "left")
    run = Window.partitionBy(key).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumns({v: F.last(v, ignorenulls=True).over(run) for v in values}).drop("_label")


def following(events: DataFrame, bars: DataFrame, key: str, at: str, time: str, n: int, horizon_seconds: int) -> DataFrame:
    """The first n bars strictly after each event, within a horizon (J20): bars meet the events of
    their own and the earlier bucket, so the range join is an equi-join."""
    bucket = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / horizon_seconds)
    e = events.withColumn("_id", F.monotonically_increasing_id()).withColumn("_k", F.explode(F.array(bucket(at), bucket(at) + 1)))
    b = bars.withColumn("_k", bucket(time))
    seconds = F.unix_seconds(F.col(time).cast("timestamp")) - F.unix_seconds(F.col(at).cast("timestamp"))
    met = e.join(b, [key, "_k"]).filter((F.col(time) > F.col(at)) & (seconds <= horizon_seconds))
    rank = F.row_number().over(Window.partitionBy("_id").orderBy(time))
    return met.withColumn("step", rank).filter(F.col("step") <= n).drop("_k")
