"""Stateful series operators without a loop over rows: affine scans, islands, hysteresis."""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def exponential_means(df: DataFrame, key: str, time: str, value: str, spans: tuple[int, ...], chunk: int = 256) -> DataFrame:
    """y = a x + (1 - a) y[-1], y[first] = x, for each span, as column ema<span>.

    The recursion is affine. Each chunk of rows is summed up as y_end = decay * y_start + gain;
    the start of a chunk follows from the sums of the chunks before it, of which only so many are
    looked at as still count in a double (2^-80); then each chunk is finished from its own start.
    Rows are numbered within their key, for which Spark sorts a key in one task (it spills); all
    else is by chunk.
    """
    order = Window.partitionBy(key).orderBy(time)
    rows = df.withColumn("_n", F.row_number().over(order) - 1).withColumn("_c", F.floor(F.col("_n") / chunk))
    at = F.col("_n") % chunk
    first = F.col("_n") == 0
    weighted = {}
    for s in spans:
        keep = 1 - 2 / (s + 1)
        weight = F.when(first, F.lit(1.0)).otherwise(F.lit(2 / (s + 1)))
        # inside a chunk: y[i] / keep^i is a running sum, and keep^-chunk stays within a double
        weighted[f"_s{s}"] = F.sum(weight * F.col(value) * F.pow(F.lit(keep), -at)).over(
            Window.partitionBy(key, "_c").orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
        ) * F.pow(F.lit(keep), at)
    rows = rows.withColumns(weighted)
    sums = rows.groupBy(key, "_c").agg(F.count(F.lit(1)).alias("_size"), *[F.max_by(f"_s{s}", time).alias(f"_g{s}") for s in spans])
    past = max(2, *[math.ceil(80 * math.log(2) / (-math.log(1 - 2 / (s + 1)) * chunk)) + 1 if s > 1 else 2 for s in spans])
    by = Window.partitionBy(key).orderBy("_c").rowsBetween(-past, -1)
    starts = sums.withColumn("_past", F.collect_list(F.struct("_size", *[f"_g{s}" for s in spans])).over(by))
    for s in spans:
        keep = 1 - 2 / (s + 1)
        starts = starts.withColumn(f"_y{s}", F.aggregate("_past", F.lit(0.0), lambda y, c: y * F.pow(F.lit(keep), c["_size"]) + c[f"_g{s}"]))
    out = rows.join(starts.select(key, "_c", *[f"_y{s}" for s in spans]), [key, "_c"])
    made = {f"ema{s}": F.col(f"_s{s}") + F.col(f"_y{s}") * F.pow(F.lit(1 - 2 / (s + 1)), at + 1) for s in spans}
    return out.withColumns(made).select(*df.columns, *made)


def streaks(df: DataFrame, key: str, time: str, flag: str) -> DataFrame:
    """(key, n, last): every run of rows with the flag (gaps and islands)."""
    w = Window.partitionBy(key).orderBy(time)
    begins = (F.col(flag) & ~F.coalesce(F.lag(flag).over(w), F.lit(False))).cast("int")
    runs = df.withColumn("_i", F.sum(begins).over(w)).filter(flag)
    return runs.groupBy(key, "_i").agg(F.count(F.lit(1)).alias("n"), F.max(time).alias("last")).drop("_i")


def hysteresis(df: DataFrame, key: str, time: str, rank: str, q: float, h: float, eps: float = 1e-9) -> DataFrame:
    """Side (-1, 0, 1): enter a tail at q, leave it only past q + h; a null rank leaves.

    The state at a row follows from the last entry and the last time outside that side's band.
    """
    run = Window.partitionBy(key).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    r = F.col(rank)
    entry = F.when(r >= 1 - q - eps, 1).when(r <= q + eps, -1)
    seen = df.withColumns(
        {
            "_side": F.last(entry, ignorenulls=True).over(run),
            "_at": F.max(F.when(entry.isNotNull(), F.col(time))).over(run),
            "_out_high": F.max(F.when(r.isNull() | (r < 1 - q - h - eps), F.col(time))).over(run),
            "_out_low": F.max(F.when(r.isNull() | (r > q + h + eps), F.col(time))).over(run),
        }
    )
    out = F.when(F.col("_side") == 1, F.col("_out_high")).otherwise(F.col("_out_low"))
    held = F.col("_side").isNotNull() & (out.isNull() | (out < F.col("_at")))
    return seen.withColumn("side", F.when(held, F.col("_side")).otherwise(0)).drop("_side", "_at", "_out_high", "_out_low")


def delayed_exit(df: DataFrame, key: str, time: str, rank: str, q: float, *delays: int, eps: float = 1e-9) -> DataFrame:
    """Side of the last entry, kept for so many rows after the last row in its tail (X18); for
    several delays one row for each, in column k, from one pass over the series."""
    order = Window.partitionBy(key).orderBy(time)
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    r = F.col(rank)
    entry = F.when(r >= 1 - q - eps, 1).when(r <= q + eps, -1)
    rows = df.withColumn("_n", F.row_number().over(order)).withColumns(
        {
            "_side": F.last(entry, ignorenulls=True).over(run),
            "_at": F.max(F.when(entry.isNotNull(), F.col("_n"))).over(run),
            "_null": F.max(F.when(r.isNull(), F.col("_n"))).over(run),
        }
    )
    rows = rows.withColumn("k", F.explode(F.array(*map(F.lit, delays))))
    held = F.col("_side").isNotNull() & (F.col("_n") - F.col("_at") <= F.col("k")) & (F.col("_null").isNull() | (F.col("_null") < F.col("_at")))
    return rows.withColumn("side", F.when(held, F.col("_side")).otherwise(0)).drop("_n", "_side", "_at", "_null")
