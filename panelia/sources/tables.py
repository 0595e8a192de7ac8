"""Scans: tables with NaN as null, keyed series without repeats, point-in-time cuts, mappings."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A parquet table with NaN turned to null, once, here."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    doubles = {c for c, t in df.dtypes if t in ("double", "float")}
    return df.select([F.when(~F.isnan(c), F.col(c)).alias(c) if c in doubles else F.col(c) for c in df.columns])


def first_kept(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key: the first in a full ordering."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def closed_bars(bars: DataFrame, key: str = "symbol", time: str = "day") -> DataFrame:
    """Bars without the last one of each key, which may still be forming (A1)."""
    last = F.max(time).over(Window.partitionBy(key))
    return bars.withColumn("_last", last).filter(F.col(time) < F.col("_last")).drop("_last")


def newer_rows(fresh: DataFrame, stored: DataFrame, key: str, time: str) -> DataFrame:
    """Rows of ``fresh`` after the stored end of their key; new keys come whole (A3)."""
    end = stored.groupBy(key).agg(F.max(time).alias("_end"))
    return fresh.join(end, key, "left").filter(F.col("_end").isNull() | (F.col(time) > F.col("_end"))).drop("_end")


def scaled_mapping(bars: DataFrame, mapping: DataFrame, price: str, key: str = "symbol") -> DataFrame:
    """A second market by a table (symbol, other, multiplier); prices scaled (A4). The mapping is
    joined by Spark's own choice, so a large one is shuffled."""
    return bars.join(mapping, key).withColumn(price, F.col(price) * F.col("multiplier"))


def venues(parts: dict[str, DataFrame]) -> DataFrame:
    """Several venues of one shape as one table with a venue column (A5)."""
    out = None
    for name, df in parts.items():
        df = df.withColumn("venue", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def calendar(df: DataFrame, time: str = "day", step: str = "INTERVAL 1 DAY") -> DataFrame:
    """All periods from the first to the last one of ``df``."""
    ends = df.agg(F.min(time).alias("a"), F.max(time).alias("b"))
    return ends.filter("a IS NOT NULL").select(F.explode(F.sequence("a", "b", F.expr(step))).alias(time))


def missing_keys(wanted: DataFrame, *present: DataFrame, on: list[str]) -> DataFrame:
    """Wanted keys that none of the tables has."""
    for table in present:
        wanted = wanted.join(table.select(*on), on, "left_anti")
    return wanted


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Union where the new value of a key wins."""
    both = old.withColumn("_p", F.lit(0)).unionByName(new.withColumn("_p", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_p").alias("_r")).select(*keys, "_r.*")


def coverage(eav: DataFrame, by: list[str], member: str) -> DataFrame:
    """Rows and distinct members of each group (A10)."""
    return eav.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(member).alias("n_members"))


def minimum_history(df: DataFrame, key: str, least: int) -> DataFrame:
    """Rows of keys with at least ``least`` rows."""
    enough = df.groupBy(key).count().filter(F.col("count") >= least).select(key)
    return df.join(enough, key, "left_semi")


def point_in_time(bars: DataFrame, as_of: Column, key: str, time: str, least: int) -> DataFrame:
    """Rows up to ``as_of`` of keys with enough of them."""
    return minimum_history(bars.filter(F.col(time) <= as_of), key, least)


def common_cutoff(df: DataFrame, key: str, time: str) -> DataFrame:
    """All keys trimmed to the earliest last period."""
    cut = df.groupBy(key).agg(F.max(time).alias("_e")).agg(F.min("_e").alias("_cut"))
    return df.join(F.broadcast(cut), F.col(time) <= F.col("_cut")).drop("_cut")


def conflicts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys with more than one value (A14); empty if the extracts agree."""
    return df.groupBy(*keys).agg(F.countDistinct(value).alias("n_values")).filter("n_values > 1")


def digest(df: DataFrame, text: Column) -> DataFrame:
    """Order-free digest of the rows: their count and sums of the two halves of each MD5."""
    h = F.md5(text.cast("binary") if not isinstance(text, str) else text)
    part = lambda a: F.sum(F.conv(F.substring(h, a, 8), 16, 10).cast("bigint"))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), part(1).alias("sum_1"), part(9).alias("sum_2"))


def alias_projection(df: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """For each name the first column present among its candidates, whatever the case; else null."""
    present = {c.lower(): c for c in reversed(df.columns)}

    def pick(candidates: list[str]) -> Column:
        return next((F.col(present[c.lower()]) for c in candidates if c.lower() in present), F.lit(None).cast("string"))

    return df.select(*[pick(c).alias(name) for name, c in wanted.items()])


def book_rows(books: DataFrame, day: str, longs: str, shorts: str) -> DataFrame:
    """Comma lists of names to rows with weight +-0.5/n a side."""

    def side(name: str, sign: float) -> DataFrame:
        names = F.filter(F.transform(F.split(name, ","), lambda x: F.trim(x)), lambda x: x != "")
        rows = books.select(day, names.alias("_n")).filter(F.size("_n") > 0)
        return rows.select(day, F.explode("_n").alias("symbol"), (F.lit(0.5 * sign) / F.size("_n")).alias("weight"))

    return side(longs, 1.0).unionByName(side(shorts, -1.0))


def disjoint(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(n_left, n_right, n_common, disjoint): two universes must not share a key."""
    sides = left.select(key, F.lit(True).alias("a")).unionByName(right.select(key, F.lit(False).alias("a")))
    each = sides.groupBy(key).agg(F.bool_or("a").alias("l"), F.bool_or(~F.col("a")).alias("r"))
    both = F.count_if(F.col("l") & F.col("r"))
    return each.agg(F.count_if("l").alias("n_left"), F.count_if("r").alias("n_right"), both.alias("n_common"), (both == 0).alias("disjoint"))
