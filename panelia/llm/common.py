"""Shared pieces of the text operators: tables, scratch storage, skew-safe joins."""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelia.session import ship_package

#: A key with more than one row in HOT_SHARE is hot. Fewer than HOT_SHARE keys can be hot,
#: whatever the size of the input, so a table of hot keys may always be broadcast.
HOT_SHARE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def text_digest() -> Column:
    """SHA-256 of the UTF-8 text, null as empty."""
    return F.unhex(F.sha2(text_or_empty(), 256))


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster. Where the session names none, a default of a local session
    serves, whose executors are on this machine; on a cluster there is none."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir("/tmp/checkpoints")
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: lineage ends there, so a lost executor costs
    a reread and nothing is computed twice."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches, rows: int = 500):
    """Arrow batches cut into pieces of so many rows: what Python makes of a piece is soon freed."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """Inner join of ``rows`` with one row of ``groups`` for each key, safe for hot keys.

    Rows of hot keys meet their group by broadcast and are never shuffled; the others take a
    sort-merge join in which no key holds more than one row in HOT_SHARE. Both inputs are read
    twice, so they should be stored tables.
    """
    is_hot = F.col(size) * HOT_SHARE > rows.count()
    hot, cold = groups.filter(is_hot), groups.filter(~is_hot)
    near = rows.join(F.broadcast(hot), key)
    far = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold.hint("merge"), key)
    return near.unionByName(far)
