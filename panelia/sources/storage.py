"""Tables in the folder that all executors share, and a sink keyed by partition."""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelia.sources.tables import upsert


def scratch_root(spark: SparkSession) -> str:
    """The folder of this application in the shared folder. A local session without one uses a
    default, since its executors are on this machine; on a cluster there is none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "/tmp/checkpoints"
    return f"{base.rstrip('/')}/panelia-{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for a table of this application."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def discard_scratch(spark: SparkSession) -> None:
    """Remove all tables that this application stored. Results that were not written or collected
    yet can no longer be computed, so this belongs at the end of a job."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back: lineage ends there, and values that a second
    run of the plan could choose otherwise (row numbers among ties, sketches) are fixed."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stale_tails(table: DataFrame, key: str, time: str, now: Column, hours: int = 12) -> DataFrame:
    """(key, end, stale): the stored end of each key and whether it is older than so many hours (A3)."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("end").cast("timestamp"))
    return table.groupBy(key).agg(F.max(time).alias("end")).withColumn("stale", age > hours * 3_600_000_000)


def upsert_partitions(batch: DataFrame, path: str, keys: list[str], partition: str) -> None:
    """Upsert a batch into a Parquet table partitioned by ``partition``, which the keys fix.

    Only partitions that the batch has rows for are read and written again; the files of all
    others stay as they are. The merged partitions are stored before any is replaced, and a value
    that is already there is replaced by itself, so a batch may be replayed.
    """
    spark = batch.sparkSession
    batch = stored(batch, "batch")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(target):
        old = spark.read.schema(batch.schema).parquet(path)
        # a semi join on the partition column prunes the scan at run time
        touched = old.join(F.broadcast(batch.select(partition).distinct()), partition, "left_semi")
        batch = stored(upsert(touched.select(*batch.columns), batch, keys), "merged")
    batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
