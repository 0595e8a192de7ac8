"""Operator 5, exact dedup: a persistent digest index, bucketed and sorted by hash."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelia.llm.common import join_groups, stored, table, text_or_empty

INDEX_SCHEMA = "digest binary, keep_id long"


def create_index(spark: SparkSession, name: str, buckets: int) -> None:
    """An empty index table; one file for each bucket is added by every append."""
    if not spark.catalog.tableExists(name):
        spark.createDataFrame([], INDEX_SCHEMA).write.bucketBy(buckets, "digest").sortBy("digest").format(
            "parquet"
        ).saveAsTable(name)


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest): SHA-256 of the UTF-8 text, null as empty. 40 bytes a row from here on."""
    return docs.select("doc_id", F.unhex(F.sha2(text_or_empty(), 256)).alias("digest"))


def exact_dedup(docs: DataFrame, index: str, buckets: int = 64) -> DataFrame:
    """Assign every row to its group of equal texts and append the new digests to ``index``.

    Returns one row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.
    A text that the index knows from an earlier batch keeps that batch's row: all its rows here
    are dropped. Among the new ones the largest doc_id stays. Null and empty texts are one text.
    Rows that repeat both doc_id and text are one document given twice and share a verdict; a
    null doc_id never stays beside another. Other columns are ignored. An empty input gives an
    empty result and leaves the index as it is.
    """
    spark = docs.sparkSession
    create_index(spark, index, buckets)
    rows = stored(digests(docs), "digests")
    groups = stored(
        rows.groupBy("digest").agg(F.max("doc_id").alias("newest"), F.count(F.lit(1)).alias("group_size")),
        "digest-groups",
    )
    known = spark.table(index)
    fresh = groups.join(known.select("digest").hint("merge"), "digest", "left_anti")
    # hash partitioning on the digest is the bucketing of the table: one file for each bucket
    fresh.select("digest", F.col("newest").alias("keep_id")).repartition(buckets, "digest").write.bucketBy(
        buckets, "digest"
    ).sortBy("digest").mode("append").format("parquet").saveAsTable(index)
    spark.catalog.refreshTable(index)
    chosen = groups.select("digest", "group_size").join(spark.table(index).hint("merge"), "digest")
    return join_groups(rows, chosen, "digest", "group_size").select(
        "doc_id",
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def index_buckets(spark: SparkSession) -> int:
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` against an index that starts empty and is dropped in the end."""
    index = f"digest_index_{uuid.uuid4().hex}"
    try:
        return stored(exact_dedup(table(spark, sf_dir, "documents"), index, index_buckets(spark)), "exact-dedup")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {index}")


OP5_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM d
"""
