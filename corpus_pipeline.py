"""Corpus pipeline: toxicity, exact dedup, near-dedup, decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and
read again as the next stage's docs. All but the last keep the columns of ``documents``.
"""

import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelia.llm import byte_bpe, decontamination, exact_dedup, simhash, toxicity
from panelia.llm.common import stored, table, text_digest


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go. Null and empty texts are not toxic; rows with
    a null or repeated doc_id are judged by their text; an empty table stays empty."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays, that with the largest doc_id; one with a null doc_id if there
    is no other. Null and empty texts are equal; of rows given twice one stays; an empty table
    stays empty."""
    index = f"digest_index_{uuid.uuid4().hex}"
    try:
        verdicts = exact_dedup.exact_dedup(docs, index, exact_dedup.index_buckets(spark))
        # the kept keys are stored, so the index may go
        return keep_rows(docs, verdicts.filter("kept").select("doc_id", F.unhex("text_sha256").alias("digest")))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {index}")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies one row stays, that with the smallest doc_id; one with a
    null doc_id if there is no other. Null and empty texts are near copies of one another; of rows
    given twice one stays; an empty table stays empty."""
    return keep_rows(docs, simhash.near_kept(docs))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go. Null and empty texts hold none; ids do not count, so
    rows with a null or repeated doc_id are judged by their text; an empty table stays empty."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded bytes of what is left, one row for each row, whatever
    its doc_id; null and empty texts have no ids."""
    return byte_bpe.encoding_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def row_key(digest: Column) -> Column:
    """Text and doc_id as one value that is never null: a null doc_id equals another one here."""
    return F.concat(digest, F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))


def keep_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """One row of ``docs`` for each (doc_id, digest) of ``kept``, the first of those given twice.

    Rows of one key are made one before they are shuffled, so a key that holds a third of all rows
    sends one row a task. The kept keys grow with the input, so they meet the documents by
    sort-merge join, which uses the partitioning and order that the grouping left."""
    key, row = (f"{name}-{uuid.uuid4().hex}" for name in ("key", "row"))  # no column of docs has this name
    keys = stored(kept.select(row_key(F.col("digest")).alias("key")).distinct(), "kept").withColumnRenamed("key", key)
    one = docs.groupBy(row_key(text_digest()).alias(key)).agg(F.first(F.struct(*(docs[c] for c in docs.columns))).alias(row))
    return one.join(keys.hint("merge"), key, "left_semi").select(f"`{row}`.*")


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("byte_bpe", byte_bpe_stage),
]

#: The stages hold a classifier, XXH64 fingerprints and a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}") if name != STAGES[-1][0] else stage(spark, docs, sf_dir)
    return docs
