"""The pipeline on the smallest tables: what each stage must and must not drop."""

import corpus_pipeline as P
from panelia.llm import decontamination, toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    toxic, exact, near, clean, coded = (f for _, f in P.STAGES)
    a = toxic(spark, docs, SF).persist()
    assert a.columns == docs.columns
    scores = toxicity.toxicity_scores(docs, toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet")))
    assert {r.doc_id for r in a.collect()} == {r.doc_id for r in scores.filter("predicted = 0").collect()}
    b = exact(spark, a, SF).persist()
    assert b.columns == docs.columns
    want = {}
    for r in a.collect():
        want[r.text] = max(want.get(r.text, r.doc_id), r.doc_id)
    assert {r.doc_id for r in b.collect()} == set(want.values())
    c = near(spark, b, SF).persist()
    assert c.columns == docs.columns and {r.doc_id for r in c.collect()} <= set(want.values())
    d = clean(spark, c, SF).persist()
    bench = [decontamination.normalised(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {r.doc_id for r in d.collect()}
    for r in c.collect():
        if any(x in decontamination.normalised(r.text) for x in bench):
            assert r.doc_id not in left
    e = coded(spark, d, SF)
    assert {r.doc_id for r in e.collect()} == left
    assert {tuple(r) for r in P.run(spark, SF).collect()} == {tuple(r) for r in e.collect()}


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    empty = docs.limit(0)
    for name, stage in P.STAGES:
        assert stage(spark, empty, SF).count() == 0, name


def test_null_and_repeated_ids(spark):
    texts = {k: " ".join(f"{k}{n * n % 97}" for n in range(40)) for k in "abcdef"}
    rows = [(None, "a"), (None, "b"), (None, "b"), (1, "c"), (None, "c"), (3, "d"), (9, "d"), (3, "e"), (7, "f"), (7, "f"), (3, "a")]
    docs = spark.createDataFrame([(i, texts[k], k) for i, k in rows], "doc_id long, text string, source string")
    key = lambda r: (r[1], -1 if r[0] is None else r[0])
    exact = P.exact_dedup_stage(spark, docs, SF)
    assert exact.columns == docs.columns
    assert sorted([(r.doc_id, r.source) for r in exact.collect()], key=key) == [(3, "a"), (None, "b"), (1, "c"), (9, "d"), (3, "e"), (7, "f")]
    near = P.near_dedup_stage(spark, docs, SF)
    assert near.columns == docs.columns
    assert sorted([(r.doc_id, r.source) for r in near.collect()], key=key) == [(3, "a"), (None, "b"), (1, "c"), (3, "d"), (3, "e"), (7, "f")]


def test_keep_rows_with_clashing_columns_and_one_hot_text(spark):
    """A text with half of all rows and no ids; columns with names that the join uses."""
    rows = [(None, "same text", "a", "b", k) for k in range(500)] + [(k, f"text {k}", "a", "b", k) for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key string, key string, _row int")
    kept = P.exact_dedup_stage(spark, docs, SF)
    assert kept.columns == docs.columns and kept.count() == 501
    assert {(r._key, r.key) for r in kept.collect()} == {("a", "b")}
    from panelia.llm.common import text_digest

    plan = P.keep_rows(docs, docs.select("doc_id", text_digest().alias("digest")))._jdf.queryExecution().toString()
    assert plan.count("partial_first") >= 1  # hot rows are made one before the shuffle
