"""Prices of zero, rounding, order of rows and growth, against SQL twins or loops."""

import random
from datetime import datetime, timedelta

import duckdb
import pandas as pd
import pytest

from panelia.operators import labels as L
from panelia.operators import ranges as R
from panelia.plans import catalogue


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Events of three symbols, five a day over thirty days; every ninth value is zero, and one symbol
    has days of nothing else."""
    out = tmp_path_factory.mktemp("zeros")
    rng, rows = random.Random(3), []
    for i in range(450):
        ts = datetime(2024, 1, 1) + timedelta(days=i // 15, hours=i % 15, seconds=rng.randrange(3000), microseconds=i)
        user = 700 + i % 3
        quiet = user == 701 and 10 <= i // 15 <= 22
        value = 0.0 if i % 9 == 0 or quiet else rng.randrange(1, 9000) / 100
        rows.append((i, ts, user, rng.choice(["click", "purchase", "view", "signup", "error"]), value, f'{{"k": {rng.randrange(100)}}}'))
    df = pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
    duckdb.sql(f"COPY (SELECT * REPLACE (ts::TIMESTAMP AS ts) FROM df) TO '{out}/events.parquet' (FORMAT parquet)")
    return str(out)


def cells(columns, rows):
    """Rows in an order of their own; NaN as text, since it equals nothing."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple("nan" if r[i] != r[i] else r[i] for i in order) for r in rows), key=repr)


def assert_same(spark, folder, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    found, df = con.sql(catalogue.SQL[name]), catalogue.QUERIES[name](spark, folder)
    assert cells(df.columns, df.collect()) == cells(found.columns, found.fetchall())


def test_exit_replay_without_an_entry_price(spark, folder):
    """A symbol's rows with six bars after them, but those with a price of zero, in each part."""
    con = duckdb.connect()
    closes = con.sql(f"SELECT user_id, ts::DATE AS d, arg_max(value, ts) AS c FROM '{folder}/events.parquet' GROUP BY ALL ORDER BY ALL").fetchall()
    want = {"train": 0, "oos": 0}
    for user in {u for u, _, _ in closes}:
        own = [c for u, _, c in closes if u == user]
        for n, close in enumerate(own[:-6], 1):
            want["train" if n * 2 <= len(own) else "oos"] += 2 * (close > 0)
    got = catalogue.QUERIES["h11_h12_exit_replay"](spark, folder).collect()
    assert len(got) == 6 and all(r.n == want[r.part] and abs(r.mean_mfe) < float("inf") for r in got)


def test_profiles_from_a_price_of_zero(spark, folder):
    assert_same(spark, folder, "h11_h12_profiles")


def test_bars_after_an_event_of_value_zero(spark, folder):
    assert_same(spark, folder, "j20_following_bars")


def test_candles_with_a_low_of_zero(spark, folder):
    assert_same(spark, folder, "p1_p9_candle_shape")


def test_rounding_goes_by_the_binary_value(spark):
    from pyspark.sql import functions as F

    from panelia.functions import series as S

    values = [57.63 / 6.4 - 1, -(57.63 / 6.4 - 1), 0.285, 1.5e-6, float("inf"), None]
    got = spark.createDataFrame([(x,) for x in values], "x double").select(*[S.ieee_round(F.col("x"), n).alias(f"r{n}") for n in (2, 6)]).collect()
    want = [duckdb.connect().execute("SELECT round(?::DOUBLE, 2), round(?::DOUBLE, 6)", [x, x]).fetchall()[0] for x in values]
    assert [tuple(r) for r in got] == want


def test_beta_of_prices_of_zero(spark, folder):
    assert_same(spark, folder, "w17_w18_beta")


def test_extremes_of_prices_of_zero(spark, folder):
    assert_same(spark, folder, "w6_w7_extremes")


def test_log_returns_of_prices_of_zero(spark, folder):
    assert_same(spark, folder, "w1_w3_lags")


def test_income_that_ends_in_a_five(spark, tmp_path):
    """Outcomes of 0.005, 0.015, ... lie a little above or below the half cent."""
    df = pd.DataFrame({"event_id": [i * 7 + 1 for i in range(40)], "ts": [datetime(2024, 1, 1) + timedelta(hours=i) for i in range(40)], "user_id": range(40),
        "event_type": ["view", "click"] * 20, "value": [55.0 + 10 * (i % 30) for i in range(40)], "props": ['{"k": 1}'] * 40})
    duckdb.sql(f"COPY (SELECT * REPLACE (ts::TIMESTAMP AS ts) FROM df) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    assert_same(spark, str(tmp_path), "g12_weeks")


def test_span_sums_when_rows_come_in_another_order(spark):
    """Every run of the plan gives the spans in another order, as shuffles of a cluster do."""

    def shuffled(batches):
        for b in batches:
            yield b.sample(frac=1)

    spans = spark.range(0, 400, 1, 1).selectExpr("id % 4 AS k", "id AS a", "id + 1 + id % 7 AS b").mapInPandas(shuffled, "k long, a long, b long")
    flows = spark.range(0, 1600).selectExpr("id % 4 AS k", "id % 400 AS t", "CAST(id AS DOUBLE) AS v")
    of = lambda k, a, b: [i for i in range(1600) if i % 4 == k and a < i % 400 <= b]
    got = R.span_sums(spans, flows, "k", "a", "b", "t", "v").collect()
    assert len(got) == 400
    for r in got:
        closed = of(r.k, r.a, r.b)
        kept = [i for i in closed if i % 400 < r.b]
        assert (r.closed_n, r.open_n) == (len(closed), len(kept)) and abs(r.closed_sum - sum(closed)) < 1e-6 and abs(r.open_sum - sum(kept)) < 1e-6


@pytest.mark.parametrize("least, size, step, embargo", [(50, 20, 20, 6), (10, 8, 5, 0), (30, 10, 10, 400)])
def test_train_counts_equal_the_rows_left(spark, least, size, step, embargo):
    rng = random.Random(least)
    rows = [(t := rng.randrange(900), t + rng.randrange(60)) for _ in range(400)]
    x = spark.createDataFrame(rows, "t long, z long")
    folds, purged = L.event_purged_folds(x, "t", "z", least, size, step, embargo)
    gone = {r.fold: r["count"] for r in purged.groupBy("fold").count().collect()}
    got = L.event_train_counts(x, folds, "t", "z", embargo).collect()
    assert len(got) == folds.count() > 10
    for r in got:
        assert (r.n_purged, r.n_train) == (gone.get(r.fold, 0), r.n_before - gone.get(r.fold, 0))
        assert r.last_end == max((z for _, z in rows if z < r.a - embargo), default=None)


def test_event_folds_equal_their_sql(spark, folder):
    assert_same(spark, folder, "h7_event_purged_folds")


def test_orientation_orders_no_side_in_one_task(spark, folder):
    import re

    assert_same(spark, folder, "n15_orientation")
    plan = catalogue.QUERIES["n15_orientation"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    ordered = re.findall(r"windowspecdefinition\(([^()]*?)(?:proba|pnl|event_id)#\d+ ASC", plan)
    assert ordered and all("_range#" in partition for partition in ordered)


def test_chains_send_nothing_through_the_driver(spark):
    rows = [(i % 50, datetime(2024, 1, 1) + timedelta(minutes=37 * i)) for i in range(2000)]
    kept = L.cooldown(spark.createDataFrame(rows, "k long, ts timestamp"), "k", "ts", 5 * 24 * 3600)
    assert 0 < len(kept.collect()) < 2000
    plan = kept._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "LeftSemi" in line]
    assert joins and not any("Broadcast" in line for line in joins)


def test_small_members_are_parsed_together(spark, monkeypatch):
    """One parse for the members of a file that begin alike; a bad one among them is found alone."""
    import io
    import zipfile

    from panelia.sources import archives as Z

    texts = {f"m{i}.csv": f"t,x\n2024-01-01 00:00:0{i},{i}\n2024-01-02 00:00:0{i},\n" for i in range(5)}
    texts |= {"bad.csv": "t,x\n1,2,3\n", "quoted.csv": 't,x\n"2024-01-03 00:00:00",7\n', "other.csv": "x,t\n8,2024-01-04 00:00:00\n", "empty.csv": ""}
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for name, text in texts.items():
            archive.writestr(name, text)
    files = spark.createDataFrame([("a.zip", packed.getvalue())], "path string, content binary")
    got = Z.archive_rows(files, {"x": "value"}, "t").collect()
    assert sorted(r.member for r in got if r.error) == ["bad.csv", "empty.csv"]
    rows = sorted((r.member, str(r.t), r.value) for r in got if not r.error and r.value is not None)
    want = [(f"m{i}.csv", f"2024-01-01 00:00:0{i}", float(i)) for i in range(5)]
    assert rows == sorted([*want, ("quoted.csv", "2024-01-03 00:00:00", 7.0), ("other.csv", "2024-01-04 00:00:00", 8.0)]) and len(got) == 14
    seen = []
    run = Z.csv.read_csv
    monkeypatch.setattr(Z.csv, "read_csv", lambda *a, **k: seen.append(1) or run(*a, **k))

    class Files:
        """Runs the reader's function here."""

        def select(self, *names):
            return self

        def mapInArrow(self, function, schema):
            batch = Z.pa.RecordBatch.from_arrays([Z.pa.array(["b.zip"]), Z.pa.array([clean.getvalue()])], names=["path", "content"])
            self.rows = sum(map(len, function([batch])))
            raise StopIteration

    clean = io.BytesIO()
    with zipfile.ZipFile(clean, "w") as archive:
        for i in range(30):
            archive.writestr(f"m{i}.csv", texts["m1.csv"])
    files = Files()
    with pytest.raises(StopIteration):
        Z.archive_rows(files, {"x": "value"}, "t")
    assert files.rows == 60 and len(seen) == 1


def test_ridge_scores_equal_single_fits(spark):
    from pyspark.sql import functions as F

    from panelia.operators import models as M

    rng = random.Random(5)
    rows = [(i % 2, "test" if i % 5 == 0 else "train", rng.gauss(3, 1), rng.gauss(0, 9), rng.gauss(0, 1), rng.uniform(0.5, 2)) for i in range(400)]
    x = spark.createDataFrame(rows, "fold int, part string, a double, b double, y double, w double").withColumn("y", F.col("y") + F.col("a") / 2 - F.col("b") / 9)
    got = {(k, n, alpha): score for k, n, alpha, score in M.ridge_scores(x, "fold", [["a"], ["a", "b"]], "y", "w", [1.0, 500.0])}
    assert len(got) == 8
    for (k, n, alpha), score in got.items():
        own, names = x.filter(F.col("fold") == k), ["a", "b"][:n]
        scale, fitted = M.ridge(own.filter("part = 'train'"), names, "y", "w", alpha)
        scored = fitted.transform(M.assembled(M.scaled(own.filter("part = 'test'"), scale), names))
        assert score == pytest.approx(scored.agg(F.corr("prediction", "y")).first()[0], abs=1e-9)


def test_boosted_trees_read_a_stored_ledger(spark, monkeypatch):
    """The folds' plans read stored rows, not events."""
    from panelia.operators import models as M

    seen, run = [], M.boosted

    def boosted(train, test, *rest, **named):
        seen.extend(f for df in (train, test) for f in df.inputFiles())
        return run(train, test, *rest, **named)

    monkeypatch.setattr(M, "boosted", boosted)
    assert catalogue.QUERIES["m3_boosted_walk_forward"](spark, "/root/testdata/sf0.01").count() == 4
    assert seen and not any("events.parquet" in f for f in seen)
