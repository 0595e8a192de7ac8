"""Split scans, chains, folds, refits, entries, archives and sinks against loops and plain windows."""

import io
import os
import random
import zipfile
from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelia.operators import joins as J
from panelia.operators import labels as L
from panelia.operators import ranges as R
from panelia.operators import refits as M
from panelia.sources import archives as Z
from panelia.sources import storage as Y
from panelia.sources.storage import discard_scratch, scratch, scratch_root, stored
from panelia.streaming import streams as W


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def hot(spark):
    """4,000 rows of which one key holds half; equal times, nulls."""
    rng = random.Random(1)
    rows = [(i, 0 if i % 2 else rng.randrange(1, 9), rng.randrange(3000), rng.choice([None, round(rng.gauss(0, 1), 6)])) for i in range(4000)]
    return spark.createDataFrame(rows, "id long, k long, t long, v double").repartition(3)


def test_a_hot_key_is_split_in_order(hot):
    cut = R.split_ranges(hot, "k", "t").filter("k = 0").groupBy("_range").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count("*").alias("n")).orderBy("_range").collect()
    assert len(cut) > 200 and max(r.n for r in cut) < 40
    assert all(x.b < y.a for x, y in zip(cut, cut[1:]))


def test_running_equals_windows(hot):
    scans = {"last": ("last", F.col("v")), "most": ("max", F.col("v")), "least": ("min", F.col("v")), "n": ("count", F.col("v")), "total": ("sum", F.col("v")), "grown": ("product", 1 + F.col("v") / 100)}
    got = R.running(hot, "k", "t", scans, "id").toPandas().set_index("id").sort_index()
    w = Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    plain = {"last": F.last("v", ignorenulls=True), "most": F.max("v"), "least": F.min("v"), "n": F.count("v"), "total": F.sum("v"), "grown": F.product(1 + F.col("v") / 100)}
    want = hot.withColumns({c: x.over(w) for c, x in plain.items()}).toPandas().set_index("id").sort_index()
    for c in scans:
        assert np.allclose(got[c], want[c], rtol=1e-9, atol=1e-12, equal_nan=True), c
    assert R.running(hot.limit(0), "k", "t", scans).count() == 0


def test_split_asof_equals_asof(hot):
    left, right = hot.filter("id % 3 = 0").select("id", "k", "t"), hot.filter("id % 3 = 1").dropDuplicates(["k", "t"]).select("k", "t", "v")
    assert rows_of(R.asof_split(left, right, "k", "t", ["v"])) == rows_of(J.asof(left, right, "k", "t", ["v"]))


def test_span_sums(spark, hot):
    rng = random.Random(2)
    spans = [(i, rng.randrange(10), a := rng.randrange(3000), a + rng.randrange(-2, 3000)) for i in range(300)]
    spans += [(900, 0, 5, 5), (901, 77, 0, 9), (902, 0, -10**9, 10**9)]  # empty, unknown key, a span of many years
    flows = [(r.k, r.t, r.v) for r in hot.collect()]
    got = {r.id: r for r in R.span_sums(spark.createDataFrame(spans, "id long, k long, a long, b long"), hot.select("k", "t", "v"), "k", "a", "b", "t", "v").collect()}
    assert len(got) == len(spans)
    for i, k, a, b in spans:
        inside = lambda end: [v for x, t, v in flows if x == k and a < t and (t <= b if end else t < b) and a < b and v is not None]  # noqa: B023, E731
        for end, name in ((False, "open"), (True, "closed")):
            assert got[i][f"{name}_n"] == len(inside(end)) and abs(got[i][f"{name}_sum"] - sum(inside(end))) < 1e-9


def test_chain_of_a_million_rows_of_one_key(spark):
    at = F.expr("TIMESTAMP_SECONDS(id * 37 % 1000003)")
    rows = spark.range(1_000_000).select("id", F.lit(1).alias("k"), at.alias("a"), (F.unix_seconds(at) + 40 + F.col("id") % 100).alias("z")).withColumn("z", F.timestamp_seconds("z"))
    kept = R.chain_of(rows, "k", "a", "z")
    assert "Python" not in kept._jdf.queryExecution().toString()
    ids = np.arange(1_000_000)
    a = ids * 37 % 1_000_003
    order, free, want = np.argsort(a), -1, []
    z = a + 40 + ids % 100
    for i in order.tolist():
        if a[i] >= free:
            want.append(i)
            free = z[i]
    assert sorted(r.id for r in kept.select("id").collect()) == sorted(want)


def test_chain_with_ties_and_empty_spans(spark):
    rng = random.Random(3)
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    rows = [(i, rng.randrange(4), at(x := rng.randrange(300)), at(x + rng.choice([0, 0, 5, 40]))) for i in range(400)] + [(900, None, at(1), at(2)), (901, 1, None, at(2))]
    got = R.chain_of(spark.createDataFrame(rows, "id long, k long, a timestamp, z timestamp"), "k", "a", "z").collect()
    for k in range(4):
        free, want = None, []
        for a, z in sorted((a, z) for _, key, a, z in rows if key == k and a):
            if free is None or a >= free:
                want.append((a, z))
                free = z
        assert sorted((r.a, r.z) for r in got if r.k == k) == want
    assert {r.id for r in got}.isdisjoint({900, 901})


@pytest.mark.parametrize("least, size, step, embargo", [(50, 20, 20, 60), (10, 15, 5, 0), (5, 4, 9, 500)])
def test_event_purged_folds(spark, least, size, step, embargo):
    rng = random.Random(size)
    rows = sorted((rng.randrange(5000), i) for i in range(173))
    rows = [(i, t, t + rng.choice([0, 10, 300, 2500])) for t, i in rows]
    folds, purged = L.event_purged_folds(spark.createDataFrame(rows, "id long, t long, z long"), "t", "z", least, size, step, embargo)
    order = sorted((t, z) for _, t, z in rows)
    want, out = {}, {}
    for fold in range(200):
        start = least + fold * step
        if start + size > len(order):
            break
        block = order[start : start + size]
        a, b = min(t for t, _ in block), max(z for _, z in block)
        want[fold] = (a, b, size, start)
        out[fold] = sorted(p for p, (t, z) in enumerate(order[:start]) if not (z < a - embargo or t > b + embargo))
    assert {r.fold: (r.a, r.b, r.n_test, r.n_before) for r in folds.collect()} == want
    got = {f: [] for f in want}
    for r in purged.collect():
        got[r.fold].append(r.place)
    assert {f: sorted(x) for f, x in got.items()} == out
    # no train row's outcome reaches into a test block
    for f, (a, _, _, start) in want.items():
        assert all(order[p][1] < a - embargo for p in range(start) if p not in set(got[f]))


def test_ridges_equal_numpy(spark):
    rng = np.random.default_rng(4)
    rows = [(int(g), *map(float, x), float(x @ [1, -2, 0.5] + g + rng.normal())) for g in range(5) for x in rng.normal(size=(40, 3))]
    df = spark.createDataFrame([*rows, (0, None, 1.0, 1.0, 1.0)], "g long, a double, b double, c double, y double")
    fits = M.ridges(M.grams(df, ["g"], ["a", "b", "c"], "y"), ["g"], 3, 2.5).collect()
    assert len(fits) == 5
    for f in fits:
        m = np.array([r[1:] for r in rows if r[0] == f.g])
        x, y = m[:, :3] - m[:, :3].mean(axis=0), m[:, 3] - m[:, 3].mean()
        slopes = np.linalg.solve(x.T @ x + 2.5 * np.eye(3), x.T @ y)
        assert np.allclose(f.slopes, slopes) and np.isclose(f.intercept, m[:, 3].mean() - slopes @ m[:, :3].mean(axis=0)) and f.n == 40


def test_block_shuffle_keeps_blocks(spark):
    rows = [(s, i, float(100 * s + i)) for s in range(3) for i in range(29)]
    got = M.block_shuffled(spark.createDataFrame(rows, "s long, n long, v double"), "s", "n", "v", 12, 6, "x").toPandas()
    for (draw, s), g in got.groupby(["draw", "s"]):
        values = g.sort_values("n").shuffled.to_numpy() - 100 * s
        assert sorted(g.n) == list(range(29)) and sorted(values) == list(range(29))
        jumps = [b for a, b in zip(values, values[1:]) if b != a + 1]
        assert all(x % 12 == 0 for x in [values[0], *jumps])
        assert draw >= 0 or list(values) == list(range(29))
    assert len({tuple(g.sort_values("n").shuffled) for _, g in got[got.s == 0].groupby("draw")}) > 2


@pytest.fixture(scope="module")
def bars(spark):
    rng = random.Random(7)
    rows = []
    for s in range(3):
        c = 100.0
        for i in range(40):
            o, c = c, c * (1 + rng.gauss(0, 0.03))
            rows.append((s, date(2024, 1, 1) + timedelta(i), o, max(o, c) * (1 + rng.random() / 50), min(o, c) * (1 - rng.random() / 50), c, 0.02 + rng.random() / 50))
    return rows, spark.createDataFrame(rows, "symbol long, day date, open double, high double, low double, close double, atr double")


def loop_exit(path, entry, stop, target, side):
    for h, l, _ in path:
        if (l <= stop if side > 0 else h >= stop):
            return stop
        if (h >= target if side > 0 else l <= target):
            return target
    return path[-1][2]


def test_touch_grid_against_loop(bars):
    rows, df = bars
    cells = [(1, 0.02, 0.03), (3, 0.02, 0.02), (6, 0.05, 0.04)]
    got = {(r.symbol, r.day, r.horizon, r.stop): (r.long_gross, r.short_gross, r.end) for r in M.touch_grid(df, "symbol", "day", cells).collect()}
    count = 0
    for s in range(3):
        mine = [r for r in rows if r[0] == s]
        for i, (_, day, _, _, _, c, _) in enumerate(mine):
            for h, stop, target in cells:
                if i + h < len(mine):
                    path = [(x[3], x[4], x[5]) for x in mine[i + 1 : i + 1 + h]]
                    want = [side * (loop_exit(path, c, c * (1 - side * stop), c * (1 + side * target), side) / c - 1) for side in (1, -1)]
                    assert np.allclose(got[s, day, h, stop][:2], want) and got[s, day, h, stop][2] == mine[i + h][1]
                    count += 1
    assert count == len(got)


def test_resting_entries_against_loop(bars):
    rows, df = bars
    waits, n, stop, target, offset, slip, fees = [1, 3], 5, 1.0, 1.5, 0.01, 0.0005, (0.0002, 0.0005)
    ahead = Window.partitionBy("symbol").orderBy("day").rowsBetween(1, 3 + n)
    signals = df.withColumn("path", F.collect_list(F.struct("high", "low", "close")).over(ahead)).withColumn("side", F.explode(F.array(F.lit(1), F.lit(-1))))
    entries = L.resting_entries(signals, waits, n, stop, target, offset, slip, fees)
    got = {(r.symbol, r.day, r.side, r.wait): (r.filled, r.ret) for r in entries.collect()}
    want = {}
    for s in range(3):
        mine = [r for r in rows if r[0] == s]
        for i, (_, day, _, _, _, c, atr) in enumerate(mine):
            if i + n >= len(mine):
                continue
            for side in (1, -1):
                value = lambda entry, path, fee: side * (loop_exit(path, entry, entry * (1 - side * atr * stop), entry * (1 + side * atr * target), side) * (1 - side * slip) - entry) / entry - fee - fees[1]  # noqa: B023, E731
                bar = lambda a, b: [(x[3], x[4], x[5]) for x in mine[a:b]]  # noqa: B023, E731
                at_once = value(c * (1 + side * slip), bar(i + 1, i + 1 + n), fees[1])
                want[s, day, side, 0] = True, at_once
                limit = c * (1 - side * offset)
                for wait in waits:
                    at = next((j for j in range(i + 1, min(i + 1 + wait, len(mine))) if (mine[j][4] <= limit if side > 0 else mine[j][3] >= limit)), None)
                    if at is None:
                        want[s, day, side, wait] = False, at_once
                    elif at + n < len(mine):
                        want[s, day, side, wait] = True, value(limit, bar(at, at + n + 1), fees[0])
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-12 for k in want)
    assert {f for f, _ in got.values()} == {True, False}


def test_circular_sums_of_a_long_series(spark):
    n, rng = 100_000, np.random.default_rng(5)
    w, r = rng.normal(size=(2, n)), rng.normal(size=(2, n))
    pdf = pd.concat([pd.DataFrame({"s": s, "i": np.arange(n), "n": n, "w": w[s], "r": r[s]}) for s in (0, 1)])
    got = M.circular_sums(spark.createDataFrame(pdf), "s", "i", "n", "w", "r").toPandas().set_index("shift").total
    assert len(got) == n
    for shift in (0, 1, 14, 777, 50_000, 99_999):
        assert np.isclose(got[shift], sum((w[s] * np.roll(r[s], shift)).sum() for s in (0, 1)), atol=1e-7)


def test_gap_stream_however_it_is_cut(spark):
    """The same messages in one, in four and in fifteen batches, against a loop."""
    rng = random.Random(6)
    hour = 3_600_000_000
    rows = sorted((int(rng.random() ** 2 * 900) * hour + i, rng.choice("aab")) for i in range(120)) + [(1000 * hour, "a"), (1030 * hour, "c")]
    want, end = set(), 1030 * hour // 1000 - 1000
    for key in "abc":
        mine = [t for t, k in rows if k == key]
        gaps = [(t, i + 1) for i, t in enumerate(mine) if (mine[i + 1] - t > 24 * hour if i + 1 < len(mine) else (t + 24 * hour) // 1000 + 1 < end)]
        want |= {(key, t, n, k + 1) for k, (t, n) in enumerate(gaps)} | {(key, None, len(mine), len(gaps))}
    assert sum(x[1] is not None for x in want) > 5
    for parts in (1, 4, 15):
        path = scratch(spark, "gaps")
        for k in range(parts):
            part = rows[len(rows) * k // parts : len(rows) * (k + 1) // parts]
            spark.createDataFrame(part, "us long, key string").coalesce(1).write.mode("append").json(f"{path}/in")
        stream = spark.readStream.schema("us long, key string").option("maxFilesPerTrigger", 1).json(f"{path}/in").withColumn("at", F.timestamp_micros("us"))
        g = W.gap_events(stream, "key", "at", 24 * hour, "1 second")
        g.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
        out = spark.read.schema(W.GAPS).parquet(f"{path}/out").collect()
        got = {(r.key, r.last, r.n_messages, r.n_gaps) for r in out if r.gap}
        assert len(got) == sum(r.gap for r in out)
        got |= {(k, None, max(r.n_messages for r in out if r.key == k), max(r.n_gaps for r in out if r.key == k)) for k in "abc"}
        assert got == want, parts


def zipped(members, cut=None):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members.items():
            z.writestr(name, text)
    return bytearray(out.getvalue()[:cut])


def test_archives_report_bad_members(spark):
    good = "create_time,a,b\n2024-01-01 00:05:00,1.5,x\nno time,nan,2\n"
    long = "create_time,a,b\n" + "2024-01-01 00:05:00,1,2\n" * 200_000
    files = [("1", zipped({"m.csv": good, "other.csv": "create_time,b\n2024-01-02 00:00:00,7\n"})), ("2", zipped({"long.csv": long})), ("3", bytearray(b"no zip")), ("4", zipped({"m.csv": good}, -30)),
             ("5", zipped({"torn.csv": good + "1,2\n", "fine.csv": good})), ("6", zipped({"empty.csv": ""}))]
    df = spark.createDataFrame(files, "path string, content binary")
    got = Z.archive_rows(df, {"a": "alpha", "b": "beta"}, "create_time").collect()
    of = lambda p: [(r.member, r.create_time and str(r.create_time), r.alpha, r.beta) for r in got if r.path == p and r.error is None]
    assert sorted(of("1"), key=str) == sorted([("m.csv", "2024-01-01 00:05:00", 1.5, None), ("m.csv", None, None, 2.0), ("other.csv", "2024-01-02 00:00:00", None, 7.0)], key=str)
    assert len(of("2")) == 200_000
    faults = {(r.path, r.member) for r in got if r.error is not None}
    assert faults == {("3", None), ("4", None), ("5", "torn.csv"), ("6", "empty.csv")}
    assert {m for m, *_ in of("5")} >= {"fine.csv"}


def test_keyed_sink_leaves_other_partitions(spark):
    path = scratch(spark, "sink")
    day = lambda k: date(2024, 1, k)
    schema = "symbol long, close double, day date"
    upsert = lambda rows: Y.upsert_partitions(spark.createDataFrame(rows, schema), path, ["symbol", "day"], "day")
    upsert([(s, float(s + k), day(k)) for s in range(5) for k in (1, 2, 3)])
    files = lambda k: {(f, os.stat(f"{path}/day=2024-01-0{k}/{f}").st_mtime_ns) for f in os.listdir(f"{path}/day=2024-01-0{k}")}
    before = {k: files(k) for k in (1, 2, 3)}
    batch = [(0, -1.0, day(2)), (9, -2.0, day(2)), (9, -3.0, day(4))]
    want = {(s, float(s + k), day(k)) for s in range(5) for k in (1, 2, 3)} - {(0, 2.0, day(2))} | set(batch)
    for _ in range(2):  # a batch may be replayed
        upsert(batch)
        assert {tuple(r) for r in spark.read.schema(schema).parquet(path).collect()} == want
    assert files(1) == before[1] and files(3) == before[3] and files(2) != before[2]
    ends = Y.stale_tails(spark.read.schema(schema).parquet(path), "symbol", "day", F.expr("TIMESTAMP '2024-01-04 12:00:00'"))
    assert {r.symbol: r.stale for r in ends.collect()} == {**dict.fromkeys(range(5), True), 9: False}


def test_scratch_can_be_discarded(spark):
    kept = stored(spark.range(5), "numbers")
    assert kept.count() == 5 and os.path.isdir(scratch_root(spark).removeprefix("file:"))
    discard_scratch(spark)
    assert not os.path.exists(scratch_root(spark).removeprefix("file:"))
    assert stored(spark.range(3), "numbers").count() == 3
