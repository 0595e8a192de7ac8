"""Properties: no look-ahead, invariants of weights, loops against window forms, streams."""

import random
from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelia.functions import series as S
from panelia.operators import accounting as A
from panelia.operators import cross as X
from panelia.operators import inference as N
from panelia.operators import joins as J
from panelia.operators import labels as L
from panelia.operators import models as M
from panelia.operators import ranges as R
from panelia.operators import states
from panelia.sources import tables as B
from panelia.streaming import streams as W

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(3)
    rows = []
    for s in range(12):
        price, flow = 100.0, 0.0
        for k in range(60):
            flow = 0.9 * flow + rng.normal(0, 0.0004)
            price *= 1 + rng.normal(-3 * flow, 0.03)
            rows.append((s, date(2024, 1, 1) + timedelta(k), float(price), float(price * 1.01), float(price * 0.99), 0.0 if (s, k) == (3, 30) else 10.0, float(flow)))
    return spark.createDataFrame(rows, "symbol long, day date, close double, high double, low double, volume double, rate double")


def weights(panel):
    full = A.panel_with_cash(panel.drop("rate"), panel.select("symbol", "day", "rate"), X.skeleton)
    return X.tail_weights(full.withColumn("signal", S.rolling(F.col("cash"), 7, 7, S.over(), F.sum)), "signal", 0.2, -1)


def test_no_look_ahead(panel):
    cut = F.lit(date(2024, 2, 10))
    shock = panel.withColumn("rate", F.when(F.col("day") > cut, F.col("rate") * -7 + 1).otherwise(F.col("rate"))).withColumn("close", F.when(F.col("day") > cut, F.col("close") * 3).otherwise(F.col("close")))
    a, b = (weights(p).filter(F.col("day") <= cut).select("symbol", "day", "weight") for p in (panel, shock))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_weights_gross_one_net_zero(panel):
    w = weights(panel)
    d = w.groupBy("day").agg(F.sum("weight").alias("net"), F.sum(F.abs("weight")).alias("gross")).collect()
    assert all(abs(r.net) < 1e-9 and (abs(r.gross - 1) < 1e-9 or r.gross == 0) for r in d)
    dead = A.account(w, 0.0).filter("day = DATE '2024-01-31'").collect()[0]
    assert dead.gross <= 1 + 1e-9


def test_legs_add_up(panel):
    w = weights(panel)
    total = A.account(w, 0.001).agg(F.sum("net")).first()[0]
    legs = A.legs(w, 0.001).agg(F.sum(F.col("price") + F.col("funding") - F.col("cost"))).first()[0]
    assert abs(total - legs) < 1e-9


def test_average_rank_equals_pandas(spark):
    rng = random.Random(1)
    rows = [(d, rng.choice([None, 1.0, 2.0, 2.5, rng.random()])) for d in range(6) for _ in range(30)]
    got = spark.createDataFrame(rows, "day int, x double").withColumn("r", S.average_rank(F.col("x"), "day")).toPandas()
    want = got.groupby("day").x.rank(pct=True)
    assert np.allclose(got.r, want, equal_nan=True, atol=0)


def test_exponential_means(panel):
    got = states.exponential_means(panel.select("symbol", "day", "close"), "symbol", "day", "close", (3, 20), chunk=7).toPandas().sort_values(["symbol", "day"])
    for s in (3, 20):
        want = got.groupby("symbol").close.transform(lambda x: x.ewm(span=s, adjust=False).mean())
        assert np.allclose(got[f"ema{s}"], want, rtol=1e-12)


def loop_hysteresis(ranks, q, h, eps=1e-9):
    side, out = 0, []
    for r in ranks:
        if r is None or r != r:
            side = 0
        else:
            if side == 1 and r < 1 - q - h - eps or side == -1 and r > q + h + eps:
                side = 0
            if r >= 1 - q - eps:
                side = 1
            elif r <= q + eps:
                side = -1
        out.append(side)
    return out


def test_hysteresis_and_zero_band(spark):
    rng = random.Random(2)
    rows = [(s, t, None if rng.random() < 0.05 else rng.random()) for s in range(20) for t in range(80)]
    df = spark.createDataFrame(rows, "symbol int, day int, rank double")
    for h in (0.0, 0.15):
        got = states.hysteresis(df, "symbol", "day", "rank", 0.2, h).toPandas().sort_values(["symbol", "day"])
        want = [x for _, g in got.groupby("symbol") for x in loop_hysteresis(g["rank"].tolist(), 0.2, h)]
        assert got.side.tolist() == want
    zero = states.delayed_exit(df, "symbol", "day", "rank", 0.2, 0).toPandas().sort_values(["symbol", "day"])
    assert zero.side.tolist() == [1 if r >= 0.8 - 1e-9 else -1 if r <= 0.2 + 1e-9 else 0 for r in zero["rank"]]


def test_asof_equals_merge_asof(spark):
    rng = random.Random(4)
    left = pd.DataFrame([(rng.randrange(4), rng.randrange(200)) for _ in range(150)], columns=["k", "t"])
    right = pd.DataFrame({"k": [rng.randrange(4) for _ in range(60)], "t": rng.sample(range(200), 60)})
    right["v"] = range(60)
    got = J.asof(spark.createDataFrame(left, "k int, t long"), spark.createDataFrame(right, "k int, t long, v int"), "k", "t", ["v"]).toPandas()
    want = pd.merge_asof(left.sort_values("t"), right.sort_values("t"), on="t", by="k")
    a = sorted((r.k, r.t, -1 if pd.isna(r.v) else int(r.v)) for r in got.itertuples())
    assert a == sorted((r.k, r.t, -1 if pd.isna(r.v) else int(r.v)) for r in want.itertuples())


def test_interval_ends_are_strict(spark):
    at = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    spans = spark.createDataFrame([(1, at(0), at(8))], "k int, a timestamp, b timestamp")
    flows = spark.createDataFrame([(1, at(0), 1.0), (1, at(4), 10.0), (1, at(8), 100.0)], "k int, t timestamp, v double")
    met = R.span_sums(spans, flows, "k", "a", "b", "t", "v").first()
    assert (met.open_sum, met.open_n, met.closed_sum, met.closed_n) == (10, 1, 110, 2)


def test_greedy_selection_against_loop(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(5), datetime(2024, 1, 1) + timedelta(seconds=rng.randrange(100_000))) for _ in range(400)]
    got = L.cooldown(spark.createDataFrame(rows, "symbol int, ts timestamp"), "symbol", "ts", 1800).toPandas()
    want = []
    for s in range(5):
        free = None
        for t in sorted(t for k, t in rows if k == s):
            if free is None or t >= free:
                want.append((s, t))
                free = t + timedelta(seconds=1800)
    assert sorted((r.symbol, r.ts.to_pydatetime().replace(tzinfo=None)) for r in got.itertuples()) == sorted(want)


def test_folds_do_not_leak(panel):
    t = L.first_touch(panel, 5, 0.02, 0.03, 0.001).filter("long_ret IS NOT NULL")
    f = L.purged_folds(t, L.fold_table(t, 4, "day"), "day", "long_end", 1)
    bad = f.filter("part = 'train'").filter("long_end >= date_sub(a, 1)")
    assert bad.isEmpty() and f.filter("part = 'purged'").count() > 0


def test_donors_are_permutations(panel):
    d = N.donor_map(panel, 5, "s").toPandas()
    assert all(sorted(g.donor) == sorted(g.symbol) == list(range(12)) for _, g in d.groupby("draw"))


def test_ridge_closed_form(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 2))
    y = x @ [0.5, -1.0] + rng.normal(size=200)
    w = rng.uniform(0.5, 1.5, 200)
    df = spark.createDataFrame([(float(a), float(b), float(c), float(d)) for (a, b), c, d in zip(x, y, w)], "a double, b double, y double, w double")
    _, fitted = M.ridge(df, ["a", "b"], "y", "w", 50.0)
    z = (x - x.mean(0)) / x.std(0)
    wn = w / w.mean()
    zc, yc = z - np.average(z, axis=0, weights=wn), y - np.average(y, weights=wn)
    want = np.linalg.solve((zc * wn[:, None]).T @ zc + 50.0 * np.eye(2), (zc * wn[:, None]).T @ yc)
    assert np.allclose(fitted.coefficients.toArray(), want, rtol=1e-6)


def test_books_and_conflicts(spark):
    b = spark.createDataFrame([(1, "a, b,", "c"), (2, "", None)], "day int, longs string, shorts string")
    rows = {(r.day, r.symbol): r.weight for r in B.book_rows(b, "day", "longs", "shorts").collect()}
    assert rows == {(1, "a"): 0.25, (1, "b"): 0.25, (1, "c"): -0.5}
    x = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 3.0), (2, 3.0)], "k int, v double")
    assert [r.k for r in B.conflicts(x, ["k"], "v").collect()] == [1]


def test_sampled_stream_equals_batch(spark):
    from panelia.plans import catalogue

    got = {r.symbol: r.n_kept for r in catalogue.QUERIES["t1_sampled_stream"](spark, SF).collect()}
    want = {r.symbol: r.n_kept for r in catalogue.QUERIES["h8_h9_cooldown"](spark, SF).collect()}
    assert got == want


def test_append_once(spark):
    from panelia.plans import catalogue

    assert all(r.n_once == r.n_rotated for r in catalogue.QUERIES["t5_t8_append_once"](spark, SF).collect())


def test_tumbling_stream_is_part_of_batch(spark):
    from panelia.plans import catalogue

    stream = set(catalogue.QUERIES["t6_tumbling_stream"](spark, SF).collect())
    batch = set(catalogue.QUERIES["t6_tumbling"](spark, SF).collect())
    assert stream <= batch and len(stream) > 0.9 * len(batch)


def test_rest_imports_without_text_operators(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "panelia", tmp_path / "panelia", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert e.oracle_sql() and not any(k.startswith('op') or k == 'pipeline' for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})


def test_exit_replay_against_a_loop(spark):
    """Every profile and side on random paths, bar by bar with prices."""
    import random

    from panelia.operators import labels
    from panelia.plans.labels import PROFILES

    rng = random.Random(3)
    rows = []
    for i in range(400):
        path, price = [], 100.0
        for _ in range(6):
            a, price = price, price * (1 + rng.uniform(-0.35, 0.4))
            path.append((max(a, price) * (1 + rng.uniform(0, 0.2)), min(a, price) * (1 - rng.uniform(0, 0.2)), price))
        rows.append((i, rng.choice([1, -1]), 100.0, path, *PROFILES[i % len(PROFILES)]))
    schema = "i int, side int, entry double, path array<struct<high: double, low: double, close: double>>, " + labels.PROFILE
    got = {r.i: (r.reason, r.pnl, r.bars_held, r.mfe, r.mae) for r in labels.exit_replay(spark.createDataFrame(rows, schema), 0.001).collect()}
    seen = set()
    for i, side, entry, path, _, stop, target, share, runner, trail, even, wait, trigger in rows:
        gain = lambda p: side * (p - entry) / entry
        level, best, first, mfe, mae, out = entry * (1 - side * stop), entry, None, 0.0, 0.0, None
        tighter = lambda *p: max(p) if side > 0 else min(p)
        for n, (high, low, close) in enumerate(path, 1):
            good, bad = (high, low) if side > 0 else (low, high)
            mfe, mae = max(mfe, gain(good)), min(mae, gain(bad))
            if gain(bad) <= gain(level) + 1e-12:
                out = ("TP1_TRAIL_STOP", share * target + (1 - share) * gain(level)) if first else ("SL_OR_TRAIL", gain(level))
            elif first and gain(good) >= target * runner:
                out = "TP1_RUNNER_TP", share * target + (1 - share) * target * runner
            if out:
                break
            best = tighter(best, good)
            if not first and gain(good) >= target:
                first, level = n, tighter(level, entry * (1 + side * even))
                trails = wait <= 0
            elif first:
                trails = n - first >= wait
            else:
                trails = trigger is not None and gain(best) >= trigger
            if trails:
                level = tighter(level, entry * (1 + side * even), best * (1 - side * trail))
        if not out:
            out = ("TP1_TIME", share * target + (1 - share) * gain(path[-1][2])) if first else ("OPEN", None)
        seen.add(out[0])
        reason, pnl, held, up, down = got[i]
        assert (reason, held) == (out[0], n) and abs(up - mfe) < 1e-9 and abs(down - mae) < 1e-9
        assert pnl is None if out[1] is None else abs(pnl - (out[1] - 0.001)) < 1e-9
    assert len(seen) == 5
