"""Trade summaries, routes, admission and scorecards against plain Python."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from panelia.operators import decisions as D
from panelia.operators import trades as R

SF = "/root/testdata/sf0.001"


def test_trade_summary_against_loop(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("ab"), datetime(2024, 1, 1) + timedelta(hours=i), rng.choice([None, 0.01, -0.02, 0.03, 0.0])) for i in range(300)]
    rows += [(900, "wins", datetime(2024, 1, 1), 0.5), (901, "wins", datetime(2024, 1, 2), 0.1), (902, "flat", datetime(2024, 1, 1), 0.0), (903, "open", datetime(2024, 1, 1), None)]
    got = {r.g: r for r in R.trade_summary(spark.createDataFrame(rows, "event_id long, g string, ts timestamp, pnl double"), ["g"], "ts", "event_id").collect()}
    assert set(got) == {"a", "b", "wins", "flat"}
    for g, r in got.items():
        x = [p for _, k, _, p in rows if k == g and p is not None]
        won, lost = sum(p for p in x if p > 0), -sum(p for p in x if p < 0)
        total = peak = fall = 0.0
        peak = float("-inf")
        for p in x:
            total += p
            peak = max(peak, total)
            fall = min(fall, total - peak)
        assert r.n == len(x) and r.total == pytest.approx(sum(x)) and r.max_dd_bps == pytest.approx(fall * 1e4, abs=1e-3)
        assert r.profit_factor == (pytest.approx(won / lost, abs=1e-6) if lost else None)
        assert r.endless == (won > 0 and lost == 0) and r.profit_factor_99 == (99 if r.endless else r.profit_factor)


def test_routes_follow_the_first_rule(spark):
    cases = [
        ("x CANARY_MIRROR", "", "CANARY_MIRROR"), (None, "SHORT0_CANARY_MIRROR_2", "CANARY_MIRROR"), ("", "short0_canary_exact_bucket", "CANARY_EXACT_BUCKET"), ("mirror scout", None, "MIRROR_SHORT"),
        ("a SCOUT DISCOVERY", "", "SCOUT"), ("", "DISCOVERY_A", "DISCOVERY"), ("", "X_DISCOVERY_A", "UNKNOWN"), ("strict_symbol", "", "STRICT_PROMOTE"), ("", "PROMOTE_SYMBOL", "STRICT_PROMOTE"), (None, None, "UNKNOWN"),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, reason string, prior string, want string")
    assert [r.i for r in df.filter(R.route(F.col("reason"), F.col("prior")) != F.col("want")).collect()] == []


def test_admission_names_the_first_demand(spark):
    policy = [("a", "LIVE", 0.5, 0.6, 1.0, False, 10, 1.1, 3, 24.0, 0.1), ("p", "PAPER_ONLY", 0.1, 0.6, 0.5, True, 0, 0.0, 0, 0.0, 0.0), ("off", "DISABLED", 0.0, 1.0, 1.0, True, 0, 0.0, 0, 0.0, 0.0)]
    default = {"mode": "RESEARCH_ONLY", "min_proba": 1.01, "max_stop": 0.0, "size": 0.0, "unproven": False, "min_n": 0, "min_factor": 0.0, "min_days": 0, "max_age": 0.0, "max_fall": 0.0}
    proof = "route string, n long, profit_factor double, endless boolean, days long, age_hours double, drawdown double"
    one = lambda proofs, route, proba, risk, live: R.admitted(
        spark.createDataFrame([(route, proba, risk, live)], "route string, proba double, stop_risk double, live boolean"), spark.createDataFrame(proofs, proof), spark.createDataFrame(policy, R.POLICY), default).first()
    good = [("a", 20, 1.5, False, 5, 3.0, -0.05)]
    assert one(good, "a", 0.9, 0.2, True)[4:] == (True, "LIVE", "ROUTE_LIVE_APPROVED", 1.0)
    assert one(good, "a", 0.9, 0.2, False).reason == "ROUTE_PAPER_APPROVED"
    assert one(good, "a", 0.4, 0.2, True).reason == "ROUTE_PROBA_BLOCK:0.400<0.50"
    assert one([], "a", 0.9, 0.2, True).reason == "ROUTE_PROOF_WARMUP:0<10"
    assert one([("a", 20, 1.0, False, 5, 3.0, 0.0)], "a", 0.9, 0.2, True).reason == "ROUTE_PROOF_BLOCK:PF1.00<1.10"
    assert one([("a", 20, None, True, 1, 3.0, 0.0)], "a", 0.9, 0.2, True).reason == "ROUTE_DAY_DIVERSITY_BLOCK:1<3"
    assert one([("a", 20, None, False, 5, 3.0, 0.0)], "a", 0.9, 0.2, True).reason == "ROUTE_PROOF_BLOCK:PFnan<1.10"
    assert one([("a", 20, 1.5, False, 5, 30.0, 0.0)], "a", 0.9, 0.2, True).reason == "ROUTE_STALE_PROOF"
    assert one([("a", 20, 1.5, False, 5, 3.0, -0.2)], "a", 0.9, 0.2, True).reason == "ROUTE_DRAWDOWN_BLOCK:-0.2000<-0.1000"
    assert one(good, "a", 0.9, None, False).reason == "STOP_HIT_MODEL_UNAVAILABLE"
    assert one(good, "a", 0.9, 0.7, True).reason == "STOP_HIT_RISK_BLOCK:0.700>0.60"
    assert one(good, "p", 0.9, None, False)[4:] == (True, "PAPER_ONLY", "ROUTE_PAPER_APPROVED_MODEL_PENDING", 0.5)
    assert one(good, "p", 0.9, None, True).reason == "STOP_HIT_MODEL_UNAVAILABLE"
    assert one(good, "off", 0.9, 0.1, True).reason == "ROUTE_DISABLED" and one(good, "zzz", 0.9, 0.1, True).reason == "ROUTE_RESEARCH_ONLY"


@pytest.mark.parametrize(
    "days, value, want",
    [
        (59, 5.0, ("NOT-YET", False, None, "NOT-YET", date(2024, 3, 1))),
        (60, 5.0, ("PASS", False, None, "GO", None)),
        (60, -1.0, ("FAIL", False, date(2024, 3, 22), "NOT-YET", date(2024, 3, 22))),
        (89, None, ("FAIL", False, date(2024, 2, 22), "NOT-YET", date(2024, 3, 1))),
        (90, -1.0, ("FAIL", True, None, "NO-GO", date(2024, 3, 1))),
        (90, 1.0, ("PASS", False, None, "GO", None)),
    ],
)
def test_judged_and_verdict(spark, days, value, want):
    """A record whose last day is 2024-02-20, judged from 60 days on and again at 90, on 2024-03-01."""
    facts = spark.createDataFrame([(days, value, date(2024, 2, 20))], "days int, value double, last date")
    state, terminal, due = D.judged(F.col("value"), F.col("value") > 0, F.col("days"), 60, 90, F.col("last"))
    r = D.scorecard(facts, [D.condition("one", state, F.col("value"), terminal, due)], F.lit("2024-03-01")).first()
    assert (r.state, r.terminal, r.due, r.verdict, r.earliest) == want


def test_longest_run(spark):
    flags = [True, False, True, True, True, False, True, True]
    rows = spark.createDataFrame(list(enumerate(flags)), "t int, f boolean")
    assert tuple(D.longest_run(rows, "t", "f").first()) == (3, 2)
    assert tuple(D.longest_run(rows.filter("t <= 5"), "t", "f").first()) == (3, 0)
    assert tuple(D.longest_run(rows.limit(0), "t", "f").first()) == (0, 0)


def test_order_plan_keeps_its_limits(spark):
    """Chunks never exceed the cap unless they are one order of under two minimums, add up to whole
    quantities, and orders that reduce come first."""
    from panelia.plans import execution as E

    plan = E.order_plan(spark, SF).toPandas()
    assert {"close_orphan", "close_before_flip", "open_after_flip", "rebalance"} <= set(plan.reason)
    late = F.col("run") >= F.lit("1997-01-01").cast("date")
    f = E.T.fills(spark, SF).groupBy("part", late.alias("late")).agg(F.avg("price").alias("mark")).collect()
    early, later = ({r.part: r.mark for r in f if r.late == x and (not x or r.part % 5)} for x in (False, True))
    marks = early | later
    sent = plan[plan.quantity > 0]
    assert (sent.quantity % E.STEP == 0).all() and (sent.phase == (~sent.reduce_only).astype(int)).all()
    assert all(q * marks[p] <= 1.001 * E.MOST_NOTIONAL for p, q in zip(sent.part, sent.quantity))
    for _, g in plan.groupby(["part", "reason"]):
        assert sorted(g.chunk) == list(range(1, len(g) + 1)) and g.side.nunique(dropna=False) == 1
    closed, opened = (plan[plan.reason == r].groupby("part").side.first() for r in ("close_before_flip", "open_after_flip"))
    assert (closed.reindex(opened.index).dropna() == opened[closed.reindex(opened.index).notna()]).all()
