"""Queries of scorecards and nominations (survey N17, N18)."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelia.functions import series as S
from panelia.operators import accounting as A
from panelia.operators import decisions as D
from panelia.plans.accounting import COST, NAMES, WEEK, week_panel
from panelia.plans.inference import live
from panelia.plans.registry import query
from panelia.sources import stand_ins as T

#: Limits of the scorecard: periods of record, Sharpe, total, drawdown, staleness, runs, weekly divergence, fills, months.
TODAY, LEAST, EXTENDED, SHARPE, TOTAL, FALL, STALE = "1998-12-20", 60, 90, 0.3, 0.0, -25.0, 14
RUNS, DIVERGENCE, WEEKS, FILL_BPS, MONTHS = 30, 0.4, 3, 10.0, 3


@query("n18_gate_scorecard", T.with_sql(NAMES + " fill", WEEK + f"""
, eq AS (SELECT *, product(1 + net) OVER (ORDER BY day) AS e FROM live), pk AS (SELECT *, greatest(max(e) OVER (ORDER BY day), 1) AS pk FROM eq)
, pa AS (SELECT count(*) AS n, avg(net) / nullif(stddev_samp(net), 0) * sqrt(52) AS sharpe, (arg_max(e, day) - 1) * 100 AS total, least(min(e / pk - 1), 0) * 100 AS fall, max(day) AS last FROM pk)
, rn AS (SELECT o_orderdate::DATE AS day, CASE WHEN bool_or(o_orderstatus = 'P') THEN 'MISMATCH' WHEN bool_and(o_orderstatus = 'F') THEN 'COMPLETE' ELSE 'PARTIAL' END AS st, count(*) FILTER (o_orderkey % 5000 = 1) AS bad FROM orders GROUP BY 1)
, ru AS (SELECT count(*) FILTER (st = 'COMPLETE') AS n_complete, arg_max(st, day) = 'MISMATCH' AS exposed, count(*) FILTER (st = 'COMPLETE' AND bad > 0) AS n_bad FROM rn)
, wk AS (SELECT day, abs(net - price) * 100 > {DIVERGENCE} AS breach, row_number() OVER (ORDER BY day) AS n, count(*) OVER () AS tot FROM live)
, ws AS (SELECT *, n - coalesce(max(CASE WHEN NOT breach THEN n END) OVER (ORDER BY n), 0) AS run FROM wk), tr AS (SELECT coalesce(max(run), 0) AS longest, coalesce(max(CASE WHEN n = tot THEN run END), 0) AS current FROM ws)
, fl AS (SELECT avg((CASE side WHEN 'BUY' THEN 1 ELSE -1 END) * (price / reference - 1)) * 1e4 AS bps, count(*) AS n_fills FROM fill)
, mo AS (SELECT date_trunc('month', day)::DATE AS m, avg(net) AS a, avg(net) - avg(price) AS gap FROM live GROUP BY 1), ml AS (SELECT *, row_number() OVER (ORDER BY m DESC) AS r FROM mo)
, ca AS (SELECT max(m) AS newest, count(*) FILTER (r <= {MONTHS} AND a < 0) AS alerts, count(*) FILTER (r <= {MONTHS} AND gap < 0) AS inverted, max(CASE WHEN r = 1 THEN gap END) AS gap FROM ml)
, inc AS (SELECT count(*) FILTER (o_orderpriority = '1-URGENT' AND o_orderstatus = 'P') AS n_open, count(*) FILTER (p_retailprice <= 0) AS n_marks FROM orders FULL JOIN (SELECT p_retailprice FROM part WHERE p_retailprice <= 0) ON false)
, f AS (SELECT *, DATE '{TODAY}' AS today FROM pa, ru, tr, fl, ca, inc)
, c AS (
  SELECT 'paper days' AS condition, CASE WHEN n >= {LEAST} THEN 'PASS' ELSE 'NOT-YET' END AS state, n::DOUBLE AS measured, false AS terminal, CASE WHEN n < {LEAST} THEN last + ({LEAST} - n + 1)::INT END AS due, today FROM f
  UNION ALL SELECT 'paper Sharpe', CASE WHEN n < {LEAST} THEN 'NOT-YET' WHEN coalesce(sharpe > {SHARPE}, false) THEN 'PASS' ELSE 'FAIL' END, round(sharpe, 6), n >= {EXTENDED} AND NOT coalesce(sharpe > {SHARPE}, false),
    CASE WHEN n >= {LEAST} AND n < {EXTENDED} AND NOT coalesce(sharpe > {SHARPE}, false) THEN last + ({EXTENDED} - n + 1)::INT END, today FROM f
  UNION ALL SELECT 'paper total return', CASE WHEN n < {LEAST} THEN 'NOT-YET' WHEN coalesce(total > {TOTAL}, false) THEN 'PASS' ELSE 'FAIL' END, round(total, 6), n >= {EXTENDED} AND NOT coalesce(total > {TOTAL}, false),
    CASE WHEN n >= {LEAST} AND n < {EXTENDED} AND NOT coalesce(total > {TOTAL}, false) THEN last + ({EXTENDED} - n + 1)::INT END, today FROM f
  UNION ALL SELECT 'paper max drawdown', CASE WHEN fall <= {FALL} THEN 'FAIL' ELSE 'PASS' END, round(fall, 6), fall <= {FALL}, NULL, today FROM f
  UNION ALL SELECT 'paper record current', CASE WHEN today - last <= {STALE} THEN 'PASS' ELSE 'FAIL' END, (today - last)::DOUBLE, false, NULL, today FROM f
  UNION ALL SELECT 'complete runs', CASE WHEN n_complete >= {RUNS} THEN 'PASS' ELSE 'NOT-YET' END, n_complete, false, CASE WHEN n_complete < {RUNS} THEN today + ({RUNS} - n_complete)::INT END, today FROM f
  UNION ALL SELECT 'exposure clean', CASE WHEN exposed THEN 'FAIL' ELSE 'PASS' END, exposed::INT, false, NULL, today FROM f
  UNION ALL SELECT 'reconcile exit', CASE WHEN n_bad > 0 THEN 'FAIL' ELSE 'PASS' END, n_bad, false, NULL, today FROM f
  UNION ALL SELECT 'tracking error', CASE WHEN longest >= {WEEKS} THEN 'FAIL' ELSE 'PASS' END, longest, longest >= {WEEKS}, NULL, today FROM f
  UNION ALL SELECT 'fill shortfall', CASE WHEN n_fills = 0 THEN 'NOT-YET' WHEN bps > {FILL_BPS} THEN 'FAIL' ELSE 'PASS' END, round(bps, 6), false, NULL, today FROM f
  UNION ALL SELECT 'signal canary', CASE WHEN newest IS NULL THEN 'NOT-YET' WHEN alerts > 0 OR inverted = {MONTHS} THEN 'FAIL' WHEN today - newest > 62 THEN 'NOT-YET' ELSE 'PASS' END, round(gap, 6), alerts = {MONTHS}, NULL, today FROM f
  UNION ALL SELECT 'no blocking markers', CASE WHEN n_marks > 0 THEN 'FAIL' ELSE 'PASS' END, n_marks, false, NULL, today FROM f
  UNION ALL SELECT 'incidents closed', CASE WHEN n_open > 0 THEN 'FAIL' ELSE 'PASS' END, n_open, false, NULL, today FROM f)
, v AS (SELECT *, CASE WHEN bool_or(state = 'FAIL' AND terminal) OVER () THEN 'NO-GO' WHEN bool_and(state = 'PASS') OVER () THEN 'GO' ELSE 'NOT-YET' END AS verdict, max(due) OVER () AS latest FROM c)
SELECT condition, state, measured, terminal, due::VARCHAR AS due, verdict, CASE WHEN latest IS NOT NULL THEN greatest(latest, today) WHEN verdict <> 'GO' THEN today END::VARCHAR AS earliest FROM v"""))
def gate_scorecard(spark, d):
    """Thirteen conditions on a book's record, its runs, its divergence, fills and signal, with
    three states, terminal failures, due dates and one verdict."""
    net = live(spark, d)
    run = Window.partitionBy(F.lit(0)).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)  # one row a period
    e = net.withColumn("e", F.product(1 + F.col("net")).over(run)).withColumn("pk", F.greatest(F.max("e").over(run), F.lit(1.0)))
    paper = e.agg(
        F.count(F.lit(1)).alias("n"), (F.avg("net") / F.nullif(F.stddev_samp("net"), F.lit(0.0)) * 52**0.5).alias("sharpe"), ((F.max_by("e", "day") - 1) * 100).alias("total"),
        (F.least(F.min(F.col("e") / F.col("pk") - 1), F.lit(0.0)) * 100).alias("fall"), F.max("day").alias("last"))
    o = spark.read.parquet(f"{d}/orders.parquet")
    st = F.when(F.bool_or(F.col("o_orderstatus") == "P"), "MISMATCH").when(F.every(F.col("o_orderstatus") == "F"), "COMPLETE").otherwise("PARTIAL")
    runs = o.groupBy(F.to_date("o_orderdate").alias("day")).agg(st.alias("st"), F.count_if(F.col("o_orderkey") % 5000 == 1).alias("bad"))
    complete = F.col("st") == "COMPLETE"
    rehearsal = runs.agg(F.count_if(complete).alias("n_complete"), (F.max_by("st", "day") == "MISMATCH").alias("exposed"), F.count_if(complete & (F.col("bad") > 0)).alias("n_bad"))
    tracking = D.longest_run(net.withColumn("breach", F.abs(F.col("net") - F.col("price")) * 100 > DIVERGENCE), "day", "breach")
    signed = F.when(F.col("side") == "BUY", 1).otherwise(-1) * (F.col("price") / F.col("reference") - 1)
    fills = T.fills(spark, d).agg((F.avg(signed) * 1e4).alias("bps"), F.count(F.lit(1)).alias("n_fills"))
    months = net.groupBy(F.trunc("day", "month").alias("m")).agg(F.avg("net").alias("a"), (F.avg("net") - F.avg("price")).alias("gap"))
    months = months.withColumn("r", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("m"))))
    near = F.col("r") <= MONTHS
    canary = months.agg(F.max("m").alias("newest"), F.count_if(near & (F.col("a") < 0)).alias("alerts"), F.count_if(near & (F.col("gap") < 0)).alias("inverted"), F.max(F.when(F.col("r") == 1, F.col("gap"))).alias("gap"))
    open_ = o.agg(F.count_if((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "P")).alias("n_open"))
    marks = spark.read.parquet(f"{d}/part.parquet").agg(F.count_if(F.col("p_retailprice") <= 0).alias("n_marks"))
    facts = paper
    for one in (rehearsal, tracking, fills, canary, open_, marks):  # one row each
        facts = facts.join(F.broadcast(one))
    c, today = F.col, F.lit(TODAY).cast("date")
    state = lambda bad, other=D.PASS: F.when(bad, D.FAIL).otherwise(other)
    n, last = c("n"), c("last")
    s_state, s_end, s_due = D.judged(c("sharpe"), c("sharpe") > SHARPE, n, LEAST, EXTENDED, last)
    t_state, t_end, t_due = D.judged(c("total"), c("total") > TOTAL, n, LEAST, EXTENDED, last)
    old = F.when(F.datediff(today, c("newest")) > 62, D.WAIT).otherwise(D.PASS)
    return D.scorecard(facts, [
        D.condition("paper days", F.when(n >= LEAST, D.PASS).otherwise(D.WAIT), n, due=F.when(n < LEAST, F.date_add(last, (LEAST - n + 1).cast("int")))),
        D.condition("paper Sharpe", s_state, c("sharpe"), s_end, s_due),
        D.condition("paper total return", t_state, c("total"), t_end, t_due),
        D.condition("paper max drawdown", state(c("fall") <= FALL), c("fall"), c("fall") <= FALL),
        D.condition("paper record current", F.when(F.datediff(today, last) <= STALE, D.PASS).otherwise(D.FAIL), F.datediff(today, last)),
        D.condition("complete runs", F.when(c("n_complete") >= RUNS, D.PASS).otherwise(D.WAIT), c("n_complete"), due=F.when(c("n_complete") < RUNS, F.date_add(today, (RUNS - c("n_complete")).cast("int")))),
        D.condition("exposure clean", state(c("exposed")), c("exposed").cast("int")),
        D.condition("reconcile exit", state(c("n_bad") > 0), c("n_bad")),
        D.condition("tracking error", state(c("longest") >= WEEKS), c("longest"), c("longest") >= WEEKS),
        D.condition("fill shortfall", F.when(c("n_fills") == 0, D.WAIT).otherwise(state(c("bps") > FILL_BPS)), c("bps")),
        D.condition("signal canary", F.when(c("newest").isNull(), D.WAIT).otherwise(F.when((c("alerts") > 0) | (c("inverted") == MONTHS), D.FAIL).otherwise(old)), c("gap"), c("alerts") == MONTHS),
        D.condition("no blocking markers", state(c("n_marks") > 0), c("n_marks")),
        D.condition("incidents closed", state(c("n_open") > 0), c("n_open")),
    ], today).withColumns({"due": c("due").cast("string"), "earliest": c("earliest").cast("string")})


QS = [0.1, 0.2, 0.3]


@query("n17_nominee", T.with_sql(NAMES, WEEK + f"""
, qs AS (SELECT unnest({QS}::DOUBLE[]) AS q), t0 AS (SELECT q, symbol, day, ret, cash, rk, count(CASE WHEN rk >= 1 - q THEN 1 END) OVER (PARTITION BY q, day) AS a, count(CASE WHEN rk <= q THEN 1 END) OVER (PARTITION BY q, day) AS b FROM ranked CROSS JOIN qs)
, t1 AS (SELECT *, CASE WHEN a = 0 OR b = 0 THEN 0 WHEN rk >= 1 - q AND NOT rk <= q THEN -0.5::DOUBLE / a WHEN rk <= q AND NOT rk >= 1 - q THEN 0.5::DOUBLE / b ELSE 0 END AS t FROM t0)
, t2 AS (SELECT *, CASE WHEN ret IS NOT NULL THEN coalesce(lag(t) OVER (PARTITION BY q, symbol ORDER BY day), 0) ELSE 0 END AS w FROM t1)
, t3 AS (SELECT *, abs(w - coalesce(lag(w) OVER (PARTITION BY q, symbol ORDER BY day), 0)) AS m FROM t2)
, t4 AS (SELECT q, day, sum(w * coalesce(ret, 0)) - sum(w * coalesce(cash, 0)) AS gross_ret, sum(m) AS turnover, sum(abs(w)) AS gross FROM t3 GROUP BY q, day)
, t5 AS (SELECT *, min(CASE WHEN gross > 0 THEN day END) OVER (PARTITION BY q) AS a FROM t4), t6 AS (SELECT *, gross_ret - turnover * 0.001::DOUBLE AS net, gross_ret - turnover * 0.002::DOUBLE AS stress,
    row_number() OVER (PARTITION BY q ORDER BY day) * 2 <= count(*) OVER (PARTITION BY q) + 1 AS first FROM t5 WHERE day >= a)
, s AS (SELECT q, round(avg(net) / nullif(stddev_samp(net), 0) * sqrt(52), 6) AS sharpe, round(avg(stress) * 1e4, 6) AS stress_bps, round(avg(net) FILTER (first) * 1e4, 6) AS first_bps, round(avg(net) FILTER (NOT first) * 1e4, 6) AS second_bps,
    round(avg(turnover), 6) AS turnover FROM t6 GROUP BY q)
, k AS (SELECT *, coalesce(sharpe > -2, false) AS c1, coalesce(stress_bps > -100, false) AS c2, coalesce(first_bps * second_bps > 0, false) AS c3, coalesce(turnover < 1.4, false) AS c4 FROM s)
SELECT q, sharpe, stress_bps, turnover, c1::INT + c2::INT + c3::INT + c4::INT AS n_passed, c3 AS same_sign_halves, (c1 AND c2 AND c3 AND c4) AND row_number() OVER (PARTITION BY c1 AND c2 AND c3 AND c4 ORDER BY sharpe DESC, q) = 1 AS nominee FROM k"""))
def nomination(spark, d):
    """Three widths of the tails as cells of one grouped run, four named checks, and the nominee."""
    p = week_panel(spark, d).withColumn("rank", S.average_rank(F.col("signal"), "day")).select("symbol", "day", "ret", "cash", "rank")
    p = p.withColumn("q", F.explode(F.array(*map(F.lit, QS))))
    day = Window.partitionBy("q", "day")
    top, bottom = F.col("rank") >= 1 - F.col("q"), F.col("rank") <= F.col("q")
    a, b = (F.count(F.when(x, 1)).over(day) for x in (top, bottom))
    target = F.when((a == 0) | (b == 0), 0.0).when(top & ~bottom, -0.5 / a).when(bottom & ~top, 0.5 / b).otherwise(0.0)
    p = p.withColumn("target", target).withColumn("weight", F.coalesce(F.lag("target").over(Window.partitionBy("q", "symbol").orderBy("day")), F.lit(0.0)))
    t = A.trimmed(A.account(p, COST, ["q"]), ["q"])
    w = Window.partitionBy("q")
    t = t.withColumns({"first": F.row_number().over(w.orderBy("day")) * 2 <= F.count(F.lit(1)).over(w) + 1, "stress": F.col("net") - F.col("cost")})
    bps = lambda x: F.round(F.avg(x) * 1e4, 6)
    s = t.groupBy("q").agg(
        F.round(F.avg("net") / F.nullif(F.stddev_samp("net"), F.lit(0.0)) * 52**0.5, 6).alias("sharpe"), bps("stress").alias("stress_bps"), bps(F.when(F.col("first"), F.col("net"))).alias("first_bps"),
        bps(F.when(~F.col("first"), F.col("net"))).alias("second_bps"), F.round(F.avg("turnover"), 6).alias("turnover"))
    checks = {"sharpe": F.col("sharpe") > -2, "stress": F.col("stress_bps") > -100, "same_sign_halves": F.col("first_bps") * F.col("second_bps") > 0, "turnover": F.col("turnover") < 1.4}
    n = D.nominee(s, checks, [F.desc("sharpe"), F.col("q")])
    return n.select("q", "sharpe", "stress_bps", "turnover", "n_passed", F.col("checks")["same_sign_halves"].alias("same_sign_halves"), "nominee")
