"""Queries of resampling inference and statistics (survey N)."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelia.functions import series as S
from panelia.operators import accounting as A
from panelia.operators import cross as X
from panelia.operators import inference as N
from panelia.operators import refits as M
from panelia.plans.accounting import COST, NAMES, Q, WEEK, week_panel, week_weights
from panelia.plans.registry import query
from panelia.session import ship_package
from panelia.sources import stand_ins as T

#: Draws of permutation nulls and of bootstraps, the least shift, the block of a bootstrap, shifts of a sample.
DRAWS, BOOTSTRAPS, LEAST_SHIFT, BLOCK, SAMPLED_SHIFTS = 200, 999, 14, 22, 60


def live(spark, d):
    return A.trimmed(A.account(week_weights(spark, d), COST))


def ranks(x, t):
    return f"(rank() OVER (PARTITION BY {t}, {x} IS NULL ORDER BY {x}) + (count(*) OVER (PARTITION BY {t}, {x} IS NULL, {x}) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY {t}, {x} IS NULL)"


def null_sharpes(panel, donors):
    """Each draw trades the donor's whole signal history on the own returns. A donor stands
    once in each draw, so its ranks and targets are the same in all draws and computed once; a
    draw only joins, masks and accounts them."""
    weights = X.tail_weights(panel, "signal", Q, flip=-1).select(F.col("symbol").alias("donor"), "day", "weight")
    p = panel.select("symbol", "day", "ret", "cash").join(donors, "symbol").join(weights, ["donor", "day"])
    daily = A.trimmed(A.account(p, COST, ["draw"]), ["draw"])
    sharpe = F.avg("net") / F.nullif(F.stddev_samp("net"), F.lit(0.0)) * 52**0.5
    return daily.groupBy("draw").agg(F.round(sharpe, 6).alias("sharpe"), F.round(F.avg("turnover"), 6).alias("turnover"))


_N1 = f"""
, dr AS (SELECT unnest(range({DRAWS})) AS draw), o AS (SELECT draw, symbol, row_number() OVER (PARTITION BY draw ORDER BY md5(concat_ws('|', '11', draw,
    symbol))) AS r FROM dr CROSS JOIN syms)
, i AS (SELECT draw, symbol, row_number() OVER (PARTITION BY draw ORDER BY symbol) AS r FROM dr CROSS JOIN syms), dn AS (SELECT i.draw, i.symbol, o.symbol AS donor
    FROM i JOIN o USING (draw, r))
, n0 AS (SELECT dn.draw, p.symbol, p.day, p.ret, p.cash, q.signal AS s FROM panel p JOIN dn ON p.symbol = dn.symbol JOIN panel q ON q.symbol = dn.donor AND q.day = p.day)
, n1 AS (SELECT *, CASE WHEN s IS NOT NULL THEN {ranks('s', 'draw, day')} END AS k FROM n0)
, n2 AS (SELECT *, count(CASE WHEN k >= 1 - 0.2::DOUBLE THEN 1 END) OVER (PARTITION BY draw, day) AS a,
    count(CASE WHEN k <= 0.2::DOUBLE THEN 1 END) OVER (PARTITION BY draw, day) AS b FROM n1)
, n3 AS (SELECT *, coalesce(lag(CASE WHEN a = 0 OR b = 0 THEN 0 WHEN k >= 1 - 0.2::DOUBLE THEN -0.5::DOUBLE / a WHEN k <= 0.2::DOUBLE THEN 0.5::DOUBLE / b ELSE 0 END) OVER (PARTITION BY draw, symbol ORDER BY day), 0) AS weight FROM n2)
, n4 AS (SELECT *, CASE WHEN ret IS NOT NULL THEN weight ELSE 0 END AS w FROM n3), n5 AS (SELECT *, coalesce(lag(w) OVER (PARTITION BY draw, symbol ORDER BY day), 0) AS w0 FROM n4)
, n6 AS (SELECT draw, day, sum(w * coalesce(ret, 0)) - sum(w * coalesce(cash, 0)) - sum(abs(w - w0)) * 0.001::DOUBLE AS net, sum(abs(w - w0)) AS turnover,
    sum(abs(w)) AS gross FROM n5 GROUP BY draw, day)
, n7 AS (SELECT *, min(CASE WHEN gross > 0 THEN day END) OVER (PARTITION BY draw) AS st FROM n6)
, nul AS (SELECT draw, round(avg(net) / nullif(stddev_samp(net), 0) * sqrt(52), 6) AS sharpe, round(avg(turnover), 6) AS turnover FROM n7 WHERE day >= st GROUP BY draw)
, obs AS (SELECT round(avg(net) / nullif(stddev_samp(net), 0) * sqrt(52), 6) AS sharpe, avg(turnover) AS turnover FROM live)"""


@query("n1_permutation_null", T.with_sql(NAMES, WEEK + _N1 + " SELECT draw, sharpe, turnover FROM nul"))
def permutation_null(spark, d):
    p = week_panel(spark, d)
    return null_sharpes(p, N.donor_map(p, DRAWS, "11"))


@query("n5_n10_n16_gate", T.with_sql(NAMES, WEEK + _N1 + """
SELECT max(obs.sharpe) AS observed, count(*) AS n, (count(CASE WHEN nul.sharpe >= obs.sharpe THEN 1 END) + 1) / (count(*) + 1)::DOUBLE AS p,
    abs(avg(nul.turnover) / max(obs.turnover) - 1) <= 0.1 AS turnover_valid,
 (count(CASE WHEN nul.sharpe >= obs.sharpe THEN 1 END) + 1) / (count(*) + 1)::DOUBLE < 0.05 / 6 AND max(obs.sharpe) > 0 AS passes FROM nul, obs"""))
def gate(spark, d):
    """Finite-sample p-value, null turnover near the observed one, adjusted gate."""
    p = week_panel(spark, d)
    null = null_sharpes(p, N.donor_map(p, DRAWS, "11"))
    obs = live(spark, d).agg(F.round(F.avg("net") / F.nullif(F.stddev_samp("net"), F.lit(0.0)) * 52**0.5, 6).alias("observed"), F.avg("turnover").alias("t"))
    x = null.join(F.broadcast(obs))
    pv = (F.count(F.when(F.col("sharpe") >= F.col("observed"), 1)) + 1) / (F.count(F.lit(1)) + 1)
    return x.agg(F.max("observed").alias("observed"), F.count(F.lit(1)).alias("n"), pv.alias("p"),
        (F.abs(F.avg("turnover") / F.max("t") - 1) <= 0.1).alias("turnover_valid"), ((pv < 0.05 / 6) & (F.max("observed") > 0)).alias("passes"))


@query("n2_random_pick_null", T.with_sql(NAMES, WEEK + f"""
, dr AS (SELECT unnest(range({DRAWS})) AS draw), ix AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS i FROM days)
, el AS (SELECT draw, i // 7 AS block, symbol, row_number() OVER (PARTITION BY draw, i // 7 ORDER BY md5(concat_ws('|', '5', draw, i // 7, symbol))) AS r FROM rets
    JOIN ix USING (day) CROSS JOIN dr WHERE i % 7 = 0 AND signal > 0)
SELECT draw, round(sum(ret) / 4, 8) AS total, count(*) AS n FROM el JOIN ix ON ix.i // 7 = el.block JOIN rets ON rets.day = ix.day AND rets.symbol = el.symbol
    WHERE r <= 4 GROUP BY draw"""))
def random_pick(spark, d):
    """K eligible names in hash order at each rebalance, held for the block."""
    p = week_panel(spark, d).join(X.ordinal_days(week_panel(spark, d)), "day").withColumn("block", F.floor(F.col("i") / 7))
    e = N.draws_of(p.filter("i % 7 = 0 AND signal > 0").select("block", "symbol"), DRAWS)
    order = N.hash_order("5", *[F.col(c).cast("string") for c in ("draw", "block", "symbol")])
    e = e.withColumn("r", F.row_number().over(Window.partitionBy("draw", "block").orderBy(order))).filter("r <= 4")
    return e.join(p.select("block", "symbol", "ret"), ["block", "symbol"]).groupBy("draw").agg(F.round(F.sum("ret") / 4, 8).alias("total"), F.count(F.lit(1)).alias("n"))


@query("n3_n4_paired_null", T.with_sql(NAMES, WEEK + f"""
, dr AS (SELECT unnest(range({DRAWS})) AS draw), o AS (SELECT draw, symbol, row_number() OVER (PARTITION BY draw ORDER BY md5(concat_ws('|', '3', draw,
    symbol))) AS r FROM dr CROSS JOIN syms)
, i AS (SELECT draw, symbol, row_number() OVER (PARTITION BY draw ORDER BY symbol) AS r FROM dr CROSS JOIN syms), dn AS (SELECT i.draw, i.symbol, o.symbol AS donor
    FROM i JOIN o USING (draw, r))
SELECT dn.draw, round(avg(sign(q.signal) * p.ret), 8) AS mean_signed, round(avg(p.signal * q.ret) * 1e4, 6) AS mean_joint FROM rets p JOIN dn ON p.symbol = dn.symbol
    JOIN rets q ON q.symbol = dn.donor AND q.day = p.day GROUP BY dn.draw"""))
def paired_null(spark, d):
    """One side of a pair permuted, magnitude and sign together, before they combine."""
    p = week_panel(spark, d).select("symbol", "day", "ret", "signal")
    q = p.select(F.col("symbol").alias("donor"), "day", F.col("signal").alias("s2"), F.col("ret").alias("r2"))
    m = p.join(N.donor_map(p, DRAWS, "3"), "symbol").join(q, ["donor", "day"])
    return m.groupBy("draw").agg(F.round(F.avg(F.signum("s2") * F.col("ret")), 8).alias("mean_signed"), F.round(F.avg(F.col("signal") * F.col("r2")) * 1e4, 6).alias("mean_joint"))


@query("n6_block_shuffle", T.with_sql(NAMES, WEEK + """
, p0 AS (SELECT symbol, ret, row_number() OVER (PARTITION BY symbol ORDER BY day) - 1 AS n FROM rets)
, bl AS (SELECT symbol, block, row_number() OVER (PARTITION BY symbol ORDER BY md5(concat_ws('|', '9', symbol, block))) AS t FROM (SELECT DISTINCT symbol, n // 12 AS block FROM p0))
, mv AS (SELECT p0.symbol, row_number() OVER (PARTITION BY p0.symbol ORDER BY t, n) - 1 AS n, ret AS shuffled FROM p0 JOIN bl ON bl.symbol = p0.symbol AND bl.block = p0.n // 12)
SELECT symbol, count(*) AS n, round(corr(ret, shuffled), 6) AS c, round(sum(ret) - sum(shuffled), 8) + 0.0 AS gap FROM p0 JOIN mv USING (symbol, n) GROUP BY symbol"""))
def block_shuffle(spark, d):
    """Blocks of twelve rows in hash order within each symbol."""
    w = Window.partitionBy("symbol")
    p = week_panel(spark, d).select("symbol", "day", "ret").withColumn("n", F.row_number().over(w.orderBy("day")) - 1).withColumn("block", F.floor(F.col("n") / 12))
    b = p.select("symbol", "block").distinct().withColumn("to", F.row_number().over(w.orderBy(N.hash_order("9", F.col("symbol").cast("string"), F.col("block").cast("string")))))
    moved = p.join(b, ["symbol", "block"]).withColumn("n", F.row_number().over(w.orderBy("to", "n")) - 1).select("symbol", "n", F.col("ret").alias("shuffled"))
    return p.join(moved, ["symbol", "n"]).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("ret", "shuffled"), 6).alias("c"),
        (F.round(F.sum("ret") - F.sum("shuffled"), 8) + 0.0).alias("gap"))


_SHIFT = f"""
, ix AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS n FROM days)
, wi AS (SELECT symbol, i, n, w, coalesce(ret, 0) - coalesce(cash, 0) AS r FROM masked JOIN ix USING (day))
, fee AS (SELECT (sum(turnover) + max_by(gross, day)) * 0.001::DOUBLE AS fee, count(*) AS n FROM daily)
, al AS (SELECT unnest(range({LEAST_SHIFT}, (SELECT n FROM fee) - {LEAST_SHIFT} + 1)) AS s)
, sh AS (SELECT 0 AS s UNION ALL {{chosen}})
, nl AS (SELECT s AS shift, round((sum(a.w * b.r) - max(fee)) / max(fee.n), 12) AS net FROM wi a CROSS JOIN sh CROSS JOIN fee JOIN wi b ON b.symbol = a.symbol
    AND b.i = (a.i - s + a.n) % a.n WHERE a.n >= 2 * {LEAST_SHIFT} AND a.w <> 0 GROUP BY s)
, ob AS (SELECT net AS observed FROM nl WHERE shift = 0)
SELECT shift, net, round((count(CASE WHEN net >= observed THEN 1 END) OVER () + 1) / (count(*) OVER () + 1)::DOUBLE, 10) AS p FROM nl, ob WHERE shift > 0"""


def shifted_nets(spark, d, wanted=None):
    """(shift, net, p): net of the book with price and cash taken together from t - s around the end,
    for every distinct shift that is far enough from none, or for ``wanted`` of them in a hash
    order; the book's own costs stay. All shifts come from one circular correlation a symbol."""
    ship_package(spark)
    p = week_weights(spark, d)
    daily = A.account(p, COST)
    fee = daily.agg((F.sum("cost") + F.max_by("gross", "day") * COST).alias("fee"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= 2 * LEAST_SHIFT)
    w = F.when(F.col("ret").isNotNull(), F.col("weight")).otherwise(0.0)
    flow = F.coalesce("ret", F.lit(0.0)) - F.coalesce("cash", F.lit(0.0))
    rows = p.join(X.ordinal_days(p), "day").join(F.broadcast(fee.select("n"))).select("symbol", "i", "n", w.alias("w"), flow.alias("r"))
    null = M.circular_sums(rows, "symbol", "i", "n", "w", "r").join(F.broadcast(fee))
    null = null.select("shift", "n", F.round((F.col("total") - F.col("fee")) / F.col("n"), 12).alias("net"))
    inside = F.col("shift").between(LEAST_SHIFT, F.col("n") - LEAST_SHIFT)
    every = Window.partitionBy(F.lit(0))  # one row a shift
    null = null.withColumn("observed", F.max(F.when(F.col("shift") == 0, F.col("net"))).over(every)).filter(inside)
    if wanted is not None:
        null = null.orderBy(N.hash_order("21", F.col("shift").cast("string"))).limit(wanted)
    reached = F.count(F.when(F.col("net") >= F.col("observed"), 1)).over(every)
    return null.select("shift", "net", F.round((reached + 1) / (F.count(F.lit(1)).over(every) + 1), 10).alias("p"))


@query("n7_circular_shift", T.with_sql(NAMES, WEEK + _SHIFT.format(chosen="SELECT s FROM al")))
def circular_shift(spark, d):
    """Every distinct shift."""
    return shifted_nets(spark, d)


@query("n7_sampled_shifts", T.with_sql(NAMES, WEEK + _SHIFT.format(chosen=f"(SELECT s FROM al ORDER BY md5(concat_ws('|', '21', s)) LIMIT {SAMPLED_SHIFTS})")))
def sampled_shifts(spark, d):
    """As many shifts as are wanted."""
    return shifted_nets(spark, d, SAMPLED_SHIFTS)


_BOOT = f"""
, sr AS (SELECT row_number() OVER (ORDER BY day) - 1 AS i, net, price, net - avg(net) OVER () AS x, (net - price) - avg(net - price) OVER () AS xd, count(*) OVER () AS n FROM live)
, dr AS (SELECT draw, b, n, ('0x' || substr(md5(concat_ws('|', '13', draw, b)), 1, 8))::BIGINT % n AS start FROM (SELECT max(n) AS n FROM sr) CROSS
    JOIN range({BOOTSTRAPS}) t(draw) CROSS JOIN range(1000) u(b) WHERE b < ceil(n / {BLOCK}.0))
, pos AS (SELECT draw, (start + o) % n AS i FROM dr CROSS JOIN range({BLOCK}) v(o) WHERE b * {BLOCK} + o < n)
, bm AS (SELECT draw, avg(x) AS m, avg(xd) AS md, (avg(net) / nullif(stddev_samp(net), 0) - avg(price) / nullif(stddev_samp(price), 0)) * sqrt(52) AS ds FROM pos
    JOIN sr USING (i) GROUP BY draw)"""


@query("n8_block_bootstrap", T.with_sql(NAMES, WEEK + _BOOT + " SELECT draw, round(m * 1e4, 6) AS mean_bps FROM bm"))
def block_bootstrap(spark, d):
    b = N.block_bootstrap(live(spark, d), "net", BOOTSTRAPS, BLOCK, "13")
    return b.select("draw", F.round(F.col("mean") * 1e4, 6).alias("mean_bps"))


@query("n8_block_p_values", T.with_sql(NAMES, WEEK + _BOOT + """
, ob AS (SELECT round(avg(net), 12) AS o, round(avg(net - price), 12) AS od FROM sr)
SELECT count(*) AS n, round(max(o) * 1e4, 6) AS observed_bps, (count(CASE WHEN round(m, 12) >= o THEN 1 END) + 1) / (count(*) + 1)::DOUBLE AS p,
 round(max(od) * 1e4, 6) AS paired_bps, (count(CASE WHEN round(md, 12) >= od THEN 1 END) + 1) / (count(*) + 1)::DOUBLE AS paired_p FROM bm, ob"""))
def block_p_values(spark, d):
    """One-sided p-value of a positive net mean under serial dependence, and the paired form,
    which asks it of the difference between the net series and that of prices alone."""
    daily = live(spark, d).withColumn("gap", F.col("net") - F.col("price"))
    found = {}
    for name in ("net", "gap"):
        null = N.block_bootstrap(daily, name, BOOTSTRAPS, BLOCK, "13").select(F.round("mean", 12).alias(name))
        found[name] = N.p_value(null, daily.agg(F.round(F.avg(name), 12).alias(name)), name)
    net, gap = found["net"], found["gap"].select(F.col("observed").alias("paired"), F.col("p").alias("paired_p"))
    bps = lambda c, n: F.round(F.col(c) * 1e4, 6).alias(n)
    return net.join(F.broadcast(gap)).select("n", bps("observed", "observed_bps"), "p", bps("paired", "paired_bps"), "paired_p")


@query("n9_sharpe_interval", T.with_sql(NAMES, WEEK + _BOOT + """
, ob AS (SELECT (avg(net) / nullif(stddev_samp(net), 0) - avg(price) / nullif(stddev_samp(price), 0)) * sqrt(52) AS o FROM sr)
SELECT count(*) AS n, round(max(o), 6) AS observed, round(quantile_cont(ds, 0.025), 6) AS low, round(quantile_cont(ds, 0.975), 6) AS high, round(avg((round(ds,
    10) <= 0)::INT), 6) AS share_below FROM bm, ob"""))
def interval(spark, d):
    """Difference of the Sharpe ratios of two paired series over shared block draws: its
    percentile interval and the share of draws at or below zero."""
    daily = live(spark, d)
    sharpe = lambda c: F.avg(c) / F.nullif(F.stddev_samp(c), F.lit(0.0)) * 52**0.5
    gap = (sharpe("net") - sharpe("price")).alias("gap")
    draws = N.block_draws(daily, ["net", "price"], BOOTSTRAPS, BLOCK, "13").groupBy("draw").agg(gap)
    observed = daily.agg(gap).select(F.round("gap", 6).alias("observed"))
    edges = [F.round(F.percentile("gap", q), 6).alias(n) for n, q in (("low", 0.025), ("high", 0.975))]
    share = F.round(F.avg((F.round("gap", 10) <= 0).cast("int")), 6).alias("share_below")
    return draws.agg(F.count(F.lit(1)).alias("n"), *edges, share).join(F.broadcast(observed)).select("n", "observed", "low", "high", "share_below")


@query("n11_hac_mean", T.with_sql(NAMES, WEEK + """
, x AS (SELECT row_number() OVER (ORDER BY day) AS n, net - avg(net) OVER () AS e FROM live), cv AS (SELECT sum(2 * (1 - l / 8.0) * a.e * b.e) AS s FROM x a
    JOIN range(1, 8) t(l) ON true JOIN x b ON b.n = a.n - l)
, bs AS (SELECT count(net) AS n, avg(net) AS mean, var_pop(net) AS v0 FROM live), v AS (SELECT n, mean, sqrt(greatest((v0 + s / n) / n, 0)) AS se FROM bs, cv)
SELECT n, round(mean * 1e4, 6) AS mean_bps, round(se * 1e4, 6) AS se_bps, round(mean / nullif(se, 0), 6) AS t, round((mean - 1.96 * se) * 1e4, 6) AS low_bps,
    round((mean + 1.96 * se) * 1e4, 6) AS high_bps FROM v"""))
def hac(spark, d):
    h = N.hac_mean(live(spark, d), "net", 7)
    bps = lambda c: F.round(F.col(c) * 1e4, 6).alias(f"{c}_bps")
    return h.select("n", bps("mean"), bps("se"), F.round("t", 6).alias("t"), bps("low"), bps("high"))


@query("n12_n15_regression", T.with_sql(NAMES, WEEK + """
, mk AS (SELECT day, median(ret) AS m FROM rets GROUP BY day), j AS (SELECT l.day, net, m, row_number() OVER (ORDER BY l.day) AS i FROM live l JOIN mk USING (day)
    WHERE m IS NOT NULL)
, f AS (SELECT *, net - regr_intercept(net, m) OVER () - regr_slope(net, m) OVER () * m AS u FROM j)
SELECT count(*) AS n, round(regr_intercept(net, m) * 1e4, 6) AS intercept_bps, round(regr_slope(net, m), 6) AS slope, round(corr(net, m), 6) AS correlation,
    round(sqrt(sum(u * u)) * 1e4, 4) AS residual_bps FROM f"""))
def regression(spark, d):
    """Intercept, slope, correlation and residual scale against the market."""
    market = week_panel(spark, d).groupBy("day").agg(F.median("ret").alias("m")).filter("m IS NOT NULL")
    j = live(spark, d).join(market, "day")
    s = j.agg(F.regr_intercept("net", "m").alias("a"), F.regr_slope("net", "m").alias("b"))
    f = j.join(F.broadcast(s)).withColumn("u", F.col("net") - F.col("a") - F.col("b") * F.col("m"))
    return f.agg(F.count(F.lit(1)).alias("n"), F.round(F.max("a") * 1e4, 6).alias("intercept_bps"), F.round(F.max("b"), 6).alias("slope"), F.round(F.corr("net",
        "m"), 6).alias("correlation"), F.round(F.sqrt(F.sum(F.col("u") * F.col("u"))) * 1e4, 4).alias("residual_bps"))


@query("n12_hac_intercept", T.with_sql(NAMES, WEEK + """
, mk AS (SELECT day, median(ret) AS m FROM rets GROUP BY day), j AS (SELECT l.day, net, m, row_number() OVER (ORDER BY l.day) AS i FROM live l JOIN mk USING (day)
    WHERE m IS NOT NULL)
, c AS (SELECT regr_intercept(net, m) AS a, regr_slope(net, m) AS b, count(*) AS n, sum(m) AS s, sum(m * m) AS q FROM j)
, h AS (SELECT i, (q - s * m) / (n * q - s * s) * (net - a - b * m) AS h FROM j, c)
, v AS (SELECT (SELECT sum(h * h) FROM h) + (SELECT sum(2 * (1 - l / 11.0) * x.h * y.h) FROM h x JOIN range(1, 11) t(l) ON true JOIN h y ON y.i = x.i - l) AS v)
SELECT n, round(a * 1e4, 6) AS intercept_bps, round(b, 6) AS slope, CASE WHEN n > 12 AND v > 0 THEN round(sqrt(v) * 1e4, 6) END AS se_bps, CASE WHEN n > 12
    AND v > 0 THEN round(a / sqrt(v), 6) END AS t FROM c, v"""))
def hac_intercept(spark, d):
    """T of the intercept against the market with a Bartlett-weighted error over ten lags."""
    market = week_panel(spark, d).groupBy("day").agg(F.median("ret").alias("m")).filter("m IS NOT NULL")
    h = N.hac_intercept(live(spark, d).join(market, "day"), "net", "m", 10)
    bps = lambda c: F.round(F.col(c) * 1e4, 6).alias(f"{c}_bps")
    return h.select("n", bps("intercept"), F.round("slope", 6).alias("slope"), bps("se"), F.round("t", 6).alias("t"))


@query("n15_orientation", T.with_sql("decision", """
, x AS (SELECT side, proba, pnl, event_id FROM decision WHERE proba IS NOT NULL AND pnl IS NOT NULL)
, r AS (SELECT *, rank() OVER (PARTITION BY side ORDER BY proba) + (count(*) OVER (PARTITION BY side, proba) - 1) / 2.0::DOUBLE AS a,
   rank() OVER (PARTITION BY side ORDER BY pnl) + (count(*) OVER (PARTITION BY side, pnl) - 1) / 2.0::DOUBLE AS b,
   row_number() OVER (PARTITION BY side ORDER BY proba, event_id) AS k, count(*) OVER (PARTITION BY side) AS n, greatest(1, count(*) OVER (PARTITION BY side) // 4) AS q FROM x)
, g AS (SELECT side, count(*) AS n, round(corr(proba, pnl), 6) AS c, round(corr(a, b), 6) AS rc, round(sum(CASE WHEN k <= q THEN pnl ELSE 0 END), 6) AS bottom,
    round(sum(CASE WHEN k > n - q THEN pnl ELSE 0 END), 6) AS top FROM r GROUP BY side)
SELECT side, n, c AS correlation, rc AS rank_correlation, bottom, top, CASE WHEN n < 20 THEN 'LOW_N' WHEN rc < -0.1
    AND top < bottom THEN 'POSSIBLE_INVERTED' WHEN rc > 0.1 AND top > bottom THEN 'ALIGNED' ELSE 'WEAK_OR_NOISY' END AS verdict FROM g"""))
def orientation(spark, d):
    """Does a score rank outcomes the right way round? Correlation, rank correlation, the
    outcomes of the lowest and highest quarter of scores, and a verdict for each side. Ranks come
    from the counts of equal values and prefix sums over ranges of them; only rows whose score is the
    one at which a quarter ends are ordered by event, so no task orders a side."""
    x = T.decisions(spark, d).filter("proba IS NOT NULL AND pnl IS NOT NULL").select("side", "proba", "pnl", "event_id")
    below = lambda c: S.sum_below(x.groupBy("side", c).agg(F.count(F.lit(1)).alias("_same")), F.col("_same"), c, "_below", "side")
    mean = F.col("_below") + (F.col("_same") + 1) / 2
    sizes = x.groupBy("side").agg(F.count(F.lit(1)).alias("n")).withColumn("q", F.greatest(F.lit(1), F.floor(F.col("n") / 4)))
    cut = lambda k: (F.col("_below") < k) & (k < F.col("_below") + F.col("_same"))
    scores = below("proba").join(F.broadcast(sizes), "side").withColumns({"a": mean, "_cut": cut(F.col("q")) | cut(F.col("n") - F.col("q"))})  # one row a side
    outcomes = below("pnl").select("side", "pnl", mean.alias("b"))
    r = x.join(scores.drop("_same"), ["side", "proba"]).join(outcomes, ["side", "pnl"])
    inside = S.sum_below(r.filter("_cut"), F.lit(1), "event_id", "_inside", "side", "proba")
    r = r.filter("NOT _cut").withColumn("_inside", F.lit(0)).unionByName(inside).withColumn("k", F.col("_below") + F.col("_inside") + 1)
    total = lambda where: F.round(F.sum(F.when(where, F.col("pnl")).otherwise(0.0)), 6)
    g = r.groupBy("side").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.corr("proba", "pnl"), 6).alias("correlation"), F.round(F.corr("a", "b"), 6).alias("rank_correlation"),
        total(F.col("k") <= F.col("q")).alias("bottom"), total(F.col("k") > F.col("n") - F.col("q")).alias("top"),
    )
    c = F.col("rank_correlation")
    verdict = F.when(F.col("n") < 20, "LOW_N").when((c < -0.1) & (F.col("top") < F.col("bottom")), "POSSIBLE_INVERTED")
    return g.withColumn("verdict", verdict.when((c > 0.1) & (F.col("top") > F.col("bottom")), "ALIGNED").otherwise("WEAK_OR_NOISY"))


@query("n13_effective_n", T.with_sql("decision", """
SELECT side, count(pnl) AS n, round(sum(proba), 6) AS effective, round(sum(pnl * proba) / nullif(sum(CASE WHEN pnl IS NOT NULL THEN proba END), 0), 8) AS mean,
    round(stddev_samp(pnl) / sqrt(nullif(sum(proba), 0)), 8) AS se FROM decision GROUP BY side"""))
def effective_n(spark, d):
    """Error of a weighted mean with the sum of weights as the number of observations."""
    w, x = F.col("proba"), F.col("pnl")
    return T.decisions(spark, d).groupBy("side").agg(
        F.count(x).alias("n"), F.round(F.sum(w), 6).alias("effective"), F.round(F.sum(x * w) / F.nullif(F.sum(F.when(x.isNotNull(), w)), F.lit(0.0)),
            8).alias("mean"), F.round(F.stddev_samp(x) / F.sqrt(F.nullif(F.sum(w), F.lit(0.0))), 8).alias("se"))


@query("n17_n19_scorecard", T.with_sql(NAMES, WEEK + """
, s AS (SELECT avg(net) AS m, stddev_samp(net) AS sd, min(net) AS lo, count(*) AS n FROM live), l3 AS (SELECT bool_and(net < 0) AS down FROM (SELECT net FROM live
    ORDER BY day DESC LIMIT 3))
, c AS (SELECT 'mean_positive' AS condition, CASE WHEN n < 50 THEN 'pending' WHEN m > 0 THEN 'pass' ELSE 'fail' END AS state FROM s UNION ALL SELECT 'worst_limited',
    CASE WHEN lo > -0.2 THEN 'pass' ELSE 'fail' END FROM s
 UNION ALL SELECT 'enough_periods', CASE WHEN n >= 100 THEN 'pass' ELSE 'pending' END FROM s UNION ALL SELECT 'not_falling', CASE WHEN down THEN 'fail' ELSE 'pass' END FROM l3)
SELECT condition, state, CASE WHEN count(*) FILTER (state = 'fail') OVER () > 0 THEN 'stop' WHEN count(*) FILTER (state = 'pending') OVER () > 0 THEN 'wait' ELSE 'go' END AS verdict FROM c"""))
def scorecard(spark, d):
    """Named conditions with three states, a trend rule on the last rows, one verdict."""
    one = Window.partitionBy(F.lit(0))
    x = live(spark, d).withColumn("r", F.row_number().over(one.orderBy(F.desc("day"))))
    s = x.agg(F.avg("net").alias("m"), F.min("net").alias("lo"), F.count(F.lit(1)).alias("n"), F.every(F.when(F.col("r") <= 3, F.col("net") < 0)).alias("down"))
    state = {
        "mean_positive": F.when(F.col("n") < 50, "pending").when(F.col("m") > 0, "pass").otherwise("fail"),
        "worst_limited": F.when(F.col("lo") > -0.2, "pass").otherwise("fail"),
        "enough_periods": F.when(F.col("n") >= 100, "pass").otherwise("pending"),
        "not_falling": F.when(F.col("down"), "fail").otherwise("pass"),
    }
    rows = s.select(F.explode(F.array(*[F.struct(F.lit(k).alias("condition"), v.alias("state")) for k, v in state.items()])).alias("c")).select("c.*")
    failing, waiting = (F.count(F.when(F.col("state") == x, 1)).over(one) for x in ("fail", "pending"))
    return rows.withColumn("verdict", F.when(failing > 0, "stop").when(waiting > 0, "wait").otherwise("go"))
