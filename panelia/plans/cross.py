"""Queries of cross-sectional operators (survey X)."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelia.functions import series as S
from panelia.operators import accounting as A
from panelia.operators import cross as X
from panelia.operators import states
from panelia.plans.accounting import NAMES, WEEK, week_panel, week_weights
from panelia.plans.registry import query
from panelia.sources import stand_ins as T



def ranks(x, t="day"):
    return f"(rank() OVER (PARTITION BY {t}, {x} IS NULL ORDER BY {x}) + (count(*) OVER (PARTITION BY {t}, {x} IS NULL, {x}) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY {t}, {x} IS NULL)"


@query("x2_x4_context", T.with_sql(NAMES, WEEK + f"""
, c AS (SELECT symbol, day, ret, CASE WHEN ret IS NOT NULL THEN {ranks('ret')} - 0.5 END AS centred, median(ret) OVER (PARTITION BY day) AS market,
  avg(CASE WHEN ret IS NOT NULL THEN (ret > 0)::INT END) OVER (PARTITION BY day) AS breadth,
  quantile_cont(ret, 0.75) OVER (PARTITION BY day) - quantile_cont(ret, 0.25) OVER (PARTITION BY day) AS dispersion FROM rets)
SELECT symbol, day::VARCHAR AS day, round(centred, 8) AS centred, round(market, 8) AS market, round(breadth, 8) AS breadth, round(dispersion, 8) AS dispersion,
    round(ret - 0.5 * market, 8) AS residual FROM c"""))
def context(spark, d):
    """Centred rank, market median, breadth, dispersion, residual return."""
    r = F.col("ret")
    p = week_panel(spark, d).withColumns({
        "centred": S.average_rank(r, "day") - 0.5, "market": F.median(r).over(X.by_day()), "breadth": F.avg(F.when(r.isNotNull(), (r > 0).cast("int"))).over(X.by_day()),
        "dispersion": F.percentile(r, 0.75).over(X.by_day()) - F.percentile(r, 0.25).over(X.by_day())})
    return p.withColumn("residual", r - 0.5 * F.col("market")).select("symbol", S.day_text(), *[F.round(c, 8).alias(c) for c in ("centred", "market", "breadth",
        "dispersion", "residual")])


@query("x5_x7_daily_regression", T.with_sql(NAMES, WEEK + f"""
, rr AS (SELECT day, symbol, CASE WHEN signal IS NOT NULL AND ret IS NOT NULL THEN ret END AS y0, CASE WHEN signal IS NOT NULL AND ret IS NOT NULL THEN signal END AS x0 FROM rets)
, rk2 AS (SELECT day, CASE WHEN y0 IS NOT NULL THEN {ranks('y0')} END AS y, CASE WHEN x0 IS NOT NULL THEN {ranks('x0')} END AS x FROM rr)
SELECT day::VARCHAR AS day, count(y) AS n, round(regr_slope(y, x), 6) AS slope, round(corr(y, x), 6) AS rank_corr FROM rk2 GROUP BY day HAVING count(y) >= 5"""))
def daily_regression(spark, d):
    """Per-day regression and correlation of ranks, days with enough names."""
    p = week_panel(spark, d).filter("signal IS NOT NULL AND ret IS NOT NULL").withColumns({"y": S.average_rank(F.col("ret"), "day"), "x": S.average_rank(F.col("signal"), "day")})
    return p.groupBy(S.day_text()).agg(F.count("y").alias("n"), F.round(F.regr_slope("y", "x"), 6).alias("slope"), F.round(F.corr("y", "x"), 6).alias("rank_corr")).filter("n >= 5")


@query("x9_gated_weights", T.with_sql(NAMES, WEEK + f"""
, g AS (SELECT symbol, day, CASE WHEN row_number() OVER (PARTITION BY symbol ORDER BY day) > 20 AND ret IS NOT NULL THEN signal END AS s FROM rets)
, g2 AS (SELECT symbol, day, CASE WHEN count(s) OVER (PARTITION BY day) >= 10 THEN s END AS s FROM g), g3 AS (SELECT *, CASE WHEN s IS NOT NULL THEN {ranks('s')} END AS gk FROM g2)
, g4 AS (SELECT *, count(CASE WHEN gk >= 1 - 0.25::DOUBLE THEN 1 END) OVER (PARTITION BY day) AS nt,
    count(CASE WHEN gk <= 0.25::DOUBLE THEN 1 END) OVER (PARTITION BY day) AS nb FROM g3)
SELECT symbol, day::VARCHAR AS day, round(CASE WHEN nt = 0 OR nb = 0 THEN 0 WHEN gk >= 1 - 0.25::DOUBLE THEN 0.5::DOUBLE / nt WHEN gk <= 0.25::DOUBLE THEN -0.5::DOUBLE / nb ELSE 0 END, 8) AS target FROM g4"""))
def gated(spark, d):
    """Weights among eligible rows only; every outcome row stays."""
    p = week_panel(spark, d).withColumn("n", F.row_number().over(S.over()))
    return X.gated_weights(p, "signal", (F.col("n") > 20) & F.col("ret").isNotNull(), 0.25, 10).select("symbol", S.day_text(), F.round("target", 8).alias("target"))


@query("x10_x11_benchmarks", T.with_sql(NAMES, WEEK + """
, f AS (SELECT *, px > avg(px) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AND count(px) OVER (PARTITION BY symbol
    ORDER BY day ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) >= 10 AS up FROM base)
SELECT symbol, day::VARCHAR AS day, round(coalesce(coalesce(up, false)::INT / nullif(sum(coalesce(up, false)::INT) OVER (PARTITION BY day), 0), 0), 8) AS trend,
    (symbol = 3)::INT::DOUBLE AS single FROM f"""))
def benchmarks(spark, d):
    """Equal weight over names above their mean; one name alone."""
    p = week_panel(spark, d)
    px = F.when(F.col("volume") > 0, F.col("close"))
    up = F.coalesce(px > S.rolling(px, 10, 10, S.over()), F.lit(False)).cast("int")
    p = p.withColumn("up", up)
    return p.select("symbol", S.day_text(), F.round(F.coalesce(F.col("up") / F.nullif(F.sum("up").over(X.by_day()), F.lit(0)), F.lit(0.0)), 8).alias("trend"),
        (F.col("symbol") == 3).cast("double").alias("single"))


def _blocks(score, k, hold, name):
    pick = f"row_number() OVER (PARTITION BY block ORDER BY {score} DESC, symbol)"
    share = f"1.0::DOUBLE / {k}" if k else "1.0::DOUBLE / count(*) OVER (PARTITION BY block)"
    return f"""
, {name}_i AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS i FROM days), {name}_p AS (SELECT b.*, i, floor(i / {hold}) AS block FROM {name}_s b JOIN {name}_i USING (day))
, {name}_c AS (SELECT block, symbol, {share} AS target, {pick} AS r FROM {name}_p WHERE i % {hold} = 0 AND {score} > 0)
, {name} AS (SELECT p.*, coalesce(c.target, 0) AS target FROM {name}_p p LEFT JOIN (SELECT * FROM {name}_c WHERE {f'r <= {k}' if k else 'true'}) c USING (block, symbol))"""


@query("x12_x13_block_holdings", T.with_sql(NAMES, WEEK + ", h_s AS (SELECT symbol, day, signal FROM rets)" + _blocks("signal", 4, 7,
    "h") + ", g_s AS (SELECT symbol, day, signal FROM rets)" + _blocks("signal", None, 7, "g") + """
SELECT h.symbol, h.day::VARCHAR AS day, round(coalesce(lag(h.target) OVER (PARTITION BY h.symbol ORDER BY h.day), 0), 8) AS top,
    round(coalesce(lag(g.target) OVER (PARTITION BY h.symbol ORDER BY h.day), 0), 8) AS positive FROM h JOIN g USING (symbol, day)"""))
def blocks(spark, d):
    """Top-k positive names held for a block, and all positive names."""
    p = week_panel(spark, d).select("symbol", "day", "signal")
    top = X.block_holdings(p, "signal", 4, 7).select("symbol", "day", F.round("weight", 8).alias("top"))
    positive = X.block_holdings(p, "signal", None, 7).select("symbol", "day", F.round("weight", 8).alias("positive"))
    return top.join(positive, ["symbol", "day"]).select("symbol", S.day_text(), "top", "positive")


_RATES = """, ra AS (SELECT symbol, day, round((avg(l_discount) - 0.05::DOUBLE) / 10, 8) AS a FROM wl WHERE l_returnflag = 'R' GROUP BY symbol, day)
, rb AS (SELECT symbol, day, round((avg(l_discount) - 0.05::DOUBLE) / 10, 8) AS b FROM wl WHERE l_returnflag <> 'R' GROUP BY symbol, day)
, sp AS (SELECT symbol, day, round(a - b, 10) AS spread, round(abs(a - b), 10) AS size FROM ra JOIN rb USING (symbol, day)), days AS (SELECT DISTINCT day FROM sp),
    h_s AS (SELECT symbol, day, spread, size FROM sp)"""


def spreads(spark, d):
    a, b = (T.cash_week(spark, d, f"l_returnflag {op} 'R'").withColumnRenamed("rate", n) for op, n in (("=", "a"), ("<>", "b")))
    gap = F.col("a") - F.col("b")
    return a.join(b, ["symbol", "day"]).select("symbol", "day", F.round(gap, 10).alias("spread"), F.round(F.abs(gap), 10).alias("size"))


@query("x14_spread_weights", T.with_sql("wl", _RATES + _blocks("size", 3, 4, "h") + """
SELECT symbol, day::VARCHAR AS day, round(-sign(spread) * target, 8) + 0.0::DOUBLE AS leg_a, round(sign(spread) * target, 8) + 0.0::DOUBLE AS leg_b FROM h"""))
def spread_weights(spark, d):
    """The widest spreads, short the higher leg and long the lower."""
    h = X.block_holdings(spreads(spark, d), "size", 3, 4)
    side = F.signum("spread") * F.col("target")
    return h.select("symbol", S.day_text(), (F.round(-side, 8) + 0.0).alias("leg_a"), (F.round(side, 8) + 0.0).alias("leg_b"))


@query("x15_x16_hedged", T.with_sql(NAMES, WEEK + """
, hb AS (SELECT symbol, day, CASE WHEN symbol = 0 THEN -coalesce(sum(CASE WHEN symbol <> 0 THEN weight * (1 + symbol / 100.0::DOUBLE) END) OVER (PARTITION BY day),
    0) ELSE weight END AS w FROM panel)
SELECT symbol, day::VARCHAR AS day, round(w, 8) AS hedged, round(coalesce(w / nullif(sum(abs(w)) OVER (PARTITION BY day), 0), 0), 8) AS unit FROM hb"""))
def hedged(spark, d):
    """A hedge asset against the beta of the book; gross scaled to one."""
    p = X.with_hedge(week_weights(spark, d).withColumn("beta", 1 + F.col("symbol") / 100), 0, "beta")
    return X.unit_gross(p.withColumn("hedged", F.round("weight", 8))).select("symbol", S.day_text(), "hedged", F.round("weight", 8).alias("unit"))


@query("x17_x19_hysteresis", T.with_sql(NAMES, WEEK + """
, en AS (SELECT symbol, day, rk, ret, row_number() OVER (PARTITION BY symbol ORDER BY day) AS n, CASE WHEN rk >= 0.8 - 1e-9 THEN 1 WHEN rk <= 0.2 + 1e-9 THEN -1 END AS e FROM panel)
, st AS (SELECT *, last_value(e IGNORE NULLS) OVER r AS s, max(CASE WHEN e IS NOT NULL THEN n END) OVER r AS since, max(CASE WHEN rk IS NULL OR rk < 0.7 - 1e-9 THEN n END) OVER r AS high,
   max(CASE WHEN rk IS NULL OR rk > 0.3 + 1e-9 THEN n END) OVER r AS low, max(CASE WHEN rk IS NULL THEN n END) OVER r AS gone FROM en WINDOW r AS (PARTITION BY symbol ORDER BY day ROWS UNBOUNDED PRECEDING))
, sd AS (SELECT 0 AS k, symbol, day, ret, CASE WHEN s IS NOT NULL AND coalesce(CASE WHEN s = 1 THEN high ELSE low END, 0) < since THEN s ELSE 0 END AS side FROM st
   UNION ALL SELECT k, symbol, day, ret, CASE WHEN s IS NOT NULL AND n - since <= k AND coalesce(gone, 0) < since THEN s ELSE 0 END FROM st, range(1, 13) t(k))
, tg AS (SELECT *, CASE WHEN side <> 0 THEN side * 0.5::DOUBLE / count(*) OVER (PARTITION BY k, day, side) ELSE 0 END AS t FROM sd)
, wt AS (SELECT *, coalesce(lag(t) OVER (PARTITION BY k, symbol ORDER BY day), 0) AS held FROM tg), ws AS (SELECT *, CASE WHEN ret IS NOT NULL THEN held ELSE 0 END AS w FROM wt)
, mv AS (SELECT k, day, abs(w - coalesce(lag(w) OVER (PARTITION BY k, symbol ORDER BY day), 0)) AS m FROM ws)
, tn AS (SELECT k, avg(turnover) AS a FROM (SELECT k, day, sum(m) AS turnover FROM mv GROUP BY k, day) GROUP BY k)
, best AS (SELECT arg_min(x.k, (round(abs(x.a - y.a), 9), x.k))::INTEGER AS best_k FROM tn x JOIN tn y ON y.k = 0 WHERE x.k > 0)
SELECT symbol, sum(abs(side))::BIGINT AS periods_held, best_k FROM sd, best WHERE k = 0 GROUP BY symbol, best_k"""))
def hysteresis(spark, d):
    """Members that stay in a tail past its edge, and a placebo that only exits late; the
    delay of 1 to 12 periods whose accounted turnover is nearest to the band's, the least of equals."""
    p = week_weights(spark, d).select("symbol", "day", "rank", "ret", "cash")
    band = states.hysteresis(p, "symbol", "day", "rank", 0.2, 0.1)
    late = states.delayed_exit(p, "symbol", "day", "rank", 0.2, *range(1, 13))

    def turnover(x, *by):
        """Mean turnover of half a unit on each side, dealt equally, held from the next period on."""
        side = F.count(F.lit(1)).over(Window.partitionBy(*by, "day", "side"))
        x = x.withColumn("target", F.when(F.col("side") != 0, F.col("side") * 0.5 / side).otherwise(0.0))
        before = F.lag("target").over(Window.partitionBy(*by, "symbol").orderBy("day"))
        daily = A.account(x.withColumn("weight", F.coalesce(before, F.lit(0.0))), 0.0, list(by))
        return daily.groupBy(*by).agg(F.avg("turnover").alias("turnover"))

    goal = turnover(band).withColumnRenamed("turnover", "goal")
    gaps = turnover(late, "k").join(F.broadcast(goal)).withColumn("gap", F.round(F.abs(F.col("turnover") - F.col("goal")), 9))
    best = gaps.agg(F.min_by("k", F.struct("gap", "k")).alias("best_k"))
    held = band.groupBy("symbol").agg(F.sum(F.abs("side")).alias("periods_held"))
    return held.join(F.broadcast(best)).select("symbol", "periods_held", "best_k")


@query("x20_volatility_target", T.with_sql(NAMES, WEEK + """
, v AS (SELECT day, net, CASE WHEN count(net) OVER (ORDER BY day ROWS BETWEEN 19 PRECEDING
    AND CURRENT ROW) >= 20 THEN stddev_samp(net) OVER (ORDER BY day ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) * sqrt(52) END AS vol FROM live)
SELECT day::VARCHAR AS day, round(coalesce(lag(CASE WHEN vol > 0 THEN least(greatest(0.1 / vol, 0.25), 2) END) OVER (ORDER BY day), 1), 6) AS scale,
    round(net * coalesce(lag(CASE WHEN vol > 0 THEN least(greatest(0.1 / vol, 0.25), 2) END) OVER (ORDER BY day), 1), 8) AS scaled FROM v"""))
def volatility_target(spark, d):
    """Leverage from realised volatility, lagged, within limits."""

    w = Window.partitionBy(F.lit(0)).orderBy("day")
    daily = A.trimmed(A.account(week_weights(spark, d), 0.001)).withColumn("vol", S.rolling(F.col("net"), 20, 20, w, F.stddev_samp) * 52**0.5)
    daily = daily.withColumn("now", S.clip(S.safe_ratio(F.lit(0.1), F.col("vol")), 0.25, 2.0))
    scale = F.coalesce(F.lag("now").over(w), F.lit(1.0))
    return daily.select(S.day_text(), F.round(scale, 6).alias("scale"), F.round(F.col("net") * scale, 8).alias("scaled"))


@query("x21_x22_blend", T.with_sql(NAMES, WEEK + """
, bl AS (SELECT symbol, day, 0.7::DOUBLE * weight + 0.3::DOUBLE * coalesce(lag(weight) OVER (PARTITION BY symbol ORDER BY day), 0) AS weight FROM panel)
, fl AS (SELECT day, symbol, weight, abs((weight <> 0)::INT - coalesce((lag(weight) OVER (PARTITION BY symbol ORDER BY day) <> 0)::INT, 0)) AS flip FROM panel)
SELECT day::VARCHAR AS day, round(sum(abs(bl.weight)), 8) AS gross, sum(flip)::BIGINT AS flips, count(CASE WHEN fl.weight <> 0 THEN 1 END) AS held FROM bl
    JOIN fl USING (symbol, day) GROUP BY day"""))
def blended(spark, d):
    """Two books blended; entries and exits a day, names held."""
    p = week_weights(spark, d)
    before = F.lag("weight").over(S.over())
    b = X.blend(p, p.withColumn("weight", F.coalesce(before, F.lit(0.0))), 0.7, 0.3).groupBy("day").agg(F.round(F.sum(F.abs("weight")), 8).alias("gross"))
    on = (F.col("weight") != 0).cast("int")
    f = p.withColumn("flip", F.abs(on - F.coalesce((before != 0).cast("int"), F.lit(0)))).groupBy("day").agg(F.sum("flip").alias("flips"),
        F.count(F.when(F.col("weight") != 0, 1)).alias("held"))
    return b.join(f, "day").select(S.day_text(), "gross", "flips", "held")
