"""Queries of weights accounted period by period (survey E, and X8 with E3 and E8)."""

from pyspark.sql import functions as F

from panelia.functions import series as S
from panelia.operators import accounting as A
from panelia.operators import cross as X
from panelia.plans.registry import query
from panelia.sources import stand_ins as T

COST, Q, PERIODS = 0.001, 0.2, 52.0

#: SQL of the weekly carry panel: skeleton, returns, cash, trailing signal, rank, lagged weights.
WEEK = ", " + """days AS (SELECT DISTINCT day FROM bars_week), syms AS (SELECT DISTINCT symbol FROM bars_week)
, span AS (SELECT symbol, min(day) a, max(day) b FROM cash_week GROUP BY symbol)
, base AS (SELECT symbol, day, close, volume, CASE WHEN volume > 0 THEN close END AS px, rate,
   CASE WHEN day BETWEEN a AND b THEN coalesce(rate, 0) END AS cash
   FROM syms CROSS JOIN days LEFT JOIN bars_week USING (symbol, day) LEFT JOIN cash_week USING (symbol, day) LEFT JOIN span USING (symbol))
, rets AS (SELECT *, px / nullif(lag(px) OVER s, 0) - 1 AS ret,
   CASE WHEN count(cash) OVER (s ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) >= 7 THEN round(sum(cash) OVER (s ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 10) END AS signal
   FROM base WINDOW s AS (PARTITION BY symbol ORDER BY day))
, ranked AS (SELECT *, CASE WHEN signal IS NOT NULL THEN (rank() OVER (PARTITION BY day, signal IS NULL ORDER BY signal)
   + (count(*) OVER (PARTITION BY day, signal IS NULL, signal) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY day, signal IS NULL) END AS rk FROM rets)
, tails AS (SELECT *, count(CASE WHEN rk >= 1 - 0.2::DOUBLE THEN 1 END) OVER (PARTITION BY day) AS nt,
    count(CASE WHEN rk <= 0.2::DOUBLE THEN 1 END) OVER (PARTITION BY day) AS nb FROM ranked)
, targets AS (SELECT *, CASE WHEN nt = 0 OR nb = 0 THEN 0 WHEN rk >= 1 - 0.2::DOUBLE THEN -0.5::DOUBLE / nt WHEN rk <= 0.2::DOUBLE THEN 0.5::DOUBLE / nb ELSE 0 END AS target FROM tails)
, panel AS (SELECT *, coalesce(lag(target) OVER (PARTITION BY symbol ORDER BY day), 0) AS weight FROM targets)
, masked AS (SELECT *, CASE WHEN ret IS NOT NULL THEN weight ELSE 0 END AS w FROM panel)
, moves AS (SELECT *, coalesce(lag(w) OVER (PARTITION BY symbol ORDER BY day), 0) AS w0 FROM masked)
, daily AS (SELECT day, sum(w * coalesce(ret, 0)) AS price, -sum(w * coalesce(cash, 0)) AS funding, sum(abs(w - w0)) AS turnover, sum(abs(w)) AS gross FROM moves GROUP BY day)
, net AS (SELECT *, turnover * 0.001::DOUBLE AS cost, price + funding - turnover * 0.001::DOUBLE AS net FROM daily)
, live AS (SELECT * FROM net WHERE day >= (SELECT min(day) FROM net WHERE gross > 0))
"""
NAMES = "bars_week cash_week"

#: SQL of the performance record of a table (day, net, funding, turnover).
RECORD = """
, eq AS (SELECT *, product(1 + net) OVER (ORDER BY day) AS equity, row_number() OVER (ORDER BY day) AS n, count(*) OVER () AS tot FROM {t})
, pk AS (SELECT *, max(equity) OVER (ORDER BY day) AS peak FROM eq)
SELECT count(*) AS n_periods, round(avg(net) * 52 * 100, 6) AS annual_return, round(stddev_samp(net) * sqrt(52) * 100, 6) AS annual_vol,
 round(avg(net) / nullif(stddev_samp(net), 0) * sqrt(52), 6) AS sharpe,
 round(avg(CASE WHEN n * 2 <= tot + 1 THEN net END) / nullif(stddev_samp(CASE WHEN n * 2 <= tot + 1 THEN net END), 0) * sqrt(52), 6) AS sharpe_first,
 round(avg(CASE WHEN n * 2 > tot + 1 THEN net END) / nullif(stddev_samp(CASE WHEN n * 2 > tot + 1 THEN net END), 0) * sqrt(52), 6) AS sharpe_second,
 round(min(equity / peak - 1) * 100, 6) AS max_drawdown, round((arg_max(equity, day) - 1) * 100, 6) AS total,
 round(sum(funding) * 100, 6) AS funding_total, round(avg(turnover), 6) AS turnover, round(min(net) * 100, 6) AS worst FROM pk"""


def week_panel(spark, d):
    """The weekly panel with the trailing sum of seven settlements as signal."""
    panel = A.panel_with_cash(T.bars_week(spark, d), T.cash_week(spark, d), X.skeleton)
    return panel.withColumn("signal", F.round(S.rolling(F.col("cash"), 7, 7, S.over(), F.sum), 10))


def week_weights(spark, d):
    return X.tail_weights(week_panel(spark, d), "signal", Q, flip=-1)


def week_daily(spark, d):
    return A.account(week_weights(spark, d), COST)


def flagship(spark, d):
    """Rank nations by trailing settlements, hold the tails, report the record of the book. Mean
    turnover is given from the first position on and over the whole calendar."""
    daily = week_daily(spark, d)
    whole = daily.agg(F.round(F.avg("turnover"), 6).alias("turnover_untrimmed"))
    return A.performance(A.trimmed(daily), PERIODS).join(F.broadcast(whole))


_BOTH = RECORD.format(t="live").replace("AS worst FROM", "AS worst, (SELECT round(avg(turnover), 6) FROM net) AS turnover_untrimmed FROM")
query("e1_e3_e8_carry_record", T.with_sql(NAMES, WEEK + _BOTH))(flagship)


@query("x1_x8_tail_weights", T.with_sql(NAMES, WEEK + "SELECT symbol, day::VARCHAR AS day, round(signal, 11) AS signal, round(rk, 11) AS rank, round(target, 11) AS target, round(weight, 11) AS weight FROM panel"))
def tail_weights(spark, d):
    """Average-tie ranks and lagged tail weights on the full calendar."""
    return week_weights(spark, d).select("symbol", F.col("day").cast("string").alias("day"), *[F.round(c, 11).alias(c) for c in ("signal", "rank", "target", "weight")])


@query("e3_period_accounting", T.with_sql(NAMES, WEEK + "SELECT day::VARCHAR AS day, round(price, 11) AS price, round(funding, 11) AS funding, round(turnover, 11) AS turnover, round(gross, 11) AS gross, round(cost, 11) AS cost, round(net, 11) AS net FROM live"))
def period_accounting(spark, d):
    return A.trimmed(week_daily(spark, d)).select(F.col("day").cast("string").alias("day"), *[F.round(c, 11).alias(c) for c in ("price", "funding", "turnover",
        "gross", "cost", "net")])


@query("e4_final_liquidation", T.with_sql(NAMES, WEEK + """
, z AS (SELECT *, CASE WHEN day = max(day) OVER () THEN gross ELSE 0 END AS final FROM live)
SELECT count(*) AS n, round(sum(turnover + final), 11) AS turnover, round(sum(cost + final * 0.001), 11) AS cost, round(sum(net - final * 0.001), 11) AS net FROM z"""))
def final_liquidation(spark, d):
    """The book is closed at the end and pays for it."""
    z = A.with_liquidation(A.trimmed(week_daily(spark, d)))
    return z.agg(F.count(F.lit(1)).alias("n"), *[F.round(F.sum(c), 11).alias(c) for c in ("turnover", "cost", "net")])


@query("e7_legs", T.with_sql(NAMES, WEEK + """
, sd AS (SELECT *, CASE WHEN w <> 0 THEN sign(w) ELSE sign(w0) END AS side FROM moves)
SELECT side::BIGINT AS side, round(sum(w * coalesce(ret, 0)), 11) AS price, round(-sum(w * coalesce(cash, 0)), 11) AS funding, round(sum(abs(w - w0)) * 0.001,
    11) AS cost FROM sd WHERE side <> 0 GROUP BY 1"""))
def legs(spark, d):
    return A.legs(week_weights(spark, d), COST).select(F.col("side").cast("bigint").alias("side"), *[F.round(c, 11).alias(c) for c in ("price", "funding", "cost")])


@query("e9_book_booking", T.with_sql(NAMES, WEEK + """
, o AS (SELECT *, coalesce(lag(weight) OVER (PARTITION BY symbol ORDER BY day), 0) AS old FROM panel)
, b AS (SELECT day, sum(old * coalesce(ret, 0)) AS price, -sum(coalesce(cash, 0) * (old / 3 + weight * 2 / 3)) AS funding, sum(abs(weight - old)) * 0.001 AS cost
    FROM o GROUP BY day)
SELECT day::VARCHAR AS day, round(price, 11) AS price, round(funding, 11) AS funding, round(cost, 11) AS cost, round(price + funding - cost, 11) AS pnl,
    round(product(1 + price + funding - cost) OVER (ORDER BY day), 11) AS equity FROM b"""))
def book_booking(spark, d):
    """Open-to-open booking with the cash flow split between old and new weights."""
    b = A.split_booking(week_weights(spark, d), COST)
    return b.select(F.col("day").cast("string").alias("day"), *[F.round(c, 11).alias(c) for c in ("price", "funding", "cost", "pnl", "equity")])


@query("e10_e11_catch_up", T.with_sql(NAMES, WEEK + """
, booked AS (SELECT symbol, day, round(weight, 6) AS weight FROM panel WHERE day < DATE '2000-01-03')
, cmp AS (SELECT p.day, coalesce(abs(b.weight - p.weight), abs(p.weight)) AS gap FROM panel p LEFT JOIN booked b USING (symbol, day) WHERE p.day < DATE '2000-01-03')
SELECT (SELECT count(DISTINCT day) FROM panel WHERE day >= DATE '2000-01-03' AND ret IS NOT NULL) AS days_to_book, count(DISTINCT day) AS days_checked,
    coalesce(max(gap) <= 1e-6, false) AS agrees FROM cmp"""))
def catch_up(spark, d):
    """Periods after the last booked one that have an exit price; booked weights checked."""
    p = week_weights(spark, d)
    early = F.col("day") < F.lit("2000-01-03").cast("date")
    booked = p.filter(early).select("symbol", "day", F.round("weight", 6).alias("booked"))
    cmp = p.filter(early).join(booked, ["symbol", "day"], "full").agg(
        F.countDistinct("day").alias("days_checked"), F.coalesce(F.max(F.abs(F.coalesce("booked", F.lit(0.0)) - F.coalesce("weight", F.lit(0.0)))) <= 1e-6,
            F.lit(False)).alias("agrees"))
    ahead = p.filter(~early & F.col("ret").isNotNull()).agg(F.countDistinct("day").alias("days_to_book"))
    return ahead.join(F.broadcast(cmp)).select("days_to_book", "days_checked", "agrees")


@query("e12_attribution", T.with_sql(NAMES, WEEK + """
SELECT symbol, round(sum(w * coalesce(ret, 0)), 11) AS price, round(-sum(w * coalesce(cash, 0)), 11) AS funding, round(sum(abs(w - w0)) * 0.001, 11) AS cost,
 abs((SELECT sum(net) FROM net) - sum(sum(w * coalesce(ret, 0)) - sum(w * coalesce(cash, 0)) - sum(abs(w - w0)) * 0.001) OVER ()) <= 1e-5 AS readds FROM moves GROUP BY symbol"""))
def attribution(spark, d):
    """Price, cash and cost by entity, which must add up to the ledger."""
    p = week_weights(spark, d)
    w = S.over()
    m = p.withColumn("w", F.when(F.col("ret").isNotNull(), F.col("weight")).otherwise(0.0)).withColumn("w0", F.coalesce(F.lag("w").over(w), F.lit(0.0)))
    each = m.groupBy("symbol").agg(
        F.sum(F.col("w") * F.coalesce("ret", F.lit(0.0))).alias("price"), (-F.sum(F.col("w") * F.coalesce("cash", F.lit(0.0)))).alias("funding"),
        (F.sum(F.abs(F.col("w") - F.col("w0"))) * COST).alias("cost"))
    total = A.account(p, COST).agg(F.sum("net").alias("_total"))
    mine = each.agg(F.sum(F.col("price") + F.col("funding") - F.col("cost")).alias("_mine"))
    return each.join(F.broadcast(total)).join(F.broadcast(mine)).select(
        "symbol", *[F.round(c, 11).alias(c) for c in ("price", "funding", "cost")], (F.abs(F.col("_total") - F.col("_mine")) <= 1e-5).alias("readds"))


@query("e19_exclusion", T.with_sql(NAMES, WEEK + """
, x AS (SELECT u, day, symbol, w, ret, cash FROM masked, (VALUES ('all'), ('without')) t(u) WHERE u = 'all' OR symbol % 5 <> 0)
, xm AS (SELECT *, coalesce(lag(w) OVER (PARTITION BY u, symbol ORDER BY day), 0) AS w0 FROM x)
, xd AS (SELECT u, day, sum(w * coalesce(ret, 0)) - sum(w * coalesce(cash, 0)) - sum(abs(w - w0)) * 0.001 AS net FROM xm GROUP BY u, day)
SELECT u AS universe, count(*) AS n, round(avg(net), 11) AS mean_net, round(stddev_samp(net), 11) AS sd_net FROM xd GROUP BY u"""))
def exclusion(spark, d):
    """The same evaluation without a subset of the keys; the universe is a group key."""
    p = week_weights(spark, d)
    tags = F.when(F.col("symbol") % 5 != 0, F.array(F.lit("all"), F.lit("without"))).otherwise(F.array(F.lit("all")))
    daily = A.account(p.withColumn("universe", F.explode(tags)), COST, by=["universe"])
    return daily.groupBy("universe").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("net"), 11).alias("mean_net"), F.round(F.stddev_samp("net"), 11).alias("sd_net"))


@query("e20_signal_health", T.with_sql(NAMES, WEEK + """
, t AS (SELECT day, net, row_number() OVER (ORDER BY day DESC) AS r FROM live), m AS (SELECT day, median(signal) AS level FROM rets GROUP BY day)
SELECT count(*) AS n, round(avg(net) / nullif(stddev_samp(net), 0) * sqrt(52), 6) AS sharpe, round(avg(level), 11) AS mean_level,
    coalesce(avg(net) < 0 OR avg(level) < 0, false) AS alert FROM t JOIN m USING (day) WHERE r <= 60"""))
def signal_health(spark, d):
    """Trailing-window Sharpe and signal level with an alert rule."""
    from pyspark.sql.window import Window

    p = week_weights(spark, d)
    daily = A.trimmed(A.account(p, COST)).withColumn("r", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("day")))).filter("r <= 60")
    level = p.groupBy("day").agg(F.median("signal").alias("level"))
    net = F.col("net")
    return daily.join(level, "day").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(net) / F.nullif(F.stddev_samp(net), F.lit(0.0)) * PERIODS**0.5, 6).alias("sharpe"),
        F.round(F.avg("level"), 11).alias("mean_level"), F.coalesce((F.avg(net) < 0) | (F.avg("level") < 0), F.lit(False)).alias("alert"))


_TWO = """, a AS (SELECT symbol, day, close, lead(close) OVER (PARTITION BY symbol ORDER BY day) / close - 1 AS ra FROM (SELECT symbol, CAST(date_trunc('week',
    l_shipdate) AS DATE) AS day, round(20000 + avg(l_extendedprice / l_quantity), 6) AS close FROM wl WHERE l_linestatus = 'F' GROUP BY ALL))
, b AS (SELECT symbol, day, close, lead(close) OVER (PARTITION BY symbol ORDER BY day) / close - 1 AS rb FROM (SELECT symbol, CAST(date_trunc('week',
    l_shipdate) AS DATE) AS day, round(20000 + avg(l_extendedprice / l_quantity), 6) AS close FROM wl WHERE l_linestatus = 'O' GROUP BY ALL))
, ab AS (SELECT symbol, day, ra, rb, a.close - b.close AS basis FROM a JOIN b USING (symbol, day))
"""


@query("e2_two_legs", T.with_sql("wl", _TWO + """
SELECT day::VARCHAR AS day, count(*) AS n, round(avg(sign(basis) * (rb - ra)), 11) AS price, round(sum(abs(basis)) / 1e6, 11) AS level FROM ab WHERE ra IS NOT NULL
    AND rb IS NOT NULL GROUP BY day"""))
def two_legs(spark, d):
    """Both legs must trade; the book earns the closing of the spread."""
    w = S.over()
    a, b = (T.bars_week(spark, d, f"l_linestatus = '{s}'").select("symbol", "day", F.col("close").alias(n),
        (F.lead("close").over(w) / F.col("close") - 1).alias(f"r{n}")) for s, n in (("F", "a"), ("O", "b")))
    ab = a.join(b, ["symbol", "day"]).filter("ra IS NOT NULL AND rb IS NOT NULL").withColumn("basis", F.col("a") - F.col("b"))
    return ab.groupBy(F.col("day").cast("string").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.signum("basis") * (F.col("rb") - F.col("ra"))), 11).alias("price"), F.round(F.sum(F.abs("basis")) / 1e6,
            11).alias("level"))


@query("e15_e18_rebalance", T.with_sql("fill", """
, held AS (SELECT part, sum(CASE side WHEN 'BUY' THEN qty ELSE -qty END) AS held, avg(price) AS price FROM fill WHERE run < DATE '2000-01-01' GROUP BY part)
, want AS (SELECT part, 1.0 / count(*) OVER () AS weight, avg_price FROM (SELECT part, avg(price) AS avg_price FROM fill WHERE run >= DATE '2000-01-01' GROUP BY part))
, j AS (SELECT part, coalesce(held, 0) AS held, coalesce(floor(round(1e6 * weight / avg_price, 6) / 0.5) * 0.5, 0) AS wanted, coalesce(avg_price, price) AS price
    FROM held FULL JOIN want USING (part))
SELECT part, round(wanted - held, 6) AS delta, abs(wanted - held) * price < 5 AS too_small, ceil(abs(wanted - held) / 100)::BIGINT AS chunks, round(greatest(0.5,
    ceil(round(5 / price / 0.5, 6)) * 0.5) * price, 7) AS least_budget FROM j"""))
def rebalance(spark, d):
    """Target against held quantities, steps, minimum sizes, chunks, least budget."""
    f = T.fills(spark, d)
    signed = F.when(F.col("side") == "BUY", F.col("qty")).otherwise(-F.col("qty"))
    held = f.filter("run < DATE '2000-01-01'").groupBy("part").agg(F.sum(signed).alias("held"), F.avg("price").alias("price"))
    want = f.filter("run >= DATE '2000-01-01'").groupBy("part").agg(F.avg("price").alias("avg_price"))
    n = want.agg(F.count(F.lit(1)).alias("n"))
    want = want.join(F.broadcast(n)).withColumn("wanted", F.floor(F.round(1e6 / F.col("n") / F.col("avg_price"), 6) / 0.5) * 0.5)
    j = held.join(want, "part", "full").select("part", F.coalesce("held", F.lit(0.0)).alias("held"), F.coalesce("wanted", F.lit(0.0)).alias("wanted"),
        F.coalesce("avg_price", "price").alias("price"))
    delta, p = F.col("wanted") - F.col("held"), F.col("price")
    return j.select(
        "part", F.round(delta, 6).alias("delta"), (F.abs(delta) * p < 5).alias("too_small"), F.ceil(F.abs(delta) / 100).cast("bigint").alias("chunks"),
        F.round(F.greatest(F.lit(0.5), F.ceil(F.round(5 / p / 0.5, 6)) * 0.5) * p, 7).alias("least_budget"))
