"""Queries of books with two legs, hedged and scaled books, months (survey E5, E6, X5, X6, X16, X20, G10, G12)."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelia.functions import series as S
from panelia.operators import accounting as A
from panelia.operators import cross as X
from panelia.plans.accounting import COST, NAMES, PERIODS, WEEK, week_panel, week_weights
from panelia.plans.registry import query
from panelia.sources import stand_ins as T

#: Names of the basis and of the spread book, days that a choice is held, cost of a changed unit, capital of a unit.
TOP, HELD, BASIS_COST, LEG_COST, BASIS_CAPITAL = 3, 4, 0.0015, 0.0007, 1.5

_BOOKS = f"""
, va AS (SELECT symbol, day, round(20000 + avg(l_extendedprice / l_quantity), 6) AS pa, round((avg(l_discount) - 0.05::DOUBLE) / 10, 8) AS fa FROM wl WHERE l_linenumber % 2 = 0 GROUP BY symbol, day)
, vb AS (SELECT symbol, day, round(20000 + avg(l_extendedprice / l_quantity), 6) AS pb, round((avg(l_discount) - 0.05::DOUBLE) / 10, 8) AS fb FROM wl WHERE l_linenumber % 2 = 1 GROUP BY symbol, day)
, dy AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS i FROM (SELECT day FROM va INTERSECT SELECT day FROM vb)), sy AS (SELECT symbol FROM va INTERSECT SELECT symbol FROM vb)
, gr AS (SELECT symbol, day, i, i // {HELD} AS block, pa, pb, fa, fb FROM dy CROSS JOIN sy LEFT JOIN va USING (symbol, day) LEFT JOIN vb USING (symbol, day))
, sg AS (SELECT *, pa / lag(pa) OVER w - 1 AS ra, pb / lag(pb) OVER w - 1 AS rb,
    CASE WHEN count(fa) OVER f >= 7 THEN round(sum(fa) OVER f, 10) END AS sa, CASE WHEN count(fb) OVER f >= 7 THEN round(sum(fb) OVER f, 10) END AS sb FROM gr
    WINDOW w AS (PARTITION BY symbol ORDER BY day), f AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
, c1 AS (SELECT block, symbol, 1.0::DOUBLE / {TOP} AS t FROM sg WHERE i % {HELD} = 0 AND sa > 0 QUALIFY row_number() OVER (PARTITION BY block ORDER BY sa DESC, symbol) <= {TOP})
, c2 AS (SELECT block, symbol, sign(sa - sb) / {TOP} AS t FROM sg WHERE i % {HELD} = 0 AND sa IS NOT NULL AND sb IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY block ORDER BY round(abs(sa - sb), 10) DESC, symbol) <= {TOP})
, tg AS (SELECT 'basis' AS book, sg.*, -coalesce(t, 0) AS ta, coalesce(t, 0) AS tb FROM sg LEFT JOIN c1 USING (block, symbol)
    UNION ALL SELECT 'spread', sg.*, -coalesce(t, 0), coalesce(t, 0) FROM sg LEFT JOIN c2 USING (block, symbol))
, wt AS (SELECT *, CASE WHEN ra IS NOT NULL AND rb IS NOT NULL THEN coalesce(lag(ta) OVER w, 0) ELSE 0 END AS wa, CASE WHEN ra IS NOT NULL AND rb IS NOT NULL THEN coalesce(lag(tb) OVER w, 0) ELSE 0 END AS wb
    FROM tg WINDOW w AS (PARTITION BY book, symbol ORDER BY day))
, mv AS (SELECT *, abs(wa - coalesce(lag(wa) OVER w, 0)) AS ma, abs(wb - coalesce(lag(wb) OVER w, 0)) AS mb FROM wt WINDOW w AS (PARTITION BY book, symbol ORDER BY day))
, dl AS (SELECT book, day, sum(wa * coalesce(ra, 0) + wb * coalesce(rb, 0)) AS price, -sum(wa * coalesce(fa, 0) + CASE book WHEN 'spread' THEN wb * coalesce(fb, 0) ELSE 0 END) AS funding,
    CASE book WHEN 'basis' THEN sum(mb) ELSE sum(ma + mb) END AS turnover, CASE book WHEN 'basis' THEN sum(abs(wb)) ELSE sum(abs(wa) + abs(wb)) END AS gross FROM mv GROUP BY book, day)
, nt AS (SELECT *, turnover * CASE book WHEN 'basis' THEN {BASIS_COST}::DOUBLE ELSE {LEG_COST}::DOUBLE END AS cost,
    price + funding - turnover * CASE book WHEN 'basis' THEN {BASIS_COST}::DOUBLE ELSE {LEG_COST}::DOUBLE END AS net FROM dl)"""


def venue_grid(spark, d):
    """Returns, cash flows and trailing cash flows of two venues on the calendar that both have."""
    even = F.col("l_linenumber") % 2
    lines = T.week_lines(spark, d)
    price = F.round(20000 + F.avg(F.col("l_extendedprice") / F.col("l_quantity")), 6)
    rate = F.round((F.avg("l_discount") - 0.05) / 10, 8)
    a, b = (lines.filter(even == k).groupBy("symbol", "day").agg(price.alias(f"p{x}"), rate.alias(f"cash_{x}")) for k, x in ((0, "a"), (1, "b")))
    names = a.select("symbol").intersect(b.select("symbol"))
    days = a.select("day").intersect(b.select("day")).agg(F.array_sort(F.collect_list("day")).alias("_days"))  # a calendar, as in the skeleton
    grid = names.join(F.broadcast(days)).select("symbol", F.explode("_days").alias("day")).join(a, ["symbol", "day"], "left").join(b, ["symbol", "day"], "left")
    w = S.over()
    return grid.withColumns({f"ret_{x}": F.col(f"p{x}") / F.lag(f"p{x}").over(w) - 1 for x in "ab"} | {f"s{x}": F.round(S.rolling(F.col(f"cash_{x}"), 7, 7, w, F.sum), 10) for x in "ab"})


def leg_books(spark, d):
    """(book, day, price, funding, turnover, gross, cost, net): the basis book is long venue b and short
    venue a on the names whose cash flow in a is greatest, and has a's cash flow only; the spread
    book is short the venue that pays more and long the other, where they differ most."""
    w = S.over()
    p = venue_grid(spark, d)
    p = p.withColumn("size", F.round(F.abs(F.col("sa") - F.col("sb")), 10))
    lagged = lambda x: F.coalesce(F.lag(x).over(w), F.lit(0.0))
    basis = X.block_holdings(p, "sa", TOP, HELD).select(F.lit("basis").alias("book"), "*").withColumns({"weight_a": lagged(-F.col("target")), "weight_b": lagged(F.col("target")), "cash_b": F.lit(0.0)})
    spread = X.block_holdings(p, "size", TOP, HELD, positive=False).select(F.lit("spread").alias("book"), "*")
    # the direction is that of the day on which the block begins
    start = F.max(F.when(F.col("i") % HELD == 0, F.signum(F.col("sa") - F.col("sb")))).over(Window.partitionBy("symbol", "block"))
    spread = spread.withColumn("side", F.coalesce(start * F.col("target"), F.lit(0.0))).withColumns({"weight_a": lagged(-F.col("side")), "weight_b": lagged(F.col("side"))}).drop("side")
    daily = A.account_legs(basis.unionByName(spread), ["book"])
    one = F.col("book") == "basis"
    daily = daily.withColumns({
        "turnover": F.when(one, F.col("turnover_b")).otherwise(F.col("turnover_a") + F.col("turnover_b")), "gross": F.when(one, F.col("gross") / 2).otherwise(F.col("gross"))})
    daily = daily.withColumn("cost", F.col("turnover") * F.when(one, BASIS_COST).otherwise(LEG_COST))
    return daily.withColumn("net", F.col("price") + F.col("funding") - F.col("cost")).drop("turnover_a", "turnover_b")


@query("e5_e6_leg_books", T.with_sql("wl", _BOOKS + """
SELECT book, day::VARCHAR AS day, round(price, 10) + 0.0 AS price, round(funding, 10) + 0.0 AS funding, round(turnover, 8) AS turnover, round(gross, 8) AS gross, round(net, 10) + 0.0 AS net FROM nt"""))
def leg_days(spark, d):
    """Weights, cash flow, turnover and cost of both books, day by day."""
    n = leg_books(spark, d)
    return n.select("book", S.day_text(), *[(F.round(c, 10) + 0.0).alias(c) for c in ("price", "funding", "net")], *[F.round(c, 8).alias(c) for c in ("turnover", "gross")])


@query("e5_e6_leg_records", T.with_sql("wl", _BOOKS + f"""
, st AS (SELECT book, min(day) AS a FROM nt WHERE gross > 0 GROUP BY book), lv AS (SELECT nt.* FROM nt JOIN st USING (book) WHERE day >= a)
, eq AS (SELECT *, product(1 + net) OVER (PARTITION BY book ORDER BY day) AS e, row_number() OVER (PARTITION BY book ORDER BY day) <= count(*) OVER (PARTITION BY book) // 2 AS first FROM lv)
, dd AS (SELECT *, e / max(e) OVER (PARTITION BY book ORDER BY day) - 1 AS fall FROM eq)
SELECT book, count(*) AS n_periods, round(avg(net) / nullif(stddev_samp(net), 0) * sqrt(52), 6) AS sharpe, round(avg(net) FILTER (first) / nullif(stddev_samp(net) FILTER (first), 0) * sqrt(52), 6) AS sharpe_first,
    round(avg(net) FILTER (NOT first) / nullif(stddev_samp(net) FILTER (NOT first), 0) * sqrt(52), 6) AS sharpe_second, round(avg(net) * 5200, 6) AS annual_notional,
    round(avg(net) * 5200 / {BASIS_CAPITAL}::DOUBLE, 6) AS annual_capital, round(stddev_samp(net) * sqrt(52) * 100, 6) AS annual_vol, round(min(fall) * 100, 6) AS max_drawdown, round(avg(funding) * 5200, 6) AS annual_funding,
    round(avg(price) * 5200, 6) AS annual_price, round(avg(cost) * 5200, 6) AS annual_cost, round(avg(turnover), 6) AS turnover, round(avg(gross), 6) AS invested FROM dd GROUP BY book"""))
def leg_records(spark, d):
    """The records of both books, on notional and on capital."""
    return A.leg_record(leg_books(spark, d), PERIODS, BASIS_CAPITAL, ["book"])


@query("x16_short_hedged_book", T.with_sql(NAMES, WEEK + """
, sh AS (SELECT symbol, day, ret, cash, CASE WHEN rk >= 0.8 THEN -0.5::DOUBLE / nullif(count(CASE WHEN rk >= 0.8 THEN 1 END) OVER (PARTITION BY day), 0) ELSE 0 END AS s FROM ranked)
, hg AS (SELECT *, CASE WHEN symbol = 0 THEN s - sum(s * (1 + symbol / 100.0::DOUBLE)) OVER (PARTITION BY day) ELSE s END AS h FROM sh)
, un AS (SELECT *, coalesce(h / nullif(sum(abs(h)) OVER (PARTITION BY day), 0), 0) AS t FROM hg)
, wt AS (SELECT *, coalesce(lag(t) OVER (PARTITION BY symbol ORDER BY day), 0) AS w FROM un)
SELECT symbol, day::VARCHAR AS day, round(w, 8) + 0.0 AS weight, round(sum(abs(w)) OVER (PARTITION BY day), 6) AS gross FROM wt"""))
def short_hedged(spark, d):
    """Only the top tail, short; a hedge asset against its beta; gross scaled to one; a period later."""
    p = X.tail_weights(week_panel(spark, d), "signal", 0.2, -1).withColumn("beta", 1 + F.col("symbol") / 100)
    top = F.col("rank") >= 0.8
    n = F.count(F.when(top, 1)).over(X.by_day())
    p = p.withColumn("short", F.when(top, -0.5 / n).otherwise(0.0))
    tilt = F.sum(F.col("short") * F.col("beta")).over(X.by_day())
    p = X.unit_gross(p.withColumn("weight", F.when(F.col("symbol") == 0, F.col("short") - tilt).otherwise(F.col("short"))))
    p = p.withColumn("weight", F.coalesce(F.lag("weight").over(S.over()), F.lit(0.0)))
    return p.select("symbol", S.day_text(), (F.round("weight", 8) + 0.0).alias("weight"), F.round(F.sum(F.abs("weight")).over(X.by_day()), 6).alias("gross"))


@query("x20_volatility_control", T.with_sql(NAMES, WEEK + """
, v AS (SELECT day, CASE WHEN count(net) OVER w >= 20 THEN stddev_samp(net) OVER w * sqrt(52) END AS vol FROM net WINDOW w AS (ORDER BY day ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
, sc AS (SELECT day, coalesce(lag(CASE WHEN vol > 0 THEN least(greatest(0.1 / vol, 0.25), 2) END) OVER (ORDER BY day), 1) AS scale FROM v)
, me AS (SELECT avg(scale) AS m FROM sc JOIN net USING (day) WHERE gross > 0)
, bk AS (SELECT 'target' AS book, p.symbol, p.day, p.ret, p.cash, p.weight * scale AS weight FROM panel p JOIN sc USING (day) UNION ALL SELECT 'constant', symbol, day, ret, cash, weight * m FROM panel, me)
, ms AS (SELECT *, CASE WHEN ret IS NOT NULL THEN weight ELSE 0 END AS w FROM bk), mm AS (SELECT *, coalesce(lag(w) OVER (PARTITION BY book, symbol ORDER BY day), 0) AS w0 FROM ms)
, dl AS (SELECT book, day, sum(w * coalesce(ret, 0)) - sum(w * coalesce(cash, 0)) - sum(abs(w - w0)) * 0.001::DOUBLE AS net, sum(abs(w)) AS gross FROM mm GROUP BY book, day)
, st AS (SELECT book, min(day) AS a FROM dl WHERE gross > 0 GROUP BY book)
SELECT book, count(*) AS n, round(avg(net) / nullif(stddev_samp(net), 0) * sqrt(52), 6) AS sharpe, round(stddev_samp(net) * sqrt(52) * 100, 6) AS annual_vol, round(avg(gross), 6) AS gross, round(max(m), 6) AS mean_scale
FROM dl JOIN st USING (book), me WHERE day >= a GROUP BY book"""))
def volatility_control(spark, d):
    """The overlay on the weights, each trade paid, beside a book with its mean leverage throughout."""
    p = week_weights(spark, d).select("symbol", "day", "ret", "cash", "weight")
    w = Window.partitionBy(F.lit(0)).orderBy("day")  # one row a day
    daily = A.account(p, COST).withColumn("vol", S.rolling(F.col("net"), 20, 20, w, F.stddev_samp) * 52**0.5)
    now = S.clip(S.safe_ratio(F.lit(0.1), F.col("vol")), 0.25, 2.0)
    scale = daily.withColumn("now", now).select("day", "gross", F.coalesce(F.lag("now").over(w), F.lit(1.0)).alias("scale"))
    mean = scale.filter("gross > 0").agg(F.avg("scale").alias("mean_scale"))
    p = p.join(scale.select("day", "scale"), "day").join(F.broadcast(mean))
    books = F.explode(F.array(F.struct(F.lit("target").alias("book"), F.col("scale").alias("x")), F.struct(F.lit("constant").alias("book"), F.col("mean_scale").alias("x"))))
    p = p.withColumn("b", books).select("symbol", "day", "ret", "cash", "mean_scale", F.col("b.book").alias("book"), (F.col("weight") * F.col("b.x")).alias("weight"))
    out = A.trimmed(A.account(p.drop("mean_scale"), COST, ["book"]), ["book"])
    g = out.groupBy("book").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("net") / F.nullif(F.stddev_samp("net"), F.lit(0.0)) * 52**0.5, 6).alias("sharpe"), F.round(F.stddev_samp("net") * 52**0.5 * 100, 6).alias("annual_vol"),
        F.round(F.avg("gross"), 6).alias("gross"))
    return g.join(F.broadcast(mean.select(F.round("mean_scale", 6).alias("mean_scale"))))


_RANK = "(rank() OVER (PARTITION BY day ORDER BY {x}) + (count(*) OVER (PARTITION BY day, {x}) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY day)"
_PAIR = f""", q AS (SELECT symbol, day, signal AS x, lead(ret) OVER (PARTITION BY symbol ORDER BY day) AS y FROM rets), k AS (SELECT * FROM q WHERE x IS NOT NULL AND y IS NOT NULL)
, r AS (SELECT symbol, day, {_RANK.format(x='x')} AS rx, {_RANK.format(x='y')} AS ry FROM k)"""


def ranked_pairs(spark, d):
    p = week_panel(spark, d).select("symbol", "day", F.col("signal").alias("x"), F.lead("ret").over(S.over()).alias("y")).dropna()
    return p.withColumns({"rx": S.average_rank(F.col("x"), "day"), "ry": S.average_rank(F.col("y"), "day")})


@query("x5_rank_residuals", T.with_sql(NAMES, WEEK + _PAIR + """
, e AS (SELECT *, regr_slope(ry, rx) OVER (PARTITION BY day) AS slope, avg(rx) OVER (PARTITION BY day) AS mx, avg(ry) OVER (PARTITION BY day) AS my FROM r)
SELECT symbol, day::VARCHAR AS day, round(coalesce(slope, 0), 8) AS slope, round(ry - my - coalesce(slope, 0) * (rx - mx), 8) + 0.0 AS residual FROM e"""))
def rank_residuals(spark, d):
    """Ranks of the next return on ranks of the signal, day by day: slope and what it leaves."""
    day = Window.partitionBy("day")
    mx, my = F.avg("rx").over(day), F.avg("ry").over(day)
    slope = F.coalesce(F.regr_slope("ry", "rx").over(day), F.lit(0.0))
    r = ranked_pairs(spark, d).withColumns({"slope": slope, "mx": mx, "my": my})
    left = F.col("ry") - F.col("my") - F.col("slope") * (F.col("rx") - F.col("mx"))
    return r.select("symbol", S.day_text(), F.round("slope", 8).alias("slope"), (F.round(left, 8) + 0.0).alias("residual"))


@query("x6_mean_rank_correlation", T.with_sql(NAMES, WEEK + _PAIR + """
, c AS (SELECT day, corr(rx, ry) AS c, count(*) AS n FROM r GROUP BY day HAVING count(*) >= 5)
SELECT count(c) AS n_days, round(avg(c), 8) AS mean_correlation, round(stddev_samp(c), 8) AS deviation, round(avg((c > 0)::INT), 6) AS positive FROM c WHERE NOT isnan(c)"""))
def mean_rank_correlation(spark, d):
    """The correlation of ranks of each day with five names or more, and its mean over days."""
    c = ranked_pairs(spark, d).groupBy("day").agg(F.corr("rx", "ry").alias("c"), F.count(F.lit(1)).alias("n")).filter("n >= 5 AND c IS NOT NULL AND NOT isnan(c)")
    return c.agg(F.count("c").alias("n_days"), F.round(F.avg("c"), 8).alias("mean_correlation"), F.round(F.stddev_samp("c"), 8).alias("deviation"), F.round(F.avg((F.col("c") > 0).cast("int")), 6).alias("positive"))


@query("g10_income_months", """
WITH o AS (SELECT DISTINCT o_orderdate::TIMESTAMP AS ts, o_orderpriority AS kind, o_custkey, round(o_totalprice / 1e3, 4) AS income FROM orders)
, m AS (SELECT date_trunc('month', ts) AS a, kind, count(*) AS n, round(sum(income), 4) AS total FROM o GROUP BY ALL)
SELECT strftime(a, '%Y-%m-%d') AS month_start, strftime(a + INTERVAL '1 month' - INTERVAL '1 day', '%Y-%m-%d') AS month_end, kind, n, total, round(sum(total) OVER (PARTITION BY a), 4) AS month_total FROM m""")
def income_months(spark, d):
    """Income by type and calendar month with the month's bounds; rows that agree in time, type,
    account and amount count once; the month's total beside each type."""
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_orderpriority").alias("kind"), "o_custkey", F.round(F.col("o_totalprice") / 1e3, 4).alias("income")).distinct()
    m = o.groupBy(F.trunc("ts", "month").alias("a"), "kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("income"), 4).alias("total"))
    whole = F.round(F.sum("total").over(Window.partitionBy("a")), 4)
    return m.select(F.col("a").cast("string").alias("month_start"), F.last_day("a").cast("string").alias("month_end"), "kind", "n", "total", whole.alias("month_total"))


@query("g12_compounded_months", T.with_sql(NAMES, WEEK + """
, m AS (SELECT strftime(day, '%Y-%m') AS month, count(*) AS n, (product(1 + net) - 1) * 100 AS pct, sum(net) * 1e4 AS bps FROM live GROUP BY 1)
SELECT month, n, round(pct, 6) AS compounded_pct, round(bps, 4) AS sum_bps, month = (SELECT arg_min(month, (round(pct, 6), month)) FROM m) AS worst FROM m"""))
def compounded_months(spark, d):
    """The product of each month's returns, their sum, and which month is the worst."""
    net = A.trimmed(A.account(week_weights(spark, d), COST))
    m = net.groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.round((F.product(1 + F.col("net")) - 1) * 100, 6).alias("compounded_pct"), F.round(F.sum("net") * 1e4, 4).alias("sum_bps"))
    worst = F.min(F.struct("compounded_pct", "month")).over(Window.partitionBy(F.lit(0)))["month"]  # one row a month
    return m.withColumn("worst", F.col("month") == worst)


#: Trailing periods of the signal's health, least Sharpe, least gap while the Sharpe is under the safe one, level of the cash flow.
WINDOW, LOW, GAP, SAFE, LEVEL = 52, -3.0, 0.3, 1.0, 0.0
_SIDE = "(rank() OVER (PARTITION BY src, day, x IS NULL ORDER BY x) + (count(*) OVER (PARTITION BY src, day, x IS NULL, x) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY src, day, x IS NULL)"


@query("e20_two_signals", T.with_sql("wl", _BOOKS[: _BOOKS.index(", c1 AS")] + f"""
, si AS (SELECT 'a' AS src, symbol, day, ra, fa, sa AS x FROM sg UNION ALL SELECT 'b', symbol, day, ra, fa, sb FROM sg), rk AS (SELECT *, CASE WHEN x IS NOT NULL THEN {_SIDE} END AS k FROM si)
, tl AS (SELECT *, count(CASE WHEN k >= 1 - 0.2::DOUBLE THEN 1 END) OVER (PARTITION BY src, day) AS nt, count(CASE WHEN k <= 0.2::DOUBLE THEN 1 END) OVER (PARTITION BY src, day) AS nb FROM rk)
, tt AS (SELECT *, CASE WHEN nt = 0 OR nb = 0 THEN 0 WHEN k >= 1 - 0.2::DOUBLE THEN -0.5::DOUBLE / nt WHEN k <= 0.2::DOUBLE THEN 0.5::DOUBLE / nb ELSE 0 END AS t FROM tl)
, tw AS (SELECT *, CASE WHEN ra IS NOT NULL THEN coalesce(lag(t) OVER (PARTITION BY src, symbol ORDER BY day), 0) ELSE 0 END AS w FROM tt)
, tm AS (SELECT *, abs(w - coalesce(lag(w) OVER (PARTITION BY src, symbol ORDER BY day), 0)) AS m FROM tw)
, td AS (SELECT src, day, sum(w * coalesce(ra, 0)) - sum(w * coalesce(fa, 0)) - sum(m) * 0.001::DOUBLE AS net FROM tm GROUP BY src, day)
, tv AS (SELECT src, day, CASE WHEN count(net) OVER q >= {WINDOW} THEN avg(net) OVER q / nullif(stddev_samp(net) OVER q, 0) * sqrt(52) END AS sharpe FROM td WINDOW q AS (PARTITION BY src ORDER BY day ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW))
, lv AS (SELECT day, median(sa) / 7 * 52 AS level FROM sg GROUP BY day), h AS (SELECT a.day, round(a.sharpe, 6) AS own, round(b.sharpe, 6) AS other, round(a.sharpe - b.sharpe, 6) AS gap, round(level, 8) AS level
    FROM tv a JOIN tv b ON b.src = 'b' AND b.day = a.day JOIN lv ON lv.day = a.day WHERE a.src = 'a' AND a.sharpe IS NOT NULL AND b.sharpe IS NOT NULL)
SELECT day::VARCHAR AS day, own, other, gap, level, concat_ws('|', CASE WHEN own < {LOW} THEN 'SIGNAL:low' END, CASE WHEN gap < {GAP} AND own < {SAFE} THEN 'SIGNAL:converging' END, CASE WHEN level > {LEVEL} THEN 'REGIME:level' END) AS alerts FROM h"""))
def two_signals(spark, d):
    """The trailing Sharpe of one book under the signal of its own venue and under the other's, the
    gap between them, the market's median cash flow and the alerts that follow, period by period."""
    p = venue_grid(spark, d).select("symbol", "day", F.col("ret_a").alias("ret"), F.col("cash_a").alias("cash"), "sa", "sb")
    w = Window.partitionBy(F.lit(0)).orderBy("day")  # one row a period
    trailing = {}
    for name, signal in (("own", "sa"), ("other", "sb")):
        net = A.account(X.tail_weights(p, signal, 0.2, flip=-1), COST)
        sharpe = S.safe_ratio(S.rolling(F.col("net"), WINDOW, WINDOW, w), S.rolling(F.col("net"), WINDOW, WINDOW, w, F.stddev_samp)) * PERIODS**0.5
        trailing[name] = net.select("day", sharpe.alias(name)).dropna()
    level = p.groupBy("day").agg(F.round(F.median("sa") / 7 * PERIODS, 8).alias("level"))
    h = trailing["own"].join(trailing["other"], "day").join(level, "day")
    h = h.select("day", F.round("own", 6).alias("own"), F.round("other", 6).alias("other"), F.round(F.col("own") - F.col("other"), 6).alias("gap"), "level")
    alerts = F.concat_ws("|", F.when(F.col("own") < LOW, "SIGNAL:low"), F.when((F.col("gap") < GAP) & (F.col("own") < SAFE), "SIGNAL:converging"), F.when(F.col("level") > LEVEL, "REGIME:level"))
    return h.select(S.day_text(), "own", "other", "gap", "level", alerts.alias("alerts"))
