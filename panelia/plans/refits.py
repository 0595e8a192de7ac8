"""Queries of many fits at once (survey N6, M10)."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelia.functions import series as S
from panelia.operators import refits as R
from panelia.plans.accounting import NAMES, WEEK, week_panel
from panelia.plans.registry import query
from panelia.session import ship_package
from panelia.sources import stand_ins as T

REFITS, BLOCK, ALPHA, COST = 40, 12, 1e-4, 0.0002
#: Fold f tests places FOLD * f to FOLD * (f + 1) - 1 of each symbol; the place before is purged.
FOLD = 100
FEATURES = ["signal", "before"]

#: Closed form of a ridge fit with two features, from centred sums.
_FIT2 = """
, {name} AS (SELECT {by}, n, (sxy * (syy + {alpha}) - szy * sxz) / ((sxx + {alpha}) * (syy + {alpha}) - sxz * sxz) AS b1,
    (szy * (sxx + {alpha}) - sxy * sxz) / ((sxx + {alpha}) * (syy + {alpha}) - sxz * sxz) AS b2, mx, mz, my FROM (
  SELECT {by}, count(*) AS n, avg({x}) AS mx, avg({z}) AS mz, avg({y}) AS my, sum({x} * {x}) - count(*) * avg({x}) * avg({x}) AS sxx,
    sum({z} * {z}) - count(*) * avg({z}) * avg({z}) AS syy, sum({x} * {z}) - count(*) * avg({x}) * avg({z}) AS sxz,
    sum({x} * {y}) - count(*) * avg({x}) * avg({y}) AS sxy, sum({z} * {y}) - count(*) * avg({z}) * avg({y}) AS szy FROM {rows} GROUP BY {by}))"""


@query("n6_block_refit", T.with_sql(NAMES, WEEK + f"""
, p0 AS (SELECT symbol, ret, signal * 1000 AS signal, before, row_number() OVER (PARTITION BY symbol ORDER BY day) - 1 AS n FROM (
    SELECT symbol, day, ret, signal, lag(ret) OVER (PARTITION BY symbol ORDER BY day) AS before FROM rets) WHERE ret IS NOT NULL AND signal IS NOT NULL AND before IS NOT NULL)
, bl AS (SELECT DISTINCT draw, symbol, n // {BLOCK} AS block FROM p0 CROSS JOIN range({REFITS}) t(draw))
, od AS (SELECT *, md5(concat_ws('|', '9', draw, symbol, block)) AS o FROM bl)
, mv AS (SELECT draw, p0.symbol, row_number() OVER (PARTITION BY draw, p0.symbol ORDER BY o, n) - 1 AS n, ret AS y FROM p0 JOIN od ON od.symbol = p0.symbol AND od.block = p0.n // {BLOCK}
    UNION ALL SELECT -1, symbol, n, ret FROM p0)
, al AS (SELECT mv.draw, mv.y, p0.n, p0.signal, p0.before, f AS fold FROM mv JOIN p0 USING (symbol, n) CROSS JOIN range(1, 4) g(f) WHERE p0.n < {FOLD} * (f + 1) AND p0.n <> {FOLD} * f - 1)
, tr AS (SELECT * FROM al WHERE n < {FOLD} * fold)""" + _FIT2.format(name="ft", by="draw, fold", x="signal", z="before", y="y", rows="tr", alpha=f"{ALPHA}::DOUBLE") + f"""
, tk AS (SELECT al.draw, al.y - {COST}::DOUBLE AS net FROM al JOIN ft USING (draw, fold) WHERE al.n >= {FOLD} * fold AND my + b1 * (signal - mx) + b2 * (before - mz) > {COST}::DOUBLE)
, bp AS (SELECT draw, count(*) AS n_taken, avg(net) * 1e4 AS bps FROM tk GROUP BY draw), ob AS (SELECT bps AS observed FROM bp WHERE draw = -1)
SELECT draw, n_taken, round(bps, 6) AS bps, round((count(*) FILTER (draw >= 0 AND bps >= observed) OVER () + 1) / (count(*) FILTER (draw >= 0) OVER () + 1)::DOUBLE, 8) AS p
FROM bp, ob"""))
def block_refit(spark, d):
    """Outcomes shuffled in blocks of twelve within each symbol, the ridge of every fold fitted
    again for every draw, test rows with a predicted gain above cost taken; draw -1 is the observed
    one. All fits come from one grouped pass; the p-value is the share of draws that do as well."""
    ship_package(spark)
    by_symbol = Window.partitionBy("symbol").orderBy("day")
    p = week_panel(spark, d).select("symbol", "day", "ret", (F.col("signal") * 1000).alias("signal"), F.lag("ret").over(by_symbol).alias("before")).dropna()
    p = p.withColumn("n", F.row_number().over(by_symbol).cast("bigint") - 1).drop("day")
    rows = R.block_shuffled(p, "symbol", "n", "ret", BLOCK, REFITS, "9").join(p.drop("ret"), ["symbol", "n"])
    rows = rows.withColumn("fold", F.explode(F.array(*map(F.lit, (1, 2, 3)))))
    start = F.col("fold") * FOLD
    rows = rows.filter((F.col("n") < start + FOLD) & (F.col("n") != start - 1))
    fits = R.ridges(R.grams(rows.filter(F.col("n") < start), ["draw", "fold"], FEATURES, "shuffled"), ["draw", "fold"], 2, ALPHA)
    # one row a draw and fold
    tested = rows.filter(F.col("n") >= start).join(F.broadcast(fits.drop("n")), ["draw", "fold"])
    taken = tested.filter(R.predicted(FEATURES) > COST).groupBy("draw").agg(F.count(F.lit(1)).alias("n_taken"), (F.avg(F.col("shuffled") - COST) * 1e4).alias("bps"))
    every = Window.partitionBy(F.lit(0))
    null = F.col("draw") >= 0
    met = taken.withColumn("observed", F.max(F.when(~null, F.col("bps"))).over(every)).filter("observed IS NOT NULL")
    reached = F.count_if(null & (F.col("bps") >= F.col("observed"))).over(every)
    return met.select("draw", "n_taken", F.round("bps", 6).alias("bps"), F.round((reached + 1) / (F.count_if(null).over(every) + 1), 8).alias("p"))


#: (horizon, stop, target) of each cell, and the costs with whether a strategy can have them: one
#: that leaves by a stop cannot rest both of its orders.
CELLS = [(1, 0.2, 0.3), (2, 0.2, 0.3), (2, 0.4, 0.6), (5, 0.2, 0.3), (5, 0.4, 0.6), (5, 0.6, 0.6)]
COSTS = [("rest_both", 0.0006, False), ("rest_entry", 0.0012, True), ("at_market", 0.0015, True)]
#: A cell needs so many train rows; train ends before the cut, test begins there.
LEAST_ROWS, CUT = 100, "2024-01-20"

_CELLS = ", ".join(f"({h}, {s}::DOUBLE, {t}::DOUBLE)" for h, s, t in CELLS)
_COSTS = ", ".join(f"('{n}', {c}::DOUBLE, {str(f).lower()})" for n, c, f in COSTS)
_GRID = f"""
, ix AS (SELECT *, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY day), 0) - 1 AS step, (high - low) / nullif(close, 0) AS spread,
    row_number() OVER (PARTITION BY symbol ORDER BY day) AS n, count(*) OVER (PARTITION BY symbol) AS tot FROM bars_day)
, ce AS (SELECT * FROM (VALUES {_CELLS}) v(horizon, stop, target))
, pt AS (SELECT a.symbol, a.day, a.step, a.spread, horizon, stop, target, b.n - a.n AS k, b.day AS bday, b.close / a.close - 1 AS drift,
    b.low <= a.close * (1 - stop) AS ll, b.high >= a.close * (1 + target) AS lw, b.high >= a.close * (1 + stop) AS sl, b.low <= a.close * (1 - target) AS sw
  FROM ix a CROSS JOIN ce JOIN ix b ON a.symbol = b.symbol AND b.n > a.n AND b.n <= a.n + horizon WHERE a.n + horizon <= a.tot)
, gr AS (SELECT symbol, day, step, spread, horizon, stop, target, coalesce(arg_min(CASE WHEN ll THEN -stop ELSE target END, k) FILTER (ll OR lw), arg_max(drift, k)) AS long_gross,
    coalesce(arg_min(CASE WHEN sl THEN -stop ELSE target END, k) FILTER (sl OR sw), -arg_max(drift, k)) AS short_gross, max(bday) AS "end" FROM pt GROUP BY ALL)"""


def label_grid(spark, d):
    close = F.col("close")
    b = T.bars_day(spark, d).withColumns({"step": S.pct_change(close, 1, S.over()), "spread": S.safe_ratio(F.col("high") - F.col("low"), close)})
    return R.touch_grid(b, "symbol", "day", CELLS)


@query("m10_label_grid", T.with_sql("bars_day", _GRID + """
SELECT horizon, stop, target, count(*) AS n, round(avg(long_gross), 6) AS mean_long, round(avg(short_gross), 6) AS mean_short,
    count(*) FILTER (long_gross > 0) AS n_long_won, count(*) FILTER (short_gross > 0) AS n_short_won, max("end")::VARCHAR AS latest FROM gr GROUP BY ALL"""))
def label_cells(spark, d):
    """Outcomes of every (horizon, stop, target), from one path of the longest horizon."""
    return label_grid(spark, d).groupBy("horizon", "stop", "target").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("long_gross"), 6).alias("mean_long"), F.round(F.avg("short_gross"), 6).alias("mean_short"),
        F.count_if(F.col("long_gross") > 0).alias("n_long_won"), F.count_if(F.col("short_gross") > 0).alias("n_short_won"), F.max("end").cast("string").alias("latest"))


_BY = "side, horizon, stop, target"


@query("m10_sweep", T.with_sql("bars_day", _GRID + f"""
, sd AS (SELECT 'LONG' AS side, *, long_gross AS y FROM gr UNION ALL SELECT 'SHORT', *, short_gross FROM gr), ok AS (SELECT * FROM sd WHERE step IS NOT NULL AND spread IS NOT NULL)
, tr AS (SELECT * FROM ok WHERE "end" < DATE '{CUT}')""" + _FIT2.format(name="ft", by=_BY, x="step", z="spread", y="y", rows="tr", alpha="1.0::DOUBLE") + f"""
, te AS (SELECT {_BY}, y, my + b1 * (step - mx) + b2 * (spread - mz) AS f, ft.n AS n_train FROM ok JOIN ft USING ({_BY}) WHERE day >= DATE '{CUT}')
SELECT {_BY}, v.scheme, n_train, count(*) FILTER (f > cost) AS n_taken, round(avg(y - cost) FILTER (f > cost) * 1e4, 4) AS net_bps,
    round(avg((y > cost)::INT) FILTER (f > cost), 6) AS win_rate, v.achievable AND n_train >= {LEAST_ROWS} AND stop > cost AS feasible
FROM te CROSS JOIN (VALUES {_COSTS}) v(scheme, cost, achievable) GROUP BY {_BY}, v.scheme, v.achievable, n_train, cost"""))
def sweep(spark, d):
    """For each side and cell one ridge fit, all from one grouped pass; test rows with a predicted
    outcome above cost are taken, under every cost scheme. A cell is feasible if its costs can be
    had, it has enough train rows and its stop is wider than its cost."""
    ship_package(spark)
    sides = F.array(F.struct(F.lit("LONG").alias("side"), F.col("long_gross").alias("y")), F.struct(F.lit("SHORT").alias("side"), F.col("short_gross").alias("y")))
    g = label_grid(spark, d).select("day", "end", "step", "spread", "horizon", "stop", "target", F.explode(sides).alias("s")).select("*", "s.*").drop("s")
    by, cut = ["side", "horizon", "stop", "target"], F.lit(CUT).cast("date")
    fits = R.ridges(R.grams(g.filter(F.col("end") < cut), by, ["step", "spread"], "y"), by, 2, 1.0).withColumnRenamed("n", "n_train")
    costs = F.array(*[F.struct(F.lit(n).alias("scheme"), F.lit(c).alias("cost"), F.lit(f).alias("achievable")) for n, c, f in COSTS])
    t = g.filter(F.col("day") >= cut).dropna(subset=["step", "spread"]).join(F.broadcast(fits), by)  # one row a cell and side
    t = t.withColumn("f", R.predicted(["step", "spread"])).select(*by, "n_train", "y", "f", F.explode(costs).alias("c")).select("*", "c.*")
    own = lambda x: F.when(F.col("f") > F.col("cost"), x)
    a = t.groupBy(*by, "scheme", "cost", "achievable", "n_train").agg(
        F.count(own(F.lit(1))).alias("n_taken"), F.round(F.avg(own(F.col("y") - F.col("cost"))) * 1e4, 4).alias("net_bps"),
        F.round(F.avg(own((F.col("y") > F.col("cost")).cast("int"))), 6).alias("win_rate"))
    feasible = F.col("achievable") & (F.col("n_train") >= LEAST_ROWS) & (F.col("stop") > F.col("cost"))
    return a.select(*by, "scheme", "n_train", "n_taken", "net_bps", "win_rate", feasible.alias("feasible"))
