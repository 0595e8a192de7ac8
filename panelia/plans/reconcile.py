"""Queries that reconcile two tables (survey J12, J13, E13, E14, E16, E18)."""

from pyspark.sql import functions as F

from panelia.functions import series as S
from panelia.operators import reconcile as R
from panelia.plans.registry import query
from panelia.sources import stand_ins as T
from panelia.sources.tables import load


def _side(letter):
    return f"SELECT part, count(*)::VARCHAR AS n, max(qty)::BIGINT::VARCHAR AS largest, min(qty)::BIGINT::VARCHAR AS smallest FROM fill WHERE status = '{letter}' GROUP BY part"


@query("j12_field_differences", T.with_sql("fill", f"""
, a AS ({_side('F')}), b AS ({_side('O')}), ta AS (UNPIVOT a ON n, largest, smallest INTO NAME field VALUE "left"), tb AS (UNPIVOT b ON n, largest,
    smallest INTO NAME field VALUE "right")
SELECT part, field, "left", "right", CASE WHEN "left" IS NULL THEN 'only right' WHEN "right" IS NULL THEN 'only left' ELSE 'differs' END AS state FROM ta FULL
    JOIN tb USING (part, field) WHERE "left" IS DISTINCT FROM "right" """))
def field_differences(spark, d):
    f = T.fills(spark, d)
    side = lambda s: f.filter(F.col("status") == s).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.max("qty").alias("largest"), F.min("qty").alias("smallest"))
    return R.field_differences(side("F"), side("O"), "part", ["n", "largest", "smallest"])


@query("j13_coverage_gaps", """
WITH e AS (SELECT o_orderkey AS order_id FROM orders), r AS (SELECT l_orderkey AS order_id, count(*) AS n FROM lineitem WHERE l_linenumber = 1 GROUP BY l_orderkey)
SELECT order_id, CASE WHEN r.n IS NULL THEN 'missing' WHEN e.order_id IS NULL THEN 'unexpected' ELSE 'repeated' END AS problem FROM e FULL JOIN r USING (order_id)
    WHERE r.n IS NULL OR e.order_id IS NULL OR r.n > 1""")
def coverage_gaps(spark, d):
    e = load(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"))
    r = load(spark, d, "lineitem").filter("l_linenumber = 1").select(F.col("l_orderkey").alias("order_id"))
    return R.coverage_gaps(e, r, "order_id")


@query("e13_exact_flows", T.with_sql("bars_day settle", """
, w AS (SELECT symbol, day, (CASE WHEN close > open THEN 1 ELSE -1 END) / 100::DOUBLE AS weight FROM bars_day), o AS (SELECT *,
    coalesce(lag(weight) OVER (PARTITION BY symbol ORDER BY day), 0) AS old FROM w)
, x AS (SELECT day, -sum(rate * CASE WHEN hour(ts) < 8 THEN old ELSE weight END) AS correction, count(*) AS n_flows FROM settle JOIN o USING (symbol, day) GROUP BY day)
SELECT day::VARCHAR AS day, round(correction * 1e4, 8) AS correction_bps, n_flows, n_flows >= 8 AS complete, bool_and(n_flows >= 8) OVER (ORDER BY day) AS in_prefix FROM x"""))
def exact_flows(spark, d):
    w = T.bars_day(spark, d).select("symbol", "day", (F.when(F.col("close") > F.col("open"), 1).otherwise(-1) / 100).alias("weight"))
    x = R.exact_flows(w, T.settlements(spark, d), 8)
    return x.select(S.day_text(), F.round(F.col("correction") * 1e4, 8).alias("correction_bps"), "n_flows", "complete", "in_prefix")


@query("e14_tracking", T.with_sql("decision", """
, p AS (SELECT day, sum(pnl) AS paper FROM decision WHERE side = 'LONG' AND day <> DATE '2024-01-07' GROUP BY day), a AS (SELECT day, sum(pnl) AS actual
    FROM decision WHERE side = 'LONG' AND k % 9 <> 0 AND day <> DATE '2024-01-11' GROUP BY day)
SELECT day::VARCHAR AS day, round(actual - paper, 9) AS gap, paper IS NOT NULL AND actual IS NOT NULL AS clean,
    round(coalesce(sum(actual - paper) OVER (ORDER BY day), 0), 9) AS divergence FROM p FULL JOIN a USING (day)"""))
def tracking(spark, d):
    x = T.decisions(spark, d).filter("side = 'LONG'")
    paper = x.filter("day <> DATE '2024-01-07'").groupBy("day").agg(F.sum("pnl").alias("paper"))
    actual = x.filter("k % 9 <> 0 AND day <> DATE '2024-01-11'").groupBy("day").agg(F.sum("pnl").alias("actual"))
    t = R.tracking(paper, actual, "day")
    return t.select(S.day_text(), F.round("gap", 9).alias("gap"), "clean", F.round("divergence", 9).alias("divergence"))


@query("e17_least_budgets", T.with_sql("fill", """
, s AS (SELECT status AS book, part, round(avg(price), 6) AS price FROM fill GROUP BY ALL), w AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY book) AS weight FROM s)
, q AS (SELECT *, ceil(round(5 / price / 0.001, 6)) * 0.001 AS by_value, 0.01 AS by_lot FROM w)
, b AS (SELECT *, round(greatest(by_value, by_lot) * price / weight, 2) AS budget, CASE WHEN by_value >= by_lot THEN 'minNotional' ELSE 'minQty' END AS binds_on FROM q)
SELECT book, count(*) AS n_names, max(budget) AS least_budget, arg_max(part, (budget, -part)) AS binding_part, arg_max(binds_on, (budget, -part)) AS binds_on,
    count(*) FILTER (binds_on = 'minQty') AS n_by_lot FROM b GROUP BY book"""))
def least_budgets(spark, d):
    """The least budget with which every name of a book gets its smallest order, and the name
    that binds it."""
    s = T.fills(spark, d).groupBy(F.col("status").alias("book"), "part").agg(F.round(F.avg("price"), 6).alias("price"))
    n = s.groupBy("book").agg(F.count(F.lit(1)).alias("n"))
    by_value = F.ceil(F.round(5 / F.col("price") / 0.001, 6)) * 0.001
    q = s.join(n, "book").withColumns({"by_value": by_value, "weight": 1 / F.col("n")})
    budget = F.round(F.greatest(F.col("by_value"), F.lit(0.01)) * F.col("price") / F.col("weight"), 2)
    b = q.withColumns({"budget": budget, "binds_on": F.when(F.col("by_value") >= 0.01, "minNotional").otherwise("minQty")})
    last = F.struct("budget", -F.col("part"))
    return b.groupBy("book").agg(
        F.count(F.lit(1)).alias("n_names"), F.max("budget").alias("least_budget"), F.max_by("part", last).alias("binding_part"),
        F.max_by("binds_on", last).alias("binds_on"), F.count_if(F.col("binds_on") == "minQty").alias("n_by_lot"))


@query("e16_e18_exposure", T.with_sql("fill", """
, w AS (SELECT run, part, sum(CASE side WHEN 'BUY' THEN 1 ELSE -1 END) / count(*) OVER (PARTITION BY run) AS weight, avg(price / reference - 1) AS drift FROM fill
    GROUP BY run, part)
SELECT run::VARCHAR AS run, count(*) AS n, coalesce(bool_and(weight BETWEEN -1 AND 1), false) AND sum(abs(weight)) <= 1.000001 AS within_limits, round(sum(weight),
    6) AS net, round(median(abs(drift)), 8) AS median_drift, count(*) FILTER (abs(drift) > 0.5) AS n_drifted FROM w GROUP BY run"""))
def exposure(spark, d):
    """Exposure limits of each book and drift of prices from their reference."""
    from pyspark.sql.window import Window

    f = T.fills(spark, d).groupBy("run", "part").agg(F.sum(F.when(F.col("side") == "BUY", 1).otherwise(-1)).alias("s"),
        F.avg(F.col("price") / F.col("reference") - 1).alias("drift"))
    w = f.withColumn("weight", F.col("s") / F.count(F.lit(1)).over(Window.partitionBy("run")))
    limits = F.coalesce(F.every(F.col("weight").between(-1, 1)), F.lit(False)) & (F.sum(F.abs("weight")) <= 1.000001)
    return w.groupBy(F.col("run").cast("string").alias("run")).agg(
        F.count(F.lit(1)).alias("n"), limits.alias("within_limits"), F.round(F.sum("weight"), 6).alias("net"), F.round(F.median(F.abs("drift")),
            8).alias("median_drift"), F.count(F.when(F.abs("drift") > 0.5, 1)).alias("n_drifted"))
