"""Summaries of trades: profit factors, additive drawdown, proof of routes, admission."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelia.operators.ranges import running


def trade_columns(x: str = "pnl") -> list[Column]:
    """n, total, mean_bps, win and the profit factor under its three rules (G4): null without a loss,
    99 if there are gains only, and ``endless`` where it would be infinite."""
    c = F.col(x)
    won, lost = F.coalesce(F.sum(F.when(c > 0, c)), F.lit(0.0)), F.coalesce(-F.sum(F.when(c < 0, c)), F.lit(0.0))
    ratio = F.round(won / F.nullif(lost, F.lit(0.0)), 6)
    endless = (lost == 0) & (won > 0)
    return [
        F.count(c).alias("n"), F.round(F.sum(c), 6).alias("total"), F.round(F.avg(c) * 1e4, 4).alias("mean_bps"), F.round(F.avg((c > 0).cast("int")), 6).alias("win"),
        ratio.alias("profit_factor"), F.when(endless, 99.0).otherwise(ratio).alias("profit_factor_99"), endless.alias("endless"),
    ]


def additive_drawdowns(rows: DataFrame, by: list[str], time: str, x: str, *ties: str) -> DataFrame:
    """(*by, max_dd_bps): the deepest fall of each group's running sum below its peak so far. Groups
    are scanned in ranges of time, so a group with a large share of all rows is split."""
    g = rows.withColumn("_g", F.to_json(F.struct(*by)))
    summed = running(g, "_g", time, {"_sum": ("sum", F.col(x))}, *ties)
    peaked = running(summed, "_g", time, {"_peak": ("max", F.col("_sum"))}, *ties)
    return peaked.groupBy(*by).agg(F.round(F.min(F.col("_sum") - F.col("_peak")) * 1e4, 4).alias("max_dd_bps"))


def trade_summary(rows: DataFrame, by: list[str], time: str, *ties: str) -> DataFrame:
    """One record for each group of closed trades."""
    closed = rows.filter("pnl IS NOT NULL")
    return closed.groupBy(*by).agg(*trade_columns()).join(additive_drawdowns(closed, by, time, "pnl", *ties), by)


def route(reason: Column, prior: Column) -> Column:
    """The route of a decision by its reason and the state of its symbol: the first rule that holds."""
    r, p = F.upper(F.coalesce(reason, F.lit(""))), F.upper(F.coalesce(prior, F.lit("")))
    # fixed values: labels and the words that lead to them
    return (
        F.when(r.contains("CANARY_MIRROR") | p.contains("SHORT0_CANARY_MIRROR"), "CANARY_MIRROR")
        .when(r.contains("SHORT0_CANARY_EXACT_BUCKET") | p.contains("SHORT0_CANARY_EXACT_BUCKET"), "CANARY_EXACT_BUCKET")
        .when(r.contains("MIRROR") | (p == "MIRROR_SHORT_FROM_LONG_R0"), "MIRROR_SHORT")
        .when(r.contains("SCOUT"), "SCOUT")
        .when(r.contains("DISCOVERY") | p.startswith("DISCOVERY_"), "DISCOVERY")
        .when(r.contains("STRICT_SYMBOL") | p.isin("PROMOTE_SYMBOL", "ADAPTIVE_PROMOTE_SYMBOL"), "STRICT_PROMOTE")
        .otherwise("UNKNOWN")
    )


def route_proof(rows: DataFrame, now: Column, window: int = 60) -> DataFrame:
    """(route, n, total, profit_factor, ..., days, newest, age_hours, drawdown) over the last ``window``
    closed trades of each route (G16). The cut to the last ones happens before the shuffle."""
    latest = Window.partitionBy("route").orderBy(F.desc("ts"), F.desc("event_id"))
    last = rows.filter("pnl IS NOT NULL").withColumn("_r", F.row_number().over(latest)).filter(F.col("_r") <= window)
    onward = Window.partitionBy("route").orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0)
    curve = last.withColumn("_sum", F.sum("pnl").over(onward))
    curve = curve.withColumn("_fall", F.col("_sum") - F.max("_sum").over(onward))
    newest = F.max("ts")
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(newest.cast("timestamp"))) / 3.6e9
    return curve.groupBy("route").agg(*trade_columns(), F.countDistinct(F.to_date("ts")).alias("days"), newest.alias("newest"), F.round(age, 4).alias("age_hours"), F.round(F.min("_fall"), 8).alias("drawdown"))


#: Policy of a route: mode, least probability, greatest stop risk, size, whether paper trades may go without a
#: stop risk, and what its proof must show: trades, profit factor, days, age in hours and drawdown (0: no demand).
POLICY = "route string, mode string, min_proba double, max_stop double, size double, unproven boolean, min_n long, min_factor double, min_days long, max_age double, max_fall double"


def admitted(rows: DataFrame, proofs: DataFrame, policy: DataFrame, default: dict) -> DataFrame:
    """``rows`` (route, proba, stop_risk, live) with admitted, mode, reason and size (Q7): the first
    demand of the route's policy that is not met is the reason. A route without policy follows
    ``default``, one without proof has no trades. Both tables have a row a route."""
    x = rows.join(F.broadcast(policy), "route", "left").fillna(default)
    x = x.join(F.broadcast(proofs.select("route", "n", "profit_factor", "endless", "days", "age_hours", "drawdown")), "route", "left").fillna({"n": 0, "days": 0, "endless": False})
    c, text = F.col, F.format_string
    weak = ~c("endless") & (c("profit_factor").isNull() | (c("profit_factor") < c("min_factor")))
    old = c("age_hours").isNull() | (c("age_hours") > c("max_age"))
    blocked = (
        F.when(c("mode").isin("DISABLED", "RESEARCH_ONLY"), F.concat(F.lit("ROUTE_"), c("mode")))
        .when(c("proba") < c("min_proba"), text("ROUTE_PROBA_BLOCK:%.3f<%.2f", c("proba"), c("min_proba")))
        .when(c("n") < c("min_n"), text("ROUTE_PROOF_WARMUP:%d<%d", c("n"), c("min_n")))
        .when((c("min_factor") > 0) & weak, F.concat(F.lit("ROUTE_PROOF_BLOCK:PF"), F.when(c("profit_factor").isNull(), "nan").otherwise(text("%.2f", c("profit_factor"))), text("<%.2f", c("min_factor"))))
        .when(c("days") < c("min_days"), text("ROUTE_DAY_DIVERSITY_BLOCK:%d<%d", c("days"), c("min_days")))
        .when((c("max_age") > 0) & old, F.lit("ROUTE_STALE_PROOF"))
        .when((c("max_fall") > 0) & (c("drawdown") < -c("max_fall")), text("ROUTE_DRAWDOWN_BLOCK:%.4f<-%.4f", c("drawdown"), c("max_fall")))
        .when(c("stop_risk").isNull() & ~((c("mode") == "PAPER_ONLY") & c("unproven") & ~c("live")), F.lit("STOP_HIT_MODEL_UNAVAILABLE"))
        .when(c("stop_risk") > c("max_stop"), text("STOP_HIT_RISK_BLOCK:%.3f>%.2f", c("stop_risk"), c("max_stop")))
    )
    paper = (c("mode") == "PAPER_ONLY") | ~c("live")
    reason = F.when(c("stop_risk").isNull(), "ROUTE_PAPER_APPROVED_MODEL_PENDING").when(paper, "ROUTE_PAPER_APPROVED").otherwise("ROUTE_LIVE_APPROVED")
    ok = blocked.isNull()
    return x.select(
        *rows.columns, ok.alias("admitted"), F.when(ok, F.when(paper, "PAPER_ONLY").otherwise("LIVE")).otherwise(c("mode")).alias("mode"),
        F.coalesce(blocked, reason).alias("reason"), F.when(ok, c("size")).otherwise(0.0).alias("size"),
    )
