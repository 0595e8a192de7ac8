"""Queries of trade summaries, routes, ledger health and open rows (survey G4, G5, G16 to G18, G20, Q1 to Q4, Q7, P12)."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelia.operators import joins as J
from panelia.operators import trades as R
from panelia.plans.registry import query
from panelia.sources import stand_ins as T

STAMP = "yyyy-MM-dd HH:mm:ss"
NOW = "2024-01-31 12:00:00"

_WON, _LOST = "coalesce(sum(pnl) FILTER (pnl > 0), 0)", "coalesce(-sum(pnl) FILTER (pnl < 0), 0)"
_TRADES = f"""count(pnl) AS n, round(sum(pnl), 6) AS total, round(avg(pnl) * 1e4, 4) AS mean_bps, round(avg((pnl > 0)::INT), 6) AS win,
    round({_WON} / nullif({_LOST}, 0), 6) AS profit_factor, CASE WHEN {_LOST} = 0 AND {_WON} > 0 THEN 99 ELSE round({_WON} / nullif({_LOST}, 0), 6) END AS profit_factor_99,
    {_LOST} = 0 AND {_WON} > 0 AS endless"""
_FALL = """, c AS (SELECT *, sum(pnl) OVER (PARTITION BY {by} ORDER BY ts) AS cum FROM ledger WHERE pnl IS NOT NULL)
, fl AS (SELECT *, cum - max(cum) OVER (PARTITION BY {by} ORDER BY ts) AS fall FROM c)"""


@query("g4_trade_summary", T.with_sql("ledger", _FALL.format(by="side, regime") + f"""
SELECT side, regime, {_TRADES}, round(min(fall) * 1e4, 4) AS max_dd_bps FROM fl GROUP BY side, regime"""))
def trade_summary(spark, d):
    """Closed trades by side and regime, with the three profit-factor rules and the drawdown."""
    return R.trade_summary(T.ledger(spark, d), ["side", "regime"], "ts", "event_id")


@query("g20_edge_priors", T.with_sql("ledger", _FALL.format(by="symbol, side") + f"""
SELECT symbol, side, {_TRADES}, round(min(fall) * 1e4, 4) AS max_dd_bps, CASE WHEN count(pnl) < 5 THEN 'unknown' WHEN sum(pnl) > 0 AND {_WON} > {_LOST} THEN 'positive' ELSE 'negative' END AS status
FROM fl GROUP BY symbol, side"""))
def edge_priors(spark, d):
    """The record of each symbol and side, its drawdown and what it is taken for."""
    s = R.trade_summary(T.ledger(spark, d), ["symbol", "side"], "ts", "event_id")
    return s.withColumn("status", F.when(F.col("n") < 5, "unknown").when(F.col("total") > 0, "positive").otherwise("negative"))


#: Tables of attribution: name, filter, label; the table of buckets shows its worst twelve only.
TABLES = [
    ("actionable", "executable", "concat(side, '_Regime', regime)"), ("all", "true", "concat(side, '_Regime', regime)"), ("bucket", "true", "concat(side, '_R', regime, '_', bucket)"),
    ("exit", "exit_reason IS NOT NULL", "exit_reason"), ("layer", "true", "layer"), ("symbol", "true", "concat(symbol, '')"),
]


@query("g5_attribution_tables", T.with_sql("ledger", ", t AS (" + " UNION ALL ".join(f"SELECT '{n}' AS tab, {x} AS label, pnl FROM ledger WHERE pnl IS NOT NULL AND ({w})" for n, w, x in TABLES) + f""")
, s AS (SELECT tab, label, {_TRADES} FROM t GROUP BY tab, label), p AS (SELECT *, row_number() OVER (PARTITION BY tab ORDER BY total, label) AS place FROM s)
SELECT * FROM p WHERE tab <> 'bucket' OR place <= 12"""))
def attribution_tables(spark, d):
    """Six tables from one pass, each from its worst line on."""
    x = T.ledger(spark, d).filter("pnl IS NOT NULL")
    lines = F.array(*[F.when(F.expr(w), F.struct(F.lit(n).alias("tab"), F.expr(label).alias("label"))) for n, w, label in TABLES])
    s = x.select("pnl", F.explode(F.array_compact(lines)).alias("t")).groupBy("t.tab", "t.label").agg(*R.trade_columns())
    worst = Window.partitionBy("tab").orderBy("total", "label")  # lines, not trades
    return s.withColumn("place", F.row_number().over(worst)).filter("tab <> 'bucket' OR place <= 12")


@query("g17_discovery_candidates", T.with_sql("ledger", f"""
, g AS (SELECT symbol, bucket, {_TRADES} FROM ledger WHERE pnl IS NOT NULL AND NOT executable AND side = 'SHORT' AND regime = 0 GROUP BY symbol, side, regime, bucket HAVING count(*) >= 2)
SELECT *, row_number() OVER (ORDER BY round(total * 100, 3) DESC, endless DESC, profit_factor DESC NULLS LAST, symbol, bucket) AS place FROM g QUALIFY place <= 12"""))
def discovery_candidates(spark, d):
    """Symbols and probability buckets of shorts that were not traded, with two trades or more:
    the twelve with the greatest totals, then profit factors."""
    x = T.ledger(spark, d).filter("pnl IS NOT NULL AND NOT executable AND side = 'SHORT' AND regime = 0")
    g = x.groupBy("symbol", "side", "regime", "bucket").agg(*R.trade_columns()).filter("n >= 2")
    order = [F.desc(F.round(F.col("total") * 100, 3)), F.desc("endless"), F.desc_nulls_last("profit_factor"), "symbol", "bucket"]
    best = g.orderBy(*order).limit(12)
    return best.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))).drop("side", "regime")


@query("g18_recent_reasons", T.with_sql("ledger", """
, r AS (SELECT *, upper(coalesce(stage, '')) AS st, coalesce(reason, '') AS re FROM ledger WHERE ts >= (SELECT max(ts) FROM ledger) - INTERVAL '4320 minutes')
, n AS (SELECT 'stage' AS tab, CASE st WHEN '' THEN 'NA' ELSE st END AS label, count(*) AS n FROM r GROUP BY 2
  UNION ALL SELECT 'blocker', coalesce(nullif(CASE re WHEN '' THEN st ELSE re END, ''), 'NO_BLOCK_REASON'), count(*) FROM r WHERE rejected OR starts_with(st, 'REJECTED') GROUP BY 2)
SELECT tab, label, n, row_number() OVER (PARTITION BY tab ORDER BY n DESC, label) AS place FROM n QUALIFY place <= CASE tab WHEN 'stage' THEN 10 ELSE 12 END"""))
def recent_reasons(spark, d):
    """Stages and block reasons of the last three days before the newest row, most frequent first."""
    x = T.ledger(spark, d)
    newest = x.agg(F.max("ts").alias("newest"))  # one row
    r = x.join(F.broadcast(newest)).filter(F.col("ts") >= F.col("newest") - F.expr("INTERVAL 4320 MINUTES"))
    stage, reason = F.upper(F.coalesce("stage", F.lit(""))), F.coalesce("reason", F.lit(""))
    blocker = F.coalesce(F.nullif(F.when(reason != "", reason).otherwise(stage), F.lit("")), F.lit("NO_BLOCK_REASON"))
    blocked = F.col("rejected") | stage.startswith("REJECTED")
    lines = F.array(F.struct(F.lit("stage").alias("tab"), F.when(stage == "", "NA").otherwise(stage).alias("label")), F.when(blocked, F.struct(F.lit("blocker").alias("tab"), blocker.alias("label"))))
    n = r.select(F.explode(F.array_compact(lines)).alias("t")).groupBy("t.tab", "t.label").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("tab").orderBy(F.desc("n"), "label"))
    return n.withColumn("place", place).filter(F.col("place") <= F.when(F.col("tab") == "stage", 10).otherwise(12))


_ROUTE = """, rt AS (SELECT *, CASE WHEN r LIKE '%CANARY\\_MIRROR%' ESCAPE '\\' OR p LIKE '%SHORT0\\_CANARY\\_MIRROR%' ESCAPE '\\' THEN 'CANARY_MIRROR'
    WHEN contains(r, 'SHORT0_CANARY_EXACT_BUCKET') OR contains(p, 'SHORT0_CANARY_EXACT_BUCKET') THEN 'CANARY_EXACT_BUCKET' WHEN contains(r, 'MIRROR') OR p = 'MIRROR_SHORT_FROM_LONG_R0' THEN 'MIRROR_SHORT'
    WHEN contains(r, 'SCOUT') THEN 'SCOUT' WHEN contains(r, 'DISCOVERY') OR starts_with(p, 'DISCOVERY_') THEN 'DISCOVERY'
    WHEN contains(r, 'STRICT_SYMBOL') OR p IN ('PROMOTE_SYMBOL', 'ADAPTIVE_PROMOTE_SYMBOL') THEN 'STRICT_PROMOTE' ELSE 'UNKNOWN' END AS route
  FROM (SELECT *, upper(coalesce(reason, '')) AS r, upper(coalesce(prior, '')) AS p FROM ledger))"""
_PROOF = _ROUTE + f"""
, ls AS (SELECT * FROM rt WHERE pnl IS NOT NULL QUALIFY row_number() OVER (PARTITION BY route ORDER BY ts DESC) <= 60)
, cu AS (SELECT *, sum(pnl) OVER (PARTITION BY route ORDER BY ts) AS cum FROM ls), fa AS (SELECT *, cum - max(cum) OVER (PARTITION BY route ORDER BY ts) AS fall FROM cu)
, pf AS (SELECT route, {_TRADES}, count(DISTINCT CAST(ts AS DATE)) AS days, max(ts) AS newest, round((epoch_us(TIMESTAMP '{NOW}') - epoch_us(max(ts))) / 3.6e9, 4) AS age_hours,
    round(min(fall), 8) AS drawdown FROM fa GROUP BY route)"""


def routed(spark, d):
    return T.ledger(spark, d).withColumn("route", R.route(F.col("reason"), F.col("prior")))


@query("p12_routes", T.with_sql("ledger", _ROUTE + " SELECT route, count(*) AS n, count(DISTINCT symbol) AS n_symbols, min(event_id) AS first_id FROM rt GROUP BY route"))
def routes(spark, d):
    """The seven routes by ordered rules."""
    return routed(spark, d).groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("symbol").alias("n_symbols"), F.min("event_id").alias("first_id"))


@query("g16_route_proof", T.with_sql("ledger", _PROOF + " SELECT * REPLACE (strftime(newest, '%Y-%m-%d %H:%M:%S') AS newest) FROM pf"))
def route_proof(spark, d):
    """What each route shows over its last sixty closed trades, and how old that is."""
    return R.route_proof(routed(spark, d), F.lit(NOW)).withColumn("newest", F.date_format("newest", STAMP))


POLICY = [
    ("CANARY_MIRROR", "LIVE", 0.3, 0.6, 1.0, False, 20, 0.9, 2, 0.0, 0.0), ("CANARY_EXACT_BUCKET", "PAPER_ONLY", 0.2, 0.8, 0.5, True, 10, 0.0, 1, 0.0, 0.0),
    ("MIRROR_SHORT", "LIVE", 0.4, 0.5, 0.7, False, 30, 1.2, 2, 48.0, 0.0), ("SCOUT", "PAPER_ONLY", 0.1, 0.9, 0.2, True, 0, 0.0, 40, 0.0, 0.0),
    ("DISCOVERY", "RESEARCH_ONLY", 0.5, 0.5, 0.0, False, 0, 0.0, 0, 0.0, 0.0), ("STRICT_PROMOTE", "LIVE", 0.2, 0.7, 1.0, False, 10, 0.0, 1, 0.0, 0.05),
]
DEFAULT = {"mode": "PAPER_ONLY", "min_proba": 0.9, "max_stop": 0.4, "size": 0.1, "unproven": False, "min_n": 0, "min_factor": 0.0, "min_days": 0, "max_age": 0.0, "max_fall": 0.0}
_POLICY = ", ".join(f"('{p[0]}', '{p[1]}', {', '.join(f'{x}::DOUBLE' if isinstance(x, float) else str(x).lower() for x in p[2:])})" for p in POLICY)
_PC = "min_proba max_stop size unproven min_n min_factor min_days max_age max_fall".split()


@query("q7_route_admission", T.with_sql("ledger", _PROOF + f"""
, po AS (SELECT * FROM (VALUES {_POLICY}) v(route, mode, {', '.join(_PC)}))
, j AS (SELECT rt.event_id, rt.route, proba, stop_risk, live, coalesce(mode, 'PAPER_ONLY') AS mode, {', '.join(f"coalesce({c}, {str(DEFAULT[c]).lower()}) AS {c}" for c in _PC)},
    coalesce(pf.n, 0) AS n, profit_factor, coalesce(endless, false) AS endless, coalesce(days, 0) AS days, age_hours, drawdown FROM rt LEFT JOIN po USING (route) LEFT JOIN pf USING (route))
, b AS (SELECT *, CASE WHEN mode IN ('DISABLED', 'RESEARCH_ONLY') THEN 'ROUTE_' || mode WHEN proba < min_proba THEN printf('ROUTE_PROBA_BLOCK:%.3f<%.2f', proba, min_proba)
    WHEN n < min_n THEN printf('ROUTE_PROOF_WARMUP:%d<%d', n, min_n) WHEN min_factor > 0 AND NOT endless AND coalesce(profit_factor < min_factor, true)
      THEN 'ROUTE_PROOF_BLOCK:PF' || coalesce(printf('%.2f', profit_factor), 'nan') || printf('<%.2f', min_factor)
    WHEN days < min_days THEN printf('ROUTE_DAY_DIVERSITY_BLOCK:%d<%d', days, min_days) WHEN max_age > 0 AND coalesce(age_hours > max_age, true) THEN 'ROUTE_STALE_PROOF'
    WHEN max_fall > 0 AND drawdown < -max_fall THEN printf('ROUTE_DRAWDOWN_BLOCK:%.4f<-%.4f', drawdown, max_fall)
    WHEN stop_risk IS NULL AND NOT (mode = 'PAPER_ONLY' AND unproven AND NOT live) THEN 'STOP_HIT_MODEL_UNAVAILABLE'
    WHEN stop_risk > max_stop THEN printf('STOP_HIT_RISK_BLOCK:%.3f>%.2f', stop_risk, max_stop) END AS blocked FROM j)
SELECT event_id, route, blocked IS NULL AS admitted, CASE WHEN blocked IS NOT NULL THEN mode WHEN mode = 'PAPER_ONLY' OR NOT live THEN 'PAPER_ONLY' ELSE 'LIVE' END AS mode,
    coalesce(blocked, CASE WHEN stop_risk IS NULL THEN 'ROUTE_PAPER_APPROVED_MODEL_PENDING' WHEN mode = 'PAPER_ONLY' OR NOT live THEN 'ROUTE_PAPER_APPROVED' ELSE 'ROUTE_LIVE_APPROVED' END) AS reason,
    CASE WHEN blocked IS NULL THEN size ELSE 0 END AS size FROM b"""))
def route_admission(spark, d):
    """Q7: every decision against the policy of its route and the proof of that route."""
    x = routed(spark, d)
    policy = spark.createDataFrame(POLICY, R.POLICY)  # a fixed list
    rows = x.select("event_id", "route", "proba", "stop_risk", "live")
    return R.admitted(rows, R.route_proof(x, F.lit(NOW)), policy, DEFAULT).select("event_id", "route", "admitted", "mode", "reason", "size")


#: Masks of a ledger row and their severity, by expressions that both engines read.
MASKS = {
    "timestamp_parse_error": ("ERROR", "trim(raw_ts) <> '' AND try_cast(raw_ts AS TIMESTAMP) IS NULL"),
    "executable_size_usd_zero": ("ERROR", "executable AND size_usd <= 0"),
    "executable_invested_usdt_missing": ("WARN", "executable AND size_usd > 0 AND invested IS NULL"),
    "executable_invested_usdt_zero": ("ERROR", "executable AND size_usd > 0 AND invested <= 0"),
    "executable_size_invested_mismatch": ("WARN", "executable AND size_usd > 0 AND invested > 0 AND abs(size_usd - invested) > 1e-6"),
    "executable_size_asset_zero": ("WARN", "executable AND size_asset <= 0"),
    "rejected_row_looks_executable": ("ERROR", "rejected AND (live OR paper OR size_usd > 0)"),
    "non_executable_has_size_usd": ("WARN", "NOT executable AND size_usd > 0"),
    "final_status_missing_outcome_pnl": ("ERROR", "(status LIKE '%FINAL%' OR status LIKE '%12H%' OR status LIKE '%TP%' OR status LIKE '%SL%') AND pnl IS NULL"),
    "open_status_has_outcome_pnl": ("WARN", "status LIKE '%OPEN%' AND pnl IS NOT NULL"),
    "stale_open_over_48h": ("WARN", f"ts < TIMESTAMP '{NOW}' - INTERVAL '48' HOUR AND NOT backfilled AND price > 0"),
}
SAME = ["raw_ts", "symbol", "side", "regime", "proba", "price", "status", "stage"]


@query("q1_ledger_health", T.with_sql("ledger", ", r AS (" + " UNION ALL ".join(f"SELECT '{n}' AS rule, '{s}' AS severity, count(*) FILTER ({m}) AS n FROM ledger" for n, (s, m) in MASKS.items())
      + f" UNION ALL SELECT 'duplicated_signal_rows', 'WARN', coalesce(sum(c) FILTER (c > 1), 0)::BIGINT FROM (SELECT count(*) AS c FROM ledger GROUP BY {', '.join(SAME)}))"
      + " SELECT *, row_number() OVER (ORDER BY severity, n DESC, rule) AS place FROM r"))
def ledger_health(spark, d):
    """Q1, Q2: all twelve masks with severity and counts, errors first; eleven from one pass."""
    x = T.ledger(spark, d)
    counts = [F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"), F.count_if(F.coalesce(F.expr(m), F.lit(False))).alias("n")) for n, (s, m) in MASKS.items()]
    again = x.groupBy(*SAME).agg(F.count(F.lit(1)).alias("c")).agg(F.coalesce(F.sum(F.when(F.col("c") > 1, F.col("c"))), F.lit(0)).alias("n"))
    rules = x.agg(F.array(*counts).alias("r")).select(F.inline("r")).unionByName(again.select(F.lit("duplicated_signal_rows").alias("rule"), F.lit("WARN").alias("severity"), "n"))
    return rules.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("severity", F.desc("n"), "rule")))


@query("q3_readiness", T.with_sql("ledger", f"""
, p AS (SELECT layer, ts, ts + INTERVAL '12 hours' AS ready_at FROM ledger WHERE price > 0 AND pnl IS NULL AND NOT backfilled), n AS (SELECT TIMESTAMP '2024-01-30 00:00:00' AS now)
SELECT layer, count(*) AS n_pending, count(*) FILTER (ready_at <= now) AS n_ready, count(*) FILTER (ready_at > now) AS n_waiting, strftime(min(ts) FILTER (ready_at <= now), '%Y-%m-%d %H:%M:%S') AS oldest_ready,
    strftime(min(ready_at) FILTER (ready_at > now), '%Y-%m-%d %H:%M:%S') AS next_ready_at, round(max(epoch_us(now) - epoch_us(ts)) / 3.6e9, 4) AS oldest_hours,
    row_number() OVER (ORDER BY count(*) FILTER (ready_at <= now) DESC, count(*) DESC, layer) AS place FROM p, n GROUP BY layer"""))
def readiness(spark, d):
    """Q3: rows without outcome by layer: how many may be settled, how many wait and until when."""
    p = T.ledger(spark, d).filter("price > 0 AND pnl IS NULL AND NOT backfilled")
    now = F.expr("TIMESTAMP_NTZ '2024-01-30 00:00:00'")
    at = F.col("ts") + F.expr("INTERVAL 12 HOURS")
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 3.6e9
    g = p.groupBy("layer").agg(
        F.count(F.lit(1)).alias("n_pending"), F.count_if(at <= now).alias("n_ready"), F.count_if(at > now).alias("n_waiting"), F.date_format(F.min(F.when(at <= now, F.col("ts"))), STAMP).alias("oldest_ready"),
        F.date_format(F.min(F.when(at > now, at)), STAMP).alias("next_ready_at"), F.round(F.max(age), 4).alias("oldest_hours"))
    return g.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n_ready"), F.desc("n_pending"), "layer")))


@query("q4_marks", T.with_sql("ledger bars_4h", """
, o AS (SELECT * FROM ledger WHERE pnl IS NULL AND price > 0), lp AS (SELECT symbol, arg_max(close, bar) AS mark FROM bars_4h GROUP BY symbol)
, x AS (SELECT o.event_id, max(high) AS hi, min(low) AS lo, count(b.bar) AS n_bars FROM o LEFT JOIN bars_4h b ON b.symbol = o.symbol AND b.bar > o.ts AND b.bar <= o.ts + INTERVAL '24 hours' GROUP BY o.event_id)
SELECT o.event_id, o.symbol, n_bars, round(CASE side WHEN 'SHORT' THEN price / nullif(mark, 0) ELSE mark / price END - 1, 6) AS marked,
    round(CASE side WHEN 'SHORT' THEN price / nullif(lo, 0) ELSE hi / price END - 1, 6) AS mfe, round(CASE side WHEN 'SHORT' THEN price / nullif(hi, 0) ELSE lo / price END - 1, 6) AS mae
FROM o JOIN x USING (event_id) JOIN lp USING (symbol)"""))
def marks(spark, d):
    """Q4: open rows at the last price of their symbol against their own entry, and the best and worst
    price of the day after the entry."""
    bars = T.bars_4h(spark, d)
    o = T.ledger(spark, d).filter("pnl IS NULL AND price > 0").select("event_id", "symbol", "ts", "side", "price")
    after = J.following(o.select("event_id", "symbol", "ts"), bars.select("symbol", "bar", "high", "low"), "symbol", "ts", "bar", 7, 86_400)
    reach = after.groupBy("event_id").agg(F.max("high").alias("hi"), F.min("low").alias("lo"), F.count(F.lit(1)).alias("n_bars"))
    last = bars.groupBy("symbol").agg(F.max_by("close", "bar").alias("mark"))
    x = o.join(reach, "event_id", "left").fillna(0, ["n_bars"]).join(last, "symbol")
    gain = lambda up, down: F.round(F.when(F.col("side") == "SHORT", F.col("price") / F.nullif(F.col(down), F.lit(0.0))).otherwise(F.col(up) / F.col("price")) - 1, 6)
    return x.select("event_id", "symbol", "n_bars", gain("mark", "mark").alias("marked"), gain("hi", "lo").alias("mfe"), gain("lo", "hi").alias("mae"))
