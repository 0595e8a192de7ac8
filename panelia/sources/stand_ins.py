"""Bars, settlements and ledgers derived from the given tables, and their SQL twins."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelia.sources.tables import load

TAKER = ("click", "purchase")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select(
        "event_id", "ts", F.to_date("ts").alias("day"), F.col("user_id").alias("symbol"), "event_type", "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


def bars(events: DataFrame, *time) -> DataFrame:
    """OHLCV bars of a value series on a time column (G2): one shuffle, combined before it."""
    return events.groupBy("symbol", *time).agg(
        F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
        F.max_by("value", "ts").alias("close"), F.count(F.lit(1)).cast("double").alias("volume"),
        F.round(F.sum("value"), 6).alias("quote"), F.sum(F.col("event_type").isin(*TAKER).cast("double")).alias("taker"),
    )


def bars_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(events(spark, sf_dir), "day")


def bars_4h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(events(spark, sf_dir), F.window("ts", "4 hours").getField("start").alias("bar"))


def settlements(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).filter("event_type = 'error'")
    return e.select("symbol", "ts", "day", F.round((F.col("value") - 50) / 1e5, 10).alias("rate"))


def week_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_discount", "l_shipdate", "l_returnflag", "l_linestatus"
    )
    nations = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("bigint").alias("symbol"))
    return lines.join(nations, "l_suppkey").withColumn("day", F.to_date(F.date_trunc("week", "l_shipdate")))


def bars_week(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    """Weekly bars of nations; the offset damps weekly moves."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return week_lines(spark, sf_dir).filter(where).groupBy("symbol", "day").agg(
        F.round(20000 + F.avg(price), 6).alias("close"), F.round(20000 + F.max(price), 6).alias("high"),
        F.round(20000 + F.min(price), 6).alias("low"), F.sum("l_quantity").alias("volume"),
    )


def cash_week(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    return week_lines(spark, sf_dir).filter(where).groupBy("symbol", "day").agg(
        F.round((F.avg("l_discount") - 0.05) / 10, 8).alias("rate"))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decision log: side, regime, probability and outcome from the event."""
    return events(spark, sf_dir).select(
        "event_id", "ts", "day", "symbol", "event_type", "k",
        F.when(F.col("event_type").isin("click", "purchase", "view"), "LONG").otherwise("SHORT").alias("side"),
        F.concat(F.lit("R"), (F.col("k") % 2).cast("string")).alias("regime"),
        (F.col("k") % 100 / 100).alias("proba"),
        F.when(F.col("event_id") % 7 != 0, F.round((F.col("value") - 50) / 1e3, 8)).alias("pnl"),
    )


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fills: an order date is a run, a line is a leg, the part's retail price its reference."""
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.to_date("o_orderdate").alias("run"), F.col("o_orderstatus").alias("status"))
    li = load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("part"), F.col("l_quantity").alias("qty"),
        F.round(F.col("l_extendedprice") / F.col("l_quantity"), 9).alias("price"), F.round(F.col("l_extendedprice") * F.col("l_tax"), 6).alias("fee"),
        F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"), (F.col("l_linestatus") == "O").alias("maker"),
    )
    p = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_retailprice").alias("reference"))
    return li.join(o, "order_id").join(p, "part")


#: Columns of a full decision ledger by expressions that Spark SQL and DuckDB read alike.
LEDGER = {
    "event_id": "event_id", "ts": "ts", "day": "day", "symbol": "symbol", "price": "value", "k": "k",
    "side": "CASE WHEN event_type IN ('click','purchase','view') THEN 'LONG' ELSE 'SHORT' END", "regime": "k % 2", "proba": "(k % 100) / CAST(100 AS DOUBLE)",
    "pnl": "CASE WHEN event_id % 7 <> 0 THEN round((value - 50) / 1e3, 8) END", "executable": "event_id % 3 = 0", "live": "event_id % 12 = 0",
    "paper": "event_id % 3 = 0 AND event_id % 12 <> 0", "rejected": "event_id % 5 = 0", "backfilled": "event_id % 29 = 0",
    "size_usd": "CAST(CASE WHEN event_id % 11 = 0 OR event_id % 3 <> 0 AND event_id % 8 <> 0 THEN 0 ELSE 10 * (k % 7 + 1) END AS DOUBLE)",
    "size_asset": "CASE WHEN event_id % 23 = 0 THEN 0 ELSE 1e0 END",
    "invested": "CAST(CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 17 = 0 THEN 0 WHEN event_id % 19 = 0 THEN 10 * (k % 7 + 1) + 1 ELSE 10 * (k % 7 + 1) END AS DOUBLE)",
    "status": "CASE event_id % 4 WHEN 0 THEN 'FINAL' WHEN 1 THEN 'OPEN' WHEN 2 THEN 'TP1' ELSE 'SL_12H' END",
    "stage": "CASE event_id % 5 WHEN 0 THEN 'rejected_gate' WHEN 1 THEN 'EXECUTED' WHEN 2 THEN NULL ELSE 'SIGNAL' END",
    "reason": "CASE event_id % 8 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN 'scout_a' WHEN 3 THEN 'CANARY_MIRROR_b' WHEN 4 THEN 'DISCOVERY_c' WHEN 5 THEN 'STRICT_SYMBOL_d' WHEN 6 THEN 'MIRROR_e' ELSE 'LOW_PROBA' END",
    "prior": "CASE event_id % 9 WHEN 0 THEN 'PROMOTE_SYMBOL' WHEN 1 THEN 'DISCOVERY_x' WHEN 2 THEN 'SHORT0_CANARY_EXACT_BUCKET' ELSE '' END",
    "exit_reason": "CASE event_id % 4 WHEN 0 THEN 'STOP' WHEN 1 THEN 'TARGET' WHEN 2 THEN 'TIME' END",
    "layer": "CASE WHEN event_id % 12 = 0 THEN 'LIVE' WHEN event_id % 3 = 0 THEN 'PAPER' WHEN event_id % 5 = 0 THEN 'REJECTED' ELSE 'RESEARCH' END",
    "bucket": "CASE WHEN k % 100 < 30 THEN 'p00_30' WHEN k % 100 < 50 THEN 'p30_50' WHEN k % 100 < 60 THEN 'p50_60' WHEN k % 100 < 70 THEN 'p60_70' ELSE 'p70_up' END",
    "raw_ts": "CASE WHEN event_id % 31 = 0 THEN 'no time' WHEN event_id % 37 = 0 THEN '' ELSE CAST(ts AS VARCHAR(40)) END",
    "stop_risk": "CASE WHEN event_id % 10 <> 0 THEN (event_id % 100) / CAST(100 AS DOUBLE) END",
}


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decision ledger with sizes, states, reasons and outcomes."""
    return events(spark, sf_dir).selectExpr(*[f"{x.replace('VARCHAR(40)', 'STRING')} AS {name}" for name, x in LEDGER.items()])


SQL = {
    "ev": """ev AS (SELECT event_id, ts, CAST(ts AS DATE) AS day, user_id AS symbol, event_type, value,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""",
    "bars_day": """bars_day AS (SELECT symbol, day, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close,
  count(*)::DOUBLE AS volume, round(sum(value), 6) AS quote, sum((event_type IN ('click','purchase'))::DOUBLE) AS taker FROM ev GROUP BY symbol, day)""",
    "bars_4h": """bars_4h AS (SELECT symbol, time_bucket(INTERVAL '4 hours', ts) AS bar, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low,
  arg_max(value, ts) AS close, count(*)::DOUBLE AS volume, round(sum(value), 6) AS quote FROM ev GROUP BY symbol, bar)""",
    "settle": """settle AS (SELECT symbol, ts, day, round((value - 50) / 1e5, 10) AS rate FROM ev WHERE event_type = 'error')""",
    "wl": """wl AS (SELECT s_nationkey::BIGINT AS symbol, CAST(date_trunc('week', l_shipdate) AS DATE) AS day, lineitem.*
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)""",
    "bars_week": """bars_week AS (SELECT symbol, day, round(20000 + avg(l_extendedprice / l_quantity), 6) AS close,
  round(20000 + max(l_extendedprice / l_quantity), 6) AS high, round(20000 + min(l_extendedprice / l_quantity), 6) AS low,
  sum(l_quantity) AS volume FROM wl GROUP BY symbol, day)""",
    "cash_week": """cash_week AS (SELECT symbol, day, round((avg(l_discount) - 0.05::DOUBLE) / 10, 8) AS rate FROM wl GROUP BY symbol, day)""",
    "decision": """decision AS (SELECT event_id, ts, day, symbol, event_type, k,
  CASE WHEN event_type IN ('click','purchase','view') THEN 'LONG' ELSE 'SHORT' END AS side, 'R' || (k % 2) AS regime,
  (k % 100) / 100::DOUBLE AS proba, CASE WHEN event_id % 7 <> 0 THEN round((value - 50) / 1e3, 8) END AS pnl FROM ev)""",
    "fill": """fill AS (SELECT l_orderkey AS order_id, l_partkey AS part, l_quantity AS qty, round(l_extendedprice / l_quantity, 9) AS price,
  round(l_extendedprice * l_tax, 6) AS fee, CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side, l_linestatus = 'O' AS maker,
  CAST(o_orderdate AS DATE) AS run, o_orderstatus AS status, p_retailprice AS reference
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)""",
}
SQL["ledger"] = "ledger AS (SELECT " + ", ".join(f"{x} AS {name}" for name, x in LEDGER.items()) + " FROM ev)"
_NEEDS = {"ledger": ["ev"], "bars_day": ["ev"], "bars_4h": ["ev"], "settle": ["ev"], "bars_week": ["wl"], "cash_week": ["wl"], "decision": ["ev"]}


def with_sql(names: str, rest: str) -> str:
    """``rest`` behind the WITH clauses of the named tables; it may go on with further ones."""
    order: list[str] = []
    for n in names.split():
        order += [x for x in (*_NEEDS.get(n, []), n) if x not in order]
    head = "WITH " + ", ".join(SQL[n] for n in order)
    return head + (rest if rest.startswith(",") else " " + rest)
