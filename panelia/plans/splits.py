"""Queries of series in which one key holds half of all rows: scans and joins that split it."""

from pyspark.sql import functions as F

from panelia.operators import ranges as R
from panelia.plans.registry import query
from panelia.sources import stand_ins as T

STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"
_HOT = """
, hot AS (SELECT event_id, ts, value, k, event_type, CASE WHEN symbol % 2 = 0 THEN 0 ELSE symbol END AS name FROM ev)"""


def hot_events(spark, d):
    """Events whose even symbols are one key."""
    name = F.when(F.col("symbol") % 2 == 0, 0).otherwise(F.col("symbol")).alias("name")
    return T.events(spark, d).select("event_id", "ts", "value", "k", "event_type", name)


@query("j1_split_asof", T.with_sql("ev", _HOT + """
, q AS (SELECT name, ts, max(value) AS quote FROM hot WHERE event_type = 'error' GROUP BY name, ts)
SELECT h.event_id, h.name, round(q.quote, 6) AS quote, strftime(q.ts, '%Y-%m-%d %H:%M:%S.%f') AS quoted FROM (SELECT * FROM hot WHERE event_type <> 'error') h
    ASOF LEFT JOIN q ON h.name = q.name AND h.ts >= q.ts"""))
def split_asof(spark, d):
    """The latest error value at or before every other event of its key."""
    e = hot_events(spark, d)
    quotes = e.filter("event_type = 'error'").groupBy("name", "ts").agg(F.max("value").alias("quote"))
    met = R.asof_split(e.filter("event_type <> 'error'").select("event_id", "name", "ts"), quotes, "name", "ts", ["quote"])
    return met.select("event_id", "name", F.round("quote", 6).alias("quote"), F.date_format("ts_matched", STAMP).alias("quoted"))


_RUN = "OVER (PARTITION BY name ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query("w14_w15_w20_w21_split_scans", T.with_sql("ev", _HOT + f"""
, e AS (SELECT *, exp(sum(ln(1 + (value - 50) / 1e4)) {_RUN}) AS equity FROM hot)
SELECT event_id, name, count(*) {_RUN} AS n, round(last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) {_RUN}, 6) AS last_click,
    round(last_value(CASE WHEN k % 3 = 0 THEN value END IGNORE NULLS) {_RUN}, 6) AS filled, round(equity, 6) AS equity,
    round(equity / greatest(max(equity) {_RUN}, 1) - 1, 6) AS drawdown, round(min(value) {_RUN}, 6) AS lowest FROM e"""))
def split_scans(spark, d):
    """The value at the last click, a forward fill, the running product with its
    drawdown from the peak (initial value included), the lowest value and the ordinal."""
    e = hot_events(spark, d)
    scans = {
        "n": ("count", F.lit(1)), "last_click": ("last", F.when(F.col("event_type") == "click", F.col("value"))),
        "filled": ("last", F.when(F.col("k") % 3 == 0, F.col("value"))), "equity": ("product", 1 + (F.col("value") - 50) / 1e4), "lowest": ("min", F.col("value")),
    }
    r = R.running(R.running(e, "name", "ts", scans, "event_id"), "name", "ts", {"peak": ("max", F.col("equity"))}, "event_id")
    r6 = lambda **x: [F.round(v, 6).alias(k) for k, v in x.items()]
    return r.select("event_id", "name", F.col("n").cast("bigint").alias("n"), *r6(
        last_click=F.col("last_click"), filled=F.col("filled"), equity=F.col("equity"),
        drawdown=F.col("equity") / F.greatest("peak", F.lit(1.0)) - 1, lowest=F.col("lowest")))


@query("h8_greedy_chain", T.with_sql("ev", _HOT + """
, o AS (SELECT event_id, name, ts AS a, ts + to_hours(1 + k % 30) AS z, row_number() OVER (PARTITION BY name ORDER BY ts) AS n FROM hot)
, walk AS (SELECT name, n, event_id, z AS free, true AS kept FROM o WHERE n = 1
 UNION ALL SELECT o.name, o.n, o.event_id, CASE WHEN o.a >= walk.free THEN o.z ELSE walk.free END, o.a >= walk.free FROM walk JOIN o ON o.name = walk.name AND o.n = walk.n + 1)
SELECT event_id, name FROM walk WHERE kept""").replace("WITH ev", "WITH RECURSIVE ev", 1))
def greedy_chain(spark, d):
    """H8: spans of one to thirty hours from each event, taken if they begin after the last taken."""
    hours = F.make_dt_interval(hours=(1 + F.col("k") % 30).cast("int"))
    spans = hot_events(spark, d).select("event_id", "name", F.col("ts").alias("a"), (F.col("ts") + hours).alias("z"))
    return R.chain_of(spans, "name", "a", "z").select("event_id", "name")


@query("j3_j4_long_spans", """
WITH o AS (SELECT o_custkey AS customer, CAST(o_orderdate AS TIMESTAMP) AS a, CAST(o_orderdate AS TIMESTAMP) + INTERVAL '3650 days' AS b, o_orderkey, o_totalprice FROM orders)
SELECT o.o_orderkey AS order_id, count(*) FILTER (f.a > o.a AND f.a < o.b) AS open_n, round(coalesce(sum(f.o_totalprice) FILTER (f.a > o.a AND f.a < o.b), 0), 2) AS open_sum,
    count(*) FILTER (f.a > o.a AND f.a <= o.b) AS closed_n, round(coalesce(sum(f.o_totalprice) FILTER (f.a > o.a AND f.a <= o.b), 0), 2) AS closed_sum
FROM o LEFT JOIN o f ON f.customer = o.customer GROUP BY o.o_orderkey""")
def long_spans(spark, d):
    """What each customer ordered in the ten years after each order."""
    at = F.col("o_orderdate").cast("timestamp")
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("customer"), at.alias("a"), F.col("o_orderkey").alias("order_id"), "o_totalprice")
    spans = o.select("order_id", "customer", "a", (F.col("a") + F.expr("INTERVAL 3650 DAYS")).alias("b"))
    s = R.span_sums(spans, o.select("customer", "a", "o_totalprice"), "customer", "a", "b", "a", "o_totalprice")
    return s.select("order_id", "open_n", F.round("open_sum", 2).alias("open_sum"), "closed_n", F.round("closed_sum", 2).alias("closed_sum"))
