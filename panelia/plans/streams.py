"""Queries of streaming operators (survey T, A21). Batch twins have SQL; streams run to the end of
the data that is there."""

from pyspark.sql import functions as F

from panelia.plans.registry import query
from panelia.session import ship_package
from panelia.sources import stand_ins as T
from panelia.sources.storage import scratch
from panelia.streaming import streams as R

STAMP = "yyyy-MM-dd HH:mm:ss"


def messages(spark, d):
    """Events as JSON messages of three kinds, parsed back by the stream's schema."""
    e = T.events(spark, d)
    text = lambda c: F.col(c).cast("string")
    pair = F.array(F.array(text("value"), text("k")))
    order = F.struct(text("symbol").alias("symbol"), F.lower("event_type").alias("side"), text("k").alias("q"), text("value").alias("p"))
    kind = F.when(F.col("k") % 3 == 0, "depth").when(F.col("k") % 3 == 1, "liquidation").otherwise("gap")
    m = F.to_json(F.struct(
        kind.alias("kind"), F.unix_millis(F.col("ts").cast("timestamp")).alias("event_time_ms"), text("symbol").alias("symbol"), F.col("event_type").alias("side"),
            text("k").alias("quantity"), text("value").alias("price"),
        F.when(F.col("k") % 2 == 0, F.array(order, order)).alias("orders"), F.when(F.col("k") % 2 == 0, pair).alias("b"), F.when(F.col("k") % 2 == 1,
            pair).alias("bids"), pair.alias("a")))
    return e.select(F.from_json(m, R.RECORD).alias("r")).select("r.*")


@query("t2_liquidations", T.with_sql("ev", """
SELECT symbol::VARCHAR AS symbol, upper(event_type) AS side, sum(CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END)::BIGINT AS n,
    round(sum(CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END * k * value), 4) AS notional FROM ev WHERE k % 3 = 1 GROUP BY symbol, event_type"""))
def liquidations(spark, d):
    x = R.liquidations(messages(spark, d))
    return x.groupBy("symbol", "side").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("quantity") * F.col("price")), 4).alias("notional"))


@query("t3_depth", T.with_sql("ev", """
SELECT symbol::VARCHAR AS symbol, count(*) AS n, round(avg(value), 6) AS mean_bid, round(sum(k), 4)::DOUBLE AS bid_size, round(sum(k), 4)::DOUBLE AS ask_size FROM ev
    WHERE k % 3 = 0 GROUP BY symbol"""))
def depth(spark, d):
    x = R.depth(messages(spark, d))
    return x.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("bid"), 6).alias("mean_bid"), F.round(F.sum("bid_size"), 4).alias("bid_size"),
        F.round(F.sum("ask_size"), 4).alias("ask_size"))


@query("t4_counters", T.with_sql("ev", "SELECT CASE k % 3 WHEN 0 THEN 'depth' WHEN 1 THEN 'liquidation' ELSE 'gap' END AS kind, count(*) AS n, max(epoch_us(ts) // 1000) AS latest_ms FROM ev GROUP BY 1"))
def counters(spark, d):
    return R.kind_counters(messages(spark, d))


GAP_US, LATE_MS = 24 * 3_600_000_000, 600_000


@query("t4_gap_stream", T.with_sql("ev", f"""
, x AS (SELECT symbol, epoch_us(ts) AS us, row_number() OVER w AS n, lead(epoch_us(ts)) OVER w AS nx FROM ev WINDOW w AS (PARTITION BY symbol ORDER BY ts))
, wm AS (SELECT max(us) // 1000 - {LATE_MS} AS wm FROM x)
, g AS (SELECT symbol, us, n, row_number() OVER (PARTITION BY symbol ORDER BY us) AS k FROM x, wm WHERE nx - us > {GAP_US} OR (nx IS NULL AND (us + {GAP_US}) // 1000 + 1 < wm))
SELECT symbol::VARCHAR AS key, us AS start, n AS n_messages, k AS n_gaps FROM g
UNION ALL SELECT x.symbol::VARCHAR, NULL, count(*), (SELECT count(*) FROM g WHERE g.symbol = x.symbol) FROM x GROUP BY x.symbol"""))
def gap_stream(spark, d):
    """T4: a day without a message is a gap. The events come as JSON files, week by week, one file a
    batch; gaps of all keys and, without start, the lifetime counters."""
    ship_package(spark)
    path = scratch(spark, "streams")
    e = T.events(spark, d).select("symbol", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "day")
    for a, b in (("2024-01-01", "2024-01-09"), ("2024-01-09", "2024-01-17"), ("2024-01-17", "2024-01-25"), ("2024-01-25", "2024-02-09")):
        e.filter(f"day >= DATE '{a}' AND day < DATE '{b}'").drop("day").coalesce(1).write.mode("append").json(f"{path}/landed")
    records = spark.readStream.schema("symbol long, us long").option("maxFilesPerTrigger", 1).json(f"{path}/landed")
    g = R.gap_events(records.withColumn("at", F.timestamp_micros("us")), "symbol", "at", GAP_US, f"{LATE_MS} milliseconds")
    g.writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{path}/out/batch={n}")).option("checkpointLocation",
        f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(R.GAPS).parquet(f"{path}/out")
    life = out.groupBy("key").agg(F.lit(None).cast("long").alias("start"), F.max("n_messages").alias("n_messages"), F.max("n_gaps").alias("n_gaps"))
    return out.filter("gap").select("key", F.col("last").alias("start"), "n_messages", "n_gaps").unionByName(life)


_T6 = """SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS start, symbol, count(*) AS n, round(sum(value), 4) AS total FROM ev GROUP BY 1, 2"""


@query("t6_tumbling", T.with_sql("ev", _T6))
def tumbling(spark, d):
    """T6 as a batch."""
    g = R.tumbling(T.events(spark, d), "ts", "symbol", "value", "1 hour", None)
    return g.select(F.date_format("start", STAMP).alias("start"), "symbol", "n", F.round("total", 4).alias("total"))


def event_stream(spark, d):
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


@query("t6_tumbling_stream")
def tumbling_stream(spark, d):
    """T6 as a stream over the events file: watermark, windows, append to files. Windows that the
    watermark has not passed at the end of the data stay open."""
    path = scratch(spark, "streams")
    e = event_stream(spark, d).select("ts", F.col("user_id").alias("symbol"), "value")
    g = R.tumbling(e, "ts", "symbol", "value", "1 hour", "10 minutes")
    g.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation",
        f"{path}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema("start timestamp, symbol long, n long, total double").parquet(f"{path}/out")
    return out.select(F.date_format("start", STAMP).alias("start"), "symbol", "n", F.round("total", 4).alias("total"))


@query("t1_sampled_stream")
def sampled_stream(spark, d):
    """At most one event in thirty hours of each key, by state over micro-batches. Each batch
    has a folder, so a batch that is replayed replaces its rows."""
    ship_package(spark)
    path = scratch(spark, "streams")
    e = event_stream(spark, d).select(F.col("user_id").alias("symbol"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    s = R.sampled(e, "symbol", "t", 30 * 3600 * 1_000_000)
    s.writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{path}/out/batch={n}")).option("checkpointLocation",
        f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema("symbol long, t long").parquet(f"{path}/out")
    return out.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_kept"), F.max("t").alias("last_kept"))


@query("a21_ndjson_landing", T.with_sql("ev", "SELECT CASE k % 3 WHEN 0 THEN 'depth' WHEN 1 THEN 'liquidation' ELSE 'gap' END AS kind, count(*) AS n, max(epoch_us(ts) // 1000) AS latest_ms FROM ev GROUP BY 1"))
def ndjson_landing(spark, d):
    """The records as NDJSON files, read by the landing stream into Parquet, then counted."""
    path = scratch(spark, "streams")
    messages(spark, d).write.json(f"{path}/landed")
    found = R.landing(spark, f"{path}/landed", R.RECORD, "*.json")
    sink = found.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state")
    sink.trigger(availableNow=True).start().awaitTermination()
    return R.kind_counters(spark.read.schema(R.RECORD).parquet(f"{path}/out"))


@query("t5_t8_append_once")
def append_once(spark, d):
    """Hourly files from the stream, and the same stream appended twice stores each key
    once."""
    path = scratch(spark, "streams")
    e = event_stream(spark, d).select("event_id", "ts", F.col("user_id").alias("symbol"))
    R.rotated_sink(e, "ts", f"{path}/hours", f"{path}/s0").awaitTermination()
    schema = "event_id long, ts timestamp_ntz, symbol long"
    for k in (1, 2):
        R.append_once(e, ["event_id"], "ts", f"{path}/once", f"{path}/s{k}", schema).awaitTermination()
    hours = spark.read.parquet(f"{path}/hours").groupBy("date").agg(F.countDistinct("hour").alias("hours"), F.count(F.lit(1)).alias("n_rotated"))
    once = spark.read.schema(f"{schema}, date date, batch string").parquet(f"{path}/once").drop("date").groupBy(F.to_date("ts").alias("date")).agg(F.count(F.lit(1)).alias("n_once"))
    return hours.join(once, "date").select(F.col("date").cast("string").alias("day"), "hours", "n_rotated", "n_once")


@query("t7_staleness", T.with_sql("settle", """
, a AS (SELECT DISTINCT user_id AS symbol FROM events WHERE ts >= TIMESTAMP '2024-01-25')
SELECT a.symbol, strftime(max(s.ts), '%Y-%m-%d %H:%M:%S') AS latest, coalesce(max(s.ts) < TIMESTAMP '2024-01-28', true) AS stale FROM a LEFT
    JOIN settle s USING (symbol) GROUP BY a.symbol"""))
def staleness(spark, d):
    active = T.events(spark, d).filter("ts >= TIMESTAMP_NTZ '2024-01-25 00:00:00'").select("symbol").distinct()
    s = R.stale(T.settlements(spark, d), active, "symbol", "ts", F.expr("TIMESTAMP_NTZ '2024-01-28 00:00:00'"))
    return s.select("symbol", F.date_format("latest", STAMP).alias("latest"), "stale")
