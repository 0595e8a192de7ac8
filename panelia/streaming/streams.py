"""Structured Streaming operators: landing, flattening, sampling, windows, idempotent append."""

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from panelia.sources.storage import stored
from panelia.sources.tables import upsert

RECORD = """kind string, received string, event_time_ms long, symbol string, side string, quantity string, price string,
 orders array<struct<symbol: string, side: string, q: string, p: string>>, b array<array<string>>, bids array<array<string>>, a array<array<string>>, asks array<array<string>>"""


def landing(spark: SparkSession, path: str, schema: StructType | str, pattern: str | None = None) -> DataFrame:
    """A stream of NDJSON files as they land."""
    reader = spark.readStream.schema(schema)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).json(path)


def liquidations(records: DataFrame) -> DataFrame:
    """One row for each order of an event that holds one or many."""
    single = F.array(F.struct("symbol", "side", F.col("quantity").alias("q"), F.col("price").alias("p")))
    order = F.explode(F.when(F.size("orders") > 0, F.col("orders")).otherwise(single))
    flat = records.filter("kind = 'liquidation'").select("event_time_ms", order.alias("o"))
    number = lambda c: F.expr(f"try_cast({c} AS DOUBLE)")
    return flat.select("event_time_ms", "o.symbol", F.upper("o.side").alias("side"), number("o.q").alias("quantity"), number("o.p").alias("price"))


def depth(records: DataFrame) -> DataFrame:
    """Best levels and sums of a book record under either of its field names."""
    bids, asks = F.coalesce("bids", "b"), F.coalesce("asks", "a")
    level = lambda x, i: F.get(F.get(x, F.lit(0)), F.lit(i)).cast("double")
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + F.get(v, F.lit(1)).cast("double"))
    return records.filter("kind = 'depth'").select(
        "event_time_ms", "symbol", level(bids, 0).alias("bid"), level(asks, 0).alias("ask"), total(bids).alias("bid_size"), total(asks).alias("ask_size")
    )


def kind_counters(records: DataFrame) -> DataFrame:
    """Running counts of each kind, gaps included (T4)."""
    return records.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.max("event_time_ms").alias("latest_ms"))


def tumbling(rows: DataFrame, time: str, key: str, value: str, width: str, late: str | None) -> DataFrame:
    """Count and sum of each key and event-time window (T6); late rows go with the watermark. The
    time must be a TIMESTAMP: watermarks refuse a time without zone."""
    rows = rows.withColumn("_t", F.col(time).cast("timestamp"))
    if late:
        rows = rows.withWatermark("_t", late)
    g = rows.groupBy(F.window("_t", width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("w.start").alias("start"), key, "n", "total")


def sampled(rows: DataFrame, key: str, time_us: str, least_us: int) -> DataFrame:
    """Rows at least ``least_us`` after the last EMITTED one of their key (T1). The state of a key
    is one number; rows of a key are put in order within a micro-batch."""
    schema = rows.select(key, time_us).schema

    def run(k, batches, state: GroupState):
        import pandas as pd

        rows = pd.concat(list(batches)).sort_values(time_us)
        last = state.get[0] if state.exists else None
        kept = []
        for t in rows[time_us]:
            if last is None or t - last >= least_us:
                kept.append(t)
                last = int(t)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({key: [k[0]] * len(kept), time_us: kept})

    return rows.select(key, time_us).groupBy(key).applyInPandasWithState(run, schema, "last long", "append", GroupStateTimeout.NoTimeout)


GAPS = "key string, gap boolean, last long, n_messages long, n_gaps long"


def gap_events(rows: DataFrame, key: str, time: str, least_us: int, late: str) -> DataFrame:
    """Gaps and lifetime counters of each key of a stream (T4), columns as in GAPS.

    A key has a gap where its next message comes more than ``least_us`` after its last one. If that
    message is there, it says so; else an event-time timer does, as soon as the watermark has passed
    the time by which it was due. So every gap is one row, with the time of the message before it
    and the counters up to it, however the stream is cut into batches. Rows that are no gap give the
    counters of a key after each batch that holds it. State is four numbers a key; the messages of a
    key in one batch are put in order in memory, so the source should bound a batch.
    """
    stamp = F.col(time).cast("timestamp")
    timed = rows.select(F.col(key).cast("string").alias("key"), stamp.alias("at"), F.unix_micros(stamp).alias("us")).withWatermark("at", late)

    def run(k, batches, state: GroupState):
        import pandas as pd

        last, n, gaps, silent = state.get if state.exists else (None, 0, 0, False)
        out = []

        def gap():
            nonlocal gaps
            gaps += 1
            out.append((k[0], True, last, n, gaps))

        if state.hasTimedOut:
            gap()
            silent = True
        else:
            for t in sorted(int(x) for pdf in batches for x in pdf.us):
                if last is not None and t - last > least_us and not silent:
                    gap()
                n, silent, last = n + 1, False, t if last is None else max(last, t)
            due = (last + least_us) // 1000 + 1
            if due < state.getCurrentWatermarkMs():
                gap()
                silent = True
            else:
                state.setTimeoutTimestamp(due)
            out.append((k[0], False, last, n, gaps))
        state.update((last, n, gaps, silent))
        yield pd.DataFrame(out, columns=["key", "gap", "last", "n_messages", "n_gaps"])

    return timed.groupBy("key").applyInPandasWithState(run, GAPS, "last long, n long, gaps long, silent boolean", "append", GroupStateTimeout.EventTimeTimeout)


def stale(rows: DataFrame, active: DataFrame, key: str, time: str, expected) -> DataFrame:
    """Active keys whose latest row is before the expected boundary, or missing."""
    latest = rows.groupBy(key).agg(F.max(time).alias("latest"))
    return active.join(latest, key, "left").withColumn("stale", F.col("latest").isNull() | (F.col("latest") < expected))


def rotated_sink(rows: DataFrame, time: str, path: str, checkpoint: str):
    """Files by date and hour of the event (T5)."""
    t = F.col(time).cast("timestamp")
    return (
        rows.withColumns({"date": F.to_date(t), "hour": F.hour(t)})
        .writeStream.partitionBy("date", "hour").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(target)


def append_once(rows: DataFrame, keys: list[str], time: str, path: str, checkpoint: str, schema: str):
    """Each key stored once, a repeated batch changes nothing (T8): the run and the batch number
    name the folder of a batch, and rows that other batches have stored are left out. Files are
    partitioned by the date of ``time``, which a key must fix, and only the dates of a batch are
    read again (as many as the batch has), not the whole sink."""

    run = hashlib.md5(checkpoint.encode()).hexdigest()[:12]

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own = f"{path}/batch={run}-{number}"
        if exists(spark, f"{own}/_SUCCESS"):  # a replay of a finished batch
            return
        batch = stored(batch.dropDuplicates(keys), "append")  # it is read more than once
        fresh = batch.withColumn("date", F.to_date(time))
        if exists(spark, path):
            dates = [r.date for r in fresh.select("date").distinct().collect()]
            reader = spark.read.schema(f"{schema}, date date, batch string").option("ignoreMissingFiles", "true")
            known = reader.parquet(path).filter(F.col("date").isin(dates) & (F.col("batch") != f"{run}-{number}"))
            fresh = fresh.join(known.select(*keys), keys, "left_anti")
        fresh.write.mode("overwrite").partitionBy("date").parquet(own)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


__all__ = ["landing", "liquidations", "depth", "kind_counters", "gap_events", "tumbling", "sampled", "stale", "rotated_sink", "append_once", "upsert"]
