"""Queries of scans, sources and sinks (survey A)."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelia.functions import series as S
from panelia.plans.registry import query
from panelia.session import ship_package
from panelia.sources import archives as Z
from panelia.sources import stand_ins as T
from panelia.sources import storage as Y
from panelia.sources import tables as B
from panelia.sources.storage import scratch

ASOF = "2024-01-20"


@query("a1_a2_a13_clean_scan", T.with_sql("bars_day", """
, c AS (SELECT *, max(day) OVER (PARTITION BY symbol) AS e FROM bars_day), k AS (SELECT * FROM c WHERE day < e)
SELECT symbol, day::VARCHAR AS day, round(close, 6) AS close, volume FROM k WHERE symbol IN (SELECT symbol FROM k GROUP BY symbol HAVING count(*) >= 20)"""))
def clean_scan(spark, d):
    """The forming bar dropped, keys with too few rows dropped."""
    bars = B.closed_bars(T.bars_day(spark, d))
    return B.minimum_history(bars, "symbol", 20).select("symbol", S.day_text(), F.round("close", 6).alias("close"), "volume")


@query("a2_settlement_scan", T.with_sql("settle", """
, k AS (SELECT DISTINCT symbol, ts, rate FROM settle WHERE symbol IS NOT NULL AND ts IS NOT NULL AND rate IS NOT NULL)
SELECT symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, rate, row_number() OVER (PARTITION BY symbol ORDER BY ts, rate) AS n FROM k"""))
def settlement_scan(spark, d):
    """A2: settlements cast, without nulls and repeats, in order within each symbol."""
    k = T.settlements(spark, d).select("symbol", "ts", F.col("rate").cast("double").alias("rate")).dropna().dropDuplicates()
    n = F.row_number().over(Window.partitionBy("symbol").orderBy("ts", "rate"))
    return k.select("symbol", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "rate", n.cast("bigint").alias("n"))


@query("a3_a9_top_up", T.with_sql("bars_day", """
, old AS (SELECT symbol, day, close FROM bars_day WHERE day < DATE '2024-01-15' AND symbol % 3 <> 0), en AS (SELECT symbol, max(day) AS e FROM old GROUP BY symbol)
, fresh AS (SELECT b.symbol, b.day, b.close + 1 AS close FROM bars_day b LEFT JOIN en USING (symbol) WHERE e IS NULL OR b.day > e)
, rev AS (SELECT symbol, day, close + 2 AS close FROM old WHERE day = DATE '2024-01-10')
SELECT symbol, day::VARCHAR AS day, round(coalesce(r.close, u.close), 6) AS close FROM (SELECT * FROM old UNION ALL SELECT * FROM fresh) u LEFT JOIN rev r USING (symbol, day)"""))
def top_up(spark, d):
    """Append what is newer than the stored end; a later value of a key wins."""
    bars = T.bars_day(spark, d).select("symbol", "day", "close")
    old = bars.filter("day < DATE '2024-01-15' AND symbol % 3 <> 0")
    fresh = B.newer_rows(bars, old, "symbol", "day").withColumn("close", F.col("close") + 1)
    revised = old.filter("day = DATE '2024-01-10'").withColumn("close", F.col("close") + 2)
    return B.upsert(old.unionByName(fresh), revised, ["symbol", "day"]).select("symbol", S.day_text(), F.round("close", 6).alias("close"))


@query("a4_a5_venues", T.with_sql("bars_day", """
, mp AS (SELECT DISTINCT symbol, 'B' || symbol AS other, CASE WHEN symbol % 10 = 0 THEN 1000 ELSE 1 END AS multiplier FROM bars_day)
SELECT 'first' AS venue, count(*) AS n, round(sum(close), 4) AS total FROM bars_day UNION ALL SELECT 'second', count(*), round(sum(close * multiplier), 4)
    FROM bars_day JOIN mp USING (symbol)"""))
def venues(spark, d):
    """A4, A5: a second market by mapping and multiplier, venues as one table."""
    bars = T.bars_day(spark, d).select("symbol", "day", "close")
    names = bars.select("symbol").distinct().select("symbol", F.concat(F.lit("B"), "symbol").alias("other"), F.when(F.col("symbol") % 10 == 0,
        1000).otherwise(1).alias("multiplier"))
    both = B.venues({"first": bars, "second": B.scaled_mapping(bars, names, "close").drop("other", "multiplier")})
    return both.groupBy("venue").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("close"), 4).alias("total"))


@query("a6_g3_day_metrics", T.with_sql("bars_4h", """
SELECT symbol, CAST(bar AS DATE)::VARCHAR AS day, count(*) AS n, round(arg_max(close, bar), 6) AS last_close, round(avg(close), 6) AS mean_close, round(avg(volume),
    6) AS mean_volume, count(*) = 6 AS complete FROM bars_4h GROUP BY symbol, CAST(bar AS DATE)"""))
def day_metrics(spark, d):
    """Last sub-daily row and the mean of each metric, with the row count of the day."""
    b = T.bars_4h(spark, d).withColumn("day", F.to_date("bar"))
    return b.groupBy("symbol", S.day_text()).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.max_by("close", "bar"), 6).alias("last_close"), F.round(F.avg("close"), 6).alias("mean_close"),
        F.round(F.avg("volume"), 6).alias("mean_volume"), (F.count(F.lit(1)) == 6).alias("complete"))


#: CSV name and name in use of each metric (fixed values).
METRICS = {"sum_open_interest": "open_interest", "count_long_short_ratio": "account_ratio", "sum_taker_long_short_vol_ratio": "taker_ratio"}


def written_archive(spark, d):
    """Stand-in archive: one zip file for each symbol with one CSV member a day, 5-minute rows."""
    path = scratch(spark, "archive").removeprefix("file:")
    if "://" in path:
        raise ValueError("the stand-in archive is written through a mounted folder")
    bar = F.window("ts", "5 minutes").getField("start")
    m = T.events(spark, d).groupBy("symbol", bar.alias("create_time")).agg(
        F.round(F.sum("value"), 6).alias("sum_open_interest"), F.round(F.avg("value") / 50, 6).alias("count_long_short_ratio"),
        F.round(F.avg("k"), 6).alias("sum_taker_long_short_vol_ratio"))
    m = m.withColumn("day", F.to_date("create_time").cast("string")).withColumn("create_time", F.date_format("create_time", "yyyy-MM-dd HH:mm:ss"))

    # a day of a symbol has 288 rows at most: Spark writes them as one text, a task only packs texts
    names = ["symbol", "create_time", *METRICS]
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    lines = F.array_sort(F.collect_list(F.struct("create_time", F.concat_ws(",", *map(cell, names)).alias("line"))))
    text = F.concat_ws("\n", F.lit(",".join(names)), F.transform(lines, lambda x: x["line"]), F.lit(""))
    members = m.groupBy("symbol", "day").agg(text.alias("text")).repartition("symbol").sortWithinPartitions("symbol", "day")

    def write(batches):
        import itertools
        import os
        import zipfile

        os.makedirs(path, exist_ok=True)
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        for symbol, days in itertools.groupby(rows, lambda r: r[0]):
            with zipfile.ZipFile(f"{path}/{symbol}-metrics.part", "w", zipfile.ZIP_DEFLATED) as archive:
                for _, day, content in days:
                    archive.writestr(f"{symbol}-metrics-{day}.csv", content)
            os.replace(f"{path}/{symbol}-metrics.part", f"{path}/{symbol}-metrics.zip")
        yield from ()

    members.mapInArrow(write, "symbol long").count()
    return path


@query("a6_zip_archive", T.with_sql("ev", """
, m AS (SELECT symbol, time_bucket(INTERVAL '5 minutes', ts) AS t, round(sum(value), 6) AS oi, round(avg(value) / 50, 6) AS ar, round(avg(k), 6) AS tr FROM ev GROUP BY ALL)
SELECT symbol, CAST(t AS DATE)::VARCHAR AS day, count(*) AS n_rows, round(arg_max(oi, t), 6) AS open_interest_last, round(avg(oi), 6) AS open_interest_mean,
    round(arg_max(ar, t), 6) AS account_ratio_last, round(avg(ar), 6) AS account_ratio_mean, round(arg_max(tr, t), 6) AS taker_ratio_last, round(avg(tr), 6) AS taker_ratio_mean,
    count(*) = 288 AS complete FROM m GROUP BY ALL"""))
def zip_archive(spark, d):
    """Zipped CSV files written from the events, read back, renamed and cast; the last row and
    the mean of each metric a day, and whether all 288 rows of a day are there."""
    ship_package(spark)
    rows = Z.archive_rows(Z.zip_files(spark, written_archive(spark, d)), METRICS, "create_time")
    symbol = F.regexp_extract("member", "^(-?[0-9]+)-metrics-", 1).cast("bigint").alias("symbol")
    daily = rows.filter("error IS NULL").withColumn("day", F.to_date("create_time")).groupBy(symbol, S.day_text())
    made = [x for c in METRICS.values() for x in (S.ieee_round(F.max_by(c, "create_time"), 6).alias(f"{c}_last"), S.ieee_round(F.avg(c), 6).alias(f"{c}_mean"))]
    return daily.agg(F.count(F.lit(1)).alias("n_rows"), *made, (F.count(F.lit(1)) == 288).alias("complete"))


@query("a3_a9_keyed_sink", T.with_sql("bars_day", """
, old AS (SELECT symbol, day, close FROM bars_day WHERE day < DATE '2024-01-15' AND symbol % 3 <> 0), en AS (SELECT symbol, max(day) AS e FROM old GROUP BY symbol)
, fresh AS (SELECT b.symbol, b.day, b.close + 1 AS close FROM bars_day b LEFT JOIN en USING (symbol) WHERE (e IS NULL OR b.day > e) AND (b.symbol % 2 = 0 OR b.day < DATE '2024-01-29'))
, rev AS (SELECT symbol, day, close + 2 AS close FROM old WHERE day = DATE '2024-01-10')
, u AS (SELECT symbol, day, coalesce(r.close, o.close) AS close FROM (SELECT * FROM old UNION ALL SELECT * FROM fresh) o LEFT JOIN rev r USING (symbol, day))
SELECT symbol, day::VARCHAR AS day, round(close, 6) AS close, epoch_us(TIMESTAMP '2024-01-30 06:00:00') - epoch_us(max(day::TIMESTAMP) OVER (PARTITION BY symbol)) > 43200000000 AS stale FROM u"""))
def keyed_sink(spark, d):
    """A table partitioned by day; what is newer than the stored end of a key is added, a
    revised day is upserted, twice, and only its partition is written again. ``stale`` tells keys
    whose stored end is more than twelve hours old."""
    path = scratch(spark, "sink")
    bars = T.bars_day(spark, d).select("symbol", "close", "day")
    read = lambda: spark.read.schema(bars.schema).parquet(path)
    upsert = lambda batch: Y.upsert_partitions(batch, path, ["symbol", "day"], "day")
    old = bars.filter("day < DATE '2024-01-15' AND symbol % 3 <> 0")
    upsert(old)
    late = (F.col("symbol") % 2 == 0) | (F.col("day") < F.lit("2024-01-29").cast("date"))
    upsert(B.newer_rows(bars, read(), "symbol", "day").filter(late).withColumn("close", F.col("close") + 1))
    revised = old.filter("day = DATE '2024-01-10'").withColumn("close", F.col("close") + 2)
    upsert(revised)
    upsert(revised)
    tails = Y.stale_tails(read(), "symbol", "day", F.expr("TIMESTAMP '2024-01-30 06:00:00'")).drop("end")
    return read().join(tails, "symbol").select("symbol", S.day_text(), F.round("close", 6).alias("close"), "stale")


@query("q9_coverage_gates", T.with_sql("bars_4h", """
, dm AS (SELECT symbol, CAST(bar AS DATE) AS day, count(*) >= 4 AND arg_max(close, bar) > 0 AS valid FROM bars_4h GROUP BY ALL)
, el AS (SELECT symbol FROM dm WHERE valid GROUP BY symbol HAVING count(*) >= 10)
SELECT day::VARCHAR AS day, count(*) FILTER (valid) AS n_valid, count(*) FILTER (NOT valid) AS n_short, count(*) FILTER (valid) >= 5 AS enough FROM dm
    WHERE symbol IN (SELECT symbol FROM el) GROUP BY day"""))
def coverage_gates(spark, d):
    """Q9: a day of a symbol counts if it has enough sub-daily rows and a positive value, a symbol if
    it has enough such days, a day if enough symbols are left on it."""
    day = F.to_date("bar").alias("day")
    valid = (F.count(F.lit(1)) >= 4) & (F.max_by("close", "bar") > 0)
    m = T.bars_4h(spark, d).groupBy("symbol", day).agg(valid.alias("valid"))
    names = m.filter("valid").groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).filter("n >= 10")
    left = m.join(names.select("symbol"), "symbol", "left_semi").groupBy(S.day_text())
    return left.agg(F.count_if("valid").alias("n_valid"), F.count_if(~F.col("valid")).alias("n_short"), (F.count_if("valid") >= 5).alias("enough"))


@query("a7_a8_g15_missing", T.with_sql("bars_day", """
, cal AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM bars_day)
SELECT symbol, day::VARCHAR AS day FROM (SELECT DISTINCT symbol FROM bars_day) CROSS JOIN cal WHERE (symbol, day) NOT IN (SELECT (symbol, day) FROM bars_day)
    AND day NOT IN (DATE '2024-01-05', DATE '2024-01-06')"""))
def missing(spark, d):
    """Wanted keys without those stored and those known to be absent."""
    bars = T.bars_day(spark, d)
    days = B.calendar(bars).agg(F.collect_list("day").alias("days"))
    wanted = bars.select("symbol").distinct().join(F.broadcast(days)).select("symbol", F.explode("days").alias("day"))
    return B.missing_keys(wanted, bars, on=["symbol", "day"]).filter("day NOT IN (DATE '2024-01-05', DATE '2024-01-06')").select("symbol", S.day_text())


@query("a10_coverage", T.with_sql("ev", "SELECT day::VARCHAR AS day, event_type AS source, count(*) AS n_rows, count(DISTINCT symbol) AS n_members FROM ev GROUP BY day, event_type"))
def coverage(spark, d):
    return B.coverage(T.events(spark, d).withColumnRenamed("event_type", "source"), ["day", "source"], "symbol").withColumn("day", F.col("day").cast("string"))


@query("a11_a12_point_in_time", T.with_sql("bars_day", f"""
, p AS (SELECT * FROM bars_day WHERE day <= DATE '{ASOF}'), k AS (SELECT * FROM p WHERE symbol IN (SELECT symbol FROM p GROUP BY symbol HAVING count(*) >= 12))
, c AS (SELECT min(e) AS cut FROM (SELECT max(day) AS e FROM k GROUP BY symbol))
SELECT symbol, count(*) AS n, max(day)::VARCHAR AS last_day FROM k, c WHERE day <= cut GROUP BY symbol"""))
def point_in_time(spark, d):
    """Nothing after a date, enough history, all keys cut at the earliest end."""
    p = B.point_in_time(T.bars_day(spark, d), F.lit(ASOF).cast("date"), "symbol", "day", 12)
    return B.common_cutoff(p, "symbol", "day").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.max("day").cast("string").alias("last_day"))


@query("a14_a20_conflicts", T.with_sql("ev", """
, u AS (SELECT symbol, day, arg_min(event_type, ts) AS event_type FROM ev GROUP BY ALL UNION ALL SELECT symbol, day, arg_max(event_type, ts) FROM ev GROUP BY ALL)
SELECT symbol, day::VARCHAR AS day, count(DISTINCT event_type) AS n_values FROM u GROUP BY symbol, day HAVING count(DISTINCT event_type) > 1"""))
def conflicts(spark, d):
    """Keys on which two extracts of all events, by first and by last event of a day, disagree."""
    e = T.events(spark, d).groupBy("symbol", "day")
    first, last = (e.agg(f("event_type", "ts").alias("event_type")) for f in (F.min_by, F.max_by))
    both = first.unionByName(last)
    return B.conflicts(both, ["symbol", "day"], "event_type").withColumn("day", F.col("day").cast("string"))


@query("a20_disjoint_universes", T.with_sql("ev", """
, k AS (SELECT symbol, bool_or(day < DATE '2024-01-15') AS a, bool_or(day >= DATE '2024-01-15') AS b FROM ev WHERE event_type = 'error' GROUP BY symbol)
SELECT count(*) FILTER (a) AS n_left, count(*) FILTER (b) AS n_right, count(*) FILTER (a AND b) AS n_common, count(*) FILTER (a AND b) = 0 AS disjoint FROM k"""))
def disjoint_universes(spark, d):
    """The symbols of a discovery period against those of the hold-out."""
    e = T.events(spark, d).filter("event_type = 'error'")
    early = F.col("day") < F.lit("2024-01-15").cast("date")
    return B.disjoint(e.filter(early), e.filter(~early), "symbol")


@query("a15_digest", T.with_sql("bars_day", """
, h AS (SELECT md5(concat_ws('|', symbol, day::VARCHAR, volume::BIGINT)) AS m FROM bars_day)
SELECT count(*) AS n_rows, sum(('0x' || substr(m, 1, 8))::BIGINT)::BIGINT AS sum_1, sum(('0x' || substr(m, 9, 8))::BIGINT)::BIGINT AS sum_2 FROM h"""))
def digest(spark, d):
    """An order-free digest of exactly the rows used."""
    return B.digest(T.bars_day(spark, d), F.concat_ws("|", "symbol", F.col("day").cast("string"), F.col("volume").cast("bigint")))


@query("a17_a18_qualifying", T.with_sql("fill", """
SELECT run::VARCHAR AS "when", count(*) AS n, round(sum(qty), 4) AS amount, NULL::VARCHAR AS absent FROM fill WHERE status = 'F' AND qty >= 10 GROUP BY run"""))
def qualifying(spark, d):
    """Legs of qualifying runs; columns picked by the first alias present."""
    f = T.fills(spark, d).filter("status = 'F' AND qty >= 10")
    picked = B.alias_projection(f, {"when": ["date", "RUN"], "amount": ["Quantity", "QTY"], "absent": ["nothing"]})
    return picked.groupBy("when").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("amount"), 4).alias("amount"), F.max("absent").alias("absent")).withColumn("when",
        F.col("when").cast("string"))


@query("a19_g14_books", T.with_sql("decision", """
, b AS (SELECT day, string_agg(DISTINCT symbol::VARCHAR, ',' ORDER BY symbol::VARCHAR) FILTER (side = 'LONG') AS longs, string_agg(DISTINCT symbol::VARCHAR, ', '
    ORDER BY symbol::VARCHAR) FILTER (side = 'SHORT') AS shorts FROM decision GROUP BY day)
, r AS (SELECT day, trim(unnest(string_split(longs, ','))) AS symbol, 0.5::DOUBLE / len(string_split(longs, ',')) AS weight FROM b UNION ALL SELECT day,
    trim(unnest(string_split(shorts, ','))), -0.5::DOUBLE / len(string_split(shorts, ',')) FROM b)
SELECT symbol, count(*) AS slots, count(DISTINCT day) AS days, count(*) - count(DISTINCT day) AS both_sides, round(sum(weight), 8) AS weight FROM r GROUP BY symbol"""))
def books(spark, d):
    """Books written as comma lists, as rows; slots and days of each name."""
    x = T.decisions(spark, d)
    names = lambda side, sep: F.concat_ws(sep, F.array_sort(F.collect_set(F.when(F.col("side") == side, F.col("symbol").cast("string")))))
    b = x.groupBy("day").agg(names("LONG", ",").alias("longs"), names("SHORT", ", ").alias("shorts"))
    r = B.book_rows(b, "day", "longs", "shorts")
    return r.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("slots"), F.countDistinct("day").alias("days"), (F.count(F.lit(1)) - F.countDistinct("day")).alias("both_sides"),
            F.round(F.sum("weight"), 8).alias("weight"))
