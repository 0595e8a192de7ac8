"""Queries of joins (survey J)."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelia.functions import series as S
from panelia.operators import joins as J
from panelia.operators import ranges as R
from panelia.plans.accounting import NAMES, WEEK, week_weights
from panelia.plans.registry import query
from panelia.sources import stand_ins as T
from panelia.sources import tables as B

STAMP = "yyyy-MM-dd HH:mm:ss"


@query("j1_j2_asof", T.with_sql("bars_4h settle", """
SELECT b.symbol, strftime(b.bar, '%Y-%m-%d %H:%M:%S') AS bar, round(s.rate, 8) AS rate, coalesce(epoch_us(b.bar) - epoch_us(s.ts) <= 28800000000, false) AS fresh
FROM bars_4h b ASOF LEFT JOIN settle s ON b.symbol = s.symbol AND b.bar >= s.ts"""))
def asof(spark, d):
    """Latest settlement at or before each bar, and whether it is at most 8 hours old."""
    m = J.asof(T.bars_4h(spark, d).select("symbol", F.col("bar").alias("ts")), T.settlements(spark, d).select("symbol", "ts", "rate"), "symbol", "ts", ["rate"])
    micro = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return m.select("symbol", F.date_format("ts", STAMP).alias("bar"), F.round("rate", 8).alias("rate"),
        F.coalesce(micro("ts") - micro("ts_matched") <= 28_800_000_000, F.lit(False)).alias("fresh"))


@query("j3_j4_interval_sums", T.with_sql("bars_4h settle", """
SELECT b.symbol, strftime(b.bar, '%Y-%m-%d %H:%M:%S') AS bar, round(coalesce(sum(CASE WHEN s.ts < b.bar + INTERVAL '36 hours' THEN rate END), 0), 9) AS open_sum,
    count(CASE WHEN s.ts < b.bar + INTERVAL '36 hours' THEN 1 END) AS open_n,
 round(coalesce(sum(rate), 0), 9) AS closed_sum, count(s.ts) AS closed_n
FROM bars_4h b LEFT JOIN settle s ON b.symbol = s.symbol AND s.ts > b.bar AND s.ts <= b.bar + INTERVAL '36 hours' GROUP BY b.symbol, b.bar"""))
def interval_sums(spark, d):
    """Settlements inside a holding span, with open and closed right ends."""
    spans = T.bars_4h(spark, d).select("symbol", F.col("bar").alias("a"), (F.col("bar") + F.expr("INTERVAL 36 HOURS")).alias("b"))
    s = T.settlements(spark, d).select("symbol", "ts", "rate")
    both = R.span_sums(spans, s, "symbol", "a", "b", "ts", "rate")
    return both.select("symbol", F.date_format("a", STAMP).alias("bar"), F.round("open_sum", 9).alias("open_sum"), "open_n", F.round("closed_sum", 9).alias("closed_sum"), "closed_n")


@query("j5_higher_frame", T.with_sql("bars_4h bars_day", """
, c AS (SELECT symbol, day, lag(close) OVER (PARTITION BY symbol ORDER BY day) AS day_close, lag(high) OVER (PARTITION BY symbol ORDER BY day) AS day_high FROM bars_day)
SELECT b.symbol, strftime(bar, '%Y-%m-%d %H:%M:%S') AS bar, round(last_value(day_close IGNORE NULLS) OVER w, 6) AS day_close,
    round(last_value(day_high IGNORE NULLS) OVER w, 6) AS day_high
FROM bars_4h b LEFT JOIN c ON b.symbol = c.symbol AND CAST(bar AS DATE) = c.day WINDOW w AS (PARTITION BY b.symbol ORDER BY bar ROWS BETWEEN UNBOUNDED PRECEDING
    AND CURRENT ROW)"""))
def higher_frame(spark, d):
    """The day bar before, on four-hour bars, without look-ahead."""
    day = T.bars_day(spark, d).select("symbol", F.col("day").alias("bar"), F.col("close").alias("day_close"), F.col("high").alias("day_high"))
    out = J.higher_frame(T.bars_4h(spark, d).select("symbol", "bar"), day, "symbol", "bar", F.to_date("bar"), ["day_close", "day_high"])
    return out.select("symbol", F.date_format("bar", STAMP).alias("bar"), F.round("day_close", 6).alias("day_close"), F.round("day_high", 6).alias("day_high"))


@query("j6_calendar_reindex", T.with_sql("bars_day settle", """
, cal AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM bars_day), s AS (SELECT symbol, day, sum(rate) AS rate
    FROM settle GROUP BY symbol, day)
SELECT symbol, day::VARCHAR AS day, round(coalesce(rate, 0), 8) AS rate, rate IS NULL AS was_missing FROM (SELECT DISTINCT symbol FROM bars_day) CROSS JOIN cal LEFT
    JOIN s USING (symbol, day)"""))
def reindex(spark, d):
    """A series on the complete calendar, zero where nothing happened."""
    bars = T.bars_day(spark, d)
    days = B.calendar(bars).agg(F.collect_list("day").alias("days"))  # one row: the calendar as an array
    full = bars.select("symbol").distinct().join(F.broadcast(days)).select("symbol", F.explode("days").alias("day"))
    s = T.settlements(spark, d).groupBy("symbol", "day").agg(F.sum("rate").alias("rate"))
    return full.join(s, ["symbol", "day"], "left").select("symbol", S.day_text(), F.round(F.coalesce("rate", F.lit(0.0)), 8).alias("rate"),
        F.col("rate").isNull().alias("was_missing"))


@query("j7_panel_align", T.with_sql("wl", """
, a AS (SELECT DISTINCT symbol, day FROM wl WHERE l_linestatus = 'F'), b AS (SELECT DISTINCT symbol, day FROM wl WHERE l_linestatus = 'O')
SELECT symbol, count(*) AS n_days, min(day)::VARCHAR AS first_day, max(day)::VARCHAR AS last_day FROM a JOIN b USING (symbol, day) GROUP BY symbol"""))
def align(spark, d):
    """Days and names that both venues have."""
    a, b = (T.week_lines(spark, d).filter(F.col("l_linestatus") == s).select("symbol", "day").distinct() for s in ("F", "O"))
    return a.join(b, ["symbol", "day"]).groupBy("symbol").agg(F.count(F.lit(1)).alias("n_days"), F.min("day").cast("string").alias("first_day"),
        F.max("day").cast("string").alias("last_day"))


@query("j8_label_shift", T.with_sql("bars_day", """
SELECT a.symbol, count(*) AS n, round(avg(abs(b.open / nullif(a.close, 0) - 1)), 6) AS mean_error, round(max(abs(b.open / nullif(a.close, 0) - 1)), 6) AS worst
FROM bars_day a JOIN bars_day b ON a.symbol = b.symbol AND b.day = a.day + 1 GROUP BY a.symbol"""))
def label_shift(spark, d):
    """Two series whose labels differ by one period."""
    a = T.bars_day(spark, d).select("symbol", F.date_add("day", 1).alias("day"), "close")
    m = a.join(T.bars_day(spark, d).select("symbol", "day", "open"), ["symbol", "day"])
    e = F.abs(S.safe_ratio(F.col("open"), F.col("close")) - 1)
    return m.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(e), 6).alias("mean_error"), F.round(F.max(e), 6).alias("worst"))


@query("j9_j10_fill_match", T.with_sql("fill", """
, o AS (SELECT DISTINCT order_id FROM fill WHERE order_id % 3 <> 0), opens AS (SELECT run, avg(reference) AS open FROM fill WHERE month(run) <> 2 GROUP BY run)
SELECT f.run::VARCHAR AS run, count(*) AS n_fills, count(o.order_id) AS matched, count(*) - count(o.order_id) AS unmatched,
    count(*) FILTER (opens.open IS NULL) AS no_open, round(avg(f.price / opens.open - 1), 6) AS shortfall
FROM fill f LEFT JOIN o USING (order_id) LEFT JOIN opens USING (run) GROUP BY f.run"""))
def fill_match(spark, d):
    """Fills with their orders and the open of their day; what is missing is counted."""
    f = T.fills(spark, d)
    o = f.filter("order_id % 3 <> 0").select("order_id").distinct().withColumn("known", F.lit(1))
    opens = f.filter(F.month("run") != 2).groupBy("run").agg(F.avg("reference").alias("open"))
    m = f.join(o, "order_id", "left").join(opens, "run", "left")
    return m.groupBy(F.col("run").cast("string").alias("run")).agg(
        F.count(F.lit(1)).alias("n_fills"), F.count("known").alias("matched"), (F.count(F.lit(1)) - F.count("known")).alias("unmatched"),
        F.count(F.when(F.col("open").isNull(), 1)).alias("no_open"), F.round(F.avg(F.col("price") / F.col("open") - 1), 6).alias("shortfall"))


@query("j11_j13_reconcile", T.with_sql("fill", """
, a AS (SELECT part, sum(qty) AS expected FROM fill WHERE side = 'BUY' GROUP BY part), b AS (SELECT part, sum(qty) AS actual FROM fill WHERE maker GROUP BY part)
SELECT part, round(coalesce(actual, 0) - coalesce(expected, 0), 6) AS error, abs(coalesce(actual, 0) - coalesce(expected, 0)) <= 50 AS within,
 CASE WHEN expected IS NULL THEN 'extra' WHEN actual IS NULL THEN 'missing' WHEN expected <> actual THEN 'differs' ELSE 'same' END AS state FROM a FULL JOIN b USING (part)"""))
def reconcile(spark, d):
    """Full outer reconcile of two position tables with a tolerance and a state."""
    f = T.fills(spark, d)
    a = f.filter("side = 'BUY'").groupBy("part").agg(F.sum("qty").alias("expected"))
    b = f.filter("maker").groupBy("part").agg(F.sum("qty").alias("actual"))
    gap = F.coalesce("actual", F.lit(0.0)) - F.coalesce("expected", F.lit(0.0))
    state = F.when(F.col("expected").isNull(), "extra").when(F.col("actual").isNull(), "missing").when(F.col("expected") != F.col("actual"), "differs").otherwise("same")
    return a.join(b, "part", "full").select("part", F.round(gap, 6).alias("error"), (F.abs(gap) <= 50).alias("within"), state.alias("state"))


@query("j15_j16_permuted", T.with_sql(NAMES, WEEK + """
, dr AS (SELECT unnest(range(5)) AS draw), o AS (SELECT draw, symbol, row_number() OVER (PARTITION BY draw ORDER BY md5(concat_ws('|', '7', draw, symbol))) AS r
    FROM dr CROSS JOIN syms)
, i AS (SELECT draw, symbol, row_number() OVER (PARTITION BY draw ORDER BY symbol) AS r FROM dr CROSS JOIN syms), dn AS (SELECT i.draw, i.symbol, o.symbol AS donor
    FROM i JOIN o USING (draw, r))
SELECT dn.draw, p.symbol, round(corr(p.ret, q.signal), 6) AS c, max(donor) AS donor FROM panel p JOIN dn ON p.symbol = dn.symbol JOIN panel q ON q.symbol = dn.donor
    AND q.day = p.day GROUP BY dn.draw, p.symbol"""))
def permuted(spark, d):
    """Each draw gives every symbol the whole history of a donor."""
    from panelia.operators import inference as N

    p = week_weights(spark, d).select("symbol", "day", "ret", "signal")
    donors = N.donor_map(p, 5, "7")
    q = p.select(F.col("symbol").alias("donor"), "day", F.col("signal").alias("other"))
    m = p.join(donors, "symbol").join(q, ["donor", "day"])
    return m.groupBy("draw", "symbol").agg(F.round(F.corr("ret", "other"), 6).alias("c"), F.max("donor").alias("donor"))


@query("j17_lagged_products", T.with_sql(NAMES, WEEK + """
, x AS (SELECT row_number() OVER (ORDER BY day) AS n, net - avg(net) OVER () AS e FROM live)
SELECT l AS lag, count(*) AS n, round(sum(a.e * b.e) * 1e4, 8) AS product FROM x a JOIN (SELECT unnest(range(1, 8)) AS l) ON true JOIN x b ON b.n = a.n - l GROUP BY l"""))
def lagged_products(spark, d):
    """Sums of a series times its own lags."""
    from panelia.operators import accounting as A
    from panelia.operators import inference as N

    return N.lagged_products(A.trimmed(A.account(week_weights(spark, d), 0.001)), "net", 7).select(F.col("lag").cast("bigint").alias("lag"), "n",
        F.round(F.col("product") * 1e4, 8).alias("product"))


@query("j18_j19_j21_gates", T.with_sql("decision", """
, st AS (SELECT symbol, arg_max(event_type, ts) AS latest FROM decision GROUP BY symbol)
, ok AS (SELECT side, regime, event_type FROM decision GROUP BY ALL HAVING count(pnl) >= 5 AND avg((pnl > 0)::INT) >= 0.3)
SELECT d.event_id, st.latest, (d.side, d.regime, d.event_type) IN (SELECT (side, regime, event_type) FROM ok) AS allowed FROM decision d JOIN st USING (symbol)
    WHERE NOT (d.regime = 'R1' AND d.side = 'SHORT' AND d.symbol % 4 = 1)"""))
def gates(spark, d):
    """Latest status on every row, groups that pass a gate, a deny list taken out."""
    x = T.decisions(spark, d)
    latest = x.groupBy("symbol").agg(F.max_by("event_type", "ts").alias("latest"))
    group = ["side", "regime", "event_type"]
    ok = x.groupBy(*group).agg(F.count("pnl").alias("n"), F.avg((F.col("pnl") > 0).cast("int")).alias("win")).filter("n >= 5 AND win >= 0.3").select(*group,
        F.lit(True).alias("ok"))
    deny = x.select("symbol").distinct().filter("symbol % 4 = 1").select("symbol", F.lit("R1").alias("regime"), F.lit("SHORT").alias("side"))
    return x.join(deny, ["symbol", "regime", "side"], "left_anti").join(latest, "symbol").join(ok, group, "left").select("event_id", "latest", F.coalesce("ok",
        F.lit(False)).alias("allowed"))


@query("j20_following_bars", T.with_sql("bars_4h ev", """
, m AS (SELECT e.event_id, b.high, b.low, e.value, row_number() OVER (PARTITION BY e.event_id ORDER BY b.bar) AS r FROM ev e JOIN bars_4h b ON b.symbol = e.symbol
    AND b.bar > e.ts AND b.bar <= date_trunc('second', e.ts) + INTERVAL '1 day' WHERE e.event_type = 'purchase')
SELECT event_id, count(*) AS n, round(max(high / value - 1), 6) AS mfe, round(min(low / value - 1), 6) AS mae FROM m WHERE r <= 4 GROUP BY event_id"""))
def following(spark, d):
    """The first bars after an event within a day; best and worst excursion."""
    e = T.events(spark, d).filter("event_type = 'purchase'").select("event_id", "symbol", "ts", "value")
    m = J.following(e, T.bars_4h(spark, d).select("symbol", "bar", "high", "low"), "symbol", "ts", "bar", 4, 86400)
    return m.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max(S.ieee_ratio(F.col("high"), F.col("value")) - 1), 6).alias("mfe"),
        F.round(F.min(S.ieee_ratio(F.col("low"), F.col("value")) - 1), 6).alias("mae"))
