"""Queries of per-entity windows (survey S.over()) and scalar functions (P) on daily bars."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelia.functions import series as S
from panelia.operators import states
from panelia.plans.registry import query
from panelia.sources import stand_ins as T

PART = "PARTITION BY symbol ORDER BY day"


def day(*names):
    """SQL select list: keys, then rounded expressions."""
    return "SELECT symbol, day::VARCHAR AS day, " + ", ".join(f"round({e}, 6) AS {n}" for n, e in names)


def r6(**columns):
    return [S.ieee_round(c, 6).alias(n) for n, c in columns.items()]


def sroll(x, n, m, fn="avg"):
    f = f"OVER ({PART} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {f} >= {m} THEN {fn}({x}) {f} END"


def bars(spark, d):
    return T.bars_day(spark, d)


BD = "bars_day"


@query("p1_p9_candle_shape", T.with_sql(BD, """
SELECT symbol, day::VARCHAR AS day, round(high / nullif(low, 0) - 1, 6) AS range_pct, round(close / nullif(open, 0) - 1, 6) AS body_pct,
 round((high - greatest(open, close)) / nullif(close, 0), 6) AS upper_wick, round((least(open, close) - low) / nullif(close, 0), 6) AS lower_wick,
 round(abs(close - open), 6) AS body_abs, round(least(open, close), 6) AS body_low, round(greatest(open, close), 6) AS body_high,
 round(ln(1 + quote), 6) AS log_quote, round(ln(high / low), 6) AS log_range, round(2 * (taker / nullif(volume, 0)) - 1, 6) AS imbalance,
 sign(close - open)::DOUBLE AS direction, round(CASE WHEN abs(close / open - 1) <> 'inf'::DOUBLE THEN least(greatest(close / open - 1, -0.5), 2) END, 6) AS clipped
FROM bars_day"""))
def candle_shape(spark, d):
    """Safe ratios, candle shape, clip, logs, imbalance, sign."""
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))  # noqa: E741
    return bars(spark, d).select(
        "symbol", S.day_text(),
        *r6(
            range_pct=S.safe_ratio(h, l) - 1, body_pct=S.safe_ratio(c, o) - 1,
            upper_wick=S.safe_ratio(h - F.greatest(o, c), c), lower_wick=S.safe_ratio(F.least(o, c) - l, c),
            body_abs=F.abs(c - o), body_low=F.least(o, c), body_high=F.greatest(o, c), log_quote=F.log1p("quote"),
            log_range=S.ieee_log(S.ieee_ratio(h, l)), imbalance=2 * S.safe_ratio(F.col("taker"), F.col("volume")) - 1,
        ),
        F.signum(c - o).alias("direction"),
        *r6(clipped=S.clip(S.finite(S.ieee_ratio(c, o) - 1), -0.5, 2.0)),
    )


@query("p7_p25_calendar", T.with_sql("ev", """
SELECT event_id, hour(ts)::BIGINT AS hour, ((dayofweek(ts) + 6) % 7)::BIGINT AS weekday, strftime(time_bucket(INTERVAL '15 minutes', ts), '%Y-%m-%d %H:%M:%S') AS bar_floor,
 strftime(time_bucket(INTERVAL '15 minutes', ts - INTERVAL '1 microsecond') + INTERVAL '15 minutes', '%Y-%m-%d %H:%M:%S') AS bar_ceil,
 strftime(ts, '%G-') || lpad(ltrim(strftime(ts, '%V'), '0'), 2, '0') AS iso_week FROM ev"""))
def calendar_parts(spark, d):
    """P7, P25 and ISO weeks."""
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    floor = F.window("ts", "15 minutes").getField("start")
    micro = F.unix_micros(F.col("ts").cast("timestamp"))
    step = 900_000_000
    return T.events(spark, d).select(
        "event_id", F.hour("ts").cast("bigint").alias("hour"), F.weekday("ts").cast("bigint").alias("weekday"),
        text(floor).alias("bar_floor"), text(F.timestamp_micros(F.ceil(micro / step) * step)).alias("bar_ceil"),
        F.concat_ws("-", F.extract(F.lit("YEAROFWEEK"), "ts").cast("string"), F.lpad(F.weekofyear("ts").cast("string"), 2, "0")).alias("iso_week"),
    )


@query("p10_p14_rules", T.with_sql("decision", """
SELECT event_id, ((side = 'LONG')::INT + (proba >= 0.55)::INT + (k % 3 = 0)::INT + (regime = 'R1')::INT)::BIGINT AS score,
 (((side = 'LONG')::INT + (proba >= 0.55)::INT + (k % 3 = 0)::INT + (regime = 'R1')::INT) >= 3 AND regime = 'R1') AS candidate,
 CASE WHEN proba >= 0 AND proba < 0.55 THEN '[0,.55)' WHEN proba >= 0.55 AND proba < 0.6 THEN '[.55,.60)' WHEN proba >= 0.6 AND proba < 0.7 THEN '[.60,.70)'
  WHEN proba >= 0.7 AND proba < 0.8 THEN '[.70,.80)' WHEN proba >= 0.8 AND proba < 1.01 THEN '[.80,1.01)' ELSE 'out' END AS bucket,
 CASE WHEN contains(event_type, 'purch') THEN 'LIVE' WHEN starts_with(event_type, 'sign') THEN 'PAPER' WHEN event_type = 'error' THEN 'REJECTED'
  WHEN regexp_matches(event_type, 'cl[a-z]+k') THEN 'RESEARCH' ELSE 'OTHER' END AS layer,
 round(coalesce(pnl, CASE WHEN k % 2 = 0 THEN proba / 100 END, -0.001), 8) AS outcome, coalesce(nullif(k, 99), 999)::BIGINT AS filled FROM decision"""))
def rules(spark, d):
    """Rule scores, half-open buckets, ordered classification, coalesced outcome."""
    flag = lambda c: c.cast("int")
    p = F.col("proba")
    score = flag(F.col("side") == "LONG") + flag(p >= 0.55) + flag(F.col("k") % 3 == 0) + flag(F.col("regime") == "R1")
    edges = [(0, 0.55, "[0,.55)"), (0.55, 0.6, "[.55,.60)"), (0.6, 0.7, "[.60,.70)"), (0.7, 0.8, "[.70,.80)"), (0.8, 1.01, "[.80,1.01)")]
    bucket = F.coalesce(*[F.when((p >= a) & (p < b), n) for a, b, n in edges], F.lit("out"))
    e = F.col("event_type")
    layer = (
        F.when(e.contains("purch"), "LIVE").when(e.startswith("sign"), "PAPER").when(e == "error", "REJECTED")
        .when(e.rlike("cl[a-z]+k"), "RESEARCH").otherwise("OTHER")
    )
    return T.decisions(spark, d).select(
        "event_id", score.cast("bigint").alias("score"), ((score >= 3) & (F.col("regime") == "R1")).alias("candidate"),
        bucket.alias("bucket"), layer.alias("layer"),
        F.round(F.coalesce("pnl", F.when(F.col("k") % 2 == 0, p / 100), F.lit(-0.001)), 8).alias("outcome"),
        F.coalesce(F.nullif("k", F.lit(99)), F.lit(999)).cast("bigint").alias("filled"),
    )


@query("p15_p16_text", T.with_sql("decision", """
, raw AS (SELECT event_id, ts, symbol, CASE k % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(ts, '%d/%m/%Y %H:%M') ELSE 'n/a' END AS stamp,
  'TAIL_BLOCK:proba<' || printf('%.2f', proba) AS reason FROM decision)
SELECT symbol, count(coalesce(try_strptime(stamp, '%Y-%m-%d %H:%M:%S'), try_strptime(stamp, '%d/%m/%Y %H:%M'))) AS n_parsed,
 max(strftime(coalesce(try_strptime(stamp, '%Y-%m-%d %H:%M:%S'), try_strptime(stamp, '%d/%m/%Y %H:%M')), '%Y-%m-%d %H:%M')) AS latest,
 arg_max(regexp_extract(reason, '<([0-9.]+)', 1), ts) AS threshold FROM raw GROUP BY symbol"""))
def texts(spark, d):
    """Timestamps in mixed formats (bad ones null), a captured threshold, the latest one."""
    t = F.col("ts")
    stamp = F.when(F.col("k") % 3 == 0, F.date_format(t, "yyyy-MM-dd HH:mm:ss")).when(F.col("k") % 3 == 1, F.date_format(t, "dd/MM/yyyy HH:mm")).otherwise("n/a")
    raw = T.decisions(spark, d).select("symbol", "ts", stamp.alias("stamp"), F.concat(F.lit("TAIL_BLOCK:proba<"), F.format_string("%.2f", "proba")).alias("reason"))
    parsed = F.coalesce(F.try_to_timestamp("stamp", F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp("stamp", F.lit("dd/MM/yyyy HH:mm")))
    return raw.groupBy("symbol").agg(
        F.count(parsed).alias("n_parsed"), F.max(F.date_format(parsed, "yyyy-MM-dd HH:mm")).alias("latest"),
        F.max_by(F.regexp_extract("reason", "<([0-9.]+)", 1), "ts").alias("threshold"),
    )


@query("p17_grid_snap", T.with_sql("ev", """
SELECT event_id, epoch(ts)::DOUBLE - epoch(ts)::DOUBLE % 1 AS whole, round(epoch_us(ts) / 60000000.0)::BIGINT AS near_minute,
 CASE WHEN abs(epoch_us(ts) - round(epoch_us(ts) / 60000000.0)::BIGINT * 60000000) <= 5000000 THEN round(epoch_us(ts) / 60000000.0)::BIGINT END AS snapped FROM ev"""))
def grid_snap(spark, d):
    """Snap to the grid only within a tolerance."""
    micro = F.unix_micros(F.col("ts").cast("timestamp"))
    near = F.round(micro / 60_000_000.0).cast("bigint")
    return T.events(spark, d).select(
        "event_id", F.floor(micro / 1e6).cast("double").alias("whole"), near.alias("near_minute"),
        F.when(F.abs(micro - near * 60_000_000) <= 5_000_000, near).alias("snapped"),
    )


@query("p18_p20_signed_steps", T.with_sql("fill", """
SELECT side, run::VARCHAR AS run, count(*) AS n, round(avg(CASE WHEN side = 'BUY' THEN price / reference - 1 ELSE reference / price - 1 END), 6) AS signed_return,
 round(avg(CASE WHEN side = 'BUY' THEN 1 ELSE -1 END * (price / reference - 1) * 10000), 4) AS slippage_bps,
 sum(floor(qty::DECIMAL(38,6) / 0.25::DECIMAL(38,6))::DOUBLE * 0.25) AS floor_step, sum(ceil(qty::DECIMAL(38,6) / 7::DECIMAL(38,6))::DOUBLE * 7) AS ceil_step,
 round(max(greatest(0.25 * 2, 5 / price * 1.1)), 8) AS tolerance FROM fill GROUP BY side, run"""))
def signed_steps(spark, d):
    """Side-signed returns, decimal steps, tolerance budget."""
    p, ref, qty = F.col("price"), F.col("reference"), F.col("qty").cast("decimal(38,6)")
    buy = F.col("side") == "BUY"
    return T.fills(spark, d).groupBy("side", F.col("run").cast("string").alias("run")).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(F.when(buy, p / ref - 1).otherwise(ref / p - 1)), 6).alias("signed_return"),
        F.round(F.avg(F.when(buy, 1).otherwise(-1) * (p / ref - 1) * 10000), 4).alias("slippage_bps"),
        F.sum(F.floor(qty / F.lit("0.25").cast("decimal(38,6)")).cast("double") * 0.25).alias("floor_step"),
        F.sum(F.ceil(qty / F.lit(7)).cast("double") * 7).alias("ceil_step"),
        F.round(F.max(F.greatest(F.lit(0.5), 5 / p * 1.1)), 8).alias("tolerance"),
    )


@query("p21_p22_ids", T.with_sql("decision", """
SELECT day::VARCHAR AS day, substr(sha256(min(concat_ws('|', day::VARCHAR, upper(side), symbol::VARCHAR, '2'))), 1, 24) AS decision_id,
 substr(sha256(string_agg(DISTINCT symbol::VARCHAR || '=' || side, ',' ORDER BY symbol::VARCHAR || '=' || side)), 1, 16) AS target_id FROM decision GROUP BY day"""))
def stable_ids(spark, d):
    """SHA-256 ids of joined keys and of sorted members."""
    key = F.concat_ws("|", F.col("day").cast("string"), F.upper("side"), F.col("symbol").cast("string"), F.lit("2"))
    member = F.concat(F.col("symbol").cast("string"), F.lit("="), "side")
    return T.decisions(spark, d).groupBy("day").agg(
        F.substring(F.sha2(F.min(key), 256), 1, 24).alias("decision_id"),
        F.substring(F.sha2(F.concat_ws(",", F.array_sort(F.collect_set(member))), 256), 1, 16).alias("target_id"),
    ).withColumn("day", F.col("day").cast("string"))


LAGS = (1, 2, 3, 6)


@query("w1_w3_lags", T.with_sql(BD, day(
    *[(f"close_lag{k}", f"lag(close, {k}) OVER ({PART})") for k in LAGS], ("next_close", f"lead(close) OVER ({PART})"),
    *[(f"change{k}", f"close / nullif(lag(close, {k}) OVER ({PART}), 0) - 1") for k in LAGS],
    ("diff", f"close - lag(close) OVER ({PART})"), ("log_return", f"ln(close) - ln(lag(close) OVER ({PART}))")) + " FROM bars_day"))
def lags(spark, d):
    """Lag, lead, percent change without padding, difference."""
    c = F.col("close")
    return bars(spark, d).select("symbol", S.day_text(), *r6(
        **{f"close_lag{k}": F.lag(c, k).over(S.over()) for k in LAGS}, next_close=F.lead(c).over(S.over()),
        **{f"change{k}": S.pct_change(c, k, S.over()) for k in LAGS},
        diff=c - F.lag(c).over(S.over()), log_return=S.ieee_log(c) - S.ieee_log(F.lag(c).over(S.over()))))


@query("w4_w5_rolling", T.with_sql(BD, day(
    ("mean7", sroll("close", 7, 7)), ("sum7", sroll("volume", 7, 3, "sum")), ("std7", sroll("close", 7, 4, "stddev_samp")),
    ("z7", f"(close - ({sroll('close', 7, 4)})) / nullif({sroll('close', 7, 4, 'stddev_samp')}, 0)")) + " FROM bars_day"))
def rolling(spark, d):
    """Rolling mean, sum, deviation with a least count; z-score."""
    c = F.col("close")
    return bars(spark, d).select("symbol", S.day_text(), *r6(
        mean7=S.rolling(c, 7, 7, S.over()), sum7=S.rolling(F.col("volume"), 7, 3, S.over(), F.sum), std7=S.rolling(c, 7, 4, S.over(), F.stddev_samp), z7=S.zscore(c,
            7, 4, S.over())))


_PRIOR = f"OVER ({PART} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)"


@query("w6_w7_extremes", T.with_sql(BD, day(
    ("breakout", f"CASE WHEN count(high) {_PRIOR} = 10 THEN close / max(high) {_PRIOR} - 1 END"),
    ("breakdown", f"CASE WHEN count(low) {_PRIOR} = 10 THEN close / min(low) {_PRIOR} - 1 END"),
    ("q75", sroll("volume", 12, 12, "quantile_cont").replace("quantile_cont(volume)", "quantile_cont(volume, 0.75)"))) + " FROM bars_day"))
def extremes(spark, d):
    """Against the prior ten bars; rolling quantile with interpolation."""
    prior = S.over().rowsBetween(-10, -1)
    c = F.col("close")
    return bars(spark, d).select("symbol", S.day_text(), *r6(
        breakout=F.when(F.count("high").over(prior) == 10, S.ieee_ratio(c, F.max("high").over(prior)) - 1),
        breakdown=F.when(F.count("low").over(prior) == 10, S.ieee_ratio(c, F.min("low").over(prior)) - 1),
        q75=S.rolling(F.col("volume"), 12, 12, S.over(), lambda x: F.percentile(x, 0.75))))


SPANS = (5, 12)


@query("w8_w13_ema", T.with_sql(BD, """
, RECURSIVE_ROWS AS (SELECT symbol, day, close, row_number() OVER (PARTITION BY symbol ORDER BY day) AS n FROM bars_day)
, e AS (SELECT a.symbol, a.day, a.n, a.close, sum(CASE WHEN b.n = 1 THEN 1 ELSE 2.0::DOUBLE / 6 END * pow(1 - 2.0::DOUBLE / 6, a.n - b.n) * b.close) AS ema5,
   sum(CASE WHEN b.n = 1 THEN 1 ELSE 2.0::DOUBLE / 13 END * pow(1 - 2.0::DOUBLE / 13, a.n - b.n) * b.close) AS ema12
  FROM RECURSIVE_ROWS a JOIN RECURSIVE_ROWS b ON a.symbol = b.symbol AND b.n <= a.n GROUP BY a.symbol, a.day, a.n, a.close)
SELECT symbol, day::VARCHAR AS day, round(ema5, 6) AS ema5, round(ema12, 6) AS ema12, round(ema5 - ema12, 6) AS macd,
 round(close / nullif(ema12, 0) - 1, 6) AS distance, round(ema5 / nullif(lag(ema5, 3) OVER (PARTITION BY symbol ORDER BY day), 0) - 1, 6) AS slope3 FROM e"""))
def ema(spark, d):
    """Exponential means by a two-level affine scan, trend distance and slope."""
    e = states.exponential_means(bars(spark, d).select("symbol", "day", "close"), "symbol", "day", "close", SPANS, chunk=8)
    return e.select("symbol", S.day_text(), *r6(
        ema5=F.col("ema5"), ema12=F.col("ema12"), macd=F.col("ema5") - F.col("ema12"),
        distance=S.safe_ratio(F.col("close"), F.col("ema12")) - 1, slope3=S.pct_change(F.col("ema5"), 3, S.over())))


_M = f"(close - lag(close) OVER ({PART}))"


@query("w9_w12_indicators", T.with_sql(BD, f"""
, m AS (SELECT *, {_M} AS move, greatest(high - low, abs(high - lag(close) OVER ({PART})), abs(low - lag(close) OVER ({PART}))) AS tr FROM bars_day)
, v AS (SELECT *, {sroll('move', 6, 6, 'stddev_samp')} AS vol6, {sroll('tr', 7, 7)} AS atr,
   CASE WHEN count(move) OVER ({PART} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) >= 7 THEN 100 - 100 / (1 + avg(greatest(move,
       0)) OVER ({PART} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)
     / nullif(avg(greatest(-move, 0)) OVER ({PART} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 0)) END AS rsi FROM m)
""" + day(("rsi", "rsi"), ("tr", "tr"), ("atr", "atr"), ("band_high", f"({sroll('close', 10, 10)}) + 2 * ({sroll('close', 10, 10, 'stddev_samp')})"),
          ("band_width", f"4 * ({sroll('close', 10, 10, 'stddev_samp')}) / nullif({sroll('close', 10, 10)}, 0)"),
          ("atr_regime", f"atr / nullif({sroll('atr', 10, 5)}, 0)"), ("vol_regime", f"vol6 / nullif({sroll('vol6', 10, 5)}, 0)"),
          ("volume_regime", f"volume / nullif({sroll('volume', 10, 5)}, 0) - 1")) + " FROM v"))
def indicators(spark, d):
    """RSI, Bollinger bands, true range and ATR, volatility and volume regimes."""
    c, h, l = F.col("close"), F.col("high"), F.col("low")  # noqa: E741
    before = F.lag(c).over(S.over())
    b = bars(spark, d).withColumns({"move": c - before, "tr": F.greatest(h - l, F.abs(h - before), F.abs(l - before)), "rsi": S.rsi(c, 7, S.over())})
    b = b.withColumns({"vol6": S.rolling(F.col("move"), 6, 6, S.over(), F.stddev_samp), "atr": S.rolling(F.col("tr"), 7, 7, S.over())})
    mean, dev = S.rolling(c, 10, 10, S.over()), S.rolling(c, 10, 10, S.over(), F.stddev_samp)
    regime = lambda x: S.safe_ratio(F.col(x), S.rolling(F.col(x), 10, 5, S.over()))
    return b.select("symbol", S.day_text(), *r6(
        rsi=F.col("rsi"), tr=F.col("tr"), atr=F.col("atr"), band_high=mean + 2 * dev, band_width=S.safe_ratio(4 * dev, mean),
        atr_regime=regime("atr"), vol_regime=regime("vol6"), volume_regime=regime("volume") - 1))


@query("w14_w15_carry", T.with_sql(BD, day(
    ("last_low", f"last_value(CASE WHEN close < open THEN low END IGNORE NULLS) OVER ({PART} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"),
    ("last_high", f"last_value(CASE WHEN close > open THEN high END IGNORE NULLS) OVER ({PART} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"),
    ("filled", f"last_value(CASE WHEN volume >= 3 THEN close END IGNORE NULLS) OVER ({PART} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")) + " FROM bars_day"))
def carry(spark, d):
    """Last value at which a flag held; forward fill."""
    return bars(spark, d).select("symbol", S.day_text(), *r6(
        last_low=S.carry_forward(F.col("close") < F.col("open"), F.col("low"), S.over()),
        last_high=S.carry_forward(F.col("close") > F.col("open"), F.col("high"), S.over()),
        filled=S.carry_forward(F.col("volume") >= 3, F.col("close"), S.over())))


@query("w16_time_window", T.with_sql("settle", """
SELECT symbol, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, count(*) OVER w AS n, round(CASE WHEN count(*) OVER w >= 3 THEN sum(rate) OVER w END, 9) AS sum7d
FROM settle WINDOW w AS (PARTITION BY symbol ORDER BY epoch_us(ts) RANGE BETWEEN 604799999999 PRECEDING AND CURRENT ROW)"""))
def time_window(spark, d):
    """The last seven days, open at the left end."""
    micro = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("symbol").orderBy(micro).rangeBetween(-7 * 86_400_000_000 + 1, 0)
    n = F.count(F.lit(1)).over(w)
    return T.settlements(spark, d).select("symbol", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), n.alias("n"), F.round(F.when(n >= 3,
        F.sum("rate").over(w)), 9).alias("sum7d"))


_BETA = f"OVER ({PART} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"


@query("w17_w18_beta", T.with_sql(BD, f"""
, r AS (SELECT *, ln(close) - ln(lag(close) OVER ({PART})) AS ret FROM bars_day), mk AS (SELECT *, avg(ret) OVER (PARTITION BY day) AS mkt FROM r)
, b AS (SELECT *, CASE WHEN count(ret) {_BETA} >= 5 THEN covar_samp(ret,
    CASE WHEN ret IS NOT NULL THEN mkt END) {_BETA} / nullif(var_samp(CASE WHEN ret IS NOT NULL THEN mkt END) {_BETA}, 0) END AS beta_now FROM mk)
""" + day(("beta", f"lag(CASE WHEN beta_now IS NOT NULL THEN least(greatest(beta_now, 0), 3) END) OVER ({PART})"), ("parkinson",
    f"sqrt({sroll('(ln(high / low) ^ 2 / (4 * ln(2)))', 7, 5)})"), ("log_std", sroll("ret", 7, 5, "stddev_samp"))) + " FROM b"))
def beta(spark, d):
    """Lagged rolling beta against the cross-section, Parkinson and log volatility."""
    c = F.col("close")
    r = bars(spark, d).withColumn("ret", S.ieee_log(c) - S.ieee_log(F.lag(c).over(S.over()))).withColumn("mkt", F.avg("ret").over(Window.partitionBy("day")))
    f = S.over().rowsBetween(-9, 0)
    paired = F.when(F.col("ret").isNotNull(), F.col("mkt"))
    now = F.when(F.count("ret").over(f) >= 5, S.safe_ratio(F.covar_samp("ret", paired).over(f), F.var_samp(paired).over(f)))
    b = r.withColumn("beta_now", S.clip(now, 0.0, 3.0))
    park = F.pow(S.ieee_log(S.ieee_ratio(F.col("high"), F.col("low"))), 2) / (4 * F.log(F.lit(2.0)))
    return b.select("symbol", S.day_text(), *r6(beta=F.lag("beta_now").over(S.over()), parkinson=F.sqrt(S.rolling(park, 7, 5, S.over())),
        log_std=S.rolling(F.col("ret"), 7, 5, S.over(), F.stddev_samp)))


_ALL = f"OVER ({PART} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query("w19_w21_equity", T.with_sql("bars_week", f"""
, r AS (SELECT *, close / lag(close) OVER ({PART}) - 1 AS ret FROM bars_week)
, e AS (SELECT *, exp(sum(ln(1 + coalesce(ret, 0))) {_ALL}) AS equity, sum(coalesce(ret, 0)) {_ALL} AS additive FROM r)
SELECT symbol, day::VARCHAR AS day, row_number() OVER ({PART}) AS n, round(equity, 6) AS equity, round(equity / max(equity) {_ALL} - 1, 6) AS drawdown,
 round(equity / greatest(max(equity) {_ALL}, 1) - 1, 6) AS drawdown_nav, round(additive - max(additive) {_ALL}, 6) AS drawdown_add,
 close > ({sroll('close', 10, 10)}) AS above_mean FROM e"""))
def equity(spark, d):
    """Running product, drawdown in three forms, ordinal, moving-average state."""
    b = T.bars_week(spark, d).withColumn("ret", F.coalesce(S.pct_change(F.col("close"), 1, S.over()), F.lit(0.0)))
    run = S.over().rowsBetween(Window.unboundedPreceding, 0)
    e = b.withColumns({"equity": F.product(1 + F.col("ret")).over(run), "additive": F.sum("ret").over(run)})
    peak, apeak = F.max("equity").over(run), F.max("additive").over(run)
    return e.select("symbol", S.day_text(), F.row_number().over(S.over()).cast("bigint").alias("n"), *r6(
        equity=F.col("equity"), drawdown=F.col("equity") / peak - 1, drawdown_nav=F.col("equity") / F.greatest(peak, F.lit(1.0)) - 1, drawdown_add=F.col("additive") - apeak),
        (F.col("close") > S.rolling(F.col("close"), 10, 10, S.over())).alias("above_mean"))


@query("w22_cadence", T.with_sql(BD, f"""
, s AS (SELECT symbol, day - lag(day) OVER ({PART}) AS step FROM bars_day)
SELECT symbol, count(*) AS n, bool_and(coalesce(step, 1) = 1) AS regular, coalesce(max(step), 0)::BIGINT AS widest FROM s GROUP BY symbol"""))
def cadence(spark, d):
    """Whether every step of a key is one period."""
    s = bars(spark, d).select("symbol", F.datediff("day", F.lag("day").over(S.over())).alias("step"))
    return s.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.every(F.coalesce("step", F.lit(1)) == 1).alias("regular"), F.coalesce(F.max("step"),
        F.lit(0)).cast("bigint").alias("widest"))


@query("w23_sequences", T.with_sql(BD, f"""
, s AS (SELECT symbol, day, close, list(close) OVER ({PART} ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS x FROM bars_day)
SELECT symbol, day::VARCHAR AS day, round((list_min(x) - list_avg(x)) / nullif(list_stddev_pop(x), 0), 6) AS low_z,
    round((close - list_avg(x)) / nullif(list_stddev_pop(x), 0), 6) AS last_z FROM s WHERE len(x) = 8"""))
def sequences(spark, d):
    """Sliding sequences scaled by their own mean and deviation; their ends are returned."""
    s = bars(spark, d).withColumn("x", F.collect_list("close").over(S.over().rowsBetween(-7, 0))).filter(F.size("x") == 8)
    add = lambda a, x: a + x
    mean = F.aggregate("x", F.lit(0.0), add) / 8
    s = s.withColumn("m", mean).withColumn("sd", F.sqrt(F.aggregate(F.transform("x", lambda v: F.pow(v - F.col("m"), 2)), F.lit(0.0), add) / 8))
    z = s.withColumn("z", F.transform("x", lambda v: S.safe_ratio(v - F.col("m"), F.col("sd"))))
    return z.select("symbol", S.day_text(), *r6(low_z=F.array_min("z"), last_z=F.element_at("z", -1)))


@query("w24_w25_streaks", T.with_sql("decision", """
, wk AS (SELECT symbol, day, sum(coalesce(pnl, 0)) AS pnl FROM decision GROUP BY symbol, day)
, f AS (SELECT *, pnl < 0 AS bad, lead(day) OVER (PARTITION BY symbol ORDER BY day) - day AS gap, coalesce(lag(pnl) OVER (PARTITION BY symbol ORDER BY day), 0) < 0 AS was FROM wk)
, i AS (SELECT *, sum((bad <> was)::INT) OVER (PARTITION BY symbol ORDER BY day) AS island FROM f)
, g AS (SELECT symbol, island, count(*) AS n, max(day) AS last FROM i WHERE bad GROUP BY symbol, island)
, l AS (SELECT symbol, max(day) AS end_day, coalesce(max(gap), 0) AS widest FROM f GROUP BY symbol)
SELECT l.symbol, coalesce(max(n), 0)::BIGINT AS longest, coalesce(max(CASE WHEN g.last = l.end_day THEN n END), 0)::BIGINT AS running,
    max(l.widest)::BIGINT AS widest FROM l LEFT JOIN g USING (symbol) GROUP BY l.symbol"""))
def streaks(spark, d):
    """Intervals to the next reading; longest and running streak of losing days."""
    w = T.decisions(spark, d).groupBy("symbol", "day").agg(F.sum(F.coalesce("pnl", F.lit(0.0))).alias("pnl"))
    f = w.withColumns({"bad": F.col("pnl") < 0, "gap": F.datediff(F.lead("day").over(S.over()), "day")})
    s = states.streaks(f, "symbol", "day", "bad")
    ends = f.groupBy("symbol").agg(F.max("day").alias("end_day"), F.coalesce(F.max("gap"), F.lit(0)).alias("widest"))
    return ends.join(s, "symbol", "left").groupBy("symbol").agg(
        F.coalesce(F.max("n"), F.lit(0)).cast("bigint").alias("longest"),
        F.coalesce(F.max(F.when(F.col("last") == F.col("end_day"), F.col("n"))), F.lit(0)).cast("bigint").alias("running"),
        F.max("widest").cast("bigint").alias("widest"),
    )


@query("w26_w28_last_batches", T.with_sql("decision", """
, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) - 1 AS rn, sum(pnl) OVER (PARTITION BY symbol ORDER BY ts) AS eq FROM decision WHERE pnl IS NOT NULL)
, h AS (SELECT *, greatest(max(eq) OVER (PARTITION BY symbol ORDER BY ts), 0) AS hwm FROM r)
, b AS (SELECT symbol, floor(rn / 5)::BIGINT AS batch, count(*) AS n, sum(pnl) AS total, bool_or(hwm - eq >= 0.2) AS halted FROM h WHERE rn < 15 GROUP BY symbol, batch)
SELECT symbol, sum(n)::BIGINT AS n, round(sum(total), 6) AS total, bool_and(total > -0.1) AS passes, bool_or(halted) AS halted FROM b GROUP BY symbol"""))
def last_batches(spark, d):
    """Last rows of each key in batches that must all pass; loss from the high-water mark."""
    by = Window.partitionBy("symbol")
    run = by.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    r = T.decisions(spark, d).filter("pnl IS NOT NULL").withColumns({"rn": F.row_number().over(by.orderBy(F.desc("ts"))) - 1, "eq": F.sum("pnl").over(run)})
    h = r.withColumn("hwm", F.greatest(F.max("eq").over(run), F.lit(0.0))).filter("rn < 15")
    b = h.groupBy("symbol", F.floor(F.col("rn") / 5).alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.sum("pnl").alias("total"),
        F.bool_or(F.col("hwm") - F.col("eq") >= 0.2).alias("halted"))
    return b.groupBy("symbol").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 6).alias("total"), F.every(F.col("total") > -0.1).alias("passes"),
        F.bool_or("halted").alias("halted"))
