"""Query of setup rules (survey P10)."""

from pyspark.sql import functions as F

from panelia.functions import series as S
from panelia.operators import states
from panelia.plans.registry import query
from panelia.sources import stand_ins as T

PART = "PARTITION BY symbol ORDER BY day"


def _roll(x, n, fn="avg"):
    w = f"OVER ({PART} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {w} >= {n} THEN {fn}({x}) {w} END"


def _ema(x, span):
    a = f"2.0::DOUBLE / {span + 1}"
    return f"sum(CASE WHEN b.n = 1 THEN 1 ELSE {a} END * pow(1 - {a}, a.n - b.n) * b.{x})"


#: Flags of each side and of both, by expressions that both engines read (fixed values: thresholds).
LONG = {
    "trend": "ema14 > ema50 AND strength > -0.002", "macd": "macd_gap > -0.0005", "rsi": "rsi BETWEEN 0.44 AND 0.74", "break_": "breakout > -0.03", "slope": "slope14 > -0.002 AND slope50 > -0.003",
}
SHORT = {
    "trend": "ema14 < ema50 AND strength < 0.002", "macd": "macd_gap < 0.0005", "rsi": "rsi BETWEEN 0.26 AND 0.56", "break_": "breakdown < 0.03", "slope": "slope14 < 0.002 AND slope50 < 0.003",
}
BOTH = {"atr": "atr_pct <= 0.03", "volatility": "volatility <= 1.9", "volume": "volume_regime > -0.40"}


def _score(side):
    flags = side | BOTH
    total = " + ".join(f"CAST(coalesce({x}, false) AS INT)" for x in flags.values())
    return total, f"({total}) >= 5 AND coalesce({side['trend']}, false) AND coalesce({BOTH['atr']}, false)"


@query("p10_setup_scores", T.with_sql("bars_week", f"""
, o AS (SELECT *, row_number() OVER ({PART}) AS n, close - lag(close) OVER ({PART}) AS mv, close / nullif(lag(close) OVER ({PART}), 0) - 1 AS ret,
    greatest(high - low, abs(high - lag(close) OVER ({PART})), abs(low - lag(close) OVER ({PART}))) AS tr FROM bars_week)
, e AS (SELECT a.symbol, a.day, a.n, {_ema('close', 14)} AS ema14, {_ema('close', 50)} AS ema50, {_ema('close', 12)} - {_ema('close', 26)} AS macd FROM o a JOIN o b ON a.symbol = b.symbol AND b.n <= a.n GROUP BY a.symbol, a.day, a.n)
, g AS (SELECT a.symbol, a.day, {_ema('macd', 9)} AS signal FROM e a JOIN e b ON a.symbol = b.symbol AND b.n <= a.n GROUP BY a.symbol, a.day)
, p AS (SELECT o.*, ema14, ema50, macd - signal AS macd_gap, (ema14 - ema50) / nullif(close, 0) AS strength, CASE WHEN mv IS NOT NULL THEN greatest(mv, 0) END AS up, CASE WHEN mv IS NOT NULL THEN greatest(-mv, 0) END AS down,
    {_roll('ret', 24, 'stddev_samp')} AS v24 FROM o JOIN e USING (symbol, day) JOIN g USING (symbol, day))
, f AS (SELECT symbol, day, ema14, ema50, macd_gap, strength, ema14 / nullif(lag(ema14, 3) OVER ({PART}), 0) - 1 AS slope14, ema50 / nullif(lag(ema50, 6) OVER ({PART}), 0) - 1 AS slope50,
    (100 - 100 / (1 + {_roll('up', 14)} / nullif({_roll('down', 14)}, 0))) / 100 AS rsi, {_roll('tr', 14)} / nullif(close, 0) AS atr_pct, v24 / nullif({_roll('v24', 72)}, 0) AS volatility, volume / nullif({_roll('volume', 72)}, 0) - 1 AS volume_regime,
    close / nullif(CASE WHEN count(high) OVER x >= 20 THEN max(high) OVER x END, 0) - 1 AS breakout, close / nullif(CASE WHEN count(low) OVER x >= 20 THEN min(low) OVER x END, 0) - 1 AS breakdown
    FROM p WINDOW x AS ({PART} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
SELECT symbol, day::VARCHAR AS day, ({_score(LONG)[0]})::INT AS long_score, {_score(LONG)[1]} AS long_candidate, ({_score(SHORT)[0]})::INT AS short_score, {_score(SHORT)[1]} AS short_candidate FROM f"""))
def setup_scores(spark, d):
    """P10: eight rules a side on trend, momentum, range, volatility, volume, breakout and slope; the
    score counts those that hold, a candidate has five or more, the trend and a calm range."""
    c, w = F.col, S.over()
    b = states.exponential_means(T.bars_week(spark, d), "symbol", "day", "close", (12, 14, 26, 50), chunk=32).withColumn("macd", c("ema12") - c("ema26"))
    g = states.exponential_means(b.select("symbol", "day", "macd"), "symbol", "day", "macd", (9,), chunk=32).select("symbol", "day", c("ema9").alias("signal"))
    before = F.lag("close").over(w)
    b = b.join(g, ["symbol", "day"]).withColumns({
        "ret": S.pct_change(c("close"), 1, w), "tr": F.greatest(c("high") - c("low"), F.abs(c("high") - before), F.abs(c("low") - before)), "macd_gap": c("macd") - c("signal"),
        "strength": S.safe_ratio(c("ema14") - c("ema50"), c("close")), "rsi": S.rsi(c("close"), 14, w) / 100})
    last = w.rowsBetween(-20, -1)
    edge = lambda fn, x: F.when(F.count(x).over(last) >= 20, fn(x).over(last))
    b = b.withColumn("v24", S.rolling(c("ret"), 24, 24, w, F.stddev_samp)).withColumns({
        "slope14": S.pct_change(c("ema14"), 3, w), "slope50": S.pct_change(c("ema50"), 6, w), "atr_pct": S.safe_ratio(S.rolling(c("tr"), 14, 14, w), c("close")),
        "volatility": S.safe_ratio(c("v24"), S.rolling(c("v24"), 72, 72, w)), "volume_regime": S.safe_ratio(c("volume"), S.rolling(c("volume"), 72, 72, w)) - 1,
        "breakout": S.safe_ratio(c("close"), edge(F.max, "high")) - 1, "breakdown": S.safe_ratio(c("close"), edge(F.min, "low")) - 1})
    out = [F.expr(x).alias(n) for side, name in ((LONG, "long"), (SHORT, "short")) for x, n in zip(_score(side), (f"{name}_score", f"{name}_candidate"))]
    return b.select("symbol", S.day_text(), *out)
