"""The full decision ledger: 34 features and their outcomes (survey H13, H14)."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelia.functions import series as S
from panelia.operators import cross as X
from panelia.plans.registry import query
from panelia.sources import stand_ins as T

HORIZON, COST, LEAST_NAMES = 2, 0.0015, 10
BACK = [1, 3, 7, 14, 30]
#: Ranked feature and the name of its rank.
RANKED = {
    "ret_1d": "xs_ret_1d", "ret_3d": "xs_ret_3d", "ret_7d": "xs_ret_7d", "ret_14d": "xs_ret_14d", "vol_30d": "xs_vol_30d", "funding_sum_1d": "xs_funding",
    "funding_sum_7d": "xs_funding_7d", "log_quote_volume_30d": "xs_liquidity", "taker_imbalance_3d": "xs_taker_imbalance",
}
FEATURES = [
    *(f"ret_{k}d" for k in BACK), "vol_7d", "vol_30d", "range_1d", "range_5d", "volume_z_30d", "log_quote_volume_30d", "taker_imbalance_1d", "taker_imbalance_3d", "funding_last", "funding_sum_1d",
    "funding_mean_3d", "funding_sum_7d", "funding_z_30", *RANKED.values(), "market_ret_1d", "market_ret_3d", "market_breadth_1d", "market_dispersion_1d", "beta_60d", "resid_ret_3d", "xs_resid_ret_3d",
]
OUTCOMES = ["price_return", "realized_funding", "ret_long_net", "ret_short_net"]

_W = "OVER (PARTITION BY symbol ORDER BY day)"


def _rolling(x, n, least, fn="avg"):
    w = f"OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {w} >= {least} THEN {fn}({x}) {w} END"


def _z(x):
    return f"({x} - {_rolling(x, 30, 20)}) / nullif({_rolling(x, 30, 20, 'stddev_samp')}, 0)"


def _rank(x):
    return f"""CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY day, {x} IS NULL ORDER BY {x}) + (count(*) OVER (PARTITION BY day, {x} IS NULL, {x}) - 1) / 2.0::DOUBLE)
      / count(*) OVER (PARTITION BY day, {x} IS NULL) - 0.5 END"""


def _sql(lag):
    held = f"OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN {lag} FOLLOWING AND {lag + HORIZON - 1} FOLLOWING)"
    ready = " AND ".join(f"{c} IS NOT NULL" for c in [*FEATURES, *OUTCOMES])
    return f"""
, b0 AS (SELECT symbol, day, round(20000 + avg(l_extendedprice / l_quantity), 6) AS close, round(20000 + max(l_extendedprice / l_quantity), 6) AS high, round(20000 + min(l_extendedprice / l_quantity), 6) AS low,
    round(20000 + avg(l_extendedprice / l_quantity) FILTER (l_linenumber <= 2), 6) AS open, sum(l_quantity)::DOUBLE AS volume, round(sum(l_extendedprice), 2) AS quote,
    coalesce(sum(l_quantity) FILTER (l_linenumber % 2 = 0), 0)::DOUBLE AS taker, round((avg(l_discount) FILTER (l_linenumber % 2 = 0) - 0.05::DOUBLE) / 10, 8) AS f1,
    round((avg(l_discount) FILTER (l_linenumber % 2 = 1) - 0.05::DOUBLE) / 10, 8) AS f2 FROM wl GROUP BY symbol, day)
, b1 AS (SELECT * FROM (SELECT DISTINCT symbol FROM b0) CROSS JOIN (SELECT DISTINCT day FROM b0) LEFT JOIN b0 USING (symbol, day))
, b2 AS (SELECT *, ln(close) - ln(lag(close) {_W}) AS lr, {', '.join(f'close / nullif(lag(close, {k}) {_W}, 0) - 1 AS ret_{k}d' for k in BACK)}, (high - low) / nullif(close, 0) AS range_1d, ln(1 + greatest(quote, 0)) AS lq,
    2.0::DOUBLE * taker / nullif(volume, 0) - 1 AS taker_imbalance_1d, coalesce(f2, f1) AS funding_last, round(coalesce(f1, 0) + f2, 8) AS funding_sum_1d, (f1 IS NOT NULL)::INT + (f2 IS NOT NULL)::INT AS nf FROM b1)
, b3 AS (SELECT *, {_rolling('lr', 7, 5, 'stddev_samp')} AS vol_7d, {_rolling('lr', 30, 20, 'stddev_samp')} AS vol_30d, {_rolling('range_1d', 5, 3)} AS range_5d, {_z('lq')} AS volume_z_30d,
    {_rolling('lq', 30, 20)} AS log_quote_volume_30d, {_rolling('taker_imbalance_1d', 3, 3)} AS taker_imbalance_3d, {_rolling('funding_sum_1d', 3, 3)} AS funding_mean_3d, {_rolling('funding_sum_1d', 7, 7, 'sum')} AS funding_sum_7d,
    {_z('funding_sum_1d')} AS funding_z_30, lead(open, {lag + HORIZON}) {_W} / nullif(lead(open, {lag}) {_W}, 0) - 1 AS price_return, sum(coalesce(f1, 0) + coalesce(f2, 0)) {held} AS realized_funding, sum(nf) {held} AS n_held FROM b2)
, mk AS (SELECT day, median(ret_1d) AS market_ret_1d, median(ret_3d) AS market_ret_3d, avg(coalesce(ret_1d > 0, false)::INT) AS market_breadth_1d, quantile_cont(ret_1d, 0.75) - quantile_cont(ret_1d, 0.25) AS market_dispersion_1d
    FROM b3 GROUP BY day)
, b4 AS (SELECT b3.*, market_ret_1d, market_ret_3d, market_breadth_1d, market_dispersion_1d, {', '.join(f'{_rank(x)} AS {n}' for x, n in RANKED.items())} FROM b3 JOIN mk USING (day))
, b5 AS (SELECT *, {_rolling('market_ret_1d', 60, 30, 'var_samp')} AS mv, CASE WHEN ret_1d IS NOT NULL THEN market_ret_1d END AS pm FROM b4)
, b6 AS (SELECT *, CASE WHEN count(pm) OVER c >= 30 THEN covar_samp(ret_1d, pm) OVER c END / nullif(mv, 0) AS beta_now FROM b5 WINDOW c AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))
, b7 AS (SELECT *, lag(beta_now) {_W} AS beta_60d, price_return - realized_funding - {COST}::DOUBLE AS ret_long_net, -price_return + realized_funding - {COST}::DOUBLE AS ret_short_net FROM b6)
, b8 AS (SELECT *, ret_3d - beta_60d * market_ret_3d AS resid_ret_3d FROM b7), b9 AS (SELECT *, {_rank('resid_ret_3d')} AS xs_resid_ret_3d FROM b8)
, ok AS (SELECT * FROM b9 WHERE {ready} AND n_held >= {2 * HORIZON})
SELECT substr(sha256(concat_ws('|', day::VARCHAR, symbol::VARCHAR, '{HORIZON}', '{lag}')), 1, 24) AS decision_id, symbol, day::VARCHAR AS day, {', '.join(f'round({c}, 7) + 0.0 AS {c}' for c in [*FEATURES, *OUTCOMES])}
FROM ok QUALIFY count(DISTINCT symbol) OVER (PARTITION BY day) >= {LEAST_NAMES}"""


def full_ledger(spark, d, lag):
    """A row for each decision of a symbol on a period: what was known at its close, and what holding
    from the open ``lag`` periods later for HORIZON periods brought. One pass by symbol gives its own
    features and outcomes, one by period ranks and market, one more of each the betas and residuals."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    even, odd = F.col("l_linenumber") % 2 == 0, F.col("l_linenumber") % 2 == 1
    rate = lambda which: F.round((F.avg(F.when(which, F.col("l_discount"))) - 0.05) / 10, 8)
    b = T.week_lines(spark, d).groupBy("symbol", "day").agg(
        F.round(20000 + F.avg(price), 6).alias("close"), F.round(20000 + F.max(price), 6).alias("high"), F.round(20000 + F.min(price), 6).alias("low"),
        F.round(20000 + F.avg(F.when(F.col("l_linenumber") <= 2, price)), 6).alias("open"), F.sum("l_quantity").cast("double").alias("volume"), F.round(F.sum("l_extendedprice"), 2).alias("quote"),
        F.coalesce(F.sum(F.when(even, F.col("l_quantity"))), F.lit(0.0)).cast("double").alias("taker"), rate(even).alias("f1"), rate(odd).alias("f2"))
    w, c = S.over(), F.col
    close, zero = c("close"), F.lit(0.0)
    own = {f"ret_{k}d": S.pct_change(close, k, w) for k in BACK} | {
        "lr": F.log(close) - F.log(F.lag(close).over(w)), "range_1d": S.safe_ratio(c("high") - c("low"), close), "lq": F.log1p(F.greatest(c("quote"), zero)),
        "taker_imbalance_1d": S.safe_ratio(2 * c("taker"), c("volume")) - 1, "funding_last": F.coalesce("f2", "f1"), "funding_sum_1d": F.round(F.coalesce(c("f1"), zero) + c("f2"), 8),
        "nf": F.col("f1").isNotNull().cast("int") + F.col("f2").isNotNull().cast("int"),
    }
    held = w.rowsBetween(lag, lag + HORIZON - 1)
    roll = lambda x, n, least, fn=F.avg: S.rolling(c(x), n, least, w, fn)
    windows = {
        "vol_7d": roll("lr", 7, 5, F.stddev_samp), "vol_30d": roll("lr", 30, 20, F.stddev_samp), "range_5d": roll("range_1d", 5, 3), "volume_z_30d": S.zscore(c("lq"), 30, 20, w),
        "log_quote_volume_30d": roll("lq", 30, 20), "taker_imbalance_3d": roll("taker_imbalance_1d", 3, 3), "funding_mean_3d": roll("funding_sum_1d", 3, 3),
        "funding_sum_7d": roll("funding_sum_1d", 7, 7, F.sum), "funding_z_30": S.zscore(c("funding_sum_1d"), 30, 20, w),
        "price_return": S.safe_ratio(F.lead("open", lag + HORIZON).over(w), F.lead("open", lag).over(w)) - 1,
        "realized_funding": F.sum(F.coalesce(c("f1"), zero) + F.coalesce(c("f2"), zero)).over(held), "n_held": F.sum("nf").over(held),
    }
    p = X.skeleton(b).withColumns(own).withColumns(windows)
    market = p.groupBy("day").agg(
        F.median("ret_1d").alias("market_ret_1d"), F.median("ret_3d").alias("market_ret_3d"), F.avg(F.coalesce(c("ret_1d") > 0, F.lit(False)).cast("int")).alias("market_breadth_1d"),
        (F.percentile("ret_1d", 0.75) - F.percentile("ret_1d", 0.25)).alias("market_dispersion_1d"))
    p = p.join(market, "day").withColumns({n: S.average_rank(c(x), "day") - 0.5 for x, n in RANKED.items()})
    paired = F.when(c("ret_1d").isNotNull(), c("market_ret_1d"))
    frame = w.rowsBetween(-59, 0)
    beta = S.safe_ratio(F.when(F.count(paired).over(frame) >= 30, F.covar_samp("ret_1d", paired).over(frame)), roll("market_ret_1d", 60, 30, F.var_samp))
    p = p.withColumn("beta_now", beta).withColumn("beta_60d", F.lag("beta_now").over(w)).withColumn("resid_ret_3d", c("ret_3d") - c("beta_60d") * c("market_ret_3d"))
    p = p.withColumns({
        "xs_resid_ret_3d": S.average_rank(c("resid_ret_3d"), "day") - 0.5, "ret_long_net": c("price_return") - c("realized_funding") - COST, "ret_short_net": -c("price_return") + c("realized_funding") - COST})
    p = p.dropna(subset=[*FEATURES, *OUTCOMES]).filter(c("n_held") >= 2 * HORIZON)
    p = p.withColumn("names", F.count(F.lit(1)).over(Window.partitionBy("day"))).filter(c("names") >= LEAST_NAMES)  # a symbol has one row a day
    key = F.concat_ws("|", c("day").cast("string"), c("symbol").cast("string"), F.lit(str(HORIZON)), F.lit(str(lag)))
    return p.select(F.substring(F.sha2(key, 256), 1, 24).alias("decision_id"), "symbol", S.day_text(), *[(F.round(x, 7) + 0.0).alias(x) for x in [*FEATURES, *OUTCOMES]])


query("h13_full_ledger", T.with_sql("wl", _sql(1)))(lambda spark, d: full_ledger(spark, d, 1))
query("h14_full_ledger_lagged", T.with_sql("wl", _sql(2)))(lambda spark, d: full_ledger(spark, d, 2))
