"""Queries of aggregations, audits and data quality (survey G, S, Q)."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelia.functions import series as S
from panelia.plans.registry import query
from panelia.sources import stand_ins as T


_SUM = "count(pnl) AS n, round(sum(pnl), 6) AS total, round(avg(pnl) * 1e4, 4) AS mean_bps, round(avg(CASE WHEN pnl IS NOT NULL THEN (pnl > 0)::INT END), 6) AS win, round(sum(CASE WHEN pnl > 0 THEN pnl END) / nullif(-sum(CASE WHEN pnl < 0 THEN pnl END), 0), 6) AS profit_factor"


def summary(x="pnl"):
    """Count, sum, mean, win rate, profit factor."""
    c = F.col(x)
    return [
        F.count(c).alias("n"), F.round(F.sum(c), 6).alias("total"), F.round(F.avg(c) * 1e4, 4).alias("mean_bps"),
        F.round(F.avg(F.when(c.isNotNull(), (c > 0).cast("int"))), 6).alias("win"), F.round(S.profit_factor(c), 6).alias("profit_factor"),
    ]


@query("g1_settlement_days", T.with_sql("settle", "SELECT symbol, day::VARCHAR AS day, round(sum(rate), 9) AS total, round(arg_max(rate, ts), 9) AS last, count(*) AS n FROM settle GROUP BY symbol, day"))
def settlement_days(spark, d):
    return T.settlements(spark, d).groupBy("symbol", S.day_text()).agg(F.round(F.sum("rate"), 9).alias("total"), F.round(F.max_by("rate", "ts"), 9).alias("last"),
        F.count(F.lit(1)).alias("n"))


@query("g2_resample", T.with_sql("bars_4h", "SELECT symbol, strftime(bar, '%Y-%m-%d %H:%M:%S') AS bar, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM bars_4h"))
def resample(spark, d):
    return T.bars_4h(spark, d).select("symbol", F.date_format("bar", "yyyy-MM-dd HH:mm:ss").alias("bar"), *[F.round(c, 6).alias(c) for c in ("open", "high", "low",
        "close")], "volume")


@query("g4_g5_attribution", T.with_sql("decision", f"SELECT side, regime, event_type, {_SUM} FROM decision GROUP BY GROUPING SETS ((side, regime), (event_type), (side), ())"))
def attribution(spark, d):
    """One pass over several groupings."""
    x = T.decisions(spark, d).select("side", "regime", "event_type", "pnl")
    s, r, e = (F.col(c) for c in ("side", "regime", "event_type"))
    return x.groupingSets([[s, r], [e], [s], []], s, r, e).agg(*summary())


@query("g6_g9_costs", T.with_sql("fill", """
SELECT side, run::VARCHAR AS run, status, count(*) AS n, round(sum(qty * price), 2) AS notional, round(sum(fee), 4) AS fees,
    round(sum(fee) / nullif(sum(qty * price), 0) * 1e4, 4) AS fee_bps,
 round(avg(maker::INT), 6) AS maker_share, round(sum(qty * price * (price / reference - 1)) / nullif(sum(qty * price), 0) * 1e4, 4) AS shortfall_bps FROM fill
     GROUP BY GROUPING SETS ((side), (run), (status), ()) HAVING count(*) >= 5"""))
def costs(spark, d):
    """Cost cuts in one pass, notional-weighted means, fees, shortfall, small groups left out."""
    f = T.fills(spark, d).withColumn("run", F.col("run").cast("string")).withColumn("v", F.col("qty") * F.col("price"))
    s, r, t = (F.col(c) for c in ("side", "run", "status"))
    v = F.sum("v")
    out = f.groupingSets([[s], [r], [t], []], s, r, t).agg(
        F.count(F.lit(1)).alias("n"), F.round(v, 2).alias("notional"), F.round(F.sum("fee"), 4).alias("fees"), F.round(F.sum("fee") / F.nullif(v, F.lit(0.0)) * 1e4,
            4).alias("fee_bps"),
        F.round(F.avg(F.col("maker").cast("int")), 6).alias("maker_share"), F.round(F.sum(F.col("v") * (F.col("price") / F.col("reference") - 1)) / F.nullif(v,
            F.lit(0.0)) * 1e4, 4).alias("shortfall_bps"))
    return out.filter("n >= 5").select("side", "run", "status", "n", "notional", "fees", "fee_bps", "maker_share", "shortfall_bps")


@query("g12_weeks", T.with_sql("decision", """
, dd AS (SELECT DISTINCT symbol, day, event_type, round(value0, 2) AS v FROM (SELECT symbol, day, event_type, pnl AS value0 FROM decision WHERE pnl IS NOT NULL))
SELECT event_type, strftime(day, '%G-%V') AS week, count(*) AS n, round(sum(v), 6) AS total, round(product(1 + v / 10) - 1, 6) AS compounded FROM dd
    GROUP BY GROUPING SETS ((event_type, strftime(day, '%G-%V')), (event_type), ())"""))
def months(spark, d):
    """Income by type and ISO week without repeats, totals, compounding."""
    x = T.decisions(spark, d).filter("pnl IS NOT NULL").select("symbol", "day", "event_type", S.ieee_round(F.col("pnl"), 2).alias("v")).distinct()
    x = x.withColumn("week", F.concat_ws("-", F.extract(F.lit("YEAROFWEEK"), "day").cast("string"), F.lpad(F.weekofyear("day").cast("string"), 2, "0")))
    e, w = F.col("event_type"), F.col("week")
    return x.rollup(e, w).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 6).alias("total"), F.round(F.product(1 + F.col("v") / 10) - 1, 6).alias("compounded"))


@query("g11_concentration", T.with_sql("decision", """
, s AS (SELECT symbol, coalesce(sum(pnl), 0) AS g FROM decision GROUP BY symbol), r AS (SELECT *, row_number() OVER (ORDER BY g DESC, symbol) AS k,
    sum(g) FILTER (g > 0) OVER () AS gains, sum(g) OVER () AS net FROM s)
SELECT round(sum(CASE WHEN k = 1 THEN g END) / max(gains), 6) AS top1, round(sum(CASE WHEN k <= 3 THEN g END) / max(gains), 6) AS top3,
    round(sum(CASE WHEN g > 0 THEN (g / gains) ^ 2 END), 6) AS hhi, round(max(net) - sum(CASE WHEN k <= 3 THEN g END), 6) AS without_top3, round(avg((g > 0)::INT),
        6) AS positive FROM r"""))
def concentration(spark, d):
    """Shares of the gains, Herfindahl, the total without the best names."""
    one = Window.partitionBy(F.lit(0))
    g = F.col("g")
    s = T.decisions(spark, d).groupBy("symbol").agg(F.coalesce(F.sum("pnl"), F.lit(0.0)).alias("g"))
    totals = s.agg(F.sum(F.when(g > 0, g)).alias("gains"), F.sum(g).alias("net"))
    top = s.orderBy(F.desc("g"), "symbol").limit(3).withColumn("k", F.row_number().over(one.orderBy(F.desc("g"), "symbol"))).agg(F.sum(F.when(F.col("k") == 1,
        g)).alias("g1"), F.sum(g).alias("g3"))
    hhi = s.join(F.broadcast(totals)).agg(F.sum(F.when(g > 0, F.pow(g / F.col("gains"), 2))).alias("hhi"), F.avg((g > 0).cast("int")).alias("positive"))
    x = totals.join(F.broadcast(top)).join(F.broadcast(hhi))
    return x.select(F.round(F.col("g1") / F.col("gains"), 6).alias("top1"), F.round(F.col("g3") / F.col("gains"), 6).alias("top3"), F.round("hhi", 6).alias("hhi"),
        F.round(F.col("net") - F.col("g3"), 6).alias("without_top3"), F.round("positive", 6).alias("positive"))


@query("g13_order_statistics", T.with_sql("decision", """
SELECT event_type, round(median(pnl), 8) AS median, round(list_sort(list(pnl) FILTER (pnl IS NOT NULL))[1 + floor(0.9 * (count(pnl) - 1))::INT], 8) AS p90_index,
    round(quantile_cont(pnl, 0.9), 8) AS p90 FROM decision GROUP BY event_type"""))
def order_statistics(spark, d):
    """Median, index and interpolated percentile. The index form is a place in an external
    sort of each group, so no group is gathered in memory."""
    x = T.decisions(spark, d).filter("pnl IS NOT NULL")
    w = Window.partitionBy("event_type")
    placed = x.withColumns({"k": F.row_number().over(w.orderBy("pnl")) - 1, "n": F.count(F.lit(1)).over(w)})
    index = placed.filter(F.col("k") == F.floor(0.9 * (F.col("n") - 1))).select("event_type", F.round("pnl", 8).alias("p90_index"))
    other = x.groupBy("event_type").agg(F.round(F.median("pnl"), 8).alias("median"), F.round(F.percentile("pnl", 0.9), 8).alias("p90"))
    return other.join(index, "event_type")


@query("g16_recent_routes", T.with_sql("decision", f"""
, l AS (SELECT *, row_number() OVER (PARTITION BY side, event_type ORDER BY ts DESC) AS r FROM decision WHERE pnl IS NOT NULL), mx AS (SELECT max(ts) AS t FROM decision)
SELECT side, event_type, {_SUM}, count(DISTINCT day) AS days, max(strftime(ts, '%Y-%m-%d %H:%M')) AS newest, count(*) FILTER (ts >= t - INTERVAL '2 days') AS recent
    FROM l, mx WHERE r <= 60 GROUP BY side, event_type HAVING count(*) >= 2"""))
def routes(spark, d):
    """Proof of each pair of side and type over its last 60 rows, with what is recent."""
    w = Window.partitionBy("side", "event_type").orderBy(F.desc("ts"))
    x = T.decisions(spark, d)
    newest = x.agg(F.max("ts").alias("t"))
    last = x.filter("pnl IS NOT NULL").withColumn("r", F.row_number().over(w)).filter("r <= 60").join(F.broadcast(newest))
    return last.groupBy("side", "event_type").agg(
        *summary(), F.countDistinct("day").alias("days"), F.max(F.date_format("ts", "yyyy-MM-dd HH:mm")).alias("newest"),
        F.count(F.when(F.col("ts") >= F.col("t") - F.expr("INTERVAL 2 DAYS"), 1)).alias("recent")).filter("n >= 2")


@query("g19_drift", T.with_sql("ev", """
, e AS (SELECT quantile_cont(value, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS edges FROM ev WHERE day < DATE '2024-01-16')
, b AS (SELECT CASE WHEN day < DATE '2024-01-16' THEN 0 ELSE 1 END AS later, len(list_filter(edges, lambda x: value > x)) AS bin FROM ev, e), c AS (SELECT bin,
    count(*) FILTER (later = 0) AS n0, count(*) FILTER (later = 1) AS n1 FROM b GROUP BY bin)
, s AS (SELECT bin, (n0 + 0.5) / (sum(n0) OVER () + 5) AS p, (n1 + 0.5) / (sum(n1) OVER () + 5) AS q FROM c)
SELECT bin::BIGINT AS bin, round(p, 6) AS p, round(q, 6) AS q, round((p - q) * ln(p / q), 8) AS psi FROM s"""))
def drift(spark, d):
    """Decile edges of a base period and the share of each bin later; population stability."""
    x = T.events(spark, d).select("value", (F.col("day") >= F.lit("2024-01-16").cast("date")).alias("later"))
    edges = x.filter("NOT later").agg(F.percentile("value", F.array(*[F.lit(k / 10) for k in range(1, 10)])).alias("edges"))
    b = x.join(F.broadcast(edges)).select("later", F.size(F.filter("edges", lambda e: F.col("value") > e)).cast("bigint").alias("bin"))
    c = b.groupBy("bin").agg(F.count(F.when(~F.col("later"), 1)).alias("n0"), F.count(F.when(F.col("later"), 1)).alias("n1"))
    one = Window.partitionBy(F.lit(0))
    s = c.select("bin", ((F.col("n0") + 0.5) / (F.sum("n0").over(one) + 5)).alias("p"), ((F.col("n1") + 0.5) / (F.sum("n1").over(one) + 5)).alias("q"))
    return s.select("bin", F.round("p", 6).alias("p"), F.round("q", 6).alias("q"), F.round((F.col("p") - F.col("q")) * F.log(F.col("p") / F.col("q")), 8).alias("psi"))


@query("g20_edge_prior", T.with_sql("decision", f"SELECT symbol, side, {_SUM}, CASE WHEN count(pnl) < 5 THEN 'unknown' WHEN sum(pnl) > 0 THEN 'positive' ELSE 'negative' END AS status FROM decision GROUP BY symbol, side"))
def edge_prior(spark, d):
    status = F.when(F.count("pnl") < 5, "unknown").when(F.sum("pnl") > 0, "positive").otherwise("negative")
    return T.decisions(spark, d).groupBy("symbol", "side").agg(*summary(), status.alias("status"))


@query("s1_s4_top", T.with_sql("decision", """
, t AS (SELECT symbol, side, round(sum(coalesce(pnl, 0)), 8) AS total, count(*) AS n FROM decision GROUP BY symbol, side), r AS (SELECT *,
    row_number() OVER (PARTITION BY side ORDER BY total DESC, symbol) AS k FROM t)
SELECT side, symbol, total, n, k, first_value(symbol) OVER (PARTITION BY side ORDER BY n DESC, symbol) AS busiest FROM r QUALIFY k <= 3"""))
def top(spark, d):
    """Mixed sorts, limits, top-k of a group, arg-max with a tie rule."""
    t = T.decisions(spark, d).groupBy("symbol", "side").agg(F.round(F.sum(F.coalesce("pnl", F.lit(0.0))), 8).alias("total"), F.count(F.lit(1)).alias("n"))
    k = F.row_number().over(Window.partitionBy("side").orderBy(F.desc("total"), "symbol"))
    busiest = t.groupBy("side").agg(F.max_by("symbol", F.struct("n", -F.col("symbol"))).alias("busiest"))
    return t.withColumn("k", k.cast("bigint")).filter("k <= 3").join(busiest, "side").select("side", "symbol", "total", "n", "k", "busiest")


@query("s5_s8_sets", T.with_sql("bars_day", """
, a AS (SELECT symbol FROM bars_day GROUP BY symbol HAVING max(volume) >= 6), b AS (SELECT symbol FROM bars_day GROUP BY symbol HAVING min(close) < 3)
, h AS (SELECT symbol, day, close, row_number() OVER (PARTITION BY symbol ORDER BY day) AS n, count(*) OVER (PARTITION BY symbol) AS tot FROM bars_day)
SELECT h.symbol, h.symbol IN (SELECT * FROM a INTERSECT SELECT * FROM b) AS in_both, h.symbol IN (SELECT * FROM a EXCEPT SELECT * FROM b) AS only_a,
    count(*) FILTER (n * 2 <= tot + 1) AS first_half, round(arg_min(close, day), 6) AS first_close, round(arg_max(close, day), 6) AS last_close FROM h GROUP BY h.symbol"""))
def sets(spark, d):
    """Intersection, difference, first and last kept, halves where the first takes the odd row."""
    bars = T.bars_day(spark, d)
    a = bars.groupBy("symbol").agg(F.max("volume").alias("v")).filter("v >= 6").select("symbol")
    b = bars.groupBy("symbol").agg(F.min("close").alias("c")).filter("c < 3").select("symbol")
    both, only = a.intersect(b).withColumn("x", F.lit(True)), a.exceptAll(b).withColumn("y", F.lit(True))
    w = Window.partitionBy("symbol")
    h = bars.withColumns({"n": F.row_number().over(w.orderBy("day")), "tot": F.count(F.lit(1)).over(w)})
    out = h.groupBy("symbol").agg(F.count(F.when(F.col("n") * 2 <= F.col("tot") + 1, 1)).alias("first_half"), F.round(F.min_by("close", "day"),
        6).alias("first_close"), F.round(F.max_by("close", "day"), 6).alias("last_close"))
    return out.join(both, "symbol", "left").join(only, "symbol", "left").select("symbol", F.coalesce("x", F.lit(False)).alias("in_both"), F.coalesce("y",
        F.lit(False)).alias("only_a"), "first_half", "first_close", "last_close")


#: Q1: named masks with a severity.
RULES = {
    "no_outcome": ("warn", "pnl IS NULL"), "proba_low": ("info", "proba < 0.05"), "extreme": ("error", "abs(pnl) > 0.3"),
    "short_in_r1": ("info", "side = 'SHORT' AND regime = 'R1'"), "k_out_of_range": ("error", "k < 0 OR k > 99"), "positive_error": ("warn", "event_type = 'error' AND pnl > 0"),
}


@query("q1_q2_rule_pack", T.with_sql("decision", " UNION ALL ".join(f"SELECT '{n}' AS rule, '{s}' AS severity, count(*) FILTER ({m}) AS n, count(*) AS n_rows FROM decision" for n, (s, m) in RULES.items())
      + " UNION ALL SELECT 'repeated', 'warn', coalesce(sum(c) FILTER (c > 1), 0)::BIGINT, sum(c)::BIGINT FROM (SELECT count(*) AS c FROM decision GROUP BY symbol, day, side, event_type)"))
def rule_pack(spark, d):
    """Q1, Q2: every named mask in one pass; rows that repeat a key."""
    x = T.decisions(spark, d)
    counts = [F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"), F.count(F.when(F.expr(m), 1)).alias("n"), F.count(F.lit(1)).alias("n_rows")) for n, (s,
        m) in RULES.items()]
    rules = x.agg(F.array(*counts).alias("r")).select(F.inline("r"))
    c = x.groupBy("symbol", "day", "side", "event_type").agg(F.count(F.lit(1)).alias("c"))
    again = c.agg(F.coalesce(F.sum(F.when(F.col("c") > 1, F.col("c"))), F.lit(0)).alias("n"), F.sum("c").alias("n_rows"))
    return rules.unionByName(again.select(F.lit("repeated").alias("rule"), F.lit("warn").alias("severity"), "n", "n_rows"))


@query("q3_q5_open_rows", T.with_sql("ledger bars_day", """
, o AS (SELECT * FROM ledger WHERE pnl IS NULL), p AS (SELECT o.*, b.close FROM o ASOF LEFT JOIN bars_day b ON o.symbol = b.symbol AND o.day >= b.day)
SELECT symbol, count(*) AS n_open, round(max(epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 3.6e9, 4) AS oldest_hours,
    count(*) FILTER (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts) >= 864000000000) AS n_ready, count(*) > 3 AS over_cap,
        round(sum(CASE side WHEN 'LONG' THEN close / nullif(price, 0) - 1 ELSE price / nullif(close, 0) - 1 END), 6) AS marked FROM p GROUP BY symbol"""))
def open_rows(spark, d):
    """Q3-Q5: age and readiness of open rows, their own entry marked to the last bar, a cap for each key."""
    from panelia.operators import joins as J

    o = T.ledger(spark, d).filter("pnl IS NULL").select("symbol", "day", "ts", "side", "price")
    p = J.asof(o, T.bars_day(spark, d).select("symbol", "day", "close"), "symbol", "day", ["close"])
    age = (F.unix_micros(F.lit("2024-02-01").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp")))
    mark = F.when(F.col("side") == "LONG", S.safe_ratio(F.col("close"), F.col("price")) - 1).otherwise(S.safe_ratio(F.col("price"), F.col("close")) - 1)
    return p.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_open"), F.round(F.max(age) / 3.6e9, 4).alias("oldest_hours"), F.count(F.when(age >= 864_000_000_000, 1)).alias("n_ready"),
            (F.count(F.lit(1)) > 3).alias("over_cap"), F.round(F.sum(mark), 6).alias("marked"))


@query("q6_q7_states", T.with_sql("decision", """
, l AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) - 1 AS r FROM decision WHERE pnl IS NOT NULL), b AS (SELECT symbol, r // 4 AS batch,
    sum(pnl) AS total, count(*) AS n FROM l WHERE r < 12 GROUP BY symbol, batch)
SELECT symbol, CASE WHEN sum(n) < 12 THEN 'warming' WHEN bool_and(total < 0) THEN 'locked' WHEN arg_min(total,
    batch) < -0.1 THEN 'storm' ELSE 'released' END AS state, CASE WHEN sum(n) < 12 THEN 'too few rows' WHEN sum(total) < 0 THEN 'losing' ELSE 'ok' END AS reason
        FROM b GROUP BY symbol"""))
def state_machine(spark, d):
    """Q6, Q7: states of a recent window by batches, and an ordered reason."""
    w = Window.partitionBy("symbol").orderBy(F.desc("ts"))
    x = T.decisions(spark, d).filter("pnl IS NOT NULL").withColumn("r", F.row_number().over(w) - 1).filter("r < 12")
    b = x.groupBy("symbol", F.floor(F.col("r") / 4).alias("batch")).agg(F.sum("pnl").alias("total"), F.count(F.lit(1)).alias("n"))
    few = F.sum("n") < 12
    state = F.when(few, "warming").when(F.every(F.col("total") < 0), "locked").when(F.min_by("total", "batch") < -0.1, "storm").otherwise("released")
    return b.groupBy("symbol").agg(state.alias("state"), F.when(few, "too few rows").when(F.sum("total") < 0, "losing").otherwise("ok").alias("reason"))


@query("q8_q10_invariants", T.with_sql("bars_day", """
SELECT count(*) FILTER (high < low) AS high_below_low, count(*) - count(DISTINCT (symbol, day)) AS repeated, coalesce(bool_and(close BETWEEN low AND high),
    true) AS close_inside, (SELECT count(*) FROM (SELECT day FROM bars_day GROUP BY day HAVING count(*) >= 10)) AS wide_days FROM bars_day"""))
def invariants(spark, d):
    """Q8-Q10: prices are sane, keys unique, closes inside, days with enough names."""
    bars = T.bars_day(spark, d)
    wide = bars.groupBy("day").count().filter("count >= 10").agg(F.count(F.lit(1)).alias("wide_days"))
    x = bars.agg(F.count(F.when(F.col("high") < F.col("low"), 1)).alias("high_below_low"), (F.count(F.lit(1)) - F.countDistinct("symbol", "day")).alias("repeated"),
        F.coalesce(F.every(F.col("close").between(F.col("low"), F.col("high"))), F.lit(True)).alias("close_inside"))
    return x.join(F.broadcast(wide))


@query("q12_policy_grid", T.with_sql("decision", f"""
, s AS (SELECT *, unnest(CASE WHEN regime = 'R1' THEN ['all', 'r1'] ELSE ['all'] END) AS scope FROM decision)
SELECT scope, threshold, {_SUM} FROM s, (VALUES (0.5::DOUBLE), (0.7::DOUBLE), (0.9::DOUBLE)) t(threshold) WHERE proba >= threshold GROUP BY scope, threshold"""))
def policy_grid(spark, d):
    """Q12, M4: thresholds and named scopes as tags of one pass."""
    x = T.decisions(spark, d)
    scopes = F.when(F.col("regime") == "R1", F.array(F.lit("all"), F.lit("r1"))).otherwise(F.array(F.lit("all")))
    grid = F.filter(F.array(F.lit(0.5), F.lit(0.7), F.lit(0.9)), lambda t: F.col("proba") >= t)
    tagged = x.withColumn("scope", F.explode(scopes)).withColumn("threshold", F.explode(grid))
    return tagged.groupBy("scope", "threshold").agg(*summary())
