"""Queries of fetch plans, fee and shortfall audits, order plans, tracking and exposure (survey A4, A5, A8, E14, E15, E18, G8, G9, G11)."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelia.functions import series as S
from panelia.plans.accounting import NAMES, WEEK, week_weights
from panelia.plans.inference import live
from panelia.plans.registry import query
from panelia.sources import stand_ins as T
from panelia.sources import tables as B

TODAY, LOOKBACK = "2024-01-30", 30
#: Sources with a history, and those that only give the present day.
HISTORY, LIVE = ["view", "click", "purchase"], ["error", "signup"]


@query("a8_missing_triples", T.with_sql("ev", f"""
, s AS (SELECT unnest({HISTORY}) AS source, true AS history UNION ALL SELECT unnest({LIVE}), false)
, w AS (SELECT symbol, source, unnest(CASE WHEN history THEN range(1, {LOOKBACK}) ELSE [0] END) AS back FROM (SELECT DISTINCT symbol FROM ev) CROSS JOIN s)
, m AS (SELECT symbol, source, DATE '{TODAY}' - back::INT AS day FROM w)
SELECT symbol, source, day::VARCHAR AS day FROM m ANTI JOIN (SELECT DISTINCT symbol, event_type AS source, day FROM ev) e USING (symbol, source, day)"""))
def missing_triples(spark, d):
    """What is to be fetched for each symbol and source: the days of a rolling window, 29 finished
    days of sources with a history and today of live ones, that are not stored yet."""
    e = T.events(spark, d).select("symbol", F.col("event_type").alias("source"), "day")
    today = F.lit(TODAY).cast("date")
    days = lambda back: F.transform(back, lambda k: F.date_sub(today, k))
    plan = [F.struct(F.lit(s).alias("source"), days(F.sequence(F.lit(1), F.lit(LOOKBACK - 1))).alias("days")) for s in HISTORY]
    plan += [F.struct(F.lit(s).alias("source"), F.array(today).alias("days")) for s in LIVE]
    wanted = e.select("symbol").distinct().select("symbol", F.explode(F.array(*plan)).alias("p")).select("symbol", "p.source", F.explode("p.days").alias("day"))
    return B.missing_keys(wanted, e, on=["symbol", "source", "day"]).select("symbol", "source", S.day_text())


@query("a4_a5_named_venues", T.with_sql("bars_day settle", """
, n AS (SELECT *, CASE WHEN symbol % 10 = 0 THEN '1000' WHEN symbol % 15 = 0 THEN '1000000' ELSE '' END || 'N' || symbol AS other FROM bars_day)
, m AS (SELECT symbol, day, close, coalesce(nullif(regexp_extract(other, '^(10+)N', 1), ''), '1')::DOUBLE AS multiplier FROM n)
, r AS (SELECT symbol, day, rate AS funding, CASE WHEN extract('hour' FROM ts) % 3 = 0 THEN round(rate * 1.5, 10) END AS realized FROM settle)
, v AS (SELECT 'first' AS venue, symbol, day, close, rate FROM (SELECT symbol, day, close FROM bars_day) LEFT JOIN (SELECT symbol, day, sum(funding) AS rate FROM r GROUP BY ALL) USING (symbol, day)
  UNION ALL SELECT 'second', symbol, day, close * multiplier, rate FROM m LEFT JOIN (SELECT symbol, day, sum(coalesce(realized, funding)) AS rate FROM r GROUP BY ALL) USING (symbol, day))
SELECT venue, symbol, count(*) AS n, round(sum(close), 4) AS total, count(rate) AS n_rates, round(sum(rate), 9) AS rate FROM v GROUP BY venue, symbol"""))
def named_venues(spark, d):
    """A4, A5: the second venue lists some names in thousands, which its own name says; its rate is the
    realised one, else the announced one. Both venues in one shape."""
    bars = T.bars_day(spark, d).select("symbol", "day", "close")
    prefix = F.when(F.col("symbol") % 10 == 0, "1000").when(F.col("symbol") % 15 == 0, "1000000").otherwise("")
    other = bars.select("symbol").distinct().withColumn("other", F.concat(prefix, F.lit("N"), F.col("symbol")))
    mapping = other.withColumn("multiplier", F.coalesce(F.nullif(F.regexp_extract("other", "^(10+)N", 1), F.lit("")), F.lit("1")).cast("double"))
    r = T.settlements(spark, d).withColumn("realized", F.when(F.hour("ts") % 3 == 0, F.round(F.col("rate") * 1.5, 10)))
    rates = lambda x: r.groupBy("symbol", "day").agg(F.sum(x).alias("rate"))
    first = bars.join(rates(F.col("rate")), ["symbol", "day"], "left")
    second = B.scaled_mapping(bars, mapping, "close").drop("other", "multiplier").join(rates(F.coalesce("realized", "rate")), ["symbol", "day"], "left")
    v = B.venues({"first": first, "second": second})
    return v.groupBy("venue", "symbol").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("close"), 4).alias("total"), F.count("rate").alias("n_rates"), F.round(F.sum("rate"), 9).alias("rate"))


_FEES = """, t AS (SELECT *, CASE WHEN order_id % 7 = 0 THEN 0 ELSE round(qty * price, 6) END AS quoted, CASE WHEN part % 50 = 0 THEN 'OTHER' ELSE 'BASE' END AS asset FROM fill)
, u AS (SELECT *, CASE WHEN quoted > 0 THEN quoted ELSE qty * price END AS notional, unnest(CASE asset WHEN 'BASE' THEN ['all', 'base'] ELSE ['all'] END) AS scope FROM t)"""


@query("g8_fee_audit", T.with_sql("fill", _FEES + """
, one AS (SELECT scope, bool_and(asset = 'BASE') AS pure FROM u GROUP BY scope)
SELECT u.scope, run::VARCHAR AS run, count(DISTINCT order_id) AS n_orders, count(*) AS n_trades, round(sum(notional), 2) AS notional, round(sum(fee) FILTER (asset = 'BASE'), 4) AS commission,
    round(coalesce(sum(fee) FILTER (asset <> 'BASE'), 0), 4) AS other_commission, round(sum(notional) FILTER (maker) / nullif(sum(notional), 0) * 100, 4) AS maker_pct,
    CASE WHEN bool_and(pure) THEN round(sum(fee) FILTER (asset = 'BASE') / nullif(sum(notional), 0) * 1e4, 6) END AS commission_bps
FROM u JOIN one USING (scope) GROUP BY GROUPING SETS ((u.scope, run), (u.scope))"""))
def fee_audit(spark, d):
    """Orders, trades, notional (quoted, else quantity times price), commissions by asset, share of
    makers, for each run and in total; basis points only where a scope has one asset."""
    f = T.fills(spark, d)
    quoted = F.when(F.col("order_id") % 7 == 0, 0.0).otherwise(F.round(F.col("qty") * F.col("price"), 6))
    f = f.withColumn("base", F.col("part") % 50 != 0).withColumn("notional", F.when(quoted > 0, quoted).otherwise(F.col("qty") * F.col("price")))
    f = f.withColumn("scope", F.explode(F.when(F.col("base"), F.array(F.lit("all"), F.lit("base"))).otherwise(F.array(F.lit("all")))))
    pure = f.groupBy("scope").agg(F.every("base").alias("pure"))  # one row a scope
    f = f.join(F.broadcast(pure), "scope").withColumn("run", F.col("run").cast("string"))
    s, r = F.col("scope"), F.col("run")
    own, all_ = F.sum(F.when(F.col("base"), F.col("fee"))), F.sum("notional")
    return f.groupingSets([[s, r], [s]], s, r).agg(
        F.countDistinct("order_id").alias("n_orders"), F.count(F.lit(1)).alias("n_trades"), F.round(all_, 2).alias("notional"), F.round(own, 4).alias("commission"),
        F.round(F.coalesce(F.sum(F.when(~F.col("base"), F.col("fee"))), F.lit(0.0)), 4).alias("other_commission"), F.round(F.sum(F.when(F.col("maker"), F.col("notional"))) / F.nullif(all_, F.lit(0.0)) * 100, 4).alias("maker_pct"),
        F.when(F.every("pure"), F.round(own / F.nullif(all_, F.lit(0.0)) * 1e4, 6)).alias("commission_bps"))


@query("g9_shortfall_audit", T.with_sql("fill", """
, x AS (SELECT run, qty * price AS notional, CASE WHEN part % 20 <> 0 THEN (CASE side WHEN 'BUY' THEN 1 ELSE -1 END) * (price / reference - 1) * 1e4 END AS bps, CASE WHEN order_id % 3 <> 0 THEN (price / reference - 1) * 5e3 END AS mid FROM fill)
SELECT run::VARCHAR AS run, count(bps) AS n_covered, count(*) - count(bps) AS n_missing, round(sum(notional) FILTER (bps IS NOT NULL), 2) AS notional, round(sum(notional * bps) / nullif(sum(notional) FILTER (bps IS NOT NULL), 0), 6) AS shortfall_bps,
    count(mid) FILTER (bps IS NOT NULL) AS n_mid, round(sum(notional * mid) FILTER (bps IS NOT NULL) / nullif(sum(notional) FILTER (bps IS NOT NULL), 0), 6) AS mid_bps FROM x GROUP BY GROUPING SETS ((run), ())"""))
def shortfall_audit(spark, d):
    """Shortfall against the period's open, signed by side, for each run and in total, with the
    orders that have no open, and the slippage against the mid where it was noted."""
    f = T.fills(spark, d)
    move = F.col("price") / F.col("reference") - 1
    sign = F.when(F.col("side") == "BUY", 1).otherwise(-1)
    x = f.select(F.col("run").cast("string").alias("run"), (F.col("qty") * F.col("price")).alias("v"), F.when(F.col("part") % 20 != 0, sign * move * 1e4).alias("bps"), F.when(F.col("order_id") % 3 != 0, move * 5e3).alias("mid"))
    r, has = F.col("run"), F.col("bps").isNotNull()
    v = F.sum(F.when(has, F.col("v")))
    return x.groupingSets([[r], []], r).agg(
        F.count("bps").alias("n_covered"), (F.count(F.lit(1)) - F.count("bps")).alias("n_missing"), F.round(v, 2).alias("notional"), F.round(F.sum(F.col("v") * F.col("bps")) / F.nullif(v, F.lit(0.0)), 6).alias("shortfall_bps"),
        F.count(F.when(has, F.col("mid"))).alias("n_mid"), F.round(F.sum(F.when(has, F.col("v") * F.col("mid"))) / F.nullif(v, F.lit(0.0)), 6).alias("mid_bps"))


@query("g11_best_days", T.with_sql("decision", """
, y AS (SELECT day, coalesce(sum(pnl), 0) AS g FROM decision GROUP BY day), k AS (SELECT *, row_number() OVER (ORDER BY g DESC, day) AS r FROM y)
SELECT count(*) AS n_days, round(avg((g > 0)::INT), 6) AS positive, round(sum(g) FILTER (r = 1) / nullif(sum(g) FILTER (g > 0), 0), 6) AS best_share, round(sum(g) FILTER (r <= 3) / nullif(sum(g) FILTER (g > 0), 0), 6) AS best3_share,
    round(sum(g) FILTER (r > 1), 8) AS without_best, max(day) FILTER (r = 1)::VARCHAR AS best_day FROM k"""))
def best_days(spark, d):
    """The share of the gains that the best days hold, and the total without the best."""
    y = T.decisions(spark, d).groupBy("day").agg(F.coalesce(F.sum("pnl"), F.lit(0.0)).alias("g"))
    k = y.withColumn("r", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("g"), "day")))  # one row a day
    g, gains = F.col("g"), F.nullif(F.sum(F.when(F.col("g") > 0, F.col("g"))), F.lit(0.0))
    of = lambda c: F.sum(F.when(c, g))
    return k.agg(
        F.count(F.lit(1)).alias("n_days"), F.round(F.avg((g > 0).cast("int")), 6).alias("positive"), F.round(of(F.col("r") == 1) / gains, 6).alias("best_share"), F.round(of(F.col("r") <= 3) / gains, 6).alias("best3_share"),
        F.round(of(F.col("r") > 1), 8).alias("without_best"), F.max(F.when(F.col("r") == 1, F.col("day"))).cast("string").alias("best_day"))


#: Budget of a book, size of a step, least and greatest orders.
BUDGET, STEP, LEAST_STEPS, LEAST_NOTIONAL, MOST_NOTIONAL = 4e7, 0.5, 1, 1500.0, 9000.0


@query("e15_order_plan", T.with_sql("fill", f"""
, h AS (SELECT part, sum(CASE side WHEN 'BUY' THEN qty ELSE -qty END) AS held, avg(price) AS mark FROM fill WHERE run < DATE '1997-01-01' AND part % 3 <> 0 GROUP BY part)
, w AS (SELECT part, avg(price) AS mark, CASE WHEN part % 2 = 0 THEN 1 ELSE -1 END AS sgn FROM fill WHERE run >= DATE '1997-01-01' AND part % 5 <> 0 GROUP BY part), n AS (SELECT count(*) AS n FROM w)
, j AS (SELECT part, round(coalesce(held, 0) / {STEP})::BIGINT AS held, w.sgn, coalesce(w.mark, h.mark) AS mark, CASE WHEN w.sgn IS NULL THEN NULL ELSE floor(round({BUDGET}::DOUBLE / n / w.mark / {STEP}, 6))::BIGINT END AS want FROM h FULL JOIN w USING (part) CROSS JOIN n)
, s AS (SELECT *, sgn * want AS goal, floor(round({MOST_NOTIONAL} / mark / {STEP}, 6))::BIGINT AS most, greatest({LEAST_STEPS}, ceil(round({LEAST_NOTIONAL} / mark / {STEP}, 6)))::BIGINT AS least,
    sgn IS NOT NULL AND (want < {LEAST_STEPS} OR want * {STEP} * mark < {LEAST_NOTIONAL}) AS tiny FROM j)
, l AS (SELECT part, 'below_min_notional' AS reason, 0 AS qty, false AS reduce, mark, most, least FROM s WHERE tiny
  UNION ALL SELECT part, 'close_orphan', -held, true, mark, most, least FROM s WHERE sgn IS NULL AND held <> 0
  UNION ALL SELECT part, 'close_before_flip', -held, true, mark, most, least FROM s WHERE NOT tiny AND held * goal < 0
  UNION ALL SELECT part, 'open_after_flip', goal, false, mark, most, least FROM s WHERE NOT tiny AND held * goal < 0
  UNION ALL SELECT part, CASE WHEN abs(goal - held) >= {LEAST_STEPS} AND abs(goal - held) * {STEP} * mark >= {LEAST_NOTIONAL} THEN 'rebalance' ELSE 'delta_below_exchange_minimum' END,
    CASE WHEN abs(goal - held) >= {LEAST_STEPS} AND abs(goal - held) * {STEP} * mark >= {LEAST_NOTIONAL} THEN goal - held ELSE 0 END, held <> 0 AND held * (goal - held) < 0, mark, most, least
    FROM s WHERE NOT tiny AND held * goal >= 0 AND goal <> held)
, q AS (SELECT *, abs(qty) AS a, CASE WHEN reduce THEN {LEAST_STEPS} ELSE least END AS cm, greatest(1, ceil(abs(qty) / nullif(most, 0)))::BIGINT AS k FROM l)
, p AS (SELECT *, a - (k - 1) * most AS tail, k > 1 AND a - (k - 1) * most < cm AS short FROM q)
, o AS (SELECT *, short AND most - (cm - tail) < cm AND a < 2 * least AS single, qty <> 0 AND (most < {LEAST_STEPS} OR NOT reduce AND (most < least OR a < least) OR a < cm OR short AND most - (cm - tail) < cm AND a >= 2 * least) AS refused FROM p)
, c AS (SELECT *, unnest(range(1, CASE WHEN refused OR single OR qty = 0 THEN 2 ELSE k + 1 END)) AS chunk FROM o)
SELECT part, CASE WHEN refused THEN 'refused' ELSE reason END AS reason, chunk::BIGINT AS chunk, CASE WHEN qty = 0 THEN NULL WHEN qty > 0 THEN 'BUY' ELSE 'SELL' END AS side, reduce AS reduce_only,
    CASE WHEN refused OR qty = 0 THEN 0 WHEN single THEN a WHEN short AND chunk = k THEN cm WHEN short AND chunk = k - 1 THEN most - (cm - tail) WHEN chunk = k THEN tail ELSE most END * {STEP}::DOUBLE AS quantity,
    CASE WHEN reduce THEN 0 ELSE 1 END AS phase FROM c"""))
def order_plan(spark, d):
    """Weights to target quantities in steps; names to close, flips as a close and an opening,
    changes; orders above the cap split into chunks, the last of which borrows from the one before
    if it is too small; what cannot be sent is named. Orders that reduce are in the first phase.

    Quantities are whole numbers of steps, so nothing is lost in rounding."""
    f, c = T.fills(spark, d), F.col
    early = c("run") < F.lit("1997-01-01").cast("date")
    signed = F.when(c("side") == "BUY", c("qty")).otherwise(-c("qty"))
    held = f.filter(early & (c("part") % 3 != 0)).groupBy("part").agg(F.round(F.sum(signed) / STEP).cast("long").alias("held"), F.avg("price").alias("held_mark"))
    want = f.filter(~early & (c("part") % 5 != 0)).groupBy("part").agg(F.avg("price").alias("mark"))
    count = want.agg(F.count(F.lit(1)).alias("n"))  # one row
    want = want.join(F.broadcast(count)).withColumn("want", F.floor(F.round(BUDGET / c("n") / c("mark") / STEP, 6)).cast("long")).withColumn("goal", F.when(c("part") % 2 == 0, c("want")).otherwise(-c("want"))).drop("n")
    j = held.join(want, "part", "full").withColumns({"held": F.coalesce("held", F.lit(0)), "mark": F.coalesce("mark", "held_mark")})
    steps = lambda notional, up: (F.ceil if up else F.floor)(F.round(notional / c("mark") / STEP, 6)).cast("long")
    j = j.withColumns({"most": steps(MOST_NOTIONAL, False), "least": F.greatest(F.lit(LEAST_STEPS), steps(LEAST_NOTIONAL, True))})
    enough = lambda q: (F.abs(q) >= LEAST_STEPS) & (F.abs(q) * STEP * c("mark") >= LEAST_NOTIONAL)
    leg = lambda reason, qty, reduce: F.struct(F.lit(reason).alias("reason"), qty.cast("long").alias("qty"), reduce.alias("reduce"))
    yes, no, none, delta = F.lit(True), F.lit(False), F.lit(0), c("goal") - c("held")
    reduces = (c("held") != 0) & (c("held") * delta < 0)
    legs = (
        F.when(c("goal").isNull(), F.when(c("held") != 0, F.array(leg("close_orphan", -c("held"), yes))))
        .when(~enough(c("want")), F.array(leg("below_min_notional", none, no)))
        .when(c("held") * c("goal") < 0, F.array(leg("close_before_flip", -c("held"), yes), leg("open_after_flip", c("goal"), no)))
        .when(enough(delta), F.array(leg("rebalance", delta, reduces)))
        .when(delta != 0, F.array(leg("delta_below_exchange_minimum", none, reduces)))
    )
    q = j.select("part", "most", "least", F.explode(legs).alias("l")).select("*", "l.*").withColumn("a", F.abs("qty")).withColumn("cm", F.when(c("reduce"), LEAST_STEPS).otherwise(c("least")))
    q = q.withColumn("k", F.greatest(F.lit(1), F.coalesce(F.ceil(c("a") / F.nullif(c("most"), F.lit(0))), F.lit(1)))).withColumn("tail", c("a") - (c("k") - 1) * c("most"))
    q = q.withColumn("short", (c("k") > 1) & (c("tail") < c("cm"))).withColumn("lent", c("most") - (c("cm") - c("tail")))
    stuck = c("short") & (c("lent") < c("cm"))
    refused = (c("qty") != 0) & ((c("most") < LEAST_STEPS) | ~c("reduce") & ((c("most") < c("least")) | (c("a") < c("least"))) | (c("a") < c("cm")) | stuck & (c("a") >= 2 * c("least")))
    q = q.withColumns({"refused": refused, "single": stuck & (c("a") < 2 * c("least"))})
    q = q.withColumn("chunk", F.explode(F.sequence(F.lit(1).cast("long"), F.when(c("refused") | c("single") | (c("qty") == 0), 1).otherwise(c("k")).cast("long"))))
    size = (
        F.when(c("refused") | (c("qty") == 0), 0).when(c("single"), c("a")).when(c("short") & (c("chunk") == c("k")), c("cm"))
        .when(c("short") & (c("chunk") == c("k") - 1), c("lent")).when(c("chunk") == c("k"), c("tail")).otherwise(c("most"))
    )
    return q.select(
        "part", F.when(c("refused"), "refused").otherwise(c("reason")).alias("reason"), "chunk", F.when(c("qty") > 0, "BUY").when(c("qty") < 0, "SELL").alias("side"),
        c("reduce").alias("reduce_only"), (size * STEP).alias("quantity"), F.when(c("reduce"), 0).otherwise(1).alias("phase"))


FUNDS, CLEAN_HOURS, SUSPECT = 1e5, (165, 171), 0.01


@query("e14_tracking_intervals", T.with_sql(NAMES, WEEK + f"""
, x AS (SELECT day, row_number() OVER (ORDER BY day) AS n, price * {FUNDS} AS paper, net * {FUNDS} AS actual FROM live)
, y AS (SELECT *, day::TIMESTAMP + to_hours((n * 7 % 5)::INT) AS rd, CASE WHEN n % 13 = 0 THEN NULL WHEN n % 9 = 0 THEN 'PARTIAL' ELSE 'COMPLETE' END AS status FROM x)
, z AS (SELECT *, (epoch_us(lead(rd) OVER (ORDER BY day)) - epoch_us(rd)) / 3.6e9 AS hours, round(actual - paper, 6) AS diff FROM y)
, r AS (SELECT *, CASE WHEN coalesce(status, '') <> 'COMPLETE' THEN 'run ' || coalesce(status, 'absent') WHEN hours NOT BETWEEN {CLEAN_HOURS[0]} AND {CLEAN_HOURS[1]} THEN round(hours)::INT || 'h to the next read'
    WHEN abs(diff) > {SUSPECT * FUNDS} THEN 'off by more than the limit' ELSE '' END AS why FROM z WHERE hours IS NOT NULL)
SELECT day::VARCHAR AS day, round(hours, 1) AS hours, round(paper, 6) AS paper, round(actual, 6) AS actual, diff, why = '' AS clean, why,
    CASE WHEN why = '' THEN round(sum(CASE WHEN why = '' THEN diff END) OVER (ORDER BY day), 6) END AS cum_diff FROM r"""))
def tracking_intervals(spark, d):
    """What each pair of readings says of paper against account: whether the interval counts
    (its run complete, its length right, no jump), why not, and the divergence summed over those."""
    w = Window.partitionBy(F.lit(0)).orderBy("day")  # one row a period
    x = live(spark, d).select("day", F.row_number().over(w).alias("n"), (F.col("price") * FUNDS).alias("paper"), (F.col("net") * FUNDS).alias("actual"))
    at = F.unix_micros(F.col("day").cast("timestamp")) + F.col("n") * 7 % 5 * 3_600_000_000
    status = F.when(F.col("n") % 13 == 0, F.lit(None)).when(F.col("n") % 9 == 0, "PARTIAL").otherwise("COMPLETE")
    y = x.withColumns({"at": at, "status": status, "diff": F.round(F.col("actual") - F.col("paper"), 6)})
    y = y.withColumn("hours", (F.lead("at").over(w) - F.col("at")) / 3.6e9).filter("hours IS NOT NULL")
    why = (
        F.when(F.coalesce("status", F.lit("")) != "COMPLETE", F.concat(F.lit("run "), F.coalesce("status", F.lit("absent"))))
        .when(~F.col("hours").between(*CLEAN_HOURS), F.concat(F.round("hours").cast("int").cast("string"), F.lit("h to the next read")))
        .when(F.abs("diff") > SUSPECT * FUNDS, "off by more than the limit").otherwise("")
    )
    y = y.withColumn("why", why).withColumn("clean", F.col("why") == "")
    cum = F.sum(F.when(F.col("clean"), F.col("diff"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return y.select(S.day_text(), F.round("hours", 1).alias("hours"), *[F.round(c, 6).alias(c) for c in ("paper", "actual")], "diff", "clean", "why", F.when(F.col("clean"), F.round(cum, 6)).alias("cum_diff"))


@query("e18_target_books", T.with_sql(NAMES, WEEK + """
, b AS (SELECT day, row_number() OVER (ORDER BY day) AS n FROM days), t AS (SELECT symbol || CASE WHEN n % 17 = 0 AND symbol = 3 THEN 'EUR' ELSE 'USDT' END AS name, day, n,
    CASE WHEN n % 11 = 0 AND symbol = 5 THEN 1.5 WHEN n % 7 = 0 THEN weight * 1.1 WHEN n % 5 = 0 AND symbol = 7 THEN weight + 0.05 ELSE weight END AS w FROM panel JOIN b USING (day))
, g AS (SELECT day, n, count(*) AS n_names, sum(abs(w)) AS gross, sum(w) AS net, bool_and(ends_with(name, 'USDT')) AS named, bool_and(w BETWEEN -1 AND 1) AS inside,
    CASE WHEN n % 13 = 0 THEN md5(day::VARCHAR) ELSE sha256(day::VARCHAR) END AS id FROM t GROUP BY day, n)
SELECT day::VARCHAR AS day, n_names, round(gross, 6) AS gross, round(net, 6) + 0.0 AS net, CASE WHEN NOT named THEN 'foreign symbol' WHEN NOT inside THEN 'weight outside [-1, 1]'
    WHEN NOT regexp_full_match(id, '[0-9a-fA-F]{64}') THEN 'no identity' WHEN gross <= 0 OR gross > 1.02 OR abs(net) > 0.02 THEN 'invalid exposure' ELSE 'valid' END AS verdict FROM g"""))
def target_books(spark, d):
    """Every target book against its rules, the first broken one named: symbols of one quote,
    weights within one, the form of its identity, gross and net limits."""
    p = week_weights(spark, d).select("symbol", "day", "weight")
    n = p.select("day").distinct().withColumn("n", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("day")))  # one row a day
    p = p.join(n, "day")
    name = F.concat(F.col("symbol").cast("string"), F.when((F.col("n") % 17 == 0) & (F.col("symbol") == 3), "EUR").otherwise("USDT"))
    w = F.when((F.col("n") % 11 == 0) & (F.col("symbol") == 5), 1.5).when(F.col("n") % 7 == 0, F.col("weight") * 1.1).when((F.col("n") % 5 == 0) & (F.col("symbol") == 7), F.col("weight") + 0.05).otherwise(F.col("weight"))
    g = p.withColumns({"name": name, "w": w}).groupBy("day", "n").agg(
        F.count(F.lit(1)).alias("n_names"), F.sum(F.abs("w")).alias("gross"), F.sum("w").alias("net"), F.every(F.col("name").endswith("USDT")).alias("named"), F.every(F.col("w").between(-1, 1)).alias("inside"))
    text = F.col("day").cast("string")
    identity = F.when(F.col("n") % 13 == 0, F.md5(text.cast("binary"))).otherwise(F.sha2(text.cast("binary"), 256))
    verdict = (
        F.when(~F.col("named"), "foreign symbol").when(~F.col("inside"), "weight outside [-1, 1]").when(~identity.rlike("^[0-9a-fA-F]{64}$"), "no identity")
        .when((F.col("gross") <= 0) | (F.col("gross") > 1.02) | (F.abs("net") > 0.02), "invalid exposure").otherwise("valid")
    )
    return g.select(S.day_text(), "n_names", F.round("gross", 6).alias("gross"), (F.round("net", 6) + 0.0).alias("net"), verdict.alias("verdict"))
