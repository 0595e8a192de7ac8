"""Event labels over future paths, purged folds, sequential selections."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelia.functions import series as S
from panelia.operators.ranges import chain_of, running
from panelia.sources.storage import stored


def first_touch(bars: DataFrame, n: int, stop: float, target: float, cost: float) -> DataFrame:
    """Long and short outcome of holding from each close over the next ``n`` bars (H1, H2): the
    stop counts before the target on the same bar, else the close at the horizon; the last n rows
    of a symbol have no label. ``end`` is the day of the bar that closed the position.

    The path is an array of at most n bars, collected in the symbol's own window.
    """
    ahead = Window.partitionBy("symbol").orderBy("day").rowsBetween(1, n)
    p = bars.withColumn("_path", F.collect_list(F.struct("high", "low", "close", "day")).over(ahead))

    def label(side: int, name: str):
        up, down = F.col("close") * (1 + (target if side > 0 else stop)), F.col("close") * (1 - (stop if side > 0 else target))
        lost = lambda b: b["low"] <= down if side > 0 else b["high"] >= up
        won = lambda b: b["high"] >= up if side > 0 else b["low"] <= down
        hit = F.get(F.filter("_path", lambda b: lost(b) | won(b)), F.lit(0))
        drift = side * (F.element_at("_path", -1)["close"] / F.col("close") - 1)
        gross = F.when(hit.isNull(), drift).when(lost(hit), -stop).otherwise(target)
        end = F.coalesce(hit["day"], F.element_at("_path", -1)["day"])
        full = F.size("_path") == n
        return {f"{name}_ret": F.when(full, gross - cost), f"{name}_end": F.when(full, end)}

    return p.withColumns(label(1, "long") | label(-1, "short")).drop("_path")


def uniqueness(labels: DataFrame, calendar: DataFrame, start: str, end: str) -> DataFrame:
    """Mean of 1 / concurrency over each label's span, per symbol (H3): +1 and -1 edges, running
    sums on the symbol's calendar, prefix sums of the inverse, two lookups."""
    w = Window.partitionBy("symbol").orderBy("day")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    up = labels.groupBy("symbol", F.col(start).alias("day")).agg(F.count(F.lit(1)).alias("up"))
    down = labels.groupBy("symbol", F.col(end).alias("day")).agg(F.count(F.lit(1)).alias("down"))
    grid = calendar.join(up, ["symbol", "day"], "left").join(down, ["symbol", "day"], "left").fillna(0, ["up", "down"])
    # a span holds both of its ends: what ended before this row no longer counts
    before = F.coalesce(F.sum("down").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    c = grid.withColumn("c", F.sum("up").over(run) - before)
    c = c.withColumn("s", F.sum(F.when(F.col("c") > 0, 1 / F.col("c")).otherwise(0.0)).over(run)).withColumn("k", F.row_number().over(w))
    a = c.select("symbol", F.col("day").alias(start), F.col("k").alias("_ka"), (F.col("s") - F.when(F.col("c") > 0, 1 / F.col("c")).otherwise(0.0)).alias("_sa"))
    b = c.select("symbol", F.col("day").alias(end), F.col("k").alias("_kb"), F.col("s").alias("_sb"))
    out = labels.join(a, ["symbol", start]).join(b, ["symbol", end])
    return out.withColumn("weight", (F.col("_sb") - F.col("_sa")) / (F.col("_kb") - F.col("_ka") + 1)).drop("_ka", "_kb", "_sa", "_sb")


def fold_table(labels: DataFrame, n: int, time: str) -> DataFrame:
    """(fold, a, b): equal wall-clock test spans after the first part of the time range (H4)."""
    ends = labels.agg(F.min(time).alias("lo"), F.max(time).alias("hi")).filter("lo IS NOT NULL")
    step = F.datediff("hi", "lo") / F.lit(float(n + 1))
    rows = ends.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(n))))
    edge = lambda k: F.date_add("lo", F.floor(step * k).cast("int"))
    return rows.select("fold", edge(F.col("fold")).alias("a"), F.when(F.col("fold") == n, F.date_add("hi", 1)).otherwise(edge(F.col("fold") + 1)).alias("b"))


def purged_folds(labels: DataFrame, folds: DataFrame, time: str, end: str, embargo: int) -> DataFrame:
    """Rows of each fold tagged test, train or purged (H4, J14). The fold table has a few rows of
    fixed number and is broadcast; a row goes to train only if its label ended before the test."""
    f = labels.join(F.broadcast(folds), F.col(time) < F.col("b"))
    part = (
        F.when(F.col(time) >= F.col("a"), "test")
        .when(F.col(end) < F.date_sub("a", embargo), "train")
        .otherwise("purged")
    )
    return f.withColumn("part", part)


def non_overlapping(spans: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Spans accepted in order of start if they begin at or after the end of the last accepted one
    of their key (H8)."""
    return chain_of(spans, key, start, end)


def cooldown(events: DataFrame, key: str, time: str, seconds: int) -> DataFrame:
    """Events kept if at least ``seconds`` after the last KEPT one of their key (H9)."""
    until = F.timestamp_seconds(F.unix_micros(F.col(time).cast("timestamp")) / 1e6 + seconds)
    return chain_of(events.withColumn("_until", until), key, time, "_until").drop("_until")


def event_purged_folds(rows: DataFrame, time: str, end: str, least: int, size: int, step: int, embargo: int) -> tuple[DataFrame, DataFrame]:
    """Walk-forward folds by rows (H7): (folds, purged).

    Rows are ordered by time; fold f tests the ``size`` rows from ``least + f * step`` on, and only
    whole blocks count. A row before the block is train unless its span [time, end] comes within
    ``embargo`` seconds of the block's span on either side; later rows are never train. ``folds``
    has fold, a, b (the block's span), n_before and n_test; ``purged`` has (fold, place) of the rows
    before a block that its embargo takes out. Train rows are what is left of those before: they
    grow with the square of the folds, so they are counted, not listed.

    ``time`` and ``end`` are seconds. Ordinals come from a running count that splits the table by
    time. Spans and blocks are dealt over buckets of time, and a pair counts in the first bucket
    that both have, so the overlap join is an equi-join.
    """
    placed = running(rows.withColumn("_all", F.lit(0)), "_all", time, {"place": ("count", F.lit(1))}, end)
    placed = stored(placed.withColumn("place", F.col("place") - 1), "fold-rows")
    newest = F.floor((F.col("place") - least) / step)
    oldest = F.greatest(F.floor((F.col("place") - least - size) / step) + 1, F.lit(0))
    tests = placed.filter((F.col("place") >= least) & (oldest <= newest)).withColumn("fold", F.explode(F.sequence(oldest, newest)))
    folds = tests.groupBy("fold").agg(F.min(time).alias("a"), F.max(end).alias("b"), F.count(F.lit(1)).alias("n_test")).filter(F.col("n_test") == size)
    folds = stored(folds.withColumn("n_before", F.col("fold") * step + least), "folds")
    width = F.greatest(F.lit(1), F.lit(embargo), F.ceil(F.avg(F.col(end) - F.col(time))).cast("long"))
    bucket = placed.agg(width.alias("_w"))
    spread = lambda df, lo, hi: df.join(F.broadcast(bucket)).withColumns({
        "_lo": F.floor(F.col(lo) / F.col("_w")), "_k": F.explode(F.sequence(F.floor(F.col(lo) / F.col("_w")), F.floor(F.col(hi) / F.col("_w"))))})
    blocks = folds.select("fold", "n_before", (F.col("a") - embargo).alias("_a"), (F.col("b") + embargo).alias("_b"))
    blocks = spread(blocks, "_a", "_b").withColumnRenamed("_lo", "_blo").drop("_w")
    met = spread(placed.select("place", time, end), time, end).join(blocks, "_k").filter(F.col("_k") == F.greatest("_lo", "_blo"))
    purged = met.filter((F.col("place") < F.col("n_before")) & (F.col(end) >= F.col("_a")) & (F.col(time) <= F.col("_b")))
    return folds, purged.select("fold", "place", time, end)


def event_train_counts(rows: DataFrame, folds: DataFrame, time: str, end: str, embargo: int) -> DataFrame:
    """``folds`` (see ``event_purged_folds``) with n_train, n_purged and last_end, the latest end of a
    train row.

    No span ends before it begins, so the train rows of a fold are all those that end more than
    ``embargo`` before its block: what ends there began there too, and nothing that comes before the
    block begins after it. One running count over the ends gives all folds, whatever rows and folds
    lie within an embargo; rows to be purged are never listed.
    """
    key = F.lit(0).alias("_all")
    ends = rows.filter(F.col(end) >= F.col(time)).select(key, F.col(end).alias("_t"), F.lit(1).alias("_side"), F.col(end).alias("_end"))
    asked = folds.select("*", key, (F.col("a") - embargo).alias("_t"), F.lit(0).alias("_side")).unionByName(ends, allowMissingColumns=True)
    known = running(asked, "_all", "_t", {"_n": ("count", F.col("_end")), "last_end": ("max", F.col("_end"))}, "_side").filter("_side = 0")
    train = F.coalesce("_n", F.lit(0))
    return known.select(*folds.columns, train.alias("n_train"), (F.col("n_before") - train).alias("n_purged"), "last_end")


#: Exit profiles (H11): stop, first target, share sold there, runner target as a multiple of the
#: first, trailing distance, offset of the break-even stop, bars to wait before trailing after the
#: first target, gain from which the stop trails before it (null: never).
PROFILE = "profile string, stop double, target double, share double, runner double, trail double, even double, wait int, trigger double"


def exit_replay(paths: DataFrame, cost: float) -> DataFrame:
    """The exit of each row (H11), which holds a profile (see PROFILE), side 1 or -1, entry, and
    ``path``, an array of the bars after entry (high, low, close).

    Everything is a return in the direction of the trade, so both sides follow one rule: a bar that
    reaches the stop ends the trade there; else one that reaches the first target sells a share and
    lifts the stop to break-even; the rest runs to its own target, to the stop, which now trails
    the best price, or to the end. Adds reason, pnl (null while open), bars_held, mfe and mae. An
    entry that is not above zero has no return, so such a row is no trade and gives none."""
    side, entry = F.col("side"), F.col("entry")
    paths = paths.filter(entry > 0)
    gain = lambda price: side * (S.safe_ratio(price, entry) - 1)
    bars = F.transform("path", lambda b: F.struct(
        F.when(side > 0, gain(b["high"])).otherwise(gain(b["low"])).alias("up"),
        F.when(side > 0, gain(b["low"])).otherwise(gain(b["high"])).alias("down"), gain(b["close"]).alias("close")))
    trailing = lambda best: side * ((1 + side * best) * (1 - side * F.col("trail")) - 1)
    start = F.struct(
        F.lit("OPEN").alias("reason"), F.lit(0.0).alias("raw"), F.lit(0).alias("n"), F.lit(0).alias("first"), (-F.col("stop")).alias("at"),
        F.lit(0.0).alias("best"), F.lit(0.0).alias("mfe"), F.lit(0.0).alias("mae"), F.lit(0.0).alias("close"),
    )

    def step(s, x):
        n, running = s["n"] + 1, s["first"] > 0
        stopped = x["down"] <= s["at"]
        first = ~running & ~stopped & (x["up"] >= F.col("target"))
        ran = running & ~stopped & (x["up"] >= F.col("target") * F.col("runner"))
        best = F.greatest(s["best"], x["up"])
        waited = F.when(first, F.col("wait") <= 0).when(running, n - s["first"] >= F.col("wait")).otherwise(F.coalesce(best >= F.col("trigger"), F.lit(False)))
        even = F.when(first | waited, F.greatest(s["at"], F.col("even"))).otherwise(s["at"])
        rest = lambda r: F.when(running, F.col("share") * F.col("target") + (1 - F.col("share")) * r).otherwise(r)
        after = F.struct(
            F.when(stopped & running, "TP1_TRAIL_STOP").when(stopped, "SL_OR_TRAIL").when(ran, "TP1_RUNNER_TP").otherwise("OPEN").alias("reason"),
            F.when(stopped, rest(s["at"])).when(ran, rest(F.col("target") * F.col("runner"))).otherwise(0.0).alias("raw"),
            n.alias("n"), F.when(first, n).otherwise(s["first"]).alias("first"),
            F.when(waited, F.greatest(even, trailing(best))).otherwise(even).alias("at"), best.alias("best"),
            F.greatest(s["mfe"], x["up"]).alias("mfe"), F.least(s["mae"], x["down"]).alias("mae"), x["close"].alias("close"),
        )
        return F.when(s["reason"] == "OPEN", after).otherwise(s)

    done = paths.withColumn("_s", F.aggregate(bars, start, step))
    timed = (F.col("_s.reason") == "OPEN") & (F.col("_s.first") > 0)
    raw = F.when(timed, F.col("share") * F.col("target") + (1 - F.col("share")) * F.col("_s.close")).when(F.col("_s.reason") != "OPEN", F.col("_s.raw"))
    return done.withColumns({
        "reason": F.when(timed, "TP1_TIME").otherwise(F.col("_s.reason")), "pnl": raw - cost, "bars_held": F.col("_s.n"), "mfe": F.col("_s.mfe"), "mae": F.col("_s.mae"),
    }).drop("_s")


def resting_entries(signals: DataFrame, waits: list[int], n: int, stop: float, target: float, offset: float, slip: float, fees: tuple[float, float]) -> DataFrame:
    """Outcome of every signal entered at once and by an order that rests (H10): mode, wait, filled,
    ret, one row for each signal and mode.

    ``signals`` holds side (1 or -1), close, atr (as a share of the price) and ``path``, an array of
    the next max(waits) + n bars (high, low, close), shorter at the end of a series. A signal counts
    if n bars follow it. An order rests at ``offset`` behind the close for ``wait`` bars. Once it is
    filled, the bar that filled it is looked at first, stop before target, then n more; a fill with
    fewer bars left than that gives no row. A miss is valued as an entry at once. Exits are at the
    market. ``fees`` are those of resting and of market orders.
    """
    side, close, atr = F.col("side"), F.col("close"), F.col("atr")
    rest, market = fees

    def outcome(entry, first, count, fee):
        lost_at, won_at = entry * (1 - side * atr * stop), entry * (1 + side * atr * target)
        lost = lambda b: F.when(side > 0, b["low"] <= lost_at).otherwise(b["high"] >= lost_at)
        won = lambda b: F.when(side > 0, b["high"] >= won_at).otherwise(b["low"] <= won_at)
        part = F.slice("path", first, count)
        hit = F.get(F.filter(part, lambda b: lost(b) | won(b)), F.lit(0))
        out = F.when(hit.isNull(), F.element_at(part, -1)["close"]).when(lost(hit), lost_at).otherwise(won_at)
        return side * (out * (1 - side * slip) - entry) / entry - fee - market

    modes = [F.struct(F.lit("market").alias("mode"), F.lit(0).alias("wait"))] + [F.struct(F.lit("rest").alias("mode"), F.lit(w).alias("wait")) for w in waits]
    x = signals.filter((F.size("path") >= n) & (atr > 0)).withColumn("_m", F.explode(F.array(*modes))).select("*", "_m.*").drop("_m")
    limit = close * (1 - side * offset)
    reached = F.transform(F.slice("path", F.lit(1), F.greatest("wait", F.lit(1))), lambda b: F.when(side > 0, b["low"] <= limit).otherwise(b["high"] >= limit))
    x = x.withColumn("_at", F.when(F.col("mode") == "rest", F.array_position(reached, True)).otherwise(0))  # 0: not filled by resting
    resting = F.col("_at") > 0
    at_once = outcome(close * (1 + side * slip), F.lit(1), F.lit(n), F.lit(market))
    rested = outcome(limit, F.col("_at").cast("int"), F.lit(n + 1), F.lit(rest))
    x = x.filter(~resting | (F.col("_at") + n <= F.size("path")))
    return x.withColumns({"filled": resting | (F.col("mode") == "market"), "ret": F.when(resting, rested).otherwise(at_once)}).drop("_at")


def pooled_entries(entries: DataFrame, key: str, *by: str) -> DataFrame:
    """The table of modes pooled over keys (H10): keys without a fill do not count; adverse selection
    is the mean over keys of how much better the misses would have done than the fills."""
    mine = F.col("filled")
    e = entries.groupBy(*by, "mode", "wait", key).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(mine).alias("f"), F.sum(F.when(mine, F.col("ret"))).alias("total"),
        F.avg(F.when(mine, F.col("ret"))).alias("got"), F.avg(F.when(~mine, F.col("ret"))).alias("missed"),
    ).filter("f > 0")
    return e.groupBy(*by, "mode", "wait").agg(
        F.sum("n").alias("n_signals"), F.sum("f").alias("n_filled"), (F.sum("f") / F.sum("n")).alias("fill_rate"), (F.sum("total") / F.sum("f") * 1e4).alias("net_bps_filled"),
        (F.sum("total") / F.sum("n") * 1e4).alias("net_bps_all"), (F.avg(F.col("missed") - F.col("got")) * 1e4).alias("adverse_bps"),
    )
