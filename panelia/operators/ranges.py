"""Running scans of keyed series in which a hot key is split into time ranges.

A window over a key puts all rows of the key in one task. Here a key with many rows is cut into
ranges of its time; each range is scanned in a task of its own, and what a range carries into the
next one (its last value, greatest value, sum or product) follows from one row a range.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelia.sources.storage import stored

#: A key with more than one row in HOT_SHARE is split. Fewer than HOT_SHARE keys can be, so tables
#: with SIDE * SIDE rows for each of them are bounded whatever the input, and are broadcast.
HOT_SHARE = 1000
#: Ranges of a split key are found in two steps of SIDE comparisons each.
SIDE = 16


def split_ranges(rows: DataFrame, key: str, time: str) -> DataFrame:
    """``rows`` with ``_range``: 0 for keys with few rows, else the number of the time range.

    Bounds are approximate quantiles of the key's times and are stored, so that every use of the
    result cuts alike; rows of equal time share a range, and ranges are in order of time.
    """
    total = rows.count()
    hot = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") * HOT_SHARE > total).select(key)
    count = SIDE * SIDE
    marks = [k / count for k in range(1, count)]
    bounds = rows.select(key, time).join(F.broadcast(hot), key).groupBy(key).agg(F.percentile_approx(time, marks).alias("_bounds"))
    bounds = stored(bounds, "ranges")
    coarse = F.transform(F.sequence(F.lit(1), F.lit(SIDE - 1)), lambda k: F.element_at("_bounds", k * SIDE))
    below = lambda marks: F.size(F.filter(marks, lambda b: b < F.col(time)))
    out = rows.join(F.broadcast(bounds.withColumn("_coarse", coarse)), key, "left").withColumn("_step", below("_coarse"))
    place = F.col("_step") * SIDE + below(F.slice("_bounds", F.col("_step") * SIDE + 1, SIDE - 1))
    return out.withColumn("_range", F.when(F.col("_bounds").isNull(), 0).otherwise(place)).select(*rows.columns, "_range")


def _scan(how: str, x: Column, order: Column):
    """(aggregate of a range, what ranges before carry in, both together) of a kind of scan."""
    add = lambda inside, carry: F.coalesce(inside + carry, inside, carry)
    return {
        "last": (F.max_by(x, F.when(x.isNotNull(), order)), lambda t: F.last(t, ignorenulls=True), F.coalesce),
        "max": (F.max(x), F.max, F.greatest),
        "min": (F.min(x), F.min, F.least),
        "sum": (F.sum(x), F.sum, add),
        "count": (F.count(x), F.sum, add),
        "product": (F.product(x), F.product, lambda inside, carry: F.coalesce(inside * carry, inside, carry)),
    }[how]


def running(rows: DataFrame, key: str, time: str, scans: dict[str, tuple[str, Column]], *ties: str) -> DataFrame:
    """``rows`` with one column for each scan {name: (kind, value)}: last non-null value, max, min,
    sum, count or product of the values up to and with the row, in order of time and ``ties``.

    One shuffle of the rows by key and range. A row with a null key is scanned with the others of
    that kind in one task.
    """
    rows = split_ranges(rows, key, time)
    order = F.struct(time, *ties)
    here = Window.partitionBy(key, "_range").orderBy(time, *ties).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    inside, totals, carries, both = {}, [], {}, {}
    for name, (how, x) in scans.items():
        total, carry, join = _scan(how, x, order)
        inside_of = F.last(x, ignorenulls=True) if how == "last" else total
        inside[f"_in_{name}"] = inside_of.over(here)
        totals.append(total.alias(f"_t_{name}"))
        carries[f"_c_{name}"] = carry(F.col(f"_t_{name}")).over(before)
        both[name] = join(F.col(f"_in_{name}"), F.col(f"_c_{name}"))
    by_range = rows.filter("_range >= 0").groupBy(key, "_range").agg(*totals)
    split = by_range.withColumn("_most", F.max("_range").over(Window.partitionBy(key))).filter("_most > 0")
    carried = split.withColumns(carries).select(F.col(key).alias("_key"), F.col("_range").alias("_r"), *carries)
    met = rows.withColumns(inside).join(F.broadcast(carried), (F.col(key) == F.col("_key")) & (F.col("_range") == F.col("_r")), "left")
    return met.withColumns(both).select(*[c for c in rows.columns if c != "_range"], *scans)


def asof_split(left: DataFrame, right: DataFrame, key: str, time: str, values: list[str]) -> DataFrame:
    """As ``joins.asof`` (J1, J2), with hot keys split: the latest right row at or before each left
    row, with its time as <time>_matched."""
    match = F.struct(F.col(time).alias("t"), *values)
    other = right.select(key, time, F.lit(0).alias("_side"), match.alias("_match"))
    both = left.withColumn("_side", F.lit(1)).unionByName(other, allowMissingColumns=True)
    out = running(both, key, time, {"_m": ("last", F.col("_match"))}, "_side").filter("_side = 1")
    return out.select(*left.columns, F.col("_m.t").alias(f"{time}_matched"), *[F.col(f"_m.{v}").alias(v) for v in values])


def span_sums(spans: DataFrame, flows: DataFrame, key: str, a: str, b: str, time: str, value: str) -> DataFrame:
    """Sum and count of the flows in (a, b) and in (a, b] of each span (J3, J4): columns open_sum,
    open_n, closed_sum, closed_n.

    Running sums of the flows are looked up at both ends, so a span costs the same three rows
    whatever its length. A span that is empty or turned round has no flows. Spans are known by their
    key and ends: the sums meet a second run of the plan of ``spans``, whose rows may come in
    another order, so a number given to rows would not do.
    """
    # at one time: what ends before it, the flows, what holds them
    probe = lambda at, side, sign: F.struct(F.col(at).alias("at"), F.lit(side).alias("side"), F.lit(sign).alias("sign"))
    ends = F.explode(F.array(probe(a, 2, 0), probe(b, 0, 1), probe(b, 2, 2)))
    held = spans.filter(F.col(a) < F.col(b)).select(key, a, b).distinct()
    probes = held.select(key, F.col(a).alias("_a"), F.col(b).alias("_b"), ends.alias("_p")).select(key, "_a", "_b", "_p.*")
    f = flows.select(key, F.col(time).alias("at"), F.lit(1).alias("side"), F.col(value).alias("_v"))
    both = probes.unionByName(f, allowMissingColumns=True)
    at = running(both, key, "at", {"_s": ("sum", F.col("_v")), "_n": ("count", F.col("_v"))}, "side").filter("side <> 1")
    pick = lambda c, sign: F.max(F.when(F.col("sign") == sign, F.coalesce(F.col(c), F.lit(0))))
    sums = at.groupBy(key, F.col("_a").alias(a), F.col("_b").alias(b)).agg(*[(pick(c, s) - pick(c, 0)).alias(f"{n}_{w}") for c, w in (("_s", "sum"), ("_n", "n")) for s, n in ((1, "open"), (2, "closed"))])
    made = ["open_sum", "open_n", "closed_sum", "closed_n"]
    return spans.join(sums, [key, a, b], "left").fillna(0, made).select(*spans.columns, *made)


def chain_of(rows: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """The rows that a greedy pass accepts (H8): in order of start, each that begins at or after
    the end of the last accepted one of its key. Rows with a null key, start or end are not.

    The row accepted after an accepted one does not depend on the past: it is the first later row
    that begins at or after its end. That successor is looked up for every row by one running
    count; the accepted rows are those reached from the first. Jumps double in every round, and so
    does the part of the chain that is marked, so a chain of n rows takes log2(n) rounds of
    equi-joins, each over one row of three numbers for each input row. The joins sort both sides:
    rounds with few marks would else send these through the driver.
    """
    number = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    placed = rows.withColumns({"_a": number(start), "_z": number(end)}).dropna(subset=[key, "_a", "_z"])
    placed = stored(running(placed, key, "_a", {"_n": ("count", F.lit(1))}, "_z"), "chain-rows")
    begins = placed.select(key, F.col("_a").alias("t"), F.lit(1).alias("side"), F.lit(1).alias("_one"))
    ends = placed.select(key, F.col("_z").alias("t"), F.lit(0).alias("side"), "_n")
    seen = running(ends.unionByName(begins, allowMissingColumns=True), key, "t", {"_before": ("count", F.col("_one"))}, "side")
    most = placed.groupBy(key).agg(F.max("_n").alias("_most"))
    after = F.greatest(F.coalesce("_before", F.lit(0)), F.col("_n")) + 1
    jumps = seen.filter("side = 0").select(key, "_n", after.alias("_to")).join(most.hint("merge"), key)
    jumps = stored(jumps.select(key, "_n", F.when(F.col("_to") <= F.col("_most"), F.col("_to")).alias("_to"), (F.col("_n") == 1).alias("_kept")), "chain-jumps")
    while not (marks := jumps.filter("_kept AND _to IS NOT NULL")).isEmpty():
        reached = marks.select(key, F.col("_to").alias("_n"), F.lit(True).alias("_new"))
        further = jumps.select(key, F.col("_n").alias("_to"), F.col("_to").alias("_next"))
        jumps = stored(
            jumps.join(further.hint("merge"), [key, "_to"], "left").join(reached.hint("merge"), [key, "_n"], "left")
            .select(key, "_n", F.col("_next").alias("_to"), (F.col("_kept") | F.coalesce("_new", F.lit(False))).alias("_kept")),
            "chain-jumps",
        )
    return placed.join(jumps.filter("_kept").select(key, "_n").hint("merge"), [key, "_n"], "left_semi").select(*rows.columns)
