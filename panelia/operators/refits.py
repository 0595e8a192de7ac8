"""Many fits in one job: grouped Gram matrices, solved a row each; block shuffles; label grids."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelia.operators.inference import draws_of, hash_order


def grams(rows: DataFrame, by: list[str], features: list[str], target: str) -> DataFrame:
    """Counts, sums, x xT (upper part, by rows) and x y of each group: all that a linear fit needs,
    added up before the shuffle. Rows with a null among them do not count."""
    full = rows.dropna(subset=[*features, target])
    pairs = [F.sum(F.col(a) * F.col(b)) for i, a in enumerate(features) for b in features[i:]]
    return full.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(target).alias("y"), F.array(*map(F.sum, features)).alias("x"), F.array(*pairs).alias("xx"),
        F.array(*[F.sum(F.col(f) * F.col(target)) for f in features]).alias("xy"),
    )


def ridges(sums: DataFrame, by: list[str], width: int, alpha: float) -> DataFrame:
    """(*by, n, intercept, slopes): the ridge fit of each row of ``grams``, slopes penalised by
    ``alpha``, the intercept not. All rows of a batch are solved at once."""
    schema = sums.select(*by, "n").withColumns({"intercept": F.lit(0.0), "slopes": F.array(F.lit(0.0))}).schema
    at = np.triu_indices(width)

    def run(batches):
        for b in batches:
            if b.empty:
                continue
            n, y = b.n.to_numpy(float), b.y.to_numpy(float)
            x, xx, xy = (np.stack(b[c].to_list()).astype(float) for c in ("x", "xx", "xy"))
            full = np.zeros((len(b), width, width))
            full[:, at[0], at[1]] = full[:, at[1], at[0]] = xx
            centred = full - x[:, :, None] * x[:, None, :] / n[:, None, None] + alpha * np.eye(width)
            slopes = np.linalg.solve(centred, (xy - x * (y / n)[:, None])[:, :, None])[:, :, 0]
            out = b[[*by, "n"]].copy()
            out["intercept"] = (y - (slopes * x).sum(axis=1)) / n
            out["slopes"] = list(slopes)
            yield out

    return sums.mapInPandas(run, schema)


def predicted(features: list[str]) -> Column:
    """Prediction of a row that met its fit."""
    return sum((F.get("slopes", F.lit(i)) * F.col(f) for i, f in enumerate(features)), F.col("intercept"))


def block_shuffled(rows: DataFrame, key: str, place: str, value: str, block: int, draws: int, seed: str) -> DataFrame:
    """(draw, key, place, shuffled): for each draw the values of each key with blocks of ``block``
    consecutive places in a hash order (N6); ``place`` counts from 0 without gaps.

    Only the table of blocks is ordered; a row's new place is the start of its block plus its place
    inside. Draw -1 leaves everything where it is, so the observed fit is one of the same job.
    """
    b = rows.withColumn("_b", F.floor(F.col(place) / block)).groupBy(key, "_b").agg(F.count(F.lit(1)).alias("_size"))
    order = hash_order(seed, F.col("draw").cast("string"), F.col(key).cast("string"), F.col("_b").cast("string"))
    in_draw = Window.partitionBy("draw", key).orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)
    starts = draws_of(b, draws).withColumn("_order", order).withColumn("_start", F.coalesce(F.sum("_size").over(in_draw), F.lit(0)))
    kept = b.select(F.lit(-1).cast("bigint").alias("draw"), key, "_b", (F.col("_b") * block).alias("_start"))
    starts = starts.select("draw", key, "_b", "_start").unionByName(kept)
    moved = rows.select(key, place, value).withColumn("_b", F.floor(F.col(place) / block)).join(starts, [key, "_b"])
    return moved.select("draw", key, (F.col("_start") + F.col(place) - F.col("_b") * block).alias(place), F.col(value).alias("shuffled"))


def touch_grid(bars: DataFrame, key: str, time: str, cells: list[tuple[int, float, float]]) -> DataFrame:
    """Long and short outcome of each bar under every cell (horizon, stop, target), stop first on
    the same bar, else the close at the horizon (M10). Columns horizon, stop, target, long_gross,
    short_gross, end (the last bar that the cell's horizon looks at).

    One path of the longest horizon is collected for each bar; shorter horizons look at its
    beginning. Bars with fewer later ones than a horizon have no row for it. A price that moves to
    a barrier is tested against the entry's multiple, so equal prices count as touched.
    """
    longest = max(h for h, _, _ in cells)
    ahead = Window.partitionBy(key).orderBy(time).rowsBetween(1, longest)
    grid = F.array(*[F.struct(F.lit(h).alias("horizon"), F.lit(float(s)).alias("stop"), F.lit(float(t)).alias("target")) for h, s, t in cells])
    p = bars.withColumn("_path", F.collect_list(F.struct("high", "low", "close", F.col(time).alias("at"))).over(ahead))
    p = p.withColumn("_cell", F.explode(F.filter(grid, lambda c: c["horizon"] <= F.size("_path")))).select("*", "_cell.*")
    part = F.slice("_path", F.lit(1), F.col("horizon"))
    last = F.element_at(part, -1)

    def gross(side: int) -> Column:
        lost = lambda b: b["low"] <= F.col("close") * (1 - F.col("stop")) if side > 0 else b["high"] >= F.col("close") * (1 + F.col("stop"))
        won = lambda b: b["high"] >= F.col("close") * (1 + F.col("target")) if side > 0 else b["low"] <= F.col("close") * (1 - F.col("target"))
        hit = F.get(F.filter(part, lambda b: lost(b) | won(b)), F.lit(0))
        drift = side * (last["close"] / F.col("close") - 1)
        return F.when(hit.isNull(), drift).when(lost(hit), -F.col("stop")).otherwise(F.col("target"))

    made = {"long_gross": gross(1), "short_gross": gross(-1), "end": last["at"]}
    return p.withColumns(made).drop("_path", "_cell")


def circular_sums(rows: DataFrame, key: str, place: str, n: str, left: str, right: str) -> DataFrame:
    """(shift, total): for every shift s the sum over keys and places i of left[i] * right[i - s],
    round the end of the ``n`` places (N7). A key's series is transformed once, which costs
    n log n, and gives all shifts; a key holds one number a period."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        size = int(pdf[n].iloc[0])
        a, b = np.zeros(size), np.zeros(size)
        a[pdf[place]], b[pdf[place]] = pdf[left].fillna(0), pdf[right].fillna(0)
        sums = np.fft.irfft(np.fft.rfft(a) * np.conj(np.fft.rfft(b)), size)
        return pd.DataFrame({"shift": np.arange(size), "part": sums})

    parts = rows.select(key, place, n, left, right).groupBy(key).applyInPandas(run, "shift long, part double")
    return parts.groupBy("shift").agg(F.sum("part").alias("total"))
