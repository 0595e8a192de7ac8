"""Cross-sectional operators on a (day, symbol) panel: skeletons, ranks, weights, overlays."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelia.functions import series as S



def by_day():
    return Window.partitionBy("day")


def by_symbol():
    return Window.partitionBy("symbol").orderBy("day")


def skeleton(panel: DataFrame) -> DataFrame:
    """Every day of the panel for every symbol, so that lags go by calendar position. Each symbol
    gets the calendar as one array and explodes it; a day list is small beside the panel."""
    days = panel.select("day").distinct().agg(F.array_sort(F.collect_list("day")).alias("_days"))
    symbols = panel.select("symbol").distinct()
    full = symbols.join(F.broadcast(days)).select("symbol", F.explode("_days").alias("day"))
    return full.join(panel, ["symbol", "day"], "left")


def tail_weights(panel: DataFrame, signal: str, q: float, flip: int = 1) -> DataFrame:
    """target: 0.5 / n on the top share q, -0.5 / n on the bottom, nothing if a side is empty;
    weight: the target of the period before (X8). ``panel`` must be a full skeleton."""
    rank = S.average_rank(F.col(signal), "day")
    p = panel.withColumn("rank", rank)
    top, bottom = F.col("rank") >= 1 - q, F.col("rank") <= q
    n_top, n_bottom = (F.count(F.when(x, 1)).over(by_day()) for x in (top, bottom))
    target = (
        F.when((n_top == 0) | (n_bottom == 0), 0.0)
        .when(top & ~bottom, flip * 0.5 / n_top)
        .when(bottom & ~top, -flip * 0.5 / n_bottom)
        .otherwise(0.0)
    )
    p = p.withColumn("target", target)
    return p.withColumn("weight", F.coalesce(F.lag("target").over(by_symbol()), F.lit(0.0)))


def gated_weights(panel: DataFrame, signal: str, eligible: Column, q: float, least: int) -> DataFrame:
    """Tail weights among eligible rows on days with at least ``least`` of them; all rows stay."""
    p = panel.withColumn("_s", F.when(eligible, F.col(signal)))
    enough = F.count("_s").over(by_day()) >= least
    p = p.withColumn("_s", F.when(enough, F.col("_s")))
    return tail_weights(p, "_s", q).drop("_s")


def ordinal_days(panel: DataFrame) -> DataFrame:
    """(day, i): positions of the days, from 0. One row a day, so one ordered task is enough."""
    return panel.select("day").distinct().withColumn("i", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("day")) - 1).cast("bigint"))


def block_holdings(panel: DataFrame, score: str, k: int | None, hold: int, positive: bool = True) -> DataFrame:
    """1 / k on the k greatest (positive) scores at the start of each block of ``hold`` days, held
    for the block; all positive names share 1 if k is None; weight lags a day (X12, X13)."""
    days = ordinal_days(panel).withColumn("block", F.floor(F.col("i") / hold))
    p = panel.join(days, "day").withColumn("_start", F.col("i") % hold == 0)
    can = F.col(score).isNotNull() & (F.col(score) > 0 if positive else F.lit(True))
    start = p.filter(F.col("_start") & can)
    if k is None:
        chosen = start.select("block", "symbol", (F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy("block"))).alias("target"))
    else:
        order = Window.partitionBy("block").orderBy(F.desc(score), "symbol")
        chosen = start.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).select("block", "symbol", F.lit(1.0 / k).alias("target"))
    held = p.join(chosen, ["block", "symbol"], "left").withColumn("target", F.coalesce("target", F.lit(0.0)))
    return held.withColumn("weight", F.coalesce(F.lag("target").over(by_symbol()), F.lit(0.0))).drop("_start")


def with_hedge(panel: DataFrame, hedge: int, beta: str) -> DataFrame:
    """The hedge symbol gets minus the beta-weighted sum of the others on its day."""
    tilt = F.sum(F.when(F.col("symbol") != hedge, F.col("weight") * F.coalesce(beta, F.lit(0.0)))).over(by_day())
    return panel.withColumn("weight", F.when(F.col("symbol") == hedge, -F.coalesce(tilt, F.lit(0.0))).otherwise(F.col("weight")))


def unit_gross(panel: DataFrame) -> DataFrame:
    """Weights divided by their gross of the day."""
    gross = F.sum(F.abs("weight")).over(by_day())
    return panel.withColumn("weight", F.coalesce(S.safe_ratio(F.col("weight"), gross), F.lit(0.0)))


def blend(a: DataFrame, b: DataFrame, x: float, y: float) -> DataFrame:
    """x a + y b over all keys of both."""
    parts = a.select("day", "symbol", (F.col("weight") * x).alias("weight")).unionByName(b.select("day", "symbol", (F.col("weight") * y).alias("weight")))
    return parts.groupBy("day", "symbol").agg(F.sum("weight").alias("weight"))
