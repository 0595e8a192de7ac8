"""Resampling nulls and standard errors. A draw is a column, so one job evaluates all draws."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def hash_order(*parts) -> Column:
    """A reproducible random order, the same in other engines: MD5 of the joined key."""
    return F.md5(F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts]).cast("binary"))


def draws_of(df: DataFrame, n: int) -> DataFrame:
    """Every row once for each draw, by explode: no join is needed."""
    return df.withColumn("draw", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))))


def donor_map(panel: DataFrame, n: int, seed: str) -> DataFrame:
    """(draw, symbol, donor): a permutation of the symbols for each draw (J15). It holds one row
    for each symbol and draw and is joined by Spark's own choice."""
    s = draws_of(panel.select("symbol").distinct(), n)
    w = Window.partitionBy("draw")
    shuffled = s.withColumn("r", F.row_number().over(w.orderBy(hash_order(seed, F.col("draw").cast("string"),
        F.col("symbol").cast("string"))))).withColumnRenamed("symbol", "donor")
    return s.withColumn("r", F.row_number().over(w.orderBy("symbol"))).join(shuffled, ["draw", "r"]).drop("r")


def lagged_products(daily: DataFrame, value: str, lags: int) -> DataFrame:
    """(lag, n, product): sums of the centred series times itself ``lag`` rows before."""
    w = Window.partitionBy(F.lit(0)).orderBy("day")
    e = daily.withColumn("_e", F.col(value) - F.avg(value).over(Window.partitionBy(F.lit(0))))
    e = e.withColumn("_l", F.array(*[F.struct(F.lit(k).alias("lag"), F.lag("_e", k).over(w).alias("before")) for k in range(1, lags + 1)]))
    rows = e.select("_e", F.explode("_l").alias("x")).filter("x.before IS NOT NULL")
    return rows.groupBy(F.col("x.lag").alias("lag")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_e") * F.col("x.before")).alias("product"))


def hac_mean(daily: DataFrame, value: str, lags: int) -> DataFrame:
    """(n, mean, se, t, low, high): Bartlett-weighted error of a mean, floor 0."""
    base = daily.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("v0"))
    cov = lagged_products(daily, value, lags).agg(F.sum(2 * (1 - F.col("lag") / (lags + 1)) * F.col("product")).alias("s"))
    out = base.join(F.broadcast(cov)).withColumn("var", F.greatest((F.col("v0") + F.col("s") / F.col("n")) / F.col("n"), F.lit(0.0)))
    se = F.sqrt("var")
    return out.select("n", "mean", se.alias("se"), (F.col("mean") / F.nullif(se, F.lit(0.0))).alias("t"), (F.col("mean") - 1.96 * se).alias("low"),
        (F.col("mean") + 1.96 * se).alias("high"))


def p_value(null: DataFrame, observed: DataFrame, value: str) -> DataFrame:
    """(observed, n, p): (#{null >= observed} + 1) / (n + 1)."""
    o = observed.select(F.col(value).alias("observed"))
    x = null.select(value).join(F.broadcast(o))
    return x.groupBy("observed").agg(F.count(value).alias("n"), ((F.count(F.when(F.col(value) >= F.col("observed"), 1)) + 1) / (F.count(value) + 1)).alias("p"))


def hac_intercept(rows: DataFrame, y: str, x: str, lags: int) -> DataFrame:
    """(n, intercept, slope, se, t) of y on x with Bartlett-weighted errors.

    The intercept is a weighted sum of the errors u: h = (sum xx - x sum x) / (n sum xx - (sum x)^2) u,
    so its variance is the weighted sum of lagged products of h, as for a mean."""
    sums = rows.agg(
        F.count(F.lit(1)).alias("n"), F.regr_intercept(y, x).alias("intercept"), F.regr_slope(y, x).alias("slope"),
        F.sum(x).alias("_s"), F.sum(F.col(x) * F.col(x)).alias("_q"),
    )
    weight = (F.col("_q") - F.col("_s") * F.col(x)) / (F.col("n") * F.col("_q") - F.col("_s") * F.col("_s"))
    h = rows.join(F.broadcast(sums)).select("day", (weight * (F.col(y) - F.col("intercept") - F.col("slope") * F.col(x))).alias("h"))
    own = h.agg(F.sum(F.col("h") * F.col("h")).alias("_own"))
    lagged = lagged_products(h, "h", lags).agg(F.coalesce(F.sum(2 * (1 - F.col("lag") / (lags + 1)) * F.col("product")), F.lit(0.0)).alias("_lagged"))
    both = sums.join(F.broadcast(own)).join(F.broadcast(lagged)).withColumn("_v", F.col("_own") + F.col("_lagged"))
    se = F.when((F.col("n") > lags + 2) & (F.col("_v") > 0), F.sqrt("_v"))
    return both.select("n", "intercept", "slope", se.alias("se"), (F.col("intercept") / se).alias("t"))


def block_draws(daily: DataFrame, values: list[str], draws: int, block: int, seed: str) -> DataFrame:
    """(draw, *values): rows of circular blocks, the same places for all values. Starts come from a
    hash; blocks are exploded to positions and joined to the series."""
    w = Window.partitionBy(F.lit(0))
    s = daily.withColumn("i", F.row_number().over(w.orderBy("day")) - 1).select("i", *values)
    n = s.agg(F.count(F.lit(1)).alias("n")).filter("n > 0")
    blocks = draws_of(n, draws).withColumn("b", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / block).cast("int") - 1)))
    start = F.conv(F.substring(hash_order(seed, F.col("draw").cast("string"), F.col("b").cast("string")), 1, 8), 16, 10).cast("bigint") % F.col("n")
    at = blocks.withColumn("start", start).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(block - 1))))
    at = at.filter(F.col("b") * block + F.col("o") < F.col("n")).withColumn("i", (F.col("start") + F.col("o")) % F.col("n"))
    return at.join(s, "i").select("draw", *values)


def block_bootstrap(daily: DataFrame, value: str, draws: int, block: int, seed: str) -> DataFrame:
    """(draw, mean): means of circular blocks of the centred series."""
    centred = daily.select("day", (F.col(value) - F.avg(value).over(Window.partitionBy(F.lit(0)))).alias("x"))
    return block_draws(centred, ["x"], draws, block, seed).groupBy("draw").agg(F.avg("x").alias("mean"))
