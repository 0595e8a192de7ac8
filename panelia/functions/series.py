"""Scalar and window expressions for keyed series; each takes and gives a Column."""

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def over(key: str = "symbol", time: str = "day") -> WindowSpec:
    return Window.partitionBy(key).orderBy(time)


def day_text() -> Column:
    return F.col("day").cast("string").alias("day")


def safe_ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def ieee_ratio(a: Column, b: Column) -> Column:
    """a / b as floating-point numbers divide: infinite by zero, NaN for 0 / 0."""
    return F.when(b != 0, a / F.nullif(b, F.lit(0.0))).otherwise(F.when(b.isNotNull(), a * F.lit(float("inf"))))


def ieee_log(x: Column) -> Column:
    """ln(x), minus infinity at zero and NaN below."""
    return F.when(x > 0, F.log(x)).when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan")))


def ieee_round(x: Column, digits: int) -> Column:
    """x to so many digits by its binary value, as x * 10^digits shows it. Spark's round goes by the
    shortest decimal text of x instead, so the two differ where that ends in a 5."""
    return F.round(x * 10.0**digits) / 10.0**digits


def finite(x: Column) -> Column:
    return F.when(F.abs(x) != float("inf"), x)


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def pct_change(x: Column, k: int, w: WindowSpec) -> Column:
    """x / x[-k] - 1 without padding; a zero before gives null."""
    return safe_ratio(x, F.lag(x, k).over(w)) - 1


def rolling(x: Column, n: int, least: int, w: WindowSpec, fn=F.avg) -> Column:
    """``fn`` over the last n rows, null unless ``least`` of them are non-null."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(frame) >= least, fn(x).over(frame))


def zscore(x: Column, n: int, least: int, w: WindowSpec) -> Column:
    return safe_ratio(x - rolling(x, n, least, w), rolling(x, n, least, w, F.stddev_samp))


def rsi(close: Column, n: int, w: WindowSpec) -> Column:
    """Simple-mean form; no losses give null."""
    move = close - F.lag(close).over(w)
    gain, loss = F.when(move.isNotNull(), F.greatest(move, F.lit(0.0))), F.when(move.isNotNull(), F.greatest(-move, F.lit(0.0)))
    frame = w.rowsBetween(-(n - 1), 0)
    full = F.count(move).over(frame) >= n
    return F.when(full, 100 - 100 / (1 + safe_ratio(F.avg(gain).over(frame), F.avg(loss).over(frame))))


def carry_forward(flag: Column, x: Column, w: WindowSpec) -> Column:
    """x at the last row where the flag held."""
    return F.last(F.when(flag, x), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def average_rank(x: Column, *by: str) -> Column:
    """Average-tie percentile rank among the non-null values of a group. Null rows rank null and
    do not count: they are put in a partition of their own."""
    null = x.isNull()
    w = Window.partitionBy(*by, null)
    rank = F.rank().over(w.orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, null, x)) - 1) / 2
    return F.when(~null, rank / F.count(F.lit(1)).over(w))


def profit_factor(x: Column) -> Column:
    """Gains over losses; null without losses."""
    return F.sum(F.when(x > 0, x)) / F.nullif(-F.sum(F.when(x < 0, x)), F.lit(0.0))


def sum_below(df: DataFrame, value: Column, order: str, name: str, *by: str, ranges: int = 64) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of its group that come before in ``order``,
    whose values are distinct. Each group is cut into ranges by approximate quantiles: running sums
    within a range are added to those of the ranges before, so no task orders a whole group."""
    marks = [k / ranges for k in range(1, ranges)]
    bounds = df.groupBy(*by).agg(F.percentile_approx(order, marks).alias("_bounds"))
    rows = (df.join(bounds, list(by)) if by else df.join(F.broadcast(bounds))).withColumn(
        "_range", F.size(F.filter("_bounds", lambda b: b < F.col(order)))
    ).withColumn("_value", value)
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = Window.unboundedPreceding, -1
    sums = rows.groupBy(*by, "_range").agg(F.sum("_value").alias("_total"))
    sums = sums.withColumn("_before", F.coalesce(F.sum("_total").over(group.orderBy("_range").rowsBetween(*before)), F.lit(0)))
    inside = F.coalesce(F.sum("_value").over(Window.partitionBy(*by, "_range").orderBy(order).rowsBetween(*before)), F.lit(0))
    out = rows.withColumn("_inside", inside).join(sums.select(*by, "_range", "_before"), [*by, "_range"])
    return out.withColumn(name, F.col("_inside") + F.col("_before")).select(*df.columns, name)
