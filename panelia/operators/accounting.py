"""Period accounting of weighted panels and performance records."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelia.functions import series as S


def panel_with_cash(bars: DataFrame, cash: DataFrame, skeleton) -> DataFrame:
    """Tradeable returns and cash flows on the full calendar (E1): a period without volume has no
    return; inside a symbol's settlement span a missing cash flow is 0, outside it null."""
    span = cash.groupBy("symbol").agg(F.min("day").alias("_a"), F.max("day").alias("_b"))
    full = skeleton(bars).join(cash.select("symbol", "day", "rate"), ["symbol", "day"], "left").join(span, "symbol", "left")
    w = Window.partitionBy("symbol").orderBy("day")
    live = F.col("volume") > 0
    price = F.when(live, F.col("close"))
    inside = F.col("day").between(F.col("_a"), F.col("_b"))
    return full.withColumns(
        {"ret": S.safe_ratio(price, F.lag(price).over(w)) - 1, "cash": F.when(inside, F.coalesce("rate", F.lit(0.0))), "live": F.coalesce(live, F.lit(False))}
    ).drop("_a", "_b")


def account(panel: DataFrame, cost: float, by: list[str] = ()) -> DataFrame:
    """Daily price, cash, turnover, cost, net and gross of each book (E3). Weights where there is
    no return count as 0; one pass: a lag over the symbol, then sums of the day."""
    w = Window.partitionBy(*by, "symbol").orderBy("day")
    weight = F.when(F.col("ret").isNotNull(), F.col("weight")).otherwise(0.0)
    p = panel.withColumn("w", weight).withColumn("moved", F.abs(F.col("w") - F.coalesce(F.lag("w").over(w), F.lit(0.0))))
    daily = p.groupBy(*by, "day").agg(
        F.sum(F.col("w") * F.coalesce("ret", F.lit(0.0))).alias("price"),
        (-F.sum(F.col("w") * F.coalesce("cash", F.lit(0.0)))).alias("funding"),
        F.sum("moved").alias("turnover"),
        F.sum(F.abs("w")).alias("gross"),
    )
    return daily.withColumn("cost", F.col("turnover") * cost).withColumn("net", F.col("price") + F.col("funding") - F.col("cost"))


def trimmed(daily: DataFrame, by: list[str] = ()) -> DataFrame:
    """Days from the first position on. The daily series is small; its window is a book's."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    start = F.min(F.when(F.col("gross") > 0, F.col("day"))).over(w)
    return daily.withColumn("_a", start).filter(F.col("day") >= F.col("_a")).drop("_a")


def performance(daily: DataFrame, periods: float, by: list[str] = ()) -> DataFrame:
    """One record for each book: return, volatility, Sharpe, drawdown, total, shares."""
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("day")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    d = daily.withColumn("equity", F.product(1 + F.col("net")).over(run)).withColumn("peak", F.max("equity").over(run))
    d = d.withColumn("_n", F.row_number().over(w)).withColumn("_all", F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    half = F.col("_n") * 2 <= F.col("_all") + 1
    sharpe = lambda x: F.avg(x) / F.nullif(F.stddev_samp(x), F.lit(0.0)) * periods**0.5
    r = F.round
    return d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_periods"),
        r(F.avg("net") * periods * 100, 6).alias("annual_return"),
        r(F.stddev_samp("net") * periods**0.5 * 100, 6).alias("annual_vol"),
        r(sharpe(F.col("net")), 6).alias("sharpe"),
        r(sharpe(F.when(half, F.col("net"))), 6).alias("sharpe_first"),
        r(sharpe(F.when(~half, F.col("net"))), 6).alias("sharpe_second"),
        r(F.min(F.col("equity") / F.col("peak") - 1) * 100, 6).alias("max_drawdown"),
        r((F.max_by("equity", "day") - 1) * 100, 6).alias("total"),
        r(F.sum("funding") * 100, 6).alias("funding_total"),
        r(F.avg("turnover"), 6).alias("turnover"),
        r(F.min("net") * 100, 6).alias("worst"),
    )


def legs(panel: DataFrame, cost: float) -> DataFrame:
    """Price, cash and cost of each side; the exit day counts for the side that held."""
    w = Window.partitionBy("symbol").orderBy("day")
    weight = F.when(F.col("ret").isNotNull(), F.col("weight")).otherwise(0.0)
    p = panel.withColumn("w", weight).withColumn("_before", F.coalesce(F.lag("w").over(w), F.lit(0.0)))
    side = F.when(F.col("w") != 0, F.signum("w")).otherwise(F.signum("_before"))
    return p.withColumn("side", side).filter("side <> 0").groupBy("side").agg(
        F.sum(F.col("w") * F.coalesce("ret", F.lit(0.0))).alias("price"),
        (-F.sum(F.col("w") * F.coalesce("cash", F.lit(0.0)))).alias("funding"),
        (F.sum(F.abs(F.col("w") - F.col("_before"))) * cost).alias("cost"),
    )


def with_liquidation(daily: DataFrame) -> DataFrame:
    """The last day also pays for closing its gross."""
    last = F.max("day").over(Window.partitionBy(F.lit(0)))
    rate = F.max(F.when(F.col("turnover") > 0, F.col("cost") / F.col("turnover"))).over(Window.partitionBy(F.lit(0)))
    final = F.when(F.col("day") == last, F.col("gross")).otherwise(0.0)
    d = daily.withColumns({"turnover": F.col("turnover") + final, "cost": F.col("cost") + final * F.coalesce(rate, F.lit(0.0))})
    return d.withColumn("net", F.col("price") + F.col("funding") - F.col("cost"))


def split_booking(panel: DataFrame, cost: float) -> DataFrame:
    """A third of the day's cash flow goes to the old weights, the rest to the new."""
    w = Window.partitionBy("symbol").orderBy("day")
    p = panel.withColumn("_old", F.coalesce(F.lag("weight").over(w), F.lit(0.0)))
    flow = F.coalesce("cash", F.lit(0.0))
    daily = p.groupBy("day").agg(
        F.sum(F.col("_old") * F.coalesce("ret", F.lit(0.0))).alias("price"),
        (-F.sum(flow * (F.col("_old") / 3 + F.col("weight") * 2 / 3))).alias("funding"),
        (F.sum(F.abs(F.col("weight") - F.col("_old"))) * cost).alias("cost"),
    )
    daily = daily.withColumn("pnl", F.col("price") + F.col("funding") - F.col("cost"))
    run = Window.partitionBy(F.lit(0)).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return daily.withColumn("equity", F.product(1 + F.col("pnl")).over(run))


def account_legs(panel: DataFrame, by: list[str] = ()) -> DataFrame:
    """Daily price, cash, turnover of each leg and gross of a book with two legs.

    ``panel`` holds weight_a, weight_b (positive is long), ret_a, ret_b, cash_a, cash_b on a full
    calendar. Both legs need a return, or neither counts; a long leg pays its cash flow, a short
    one receives it."""
    w = Window.partitionBy(*by, "symbol").orderBy("day")
    both = F.col("ret_a").isNotNull() & F.col("ret_b").isNotNull()
    p = panel.withColumns({f"w_{x}": F.when(both, F.col(f"weight_{x}")).otherwise(0.0) for x in "ab"})
    p = p.withColumns({f"moved_{x}": F.abs(F.col(f"w_{x}") - F.coalesce(F.lag(f"w_{x}").over(w), F.lit(0.0))) for x in "ab"})
    flow = lambda c: sum(F.col(f"w_{x}") * F.coalesce(f"{c}_{x}", F.lit(0.0)) for x in "ab")
    return p.groupBy(*by, "day").agg(
        F.sum(flow("ret")).alias("price"), (-F.sum(flow("cash"))).alias("funding"), F.sum("moved_a").alias("turnover_a"), F.sum("moved_b").alias("turnover_b"),
        F.sum(F.abs("w_a") + F.abs("w_b")).alias("gross"),
    )


def leg_record(daily: DataFrame, periods: float, capital: float, by: list[str]) -> DataFrame:
    """The record of a book of legs from its first position on: ``daily`` has price, funding, cost, net,
    turnover, gross. Return on capital divides by the capital that a unit of notional ties up."""
    d = trimmed(daily, by)
    order = Window.partitionBy(*by).orderBy("day")
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = d.withColumn("_e", F.product(1 + F.col("net")).over(run)).withColumn("_d", F.col("_e") / F.max("_e").over(run) - 1)
    d = d.withColumns({"_first": F.row_number().over(order) <= F.floor(F.count(F.lit(1)).over(every) / 2)})
    sharpe = lambda x: F.round(F.avg(x) / F.nullif(F.stddev_samp(x), F.lit(0.0)) * periods**0.5, 6)
    year = lambda c: F.round(F.avg(c) * periods * 100, 6)
    return d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_periods"), sharpe(F.col("net")).alias("sharpe"), sharpe(F.when(F.col("_first"), F.col("net"))).alias("sharpe_first"),
        sharpe(F.when(~F.col("_first"), F.col("net"))).alias("sharpe_second"), year("net").alias("annual_notional"), F.round(F.avg("net") * periods * 100 / capital, 6).alias("annual_capital"),
        F.round(F.stddev_samp("net") * periods**0.5 * 100, 6).alias("annual_vol"), F.round(F.min("_d") * 100, 6).alias("max_drawdown"), year("funding").alias("annual_funding"),
        year("price").alias("annual_price"), year("cost").alias("annual_cost"), F.round(F.avg("turnover"), 6).alias("turnover"), F.round(F.avg("gross"), 6).alias("invested"),
    )
