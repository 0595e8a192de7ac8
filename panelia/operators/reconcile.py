"""Reconciling two tables: field differences, key coverage, tracking of one ledger by another."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def field_differences(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, left, right, state): fields of two tables that differ or that one lacks.
    Values are compared as text after decimals are normalised."""

    def tall(df: DataFrame, name: str) -> DataFrame:
        plain = {f: F.regexp_replace(F.regexp_replace(F.col(f).cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "") for f in fields}
        return df.select(key, *[plain[f].alias(f) for f in fields]).unpivot(key, fields, "field", name)

    j = tall(a, "left").join(tall(b, "right"), [key, "field"], "full")
    state = F.when(F.col("left").isNull() & F.col("right").isNull(), "same").when(F.col("left").isNull(), "only right").when(F.col("right").isNull(),
        "only left").when(F.col("left") != F.col("right"), "differs").otherwise("same")
    return j.withColumn("state", state).filter("state <> 'same'")


def coverage_gaps(expected: DataFrame, reported: DataFrame, key: str) -> DataFrame:
    """(key, problem): keys missing, unexpected or reported more than once (J13); empty if equal."""
    counts = reported.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    j = expected.select(key, F.lit(True).alias("wanted")).distinct().join(counts, key, "full")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("wanted").isNull(), "unexpected").when(F.col("n") > 1, "repeated")
    return j.withColumn("problem", problem).filter("problem IS NOT NULL").select(key, "problem")


def exact_flows(weights: DataFrame, flows: DataFrame, expected: int) -> DataFrame:
    """(day, correction, n_flows, complete, in_prefix): cash flows at the start of a day go to the
    weights held before it, later ones to the new weights (E13). Days with fewer than ``expected``
    settlements are incomplete; the prefix ends at the first of them."""
    w = Window.partitionBy("symbol").orderBy("day")
    held = weights.withColumn("old", F.coalesce(F.lag("weight").over(w), F.lit(0.0)))
    early = F.hour("ts") < 8
    j = flows.join(held, ["symbol", "day"])
    d = j.groupBy("day").agg(
        (-F.sum(F.col("rate") * F.when(early, F.col("old")).otherwise(F.col("weight")))).alias("correction"), F.count(F.lit(1)).alias("n_flows"))
    d = d.withColumn("complete", F.col("n_flows") >= expected)
    run = Window.partitionBy(F.lit(0)).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)  # one row a day
    return d.withColumn("in_prefix", F.every("complete").over(run))


def tracking(paper: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(day, gap, clean, divergence): paper against actual results; intervals count only where
    both have one, and the running divergence sums over those (E14)."""
    j = paper.join(actual, key, "full").withColumn("clean", F.col("paper").isNotNull() & F.col("actual").isNotNull())
    j = j.withColumn("gap", F.when(F.col("clean"), F.col("actual") - F.col("paper")))
    run = Window.partitionBy(F.lit(0)).orderBy(key).rowsBetween(Window.unboundedPreceding, 0)  # one row a period
    return j.withColumn("divergence", F.coalesce(F.sum("gap").over(run), F.lit(0.0)))
