"""Scorecards: named conditions with three states, terminal failures, a verdict and its earliest date."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PASS, FAIL, WAIT = "PASS", "FAIL", "NOT-YET"


def condition(name: str, state: Column, measured: Column, terminal: Column | None = None, due: Column | None = None) -> Column:
    """One line of a scorecard. ``terminal`` says that waiting cannot undo a failure; ``due`` is the
    first date on which the state can change by itself."""
    return F.struct(
        F.lit(name).alias("condition"), state.alias("state"), F.round(measured.cast("double"), 6).alias("measured"),
        (F.coalesce(terminal, F.lit(False)) if terminal is not None else F.lit(False)).alias("terminal"), (due if due is not None else F.lit(None)).cast("date").alias("due"),
    )


def judged(value: Column, good: Column, days: Column, least: int, extended: int, last: Column) -> tuple[Column, Column, Column]:
    """(state, terminal, due) of a measure that counts from ``least`` days on: a miss then extends the
    record to ``extended`` days, and a miss there is terminal. A missing value is a miss."""
    ok = F.coalesce(good, F.lit(False))
    state = F.when(days < least, WAIT).when(ok, PASS).otherwise(FAIL)
    terminal = (days >= extended) & ~ok
    due = F.when((days >= least) & (days < extended) & ~ok, F.date_add(last, (F.lit(extended) - days + 1).cast("int")))
    return state, terminal, due


def scorecard(facts: DataFrame, conditions: list[Column], today: Column) -> DataFrame:
    """A row for each condition over the one row of ``facts``, with the verdict (N18): NO-GO with a
    terminal failure, GO if all pass, else NOT-YET, and the earliest date on which that can change:
    the latest due date, but not before today; none if all pass."""
    rows = facts.select(today.cast("date").alias("_today"), F.explode(F.array(*conditions)).alias("c")).select("_today", "c.*")
    every = Window.partitionBy(F.lit(0))  # one row a condition
    dead = F.max((F.col("state") == FAIL) & F.col("terminal")).over(every)
    done = F.min(F.col("state") == PASS).over(every)
    verdict = F.when(dead, "NO-GO").when(done, "GO").otherwise("NOT-YET")
    latest = F.max("due").over(every)
    earliest = F.when(latest.isNotNull(), F.greatest(latest, F.col("_today"))).when(verdict != "GO", F.col("_today"))
    return rows.withColumns({"verdict": verdict, "earliest": earliest}).drop("_today")


def longest_run(rows: DataFrame, time: str, flag: str) -> DataFrame:
    """(longest, current): the longest run of rows with the flag and the one that ends with the last row."""
    w = Window.partitionBy(F.lit(0)).orderBy(time)  # one row a week
    place = rows.select(F.col(flag).alias("_f"), F.row_number().over(w).alias("_n"), F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))).alias("_all"))
    since = place.withColumn("_at", F.coalesce(F.max(F.when(~F.col("_f"), F.col("_n"))).over(Window.partitionBy(F.lit(0)).orderBy("_n")), F.lit(0)))
    run = F.col("_n") - F.col("_at")
    return since.agg(F.coalesce(F.max(run), F.lit(0)).alias("longest"), F.coalesce(F.max(F.when(F.col("_n") == F.col("_all"), run)), F.lit(0)).alias("current"))


def nominee(cells: DataFrame, checks: dict[str, Column], order: list[Column]) -> DataFrame:
    """``cells`` with the map of named checks, how many hold, and the nominee (N17): the first in
    ``order`` of those for which all hold. A check that cannot be told does not hold."""
    named = {k: F.coalesce(v, F.lit(False)) for k, v in checks.items()}
    x = cells.withColumn("checks", F.create_map(*[y for k, v in named.items() for y in (F.lit(k), v)]))
    x = x.withColumn("n_passed", sum(v.cast("int") for v in named.values()))
    place = F.row_number().over(Window.partitionBy(F.col("n_passed") == len(named)).orderBy(*order))
    return x.withColumn("nominee", (F.col("n_passed") == len(named)) & (place == 1))
