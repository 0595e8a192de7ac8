"""Queries of model operators (survey M). Fits are rows-only; their metrics have SQL twins."""

import functools

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelia.operators import models as M
from panelia.plans.labels import touched
from panelia.plans.registry import query
from panelia.functions import series as S
from panelia.sources import stand_ins as T
from panelia.sources.storage import stored

FEATURES = ["mom", "vol", "rel"]


def ledger(spark, d):
    """Features known at the close and the first-touch outcome after it."""
    w = S.over()
    f = T.bars_day(spark, d).select("symbol", "day", S.pct_change(F.col("close"), 3, w).alias("mom"), F.avg("volume").over(w.rowsBetween(-4, 0)).alias("vol"))
    f = f.withColumn("rel", F.col("mom") - F.avg("mom").over(Window.partitionBy("day")))
    y = touched(spark, d).select("symbol", "day", "long_ret", "long_end")
    names = F.count(F.lit(1)).over(Window.partitionBy("day"))
    x = f.join(y, ["symbol", "day"]).filter("mom IS NOT NULL")
    return x.withColumns({"target": M.centred_rank(F.col("long_ret"), "day"), "w": 1 / names, "up": (F.col("long_ret") > 0).cast("double")})


def split(x, cut="2024-01-17"):
    """Train rows whose outcome was known before the test starts."""
    c = F.lit(cut).cast("date")
    return x.filter(F.col("long_end") < c), x.filter(F.col("day") >= c)


@query("m1_rank_target", T.with_sql("decision", """
, x AS (SELECT day, symbol, round(sum(pnl), 8) AS y FROM decision WHERE pnl IS NOT NULL GROUP BY day, symbol)
SELECT day::VARCHAR AS day, symbol, round((rank() OVER (PARTITION BY day ORDER BY y) + (count(*) OVER (PARTITION BY day,
    y) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY day) - 0.5, 8) AS target FROM x"""))
def rank_target(spark, d):
    x = T.decisions(spark, d).filter("pnl IS NOT NULL").groupBy("day", "symbol").agg(F.round(F.sum("pnl"), 8).alias("y"))
    return x.select(S.day_text(), "symbol", F.round(M.centred_rank(F.col("y"), "day"), 8).alias("target"))


#: Purged walk-forward: each fold tests the days from its cut to the next one.
CUTS = ["2024-01-13", "2024-01-18", "2024-01-23", "2024-01-28"]


def fold_rows():
    """Conditions (train, test) of each fold; train rows' outcomes were known before the test starts."""
    for a, b in zip(CUTS, CUTS[1:]):
        start, end = (F.lit(c).cast("date") for c in (a, b))
        yield F.col("long_end") < start, (F.col("day") >= start) & (F.col("day") < end)


def folds(x):
    """(train, test) of each fold."""
    for train, test in fold_rows():
        yield x.filter(train), x.filter(test)


@query("m2_m5_ridge")
def ridge(spark, d):
    """M2, M5: weighted ridge for two feature sets and three penalties; the best by the median over
    purged folds of the rank correlation, ties to fewer features and then to the greater penalty."""
    tags = [F.struct(F.lit(k).alias("fold"), F.lit(p).alias("part"), rows.alias("own")) for k, both in enumerate(fold_rows()) for p, rows in zip(("train", "test"), both)]
    parts = ledger(spark, d).withColumn("_t", F.explode(F.filter(F.array(*tags), lambda t: t["own"]))).select("*", "_t.fold", "_t.part")
    scores = M.ridge_scores(parts, "fold", [FEATURES[:1], FEATURES], "target", "w", [1e2, 1e3, 1e4])
    scores = [(*fit, score if score is None else round(score, 6)) for *fit, score in scores]
    table = spark.createDataFrame(scores, "fold int, n_features int, alpha double, score double")  # one row a fit
    out = table.groupBy("n_features", "alpha").agg(F.count(F.lit(1)).alias("n_folds"), F.median("score").alias("score"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "n_features", F.desc("alpha"))
    return out.withColumn("chosen", F.row_number().over(order) == 1)


@query("m3_boosted_walk_forward")
def boosted(spark, d):
    """M3: in each purged fold, fit on the first three quarters of train, choose the threshold on its
    last quarter, trade the test days; one row a fold and one of all pooled. The ledger is stored, so
    a pass of a fit reads rows instead of making the bars and labels again."""
    x = stored(ledger(spark, d), "model-rows")
    taken = []
    for k, (train, test) in enumerate(folds(x)):
        edge = train.agg(F.percentile_approx(F.unix_date("day"), 0.75).alias("edge"))
        t = train.join(F.broadcast(edge)).withColumn("early", F.unix_date("day") < F.col("edge")).drop("edge")
        fit, valid = t.filter("early").drop("early"), t.filter("NOT early").drop("early")
        scored = M.boosted(fit, valid.withColumn("part", F.lit("valid")).unionByName(test.withColumn("part", F.lit("test"))), FEATURES, "up", "w")
        limit = M.best_threshold(scored.filter("part = 'valid'"), "p", F.col("long_ret"), [0.5, 0.55, 0.6, 0.65, 0.7], 10).select("threshold")
        rows = scored.filter("part = 'test'").join(F.broadcast(limit), how="left").select(F.lit(str(k)).alias("fold"), "p", "threshold", "long_ret")
        taken.append(rows)
    every = functools.reduce(lambda a, b: a.unionByName(b), taken)
    every = every.withColumn("fold", F.explode(F.array("fold", F.lit("pooled"))))
    own = F.when(F.col("p") >= F.col("threshold"), F.col("long_ret"))
    return every.groupBy("fold").agg(F.count(F.lit(1)).alias("n_test"), F.count(own).alias("n_taken"), F.round(F.avg(own), 6).alias("mean_ret"))


@query("m4_threshold", T.with_sql("decision", """
, g AS (SELECT t AS threshold, count(*) AS n, round(sum(pnl * (1 + proba)), 8) AS total FROM decision, (VALUES (0.5::DOUBLE), (0.6::DOUBLE), (0.7::DOUBLE),
    (0.8::DOUBLE), (0.9::DOUBLE)) v(t) WHERE proba >= t AND pnl IS NOT NULL GROUP BY t HAVING count(*) >= 10)
SELECT threshold, n, total FROM g ORDER BY total DESC, threshold LIMIT 1"""))
def threshold(spark, d):
    x = T.decisions(spark, d).filter("pnl IS NOT NULL")
    return M.best_threshold(x, "proba", F.col("pnl") * (1 + F.col("proba")), [0.5, 0.6, 0.7, 0.8, 0.9], 10).withColumn("total", F.round("total", 8))


@query("m7_logistic")
def logistic(spark, d):
    """M7: the logistic pipeline on mixed features, with its test metrics."""
    x = T.decisions(spark, d).filter("pnl IS NOT NULL").withColumns({"y": (F.col("pnl") > 0).cast("double"), "size": F.when(F.col("k") % 9 != 0, F.col("k").cast("double"))})
    score = M.logistic(x.filter("day < DATE '2024-01-20'"), ["proba", "size"], ["event_type", "regime"], "y")
    return M.probability_metrics(score(x.filter("day >= DATE '2024-01-20'")), "p", "y", "side")


@query("m8_metrics", T.with_sql("decision", """
, x AS (SELECT side, proba AS p, (pnl > 0)::INT AS y, least(greatest(proba, 1e-6), 1 - 1e-6) AS q FROM decision WHERE pnl IS NOT NULL)
, r AS (SELECT *, rank() OVER (PARTITION BY side ORDER BY p) + (count(*) OVER (PARTITION BY side, p) - 1) / 2.0::DOUBLE AS k FROM x)
SELECT side, count(*) AS n, round((sum(k * y) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / nullif(sum(y) * sum(1 - y), 0), 8) AS auc, round(avg((p - y) ^ 2),
    8) AS brier, round(avg(y) * (1 - avg(y)), 8) AS base_brier,
 round(-avg(y * ln(q) + (1 - y) * ln(1 - q)), 8) AS log_loss, round(avg(y), 8) AS prevalence FROM r GROUP BY side"""))
def metrics(spark, d):
    x = T.decisions(spark, d).filter("pnl IS NOT NULL").withColumn("y", (F.col("pnl") > 0).cast("int"))
    m = M.probability_metrics(x, "proba", "y", "side")
    return m.select("side", "n", *[F.round(c, 8).alias(c) for c in ("auc", "brier", "base_brier", "log_loss", "prevalence")])


@query("m9_m10_ablation")
def ablation(spark, d):
    """Two feature sets on the same rows, and a cost grid with infeasible cells tagged."""
    train, test = split(stored(ledger(spark, d), "model-rows"))
    parts = []
    for name, features in (("base", FEATURES[:2]), ("all", FEATURES)):
        s = M.boosted(train, test, features, "up", "w", trees=5)
        s = s.withColumn("cost", F.explode(F.array(F.lit(0.0), F.lit(0.01), F.lit(0.7))))
        taken = F.when(F.col("p") >= 0.5, F.col("long_ret") - F.col("cost"))
        row = s.groupBy("cost").agg(F.count(taken).alias("n"), F.round(F.avg(taken), 6).alias("mean_net"))
        parts.append(row.select(F.lit(name).alias("features"), "cost", (F.col("cost") < 0.6).alias("feasible"), "n", "mean_net"))
    return parts[0].unionByName(parts[1])
