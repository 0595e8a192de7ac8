"""Model routes on pyspark.ml: ridge, boosted trees, logistic regression, walk-forward."""

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelia.functions import series as S


def ridge(train: DataFrame, features: list[str], target: str, weight: str, alpha: float):
    """Weighted ridge on features scaled by their population deviation (M2). The trainer scales its
    penalty by the weighted deviation of the target, so alpha / n is multiplied by it.

    Returns (means, deviations, fitted model)."""
    stats = train.agg(
        F.count(F.lit(1)).alias("n"), F.sum(weight).alias("w"), F.sum(F.col(weight) * F.col(target)).alias("wy"), F.sum(F.col(weight) * F.col(target) ** 2).alias("wyy"),
        *[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features],
    ).first()
    scale = {f: (stats[f"m_{f}"], stats[f"s_{f}"] or 1.0) for f in features}
    deviation = max(0.0, stats.wyy / stats.w - (stats.wy / stats.w) ** 2) ** 0.5
    data = assembled(scaled(train, scale), features)
    lr = LinearRegression(featuresCol="x", labelCol=target, weightCol=weight, regParam=alpha / stats.n * deviation, elasticNetParam=0.0, standardization=False, solver="normal")
    return scale, lr.fit(data)


def ridge_scores(parts: DataFrame, by: str, features: list[list[str]], target: str, weight: str, alphas: list[float]) -> list[tuple]:
    """(fold, number of features, alpha, correlation of prediction and target on test rows) of the
    fits that ``ridge`` gives, for each list of features and each alpha (M2, M5).

    ``parts`` holds the rows with ``by``, the fold, and ``part``, train or test. Fits and correlations
    follow from weighted and plain moments of a fold's parts, so one pass gives all of them, and two
    rows of numbers a fold are collected.
    """
    every = list(dict.fromkeys(f for fs in features for f in fs))
    full = parts.dropna(subset=[*every, target, weight])
    pairs = [(a, b) for a in [*every, target] for b in [*every, target]]
    w, columns = F.col(weight), [*every, target]
    rows = full.groupBy(by, "part").agg(
        F.count(F.lit(1)).alias("n"), F.sum(w).alias("w"), F.array(*[F.sum(w * F.col(c)) for c in columns]).alias("wx"),
        F.array(*[F.sum(w * F.col(a) * F.col(b)) for a, b in pairs]).alias("wxx"), F.array(*[F.covar_pop(a, b) for a, b in pairs]).alias("cov"),
    ).collect()
    square = lambda x: np.array(x, float).reshape(len(columns), len(columns))
    sides = {(r[by], r.part): r for r in rows}
    scores = []
    for fold in sorted({r[by] for r in rows}):
        train, test = sides.get((fold, "train")), sides.get((fold, "test"))
        for fs in features:
            at = [every.index(f) for f in fs]
            for alpha in alphas:
                score = None
                if train and test:
                    mean = np.array(train.wx, float) / train.w
                    weighted = train.n * (square(train.wxx) / train.w - np.outer(mean, mean))
                    scale = np.sqrt(np.diag(square(train.cov)))[at]
                    scale[scale == 0] = 1.0
                    gram = weighted[np.ix_(at, at)] / np.outer(scale, scale) + alpha * np.eye(len(at))
                    slopes = np.linalg.solve(gram, weighted[at, -1] / scale) / scale
                    cov = square(test.cov)
                    spread = slopes @ cov[np.ix_(at, at)] @ slopes * cov[-1, -1]
                    score = float(slopes @ cov[at, -1] / spread**0.5) if spread > 0 else None
                scores.append((fold, len(fs), alpha, score))
    return scores


def scaled(df: DataFrame, scale: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({f: (F.col(f) - m) / s for f, (m, s) in scale.items()})


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="x", handleInvalid="skip").transform(df)


def boosted(train: DataFrame, test: DataFrame, features: list[str], label: str, weight: str, trees: int = 10) -> DataFrame:
    """Test rows with the probability of a boosted-tree classifier (M3); the learner differs from
    histogram boosters elsewhere, so only its properties are comparable."""
    gbt = GBTClassifier(featuresCol="x", labelCol=label, weightCol=weight, maxIter=trees, maxDepth=3, seed=7)
    fitted = gbt.fit(assembled(train, features))
    return fitted.transform(assembled(test, features)).withColumn("p", vector_to_array("probability")[1])


def logistic(train: DataFrame, numeric: list[str], categorical: list[str], label: str, rare: int = 2, c: float = 0.03):
    """Median and mode impute, scale, rare categories to one, one-hot, logistic fit (M7). ``c`` is
    the inverse strength of the penalty against the summed loss, as 1 / (c n) against its mean.

    Returns a function from rows to rows with the probability p. The categories of a column, which
    the one-hot vectors list too, are collected."""
    keep, mode = {}, {}
    for name in categorical:
        counts = train.filter(F.col(name).isNotNull()).groupBy(F.col(name).cast("string").alias("v")).count()
        keep[name] = [r.v for r in counts.filter(F.col("count") >= rare).orderBy(F.desc("count"), "v").collect()]
        mode[name] = keep[name][0] if keep[name] else "other"

    def tidy(df: DataFrame) -> DataFrame:
        text = {name: F.coalesce(F.col(name).cast("string"), F.lit(mode[name])) for name in categorical}
        return df.withColumns({n: F.when(t.isin(keep[n]), t).otherwise("other") for n, t in text.items()})

    stages = [
        Imputer(inputCols=numeric, outputCols=[f"i_{c}" for c in numeric], strategy="median"),
        *[StringIndexer(inputCol=x, outputCol=f"n_{x}", handleInvalid="keep") for x in categorical],
        OneHotEncoder(inputCols=[f"n_{c}" for c in categorical], outputCols=[f"o_{c}" for c in categorical], handleInvalid="keep"),
        VectorAssembler(inputCols=[f"i_{c}" for c in numeric], outputCol="v"),
        StandardScaler(inputCol="v", outputCol="z", withMean=True),
        VectorAssembler(inputCols=["z", *[f"o_{c}" for c in categorical]], outputCol="x"),
        LogisticRegression(featuresCol="x", labelCol=label, regParam=1 / (c * max(1, train.count())), maxIter=50, standardization=False),
    ]
    fitted = Pipeline(stages=stages).fit(tidy(train))
    return lambda df: fitted.transform(tidy(df)).withColumn("p", vector_to_array("probability")[1])


def probability_metrics(df: DataFrame, p: str, y: str, *by: str) -> DataFrame:
    """AUC by average ranks, Brier, the Brier score of the base rate, log loss, prevalence (M8).

    Ranks come from the counts of equal probabilities, which combine before their shuffle, and
    from prefix sums over ranges of probabilities, so no task orders all of a group."""
    counts = df.groupBy(*by, p).agg(F.sum(y).alias("ones"), F.count(F.lit(1)).alias("n"))
    c = S.sum_below(counts, F.col("n") - F.col("ones"), p, "below", *by)
    n1, n0 = F.sum("ones"), F.sum(F.col("n") - F.col("ones"))
    q = F.least(F.greatest(F.col(p), F.lit(1e-6)), F.lit(1 - 1e-6))
    zeros = F.col("n") - F.col("ones")
    share = F.sum("ones") / F.sum("n")
    return c.groupBy(*by).agg(
        F.sum("n").alias("n"), (F.sum(F.col("ones") * (F.col("below") + zeros / 2)) / F.nullif(n1 * n0, F.lit(0))).alias("auc"),
        (F.sum(F.col("ones") * F.pow(1 - F.col(p), 2) + zeros * F.pow(F.col(p), 2)) / F.sum("n")).alias("brier"),
        (share * (1 - share)).alias("base_brier"), (-F.sum(F.col("ones") * F.log(q) + zeros * F.log(1 - q)) / F.sum("n")).alias("log_loss"), share.alias("prevalence"),
    )


def best_threshold(df: DataFrame, p: str, value: Column, grid: list[float], least: int) -> DataFrame:
    """(threshold, n, total) with the greatest total among thresholds with enough rows (M4)."""
    tagged = df.withColumn("threshold", F.explode(F.filter(F.array(*map(F.lit, grid)), lambda t: F.col(p) >= t)))
    g = tagged.groupBy("threshold").agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).filter(F.col("n") >= least)
    return g.orderBy(F.desc("total"), "threshold").limit(1)


def centred_rank(x: Column, *by: str) -> Column:
    return S.average_rank(x, *by) - 0.5
