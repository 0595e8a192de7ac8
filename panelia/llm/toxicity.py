"""Operator 1, toxicity by weak supervision: voters, a generative label model, a linear classifier."""

import heapq
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelia.llm.common import slices, stored, table, text_or_empty

# The hand-written lexicon voters, one for each word.
LEXICON = "idiot moron stupid scum trash clown loser pathetic worthless disgusting".split()
# The hand-written pattern voters; each is tried where a text has one of its words.
PATTERNS = [
    (frozenset(LEXICON), re.compile(r"\b(?:you|they|he|she) (?:are|is) (?:an? |such an? )?(?:idiot|moron|clown|loser|trash|scum)")),
    (frozenset(("hate", "kill", "destroy")), re.compile(r"\b(?:hate|kill|destroy) (?:you|them|him|her|all)\b")),
    (frozenset(("shut", "hell", "drop")), re.compile(r"\bshut up\b|\bgo to hell\b|\bdrop dead\b")),
]
#: Words and word beginnings whose log odds of toxic are above this may be mined as voters.
TELLING = 3.0
#: The classifier is fitted on at most so many labelled rows (those of least hash) ...
SAMPLE = 20_000
#: ... and at most so many others, whose labels are the label model's alone.
UNLABELLED = 10_000
#: Words and word beginnings that the classifier may weigh.
FEATURES = 1_500
#: Where EM starts for the annotators, who are voters too: how many of the rows that they call
#: toxic, or clean, are toxic.
ANNOTATORS = (0.9, 0.05)
EM_ROUNDS = 8
THRESHOLD = 0.3

WORD = re.compile(r"[^\W\d_]+")
#: Letters that the beginnings of words have.
BEGINNINGS = (4, 5, 6)
#: Words that a task remembers the beginnings of; beyond it the memory starts anew.
REMEMBERED = 300_000


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def patterns_in(low: str, words: set[str]) -> list[str]:
    """The patterns that a text matches; the last holds for two different words of the lexicon."""
    found = [f"/{k}" for k, (guard, p) in enumerate(PATTERNS) if not guard.isdisjoint(words) and p.search(low)]
    return found + [f"/{len(PATTERNS)}"] if len(words.intersection(LEXICON)) > 1 else found


def tokens(text: str) -> set[str]:
    """The words of a text in lower case, the beginnings of longer words (bome*), those of two
    different words or more (bome*2), and the patterns that it matches (/0 and so on)."""
    low = text.lower()
    words = set(WORD.findall(low))
    begun = Counter([w[:k] for w in words for k in BEGINNINGS if len(w) > k])
    out = words | {b + "*" for b in begun} | {b + "*2" for b, n in begun.items() if n > 1}
    return out.union(patterns_in(low, words))


class Reader:
    """Finds the wanted ones among the tokens of a text without making the others."""

    def __init__(self, wanted):
        self.wanted = frozenset(wanted)
        self.beginnings = {t.rstrip("2").rstrip("*") for t in self.wanted if "*" in t}
        self.known: dict[str, list[str]] = {}

    def found(self, text: str) -> set[str]:
        low = text.lower()
        words = set(WORD.findall(low))
        known, begun = self.known, []
        for w in words:
            at = known.get(w)
            if at is None:
                at = [w[:k] for k in BEGINNINGS if len(w) > k and w[:k] in self.beginnings]
                if len(known) >= REMEMBERED:
                    known.clear()
                known[w] = at
            if at:
                begun += at
        out = words & self.wanted
        for b, n in Counter(begun).items():
            out.update(self.wanted & ({b + "*", b + "*2"} if n > 1 else {b + "*"}))
        return out.union(self.wanted.intersection(patterns_in(low, words)))


def token_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, label, tokens) of sampled rows."""

    def run(batches):
        for batch in slices(batches):
            found = [sorted(tokens(t.as_py())) for t in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "label", "tokens"])

    return docs.select("doc_id", "label", text_or_empty().alias("text")).mapInArrow(run, "doc_id long, label int, tokens array<string>")


def labelled_rows(labels: DataFrame, bound: int) -> DataFrame:
    """(doc_id, label) of up to ``bound`` labelled rows outside the held-out quarter."""
    return (
        labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("label"))
        .filter(~held_out(F.col("doc_id")))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(bound)
    )


def training_rows(docs: DataFrame, chosen: DataFrame, bound: int) -> DataFrame:
    """(doc_id, label, tokens) of the labelled ids and of up to ``bound`` others outside the
    held-out quarter, whose label is null. Both lists of ids are bounded, so they are broadcast."""
    others = (
        docs.select("doc_id")
        .filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_anti")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(bound)
    )
    ids = chosen.unionByName(others.distinct().withColumn("label", F.lit(None).cast("int")))
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    # one text of an id, so that ids given many times leave the sample within its bounds
    rows = rows.groupBy("doc_id").agg(F.first("label").alias("label"), F.min(text_or_empty()).alias("text"))
    return stored(token_sets(rows), "toxicity-sample")


def token_statistics(sample: DataFrame) -> DataFrame:
    """(token, with_1, with_0, score): log odds of the class given the token, smoothed."""
    n = sample.agg(F.sum("label").alias("n1"), F.sum(1 - F.col("label")).alias("n0")).first()
    n1, n0 = (n.n1 or 0), (n.n0 or 0)
    counts = (
        sample.select("label", F.explode("tokens").alias("token"))
        .groupBy("token")
        .agg(F.sum("label").alias("with_1"), F.sum(1 - F.col("label")).alias("with_0"))
        .filter(F.col("with_1") + F.col("with_0") >= 3)
    )
    odds = F.log((F.col("with_1") + 0.5) / (n1 + 1.0)) - F.log((F.col("with_0") + 0.5) / (n0 + 1.0))
    # chi-square-like strength: how much the token moves the odds times how often it does
    weight = F.sqrt(F.greatest(F.col("with_1") / F.lit(n1 + 1.0), F.col("with_0") / F.lit(n0 + 1.0)))
    return counts.withColumn("score", odds).withColumn("strength", F.abs(odds) * weight)


class Voters:
    """Voters by number. Hand-written and mined tokens vote for toxic where they stand; a text in
    which none of them stands, and one in which a single one does, have a voter each, which may
    learn to vote for clean; so have the annotators, for either word of theirs."""

    def __init__(self, mined: list[str]):
        names = [*LEXICON, *(f"/{k}" for k in range(len(PATTERNS) + 1)), *mined]
        self.number = {token: k for k, token in enumerate(dict.fromkeys(names))}
        self.silence, self.lone, self.says_toxic, self.says_clean = range(len(self.number), len(self.number) + 4)
        self.count = len(self.number) + 4
        self.reader = None

    def among(self, found: set[str]) -> list[int]:
        return sorted([self.number[token] for token in found & self.number.keys()])

    def votes(self, found: set[str], label: int | None = None) -> tuple[int, ...]:
        by_text = self.among(found)
        if len(by_text) < 2:
            by_text.append(self.lone if by_text else self.silence)
        return tuple(by_text) if label is None else (*by_text, self.says_toxic if label else self.says_clean)

    def read(self, text: str, label: int | None = None) -> tuple[int, ...]:
        if self.reader is None:
            self.reader = Reader(self.number)
        return self.votes(self.reader.found(text), label)


def covering(rows: list[list[int]]) -> list[int]:
    """Numbers that together stand in every row that has any: each time the one that stands in
    most rows not reached yet, the least of equals."""
    held: dict[int, list[int]] = {}
    for r, row in enumerate(rows):
        for token in row:
            held.setdefault(token, []).append(r)
    reached, chosen = [False] * len(rows), []
    heap = [(-len(at), token) for token, at in held.items()]
    heapq.heapify(heap)
    while heap:
        gain, token = heapq.heappop(heap)
        new = [r for r in held[token] if not reached[r]]
        if len(new) == -gain:
            chosen.append(token)
            for r in new:
                reached[r] = True
        elif new:
            heapq.heappush(heap, (-len(new), token))
    return chosen


def mined_voters(sample: DataFrame, statistics: DataFrame) -> list[str]:
    """Telling words and word beginnings, so many that no labelled toxic row that has any is left
    without a vote. Ranked by all rows together, the marks of a rarer language would get none."""
    # beginnings of lexicon words would only repeat their votes
    known = F.lit(False)
    for word in LEXICON:
        known = known | F.lit(word).startswith(F.rtrim(F.col("token"), F.lit("*2")))
    telling = [r.token for r in statistics.filter((F.col("score") > TELLING) & ~known & ~F.col("token").startswith("/")).orderBy(F.desc("strength"), "token").select("token").collect()]
    rank = {token: k for k, token in enumerate(telling)}
    written = Voters([])

    def run(batches):
        for batch in slices(batches):
            sets = [set(words) for words in batch.column(0).to_pylist()]
            found = [[rank[t] for t in words & rank.keys()] for words in sets if not written.among(words)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32()))], names=["found"])

    rows = sample.filter("label = 1").select("tokens").mapInArrow(run, "found array<int>").collect()
    return [telling[k] for k in covering([r.found for r in rows])]


def vote_masks(docs: DataFrame, chosen: DataFrame, voters: Voters) -> DataFrame:
    """(votes, n): how often each set of voters votes over all documents; annotators vote on the
    labelled rows that were chosen."""

    def run(batches):
        for batch in batches:
            counts = Counter(
                voters.read(text.as_py(), label) for text, label in zip(batch.column(0), batch.column(1).to_pylist())
            )
            columns = [pa.array(list(counts), pa.list_(pa.int32())), pa.array(list(counts.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["votes", "n"])

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left").select(text_or_empty().alias("text"), "label")
    return stored(rows.mapInArrow(run, "votes array<int>, n long").groupBy("votes").agg(F.sum("n").alias("n")), "votes")


def logit(p):
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


class LabelModel:
    """A generative model of two classes and of voters whose accuracy, the share of toxic texts
    among those that they vote on, is estimated by EM from all documents.

    A vote moves the log odds by what its accuracy says beyond the prior; an abstention says
    nothing, so that voters of one language do not speak against texts of another. Voters that
    fire together beyond what the class explains share their weight: each is divided by one plus
    its summed correlations with the others among toxic texts, which every round estimates anew.
    """

    def __init__(self, prior: float, accuracy: np.ndarray, share: np.ndarray | None = None):
        self.prior, self.accuracy = prior, accuracy
        self.share = np.ones(len(accuracy)) if share is None else share

    def weights(self) -> np.ndarray:
        return (logit(self.accuracy) - logit(self.prior)) * self.share

    def posterior_column(self) -> Column:
        weights = F.array(*[F.lit(float(w)) for w in self.weights()])
        z = F.aggregate("votes", F.lit(float(logit(self.prior))), lambda sum_, k: sum_ + F.get(weights, k))
        return 1 / (1 + F.exp(-z))

    def posterior(self, votes: tuple[int, ...]) -> float:
        return float(1 / (1 + np.exp(-logit(self.prior) - self.weights()[list(votes)].sum())))

    def updated(self, n: float, toxic: float, fired: dict[int, float], pairs: dict[tuple[int, int], float]) -> "LabelModel":
        """The next round's model from expected counts over all documents: how many there are, how
        many are toxic, how often each voter fires, and how often each pair of voters (and each
        voter with itself) fires on toxic ones."""
        count = len(self.accuracy)
        prior = min(max(toxic / n if n else self.prior, 1e-3), 0.5)
        got = np.array([pairs.get((k, k), 0.0) for k in range(count)])
        accuracy = (got + 2 * prior) / (np.array([fired.get(k, 0.0) for k in range(count)]) + 2)
        share = got / (toxic + 1e-9)
        summed = np.zeros(count)
        for (i, k), both in pairs.items():
            spread = math.sqrt(max(0.0, share[i] * (1 - share[i]) * share[k] * (1 - share[k])))
            if i < k and spread > 1e-9:
                c = min(1.0, max(0.0, (both / (toxic + 1e-9) - share[i] * share[k]) / spread))
                summed[[i, k]] += c
        return LabelModel(prior, accuracy, 1 / (1 + summed))

    def refined(self, masks: DataFrame) -> "LabelModel":
        """One EM round: one job over the vote sets, whose result has at most voters x voters rows."""
        weighed = masks.select("n", (F.col("n") * self.posterior_column()).alias("w"), F.concat("votes", F.array(F.lit(-1))).alias("on"))
        rows = (
            weighed.select("n", "w", F.explode("on").alias("i"), "on")
            .select("n", "w", "i", F.explode("on").alias("k"))
            .filter("i <= k")
            .groupBy("i", "k")
            .agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
            .collect()
        )
        sums = {(r.i, r.k): (float(r.n), float(r.w)) for r in rows}
        n, toxic = sums.get((-1, -1), (0.0, 0.0))  # -1 stands in every set
        own = {k: v for k, v in sums.items() if k[0] >= 0}
        return self.updated(n, toxic, {i: v[0] for (i, k), v in own.items() if i == k}, {k: v[1] for k, v in own.items()})


def first_model(masks: DataFrame, voters: Voters) -> LabelModel:
    """Where EM starts: what the annotators say of the rows on which each voter fires. Voters that
    fire on none of those are trusted by half."""
    says = F.when(F.array_contains("votes", voters.says_toxic), 1).when(F.array_contains("votes", voters.says_clean), 0)
    said = masks.select("n", says.alias("y"), F.explode(F.concat("votes", F.array(F.lit(-1)))).alias("k")).filter("y IS NOT NULL")
    found = {r.k: (r.y, r.n) for r in said.groupBy("k").agg(F.sum(F.col("n") * F.col("y")).alias("y"), F.sum("n").alias("n")).collect()}
    accuracy = np.array([(found.get(k, (0, 0))[0] + 1) / (found.get(k, (0, 0))[1] + 2) for k in range(voters.count)])
    accuracy[[voters.says_toxic, voters.says_clean]] = ANNOTATORS
    toxic, n = found.get(-1, (0, 0))
    prior = min(max(toxic / n if n else 0.05, 1e-3), 0.5)
    if not n:  # nobody has said what silence means: it is taken for clean, not for half
        accuracy[voters.silence] = prior / 2
    return LabelModel(prior, accuracy)


class Classifier:
    """Logistic regression over token features; what a task needs to score a text."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.reader = None

    def score(self, text: str) -> float:
        if self.reader is None:
            self.reader = Reader(self.weights)
        # sorted: the sum must not depend on the order of a set
        z = self.bias + sum([self.weights[t] for t in sorted(self.reader.found(text))])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit(docs: DataFrame, labels: DataFrame, sample_bound: int = SAMPLE, unlabelled: int = UNLABELLED) -> Classifier:
    """Voters from the labelled sample, the label model from all documents, the classifier from
    the posterior labels of a sample, labelled or not. Without labelled rows of both classes the
    hand-written voters are all there are, and their tokens the features. Without any row to learn
    from, the words of the lexicon count alike. Collected to the driver: FEATURES tokens, the
    telling tokens of the sample and their places in its toxic rows, and sums for each pair of
    voters."""
    chosen = stored(labelled_rows(labels, sample_bound), "labelled")
    rows = training_rows(docs, chosen, unlabelled)
    sample = rows.filter("label IS NOT NULL")
    totals = sample.agg(F.sum("label").alias("n1"), F.count(F.lit(1)).alias("n")).first()
    n1, n = totals.n1 or 0, totals.n or 0
    if rows.isEmpty():
        return Classifier({w: 3.0 for w in LEXICON}, -2.0)
    if n1 == 0 or n1 == n:
        voters = Voters([])
        features = list(voters.number)
    else:
        statistics = stored(token_statistics(sample), "token-statistics")
        strongest = statistics.orderBy(F.desc("strength"), "token")
        voters = Voters(mined_voters(sample, statistics))
        # a few labelled rows may have no token that is frequent enough
        features = [r.token for r in strongest.limit(FEATURES).collect()] or list(voters.number)
    masks = vote_masks(docs, chosen, voters)
    model = first_model(masks, voters)
    for _ in range(EM_ROUNDS):
        model = model.refined(masks)
    return Classifier(*train(rows, features, voters, model))


def train(rows: DataFrame, features: list[str], voters: Voters, model: LabelModel) -> tuple[dict[str, float], float]:
    """Logistic regression on posterior labels with pyspark.ml; a soft label is two weighted rows."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizerModel

    def run(batches):
        for batch in slices(batches):
            labels, found = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ps = [model.posterior(voters.votes(set(words), label)) for label, words in zip(labels, found)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(ps, pa.float64())], names=["tokens", "p"])

    soft = rows.select("label", "tokens").mapInArrow(run, "tokens array<string>, p double")
    vectors = CountVectorizerModel.from_vocabulary(features, "tokens", "features", binary=True).transform(soft)
    sides = F.array(
        F.struct(F.lit(1.0).alias("label"), F.col("p").alias("w")),
        F.struct(F.lit(0.0).alias("label"), (1 - F.col("p")).alias("w")),
    )
    data = vectors.select("features", F.explode(sides).alias("y")).select("features", "y.label", "y.w").filter("w > 1e-4")
    learner = LogisticRegression(weightCol="w", regParam=0.0001, maxIter=60, standardization=False)
    fitted = learner.fit(stored(data, "soft-labels"))
    return {t: float(w) for t, w in zip(features, fitted.coefficients.toArray()) if w}, float(fitted.intercept)


def toxicity_scores(docs: DataFrame, classifier: Classifier, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted for every row of ``docs``; one pass, no shuffle.

    Null and empty texts get the score of a text without tokens. Repeated rows give repeated
    results; an empty table gives an empty one; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def run(batches):
        model = shared.value
        for batch in batches:
            scores = [model.score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    scored = docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity_scores(docs, fit(docs, labels))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


def without_toxic(docs: DataFrame, classifier: Classifier, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are not called toxic, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)
    at = docs.columns.index("text")

    def run(batches):
        model = shared.value
        for batch in batches:
            keep = [model.score(t.as_py() or "") < threshold for t in batch.column(at)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
