"""Operator 11, URL filters [native]: rules first, boosted trees on lexical features for the rest."""

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelia.llm.common import stored, table

#: (verdict, host, path): a rule holds for its host and all subdomains where the path begins so.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: Labelled URLs that the trees are fitted on, those with the least hashes.
SAMPLE = 20_000
#: Suffixes are counted in so many buckets of each kind, whatever their number.
BUCKETS = 4096
TREES, DEPTH, SEED = 20, 4, 1
#: Kinds of suffix: the last label of the host, its last two labels, the path's first directory
#: and its file ending.
KINDS = ["top", "domain", "directory", "ending"]
LEXICAL = [
    "chars", "host_chars", "path_chars", "labels", "depth", "digit_ratio", "host_digit_ratio", "hyphens", "entropy", "host_entropy", "parameters",
    "query_chars", "has_fragment",
]
FEATURES = [*LEXICAL, *(f"{k}_{x}" for k in KINDS for x in ("seen", "blocked"))]


def lower_ascii(x: Column) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; without it, or null: empty."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_first(rules) -> list[tuple[str, str, str]]:
    return sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """host + path of the longest rule that fits, else null."""
    found = F.lit(None).cast("string")
    for _, rule_host, rule_path in reversed(longest_first(rules)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.when(fits, F.lit(rule_host + rule_path)).otherwise(found)
    return found


def rule_verdict(rule: Column, rules=RULES) -> Column:
    found = F.lit(None).cast("string")
    for verdict, rule_host, rule_path in rules:
        found = F.when(rule == rule_host + rule_path, F.lit(verdict)).otherwise(found)
    return found


def with_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, url, host, path, rule, ruled (the rule's verdict)."""
    return (
        pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"))
        .withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
        .withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
        .withColumn("ruled", rule_verdict(F.col("rule"), rules))
    )


def share(part: Column, whole: Column) -> Column:
    return F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0))


def digits(x: Column) -> Column:
    return F.length(F.regexp_replace(x, "[^0-9]", ""))


def entropy(x: Column) -> Column:
    """Bits a character, from the counts of the distinct ones."""
    n = F.length(x).cast("double")
    bits = F.transform(
        F.array_distinct(F.split(x, "")), lambda c: F.when(c != "", (n - F.length(F.replace(x, c, F.lit("")))) / n).otherwise(F.lit(1.0))
    )
    return F.when(n > 0, -F.aggregate(bits, F.lit(0.0), lambda s, p: s + p * F.log2(p))).otherwise(F.lit(0.0))


def suffixes() -> dict[str, Column]:
    """The suffix of each kind, empty where a URL has none."""
    host, path = F.col("host"), F.col("path")
    return {
        "top": F.regexp_extract(host, r"([^.]*)$", 1),
        "domain": F.regexp_extract(host, r"([^.]*\.[^.]*)$", 1),
        "directory": F.regexp_extract(path, "^/([^/]*)/", 1),
        "ending": F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1),
    }


def with_lexical(ruled: DataFrame) -> DataFrame:
    """Length, depth, digit ratio, entropy, parameter counts and the bucket of each suffix."""
    url, host, path = F.col("url"), F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    chars = F.length(url)
    numbers = {
        "chars": chars,
        "host_chars": F.length(host),
        "path_chars": F.length(path),
        "labels": F.when(host == "", 0).otherwise(F.size(F.split(host, r"\."))),
        "depth": F.size(F.filter(F.split(path, "/"), lambda x: x != "")),
        "digit_ratio": share(digits(url), chars),
        "host_digit_ratio": share(digits(host), F.length(host)),
        "hyphens": F.length(F.regexp_replace(host, "[^-]", "")),
        "entropy": entropy(url),
        "host_entropy": entropy(host),
        "parameters": F.size(F.filter(F.split(query, "&"), lambda x: x != "")),
        "query_chars": F.length(query),
        "has_fragment": F.contains(url, F.lit("#")).cast("int"),
    }
    buckets = {f"{k}_bucket": F.pmod(F.xxhash64(x), F.lit(BUCKETS)).cast("int") for k, x in suffixes().items()}
    return ruled.withColumns({k: v.cast("double") for k, v in numbers.items()} | buckets)


@dataclass
class UrlModel:
    """``statistics`` has at most BUCKETS rows of each kind; ``trees`` is None where the labels
    hold one class or none, whose verdict is then ``constant``."""

    statistics: DataFrame
    trees: GBTClassificationModel | None
    constant: float


def suffix_statistics(lexical: DataFrame) -> DataFrame:
    """(kind, bucket, seen, blocked) over all rows: logarithm of the rows, smoothed share of
    blocked ones among those with a rule. Summed before the shuffle; bounded by the buckets."""
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"{k}_bucket").alias("bucket")) for k in KINDS)))
    blocked = (F.col("ruled") == "block").cast("double")  # null without a rule
    return (
        lexical.select("ruled", kinds.alias("s"))
        .groupBy("s.kind", "s.bucket")
        .agg(
            F.log1p(F.count(F.lit(1))).alias("seen"),
            ((F.coalesce(F.sum(blocked), F.lit(0.0)) + 1) / (F.count(blocked) + 2)).alias("blocked"),
        )
    )


def with_features(lexical: DataFrame, statistics: DataFrame) -> DataFrame:
    """Adds the statistics of the row's suffixes; tables of at most BUCKETS rows are broadcast."""
    for kind in KINDS:
        facts = statistics.filter(F.col("kind") == kind).select(
            F.col("bucket").alias(f"{kind}_bucket"), F.col("seen").alias(f"{kind}_seen"), F.col("blocked").alias(f"{kind}_blocked")
        )
        lexical = lexical.join(F.broadcast(facts), f"{kind}_bucket", "left")
    return lexical.fillna(0.0, [f"{k}_seen" for k in KINDS]).fillna(0.5, [f"{k}_blocked" for k in KINDS])


def assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=FEATURES, outputCol="features")


def fit(pages: DataFrame, rules=RULES, sample: int = SAMPLE) -> UrlModel:
    """Trees fitted on URLs that a rule labels: all of them, or ``sample`` of them by hash.

    Suffix statistics cover all rows. The first filter by hash keeps few rows more than needed,
    so the order by hash never sees all labelled rows.
    """
    lexical = with_lexical(with_rules(pages, rules))
    statistics = stored(suffix_statistics(lexical), "url-suffixes")
    labelled = lexical.filter(F.col("ruled").isNotNull())
    total = labelled.count()
    order = F.xxhash64(F.lit(SEED), "page_id", "url")
    if total > sample:
        # 1.5 times the sample and some more: far beyond the spread of a hash filter
        keep = min(1.0, (1.5 * sample + 1000) / total)
        labelled = labelled.filter(F.pmod(order, F.lit(1 << 30)) < int(keep * (1 << 30)))
    chosen = labelled.orderBy(order, "page_id", "url").limit(sample)
    rows = with_features(chosen, statistics).select((F.col("ruled") == "block").cast("double").alias("label"), *FEATURES)
    rows = stored(rows.coalesce(4), "url-sample")
    classes = [r.label for r in rows.select("label").distinct().collect()]
    if len(classes) < 2:
        return UrlModel(statistics, None, classes[0] if classes else 0.0)
    # no pages of the host-only kind in memory: 20,000 rows of 21 numbers
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=32, stepSize=0.3, seed=SEED).fit(assembler().transform(rows))
    return UrlModel(statistics, trees, 0.0)


def block_scores(pages: DataFrame, model: UrlModel, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, ruled, block_score (0 to 1) of every row."""
    columns = ["page_id", "host", "path", "rule", "ruled"]
    ruled = with_rules(pages, rules)
    if model.trees is None:
        return ruled.select(*columns, F.lit(model.constant).alias("block_score"))
    scored = model.trees.transform(assembler().transform(with_features(with_lexical(ruled), model.statistics)))
    return scored.select(*columns, vector_to_array("probability")[1].alias("block_score"))


def url_verdicts(pages: DataFrame, model: UrlModel, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, block_score for every row of ``pages``.

    The verdict is the longest fitting rule's, else ``block`` from a score of 0.5 on. A null url
    counts as empty: no host, no path, no rule, judged by the trees like any other. Repeated rows
    give repeated results; an empty table gives an empty one (without labels every verdict is
    ``allow``); other columns are not read.
    """
    method = F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")
    return block_scores(pages, model, rules).select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "block_score"
    )


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_verdicts(pages, fit(pages))
