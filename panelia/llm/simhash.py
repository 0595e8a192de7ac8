"""Operator 10, SimHash near-dedup by anchor-point covering."""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelia.llm.common import join_groups, stored, table, text_digest, text_or_empty
from panelia.llm.components import connected_components

BITS = 64
#: Fingerprints that one task compares at an anchor; larger anchors are split into pairs of parts.
PART = 20_000


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    """64-bit SimHash: A-Z lowered, words between ASCII white space, ``words``-word shingles with
    repeats, XXH64 each; a bit is set if more than half of the hashes have it. No words: zero."""
    parts = text.lower().split()  # bytes: touches ASCII letters and white space only
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    hash_of = xxhash.xxh64_intdigest
    hashes = [hash_of(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist())]
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 15):
        block = np.array(hashes[k : k + (1 << 15)], np.uint64)
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 4, digest: bool = False) -> DataFrame:
    """(doc_id, fp long): the fingerprint of every whole text, null as empty; with its SHA-256 if
    ``digest``."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(v.as_py(), words) for v in batch.column(1)], np.uint64).view(np.int64)
            kept = [batch.column(2)] if digest else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64()), *kept], names=["doc_id", "fp", "digest"][: 2 + len(kept)])

    columns = ["doc_id", text_or_empty().cast("binary").alias("text")] + [text_digest().alias("digest")] * digest
    return docs.select(*columns).mapInArrow(run, "doc_id long, fp long" + ", digest binary" * digest)


# --- the covering code -------------------------------------------------------------------------
#
# Two fingerprints at distance <= 4 differ in at most 2 bits over some two of three segments of
# 21, 21 and 22 bits (leave out the segment with most differences). Over such a pair of segments
# (42 or 43 bits) the anchors are the words of a code: a perfect Hamming code on the first 31
# bits (covering radius 1) times all words on the rest (radius 0), so 2^26 * 2^11 anchors or
# more. If x and y differ in at most 2 of these bits, a word z lies at most 1 bit from both, and
# the anchor nearest to z is within 1 + 1 of both. So every fingerprint is replicated to the
# anchors within covering radius + 1 and every link meets at an anchor, with about 27 replicas a
# pair of segments: the threshold is halved by sending both sides out, not one.

SEGMENTS = ((0, 21), (21, 21), (42, 22))
_POSITIONS = np.arange(1, 32, dtype=np.uint64)


def _syndromes(word: np.ndarray) -> np.ndarray:
    """Of 31-bit words in the Hamming code whose parity checks are the positions 1 to 31."""
    s = np.zeros(len(word), np.uint64)
    for k, p in enumerate(_POSITIONS):
        s ^= ((word >> np.uint64(k)) & np.uint64(1)) * p
    return s


def _nearest(word: np.ndarray) -> np.ndarray:
    """The code word within one bit: a nonzero syndrome names the bit to flip."""
    s = _syndromes(word)
    flip = np.where(s > 0, np.uint64(1) << (np.maximum(s, 1).astype(np.uint64) - np.uint64(1)), np.uint64(0))
    return word ^ flip


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor): anchors within covering radius + 1 of each fingerprint, pair by pair."""
    rows, found = [], []
    one = np.uint64(1)
    low31 = (one << np.uint64(31)) - one
    for number, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        (a, m), (b, n) = SEGMENTS[i], SEGMENTS[j]
        word = (fp >> np.uint64(a)) & ((one << np.uint64(m)) - one)
        word |= ((fp >> np.uint64(b)) & ((one << np.uint64(n)) - one)) << np.uint64(m)
        code, rest = word & low31, word >> np.uint64(31)
        tag = np.uint64(number) << np.uint64(60)
        near = [_nearest(code)]
        for k in range(31):
            near.append(_nearest(code ^ (one << np.uint64(k))))
        near = np.sort(np.stack(near, axis=1), axis=1)
        fresh = np.ones(near.shape, bool)
        fresh[:, 1:] = near[:, 1:] != near[:, :-1]  # two flips reach the same anchor
        r, c = np.nonzero(fresh)
        rows.append(r)
        found.append(tag | (rest[r] << np.uint64(31)) | near[r, c])
        home = _nearest(code)
        for k in range(m + n - 31):
            rows.append(np.arange(len(fp)))
            found.append(tag | ((rest ^ (one << np.uint64(k))) << np.uint64(31)) | home)
    return np.concatenate(rows), np.concatenate(found)


def replicas(nodes: DataFrame) -> DataFrame:
    """(anchor, fp, node): every fingerprint at every anchor within reach."""

    def run(batches):
        for batch in batches:
            whole = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            node = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for k in range(0, len(whole), 2048):
                fp = whole[k : k + 2048]
                row, anchor = anchors(fp.view(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(fp[row]), pa.array(node[k : k + 2048][row])],
                    names=["anchor", "fp", "node"],
                )

    return nodes.select("fp", "node").mapInArrow(run, "anchor long, fp long, node long")


def tree_of(fp: np.ndarray, node: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among these fingerprints, not all links.

    Each fingerprint that is reached scans only those not reached yet, so a dense group of n
    costs about n steps and n - 1 edges.
    """
    left = np.arange(len(fp))
    edges = []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(fp[left] ^ fp[at]) <= most
            if near.any():
                got = left[near]
                left = left[~near]
                queue.extend(got.tolist())
                edges.extend((int(node[g]), int(node[at])) for g in got)
    return edges


def anchor_links(nodes: DataFrame, most: int = 4, part: int = PART) -> DataFrame:
    """(src, dst): a spanning forest of the links at each anchor; together they join every link.

    Anchors are counted in a bounded number of counters first. Where a counter passes ``part``,
    its anchors are split into parts by fingerprint and every pair of parts is compared apart,
    so that no task holds more than about two parts, whatever the size of the anchor.
    """
    if not 0 <= most <= 4:
        raise ValueError("the segments prove links of up to 4 bits")
    spread = replicas(nodes)
    count = max(1 << 12, 8 * 81 * nodes.count() // part)
    counter = F.pmod(F.xxhash64("anchor"), F.lit(count))
    full = stored(
        spread.groupBy(counter.alias("counter"))
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > part)
        .select("counter", F.ceil(F.col("n") / part).cast("int").alias("parts")),
        "full-anchors",
    )
    if full.isEmpty():
        keyed = spread.withColumn("pair", F.lit(0))
    else:
        # broadcast only if Spark's own threshold holds for the stored size
        marked = spread.withColumn("counter", counter).join(full, "counter", "left")
        own = F.pmod(F.xxhash64(F.col("fp"), F.lit(7)), F.col("parts")).cast("int")
        pairs = F.transform(
            F.sequence(F.lit(0), F.col("parts") - 1),
            lambda k: F.least(own, k) * F.col("parts") + F.greatest(own, k),
        )
        keyed = marked.withColumn("pair", F.explode(F.coalesce(pairs, F.array(F.lit(0)))))
    dealt = keyed.select("anchor", "pair", "fp", "node").repartition("anchor", "pair")
    sorted_rows = dealt.sortWithinPartitions("anchor", "pair")

    def run(batches):
        held: list[np.ndarray] = []  # the rows of the anchor at the end of the last batch
        for batch in batches:
            columns = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)])
            rows = np.concatenate([*held, columns], axis=1) if held else columns
            if rows.shape[1] == 0:
                continue
            change = np.nonzero((rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1]))[0] + 1
            bounds = [0, *change.tolist()]
            yield links_of(rows, bounds[:-1], bounds[1:])
            held = [rows[:, bounds[-1] :]]
        if held:
            yield links_of(held[0], [0], [held[0].shape[1]])

    def links_of(rows, begins, ends):
        edges = []
        begins, ends = np.array(begins), np.array(ends)
        for k in np.nonzero(ends - begins > 1)[0]:
            a, b = begins[k], ends[k]
            edges += tree_of(rows[2, a:b].view(np.uint64), rows[3, a:b], most)
        src, dst = zip(*edges) if edges else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    return sorted_rows.mapInArrow(run, "src long, dst long").distinct()


def near_dedup(docs: DataFrame, most: int = 4, words: int = 4) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Texts link if their fingerprints differ in at most ``most`` (up to 4) bits; component_id is
    the smallest doc_id that links lead to. Equal fingerprints are one node, so copies cost one
    row. Null and empty texts have fingerprint zero and link like any other; rows with a null
    doc_id keep a fingerprint and join the component of it. Repeated rows give repeated results;
    an empty table gives an empty one; other columns are ignored.
    """
    rows = stored(fingerprints(docs, words), "fingerprints")
    return join_groups(rows, named_fingerprints(rows, most), "fp", "copies").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def named_fingerprints(rows: DataFrame, most: int = 4) -> DataFrame:
    """(fp, copies, least, component_id, stays): for each fingerprint of ``rows`` (doc_id, fp) its
    smallest doc_id and that of its component; ``stays`` holds for one fingerprint of a component,
    which has this doc_id.

    The fingerprints are the nodes of the graph: a doc_id may be null or stand on several texts.
    """
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")), "nodes")
    links = stored(anchor_links(nodes.withColumn("node", F.col("fp")), most), "links")
    linked = connected_components(links)
    members = stored(
        nodes.join(linked, nodes.fp == linked.id, "left").select("fp", "copies", "least", F.coalesce("component", "fp").alias("component")),
        "members",
    )
    first = F.min(F.struct(F.col("least").isNull(), F.col("least"), F.col("fp"))).alias("first")
    components = stored(
        members.groupBy("component").agg(first, F.count(F.lit(1)).alias("size")).select("component", "size", F.col("first.least").alias("component_id"), F.col("first.fp").alias("stays_fp")),
        "components",
    )
    return stored(
        join_groups(members, components, "component", "size").select("fp", "copies", "least", "component_id", (F.col("fp") == F.col("stays_fp")).alias("stays")),
        "named-fingerprints",
    )


def near_kept(docs: DataFrame, most: int = 4, words: int = 4) -> DataFrame:
    """(doc_id, digest) of one row of each component of near copies, that of the smallest doc_id:
    null only if the component has no other, with the least digest if it stands on several texts
    of one fingerprint."""
    rows = stored(fingerprints(docs, words, digest=True), "fingerprints")
    chosen = named_fingerprints(rows, most).filter("stays").select("fp", "least", "copies")
    # at most one row a component: doc_id is the least of its fingerprint
    return (
        join_groups(rows, stored(chosen, "staying"), "fp", "copies")
        .filter(F.col("doc_id").eqNullSafe(F.col("least")))
        .groupBy("fp")
        .agg(F.first("least").alias("doc_id"), F.min("digest").alias("digest"))
        .select("doc_id", "digest")
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))
