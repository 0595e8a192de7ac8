"""Operator 7, substring dedup: content-defined chunks cut by a gear rolling hash."""

import bisect
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelia.llm.common import stored, table, text_or_empty

#: A place ends a chunk if its gear hash is greater than at the REACH places on both sides, so
#: chunks have more than REACH bytes and about twice that. REACH is a power of two. Chunks of more
#: than LONG bytes, as in stretches that repeat a few bytes, are cut at places that are not less
#: than those around, which keep step with the period; MOST bounds what is left.
REACH = 16
LONG = 64
MOST = 256
#: The 16-bit gear hash forgets a byte after 16 places.
FORGETS = 16
#: Words that a repeated passage must have.
PASSAGE_WORDS = 50
#: Whole chunks inside such a passage keep at least this many words of it: its ends lose FORGETS +
#: REACH bytes and the chunks that stick out. Where all words have two letters, about one passage
#: of 51 words in a hundred keeps fewer.
RUN_WORDS = 10
#: Words from which a run counts that repeats itself, such as a line of one word.
REPEATING_WORDS = 30
BLOCK = 1 << 20

GEAR = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 16, 256, dtype=np.uint16)


def gear(raw: np.ndarray) -> np.ndarray:
    """Gear hash h = (h << 1) + GEAR[byte] mod 2^16 at every place, by doubling the window."""
    h = GEAR[raw]
    for k in (1, 2, 4, 8):
        shifted = np.zeros_like(h)
        shifted[k:] = h[:-k] << np.uint16(k)
        h = h + shifted
    return h


def cuts(raw: np.ndarray) -> np.ndarray:
    """Ends of the chunks of a text, its own end last. Blocks with margins bound the memory."""
    tops, ties = [], []
    for start in range(0, len(raw), BLOCK):
        low, high = max(0, start - FORGETS - REACH), min(len(raw), start + BLOCK + REACH)
        h = np.pad(gear(raw[low:high]).astype(np.int32), REACH, constant_values=-1)
        n = high - low
        # the greatest of REACH values by doubling: those before a place and those after it
        window, size = h, 1
        while size * 2 <= REACH:
            window = np.maximum(window[: len(window) - size], window[size:])
            size *= 2
        own, before, after = h[REACH : REACH + n], window[:n], window[REACH + 1 : REACH + 1 + n]
        for found, flag in ((tops, (own > before) & (own > after)), (ties, (own >= before) & (own >= after))):
            place = np.nonzero(flag)[0] + low
            found.append(place[(place >= start) & (place < start + BLOCK)] + 1)
    ends, weak = (np.concatenate(x) if x else np.array([], np.int64) for x in (tops, ties))
    if not len(ends) or ends[-1] != len(raw):
        ends = np.append(ends, len(raw))
    starts = np.concatenate(([0], ends[:-1]))
    if (ends - starts).max(initial=0) <= LONG:
        return ends
    parts, last = [], 0
    for k in np.nonzero(ends - starts > LONG)[0]:
        parts.append(ends[last:k])
        parts.append(np.array(inner_cuts(int(starts[k]), int(ends[k]), weak), np.int64))
        last = k
    return np.concatenate([*parts, ends[last:]])


def inner_cuts(start: int, end: int, weak: np.ndarray) -> list[int]:
    """Cuts inside a long chunk: ties more than REACH bytes apart, else every MOST bytes."""
    out, at = [], start
    for place in weak[np.searchsorted(weak, start, "right") : np.searchsorted(weak, end, "left")].tolist():
        if place - at > REACH or not out:
            out += range(at + MOST, place, MOST)
            out.append(place)
            at = place
    return out + list(range(at + MOST, end, MOST))


def word_starts(raw: np.ndarray) -> np.ndarray:
    """Whether a word, a run of bytes other than ASCII white space, begins at each place."""
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    return ~space & np.concatenate(([True], space[:-1]))


CHUNK_SCHEMA = "doc_id long, start int, size int, words int, h1 long, h2 long"


def chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, start, size, words, h1, h2): every chunk of every text; places count bytes, words
    count the words that begin in the chunk, h1 and h2 are the halves of its 128-bit digest."""

    def run(batches):
        for batch in batches:
            docs_, starts_, sizes_, words_, digests = [], [], [], [], []
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = value.as_py()
                if text:
                    raw = np.frombuffer(text, np.uint8)
                    ends = cuts(raw)
                    starts = np.concatenate(([0], ends[:-1]))
                    seen = np.concatenate(([0], np.cumsum(word_starts(raw))))
                    docs_.append(np.full(len(ends), doc, np.int64))
                    starts_.append(starts)
                    sizes_.append(ends - starts)
                    words_.append(seen[ends] - seen[starts])
                    digests += [xxhash.xxh3_128_digest(text[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
                if len(digests) > 1 << 17:
                    yield packed(docs_, starts_, sizes_, words_, digests)
                    docs_, starts_, sizes_, words_, digests = [], [], [], [], []
            yield packed(docs_, starts_, sizes_, words_, digests)

    def packed(docs_, starts_, sizes_, words_, digests):
        halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        columns = [np.concatenate(x) if x else np.array([]) for x in (docs_, starts_, sizes_, words_)]
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0].astype(np.int64)), *(pa.array(c.astype(np.int32)) for c in columns[1:]), pa.array(halves[:, 0]), pa.array(halves[:, 1])],
            names=["doc_id", "start", "size", "words", "h1", "h2"],
        )

    return (
        docs.filter("doc_id IS NOT NULL")
        .select("doc_id", text_or_empty().cast("binary").alias("text"))
        .mapInArrow(run, CHUNK_SCHEMA)
    )


def repeated_spans(docs: DataFrame, passage_words: int = PASSAGE_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """doc_id, start, end, n_words, first_doc_id, redundant: passages that stand in other texts too.

    A run is a stretch of whole chunks that each stand in two documents or more. A run in which
    more than ``passage_words`` words begin is a passage; one with ``run_words`` or more is a
    passage if the texts around it show so: see ``confirmed``. A passage is given as one or more
    spans (start and end in bytes) of its whole chunks, n_words the words that begin in each:
    redundant ones have only chunks of which a document with a smaller doc_id holds a copy, the
    others only chunks of which this document holds the first copy, so that dropping the
    redundant spans leaves one copy of everything. first_doc_id is the smallest doc_id that holds
    a chunk of the span. Words end at ASCII white space, so text without any has no passages. Null
    and empty texts have no spans and rows with a null doc_id are not searched; repeated rows
    count once; different texts under one doc_id are taken as one document, whose places overlap
    (at each place the shortest chunk counts); an empty table gives an empty one; other columns
    are ignored.

    Digests are combined before their shuffle, so a chunk that stands in a third of all rows
    arrives as one row a task; in the join back, adaptive execution splits such digests. Chunks
    are cut twice: that costs less than to store them.
    """
    known = stored(
        chunks(docs)
        .groupBy("h1", "h2")
        .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        .filter("first <> last"),
        "repeated-chunks",
    )
    found = chunks(docs).join(known.hint("merge"), ["h1", "h2"])
    in_text = Window.partitionBy("doc_id").orderBy("start", "size", "h1", "h2")
    gap = F.col("start") != F.lag(F.col("start") + F.col("size"), 1, -1).over(in_text)
    again = F.col("start") == F.lag("start", 1, -1).over(in_text)
    earlier = F.col("first") < F.col("doc_id")
    turn = F.col("gap") | (earlier != F.lag(earlier, 1, False).over(in_text))
    runs = stored(
        found.withColumns({"gap": gap, "again": again})
        .filter(~F.col("again"))
        .withColumns(
            {
                "run": F.sum(F.col("gap").cast("int")).over(in_text),
                "part": F.sum(turn.cast("int")).over(in_text),
            }
        )
        .withColumn("run_words", F.sum("words").over(Window.partitionBy("doc_id", "run")))
        .filter(F.col("run_words") >= run_words)
        .drop("gap", "again"),
        "runs",
    )
    short = runs.filter(F.col("run_words") <= passage_words)
    sure = confirmed(docs, runs, short, passage_words)
    passages = runs.filter(F.col("run_words") > passage_words).unionByName(short.join(sure, ["doc_id", "run"], "left_semi"))
    return (
        passages.groupBy("doc_id", "part")
        .agg(
            F.min("start").cast("long").alias("start"),
            F.max(F.col("start") + F.col("size")).cast("long").alias("end"),
            F.sum("words").alias("n_words"),
            F.min("first").alias("first_doc_id"),
            F.every(earlier).alias("redundant"),
        )
        .drop("part")
    )


def confirmed(docs: DataFrame, runs: DataFrame, short: DataFrame, passage_words: int, repeating_words: int = REPEATING_WORDS) -> DataFrame:
    """(doc_id, run): those runs of ``short`` that lie in ``passage_words`` equal words, and those
    of ``repeating_words`` words or more that hold a chunk twice.

    The words on both sides of a chunk are compared with those around the same chunk in another
    document: the one with the smallest doc_id that holds it, or the largest where that is the
    document itself. A run has as many partners as its chunks name; its first and last chunk with
    each partner are tried, at their first and last place there and in the longest run there. A
    run of chunks that many texts share is missed only if none of them names a text with the same
    words. A place asks for its words once,
    however many runs meet there, and they travel as at most twice ``passage_words`` hashes.
    """
    partner = F.when(F.col("first") == F.col("doc_id"), F.col("last")).otherwise(F.col("first"))
    anchor = F.struct("start", "h1", "h2")
    anchors = stored(
        short.groupBy("doc_id", "run", partner.alias("partner"))
        .agg(F.explode(F.array_distinct(F.array(F.min(anchor), F.max(anchor)))).alias("anchor"))
        .select("doc_id", "run", "partner", "anchor.*"),
        "anchors",
    )
    wanted = anchors.select(F.col("partner").alias("doc_id"), "h1", "h2").distinct()
    places = stored(
        runs.select("doc_id", "h1", "h2", "start", "run_words")
        .join(wanted.hint("merge"), ["doc_id", "h1", "h2"])
        .groupBy(F.col("doc_id").alias("partner"), "h1", "h2")
        .agg(
            F.min("start").alias("low"),
            F.max("start").alias("high"),
            F.max(F.struct("run_words", -F.col("start"))).alias("begin"),
            F.max(F.struct("run_words", "start")).alias("end"),
        )
        .select("partner", "h1", "h2", F.explode(F.array_distinct(F.array("low", "high", -F.col("begin")["col2"], F.col("end")["start"]))).alias("place")),
        "places",
    )
    points = anchors.select("doc_id", "start").unionByName(places.select(F.col("partner").alias("doc_id"), F.col("place").alias("start")))
    around = stored(surroundings(docs, points.distinct(), passage_words), "surroundings")
    there = around.select(F.col("doc_id").alias("partner"), F.col("start").alias("place"), F.col("before").alias("b"), F.col("after").alias("a"))
    # the anchors keep their side of each join, so that one place with many runs can be split
    met = anchors.join(places.hint("merge"), ["partner", "h1", "h2"]).join(around.hint("merge"), ["doc_id", "start"])
    equal = leading("before", "b") + leading("after", "a")
    proven = met.join(there.hint("merge"), ["partner", "place"]).filter(equal >= passage_words).select("doc_id", "run")
    # a chunk that comes twice in a run tells no place, so equal words may not be found beside each other
    again = short.groupBy("doc_id", "run", "h1", "h2").agg(F.sum("words").alias("words"), F.count(F.lit(1)).alias("times"))
    periodic = again.groupBy("doc_id", "run").agg(F.sum("words").alias("words"), F.max("times").alias("times"))
    periodic = periodic.filter((F.col("times") > 1) & (F.col("words") >= repeating_words))
    return proven.unionByName(periodic.select("doc_id", "run")).distinct()


def leading(one: str, other: str) -> Column:
    """How many elements of two arrays are equal before the first that differ."""
    same = F.zip_with(one, other, lambda x, y: x.eqNullSafe(y))
    differs = F.array_position(same, F.lit(False))
    return F.when(differs == 0, F.size(same)).otherwise(differs - 1)


def surroundings(docs: DataFrame, points: DataFrame, most: int) -> DataFrame:
    """(doc_id, start, before, after): hashes of up to ``most`` words on each side of each place,
    the nearest first. A word across the place counts as before it."""

    def run(batches):
        for batch in batches:
            for doc, text, places in zip(*(batch.column(k) for k in range(3))):
                raw = text.as_py()
                begins = np.nonzero(word_starts(np.frombuffer(raw, np.uint8)))[0].tolist()
                words = raw.split()
                rows = []
                for place in places.as_py():
                    at = bisect.bisect_left(begins, place)
                    before, after = words[max(0, at - most) : at][::-1], words[at : at + most]
                    rows.append((doc.as_py(), place, *([xxhash.xxh64_intdigest(w) - (1 << 63) for w in x] for x in (before, after))))
                kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                for k in range(0, len(rows), 4096):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows[k : k + 4096]), kinds)], names=["doc_id", "start", "before", "after"]
                    )

    asked = points.groupBy("doc_id").agg(F.collect_list("start").alias("places"))
    texts = docs.select("doc_id", text_or_empty().cast("binary").alias("text"))
    return texts.join(asked.hint("merge"), "doc_id").select("doc_id", "text", "places").mapInArrow(
        run, "doc_id long, start int, before array<long>, after array<long>"
    )


def without_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with the redundant spans cut out of ``text``; texts without any are unchanged."""
    cuts = f"cuts-{uuid.uuid4().hex}"  # no column of docs has this name
    cut = spans.filter("redundant").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(cuts))

    @F.pandas_udf("string")
    def apart(text, spans):
        out = []
        for t, s in zip(text, spans):
            raw, at, kept = (t or "").encode(), 0, []  # Spark runs the function on every row
            for x in s:
                kept.append(raw[at : x["start"]])
                at = x["end"]
            out.append(b"".join([*kept, raw[at:]]).decode("utf-8", "ignore"))
        import pandas as pd

        return pd.Series(out)

    joined = docs.join(cut, "doc_id", "left")
    text = F.when(F.col(cuts).isNull(), F.col("text")).otherwise(apart("text", F.coalesce(cuts, F.array().cast("array<struct<start:long,end:long>>"))))
    return joined.withColumn("text", F.when(F.col("text").isNotNull(), text)).select(docs.columns)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"))
