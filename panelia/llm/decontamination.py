"""Operator 9, benchmark decontamination: pieces of an error budget, then Myers' distance."""

import re
from collections import defaultdict

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelia.llm.common import table, text_or_empty

#: Characters a piece should have; the budget is what so many pieces allow (one edit in 16 or so).
PIECE = 16
#: Normalised characters of test items that are broadcast at once; a larger benchmark takes
#: several passes over the documents, one for each block.
BLOCK = 1 << 20

_OTHER = re.compile(r"[^\w]+")


def normalised(text: str) -> str:
    """Lower case, one space for everything between words: layout and punctuation do not count."""
    return _OTHER.sub(" ", text.lower()).strip()


def budget(length: int, piece: int = PIECE) -> int:
    return max(0, length // piece - 1)


def pieces(item: str, piece: int = PIECE) -> list[tuple[int, str]]:
    """(start, piece): budget + 1 pieces that cover the item. Any text within ``budget`` edits of
    it holds one of them unchanged."""
    n = budget(len(item), piece) + 1
    cuts = [len(item) * k // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(item: str, text: str) -> tuple[int, int]:
    """(least distance of the item to a substring of ``text``, where the first such one ends)."""
    m = len(item)
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        masks[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, place = m, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        across = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | (~(across | plus) & full)
        down = plus & across
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        vertical = eq | minus
        plus = down | (~(vertical | up) & full)
        minus = up & vertical
        if score < best:
            best, place = score, j + 1
    return best, place


class Matcher:
    """Test items of one block with the automaton of their pieces."""

    def __init__(self, items: list[tuple[int, str]], piece: int):
        self.items = items
        self.budgets = [budget(len(t), piece) for _, t in items]
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, text) in enumerate(items):
            for start, part in pieces(text, piece):
                places[part].append((k, start))
        self.automaton = ahocorasick.Automaton()
        for part, where in places.items():
            self.automaton.add_word(part, (len(part), where))
        if places:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, start, end, distance) of each item's best match on each diagonal band."""
        if not len(self.automaton):
            return []
        diagonals = defaultdict(list)
        for end, (size, where) in self.automaton.iter(text):
            for k, start in where:
                diagonals[k].append(end + 1 - size - start)  # where the item would begin
        found = []
        for k, begins in diagonals.items():
            item_id, item = self.items[k]
            most = self.budgets[k]
            begins.sort()
            low = begins[0]
            bands = [[low, low]]
            for b in begins[1:]:
                if b - bands[-1][1] <= 2 * most:
                    bands[-1][1] = b
                else:
                    bands.append([b, b])
            for first, last in bands:
                a, z = max(0, first - most), min(len(text), last + len(item) + most)
                if text[max(0, first) : max(0, first) + len(item)] == item:
                    found.append((item_id, max(0, first), max(0, first) + len(item), 0))
                    continue
                distance, end = myers(item, text[a:z])
                if distance <= most:
                    found.append((item_id, max(a, a + end - len(item)), a + end, distance))
        return found


def benchmark_blocks(benchmark: DataFrame, block: int = BLOCK):
    """Lists of (item_id, normalised text), each of at most about ``block`` characters of items.

    A block has a bounded size; how many there are, and with them the passes over the documents
    and the blocks that are broadcast in turn, grows with the benchmark. Items without words match
    nothing and are left out.
    """
    items = benchmark.select("item_id", text_or_empty().alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    count = total // block + 1
    for k in range(count):
        rows = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(count)) == k).collect()
        yield [(r.item_id, t) for r in rows if (t := normalised(r.text))]


def leaks(docs: DataFrame, benchmark: DataFrame, piece: int = PIECE, block: int = BLOCK) -> DataFrame:
    """doc_id, item_id, start, end, distance: test items that stand in a text almost unchanged.

    Texts and items are compared in lower case with one space for all between two words; start
    and end count characters of that form. An item is found if a part of the text is within
    length // piece - 1 edits of it (0 for short ones). Null and empty texts and items match
    nothing. Repeated rows give repeated results; empty tables give an empty one; other columns
    are not read. One pass over the documents for each block of items; no shuffle.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, start long, end long, distance int"
    rows = docs.select("doc_id", text_or_empty().alias("text"))

    def finder(items):
        def run(batches):
            matcher = Matcher(items.value, piece)
            for batch in batches:
                found = [
                    (doc, *hit)
                    for doc, text in zip(batch.column(0).to_pylist(), batch.column(1))
                    for hit in matcher.find(normalised(text.as_py()))
                ]
                columns = list(zip(*found)) if found else [()] * 5
                kinds = [pa.int64()] * 4 + [pa.int32()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "item_id", "start", "end", "distance"]
                )

        return run

    out = spark.createDataFrame([], schema)
    for items in benchmark_blocks(benchmark, block):
        out = out.unionByName(rows.mapInArrow(finder(spark.sparkContext.broadcast(items)), schema))
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, piece: int = PIECE, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that hold no test item, with all their columns: rows are tested where
    they are read, once for each block of items, so nothing is joined or shuffled."""
    at = docs.columns.index("text")
    schema = docs.schema
    for items in benchmark_blocks(benchmark, block):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            matcher = Matcher(shared.value, piece)
            for batch in batches:
                keep = [not matcher.find(normalised(v.as_py() or "")) for v in batch.column(at)]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(run, schema)
    return docs


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
