"""Operator 13, fill-in-middle: one scan finds the cuts, one scatter writes all texts of a batch."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from panelia.llm.common import table, text_or_empty

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Bytes of text that one scatter handles at once; a longer text is handled alone.
BLOCK = 1 << 21

_LETTER = np.zeros(256, bool)
_LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1] = True


def blocks(sizes: np.ndarray, limit: int = BLOCK):
    """Ranges (first, last + 1) of rows whose bytes stay under ``limit`` together."""
    first, held = 0, 0
    for row, size in enumerate(sizes.tolist()):
        if row > first and held + size > limit:
            yield first, row
            first, held = row, 0
        held += size
    if first < len(sizes):
        yield first, len(sizes)


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, row borders in them) of a string or binary array without nulls."""
    array = array.cast(pa.large_binary())
    borders = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    flat = np.frombuffer(array.buffers()[2] or b"", np.uint8)[borders[0] : borders[-1]]
    return flat, borders - borders[0]


def text_array(flat: np.ndarray, borders: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_string(), len(borders) - 1, [None, pa.py_buffer(borders.astype(np.int64)), pa.py_buffer(flat)])


def found(flat: np.ndarray, mark: bytes) -> np.ndarray:
    """Where ``mark`` (three bytes) stands in all bytes."""
    a, b, c = mark
    return np.flatnonzero((flat[:-2] == a) & (flat[1:-1] == b) & (flat[2:] == c)) if len(flat) > 2 else np.empty(0, np.int64)


def rows_of(places: np.ndarray, borders: np.ndarray, width: int) -> np.ndarray:
    """The rows of places, without those whose mark of ``width`` bytes runs over the row's end."""
    rows = np.searchsorted(borders, places, "right") - 1
    return rows[places + width <= borders[rows + 1]]


def moved(borders: np.ndarray, cuts: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Target of every byte. Piece k of a row begins at ``cuts[:, k]`` and moves by
    ``shifts[:, k]``: steps go into a difference array, whose running sum is the displacement."""
    total = int(borders[-1])
    steps = np.ones(total + 1, np.int32 if total < 1 << 30 else np.int64)  # places themselves grow by one
    np.add.at(steps, cuts.ravel(), np.diff(shifts.ravel(), prepend=1).astype(steps.dtype))
    return np.cumsum(steps[:-1], dtype=steps.dtype)


def scatter(flat: np.ndarray, borders: np.ndarray, draws: np.ndarray, fim_percent: int, spm_percent: int):
    """Outputs of a block: (bytes, borders, tokens, form, prefix characters, middle characters).

    ``draws`` holds h1 to h4 of each row. Form 0 is plain, 1 psm, 2 spm.
    """
    starts_character = (flat & 0xC0) != 0x80
    letter = _LETTER[flat]
    follows = np.zeros(len(flat), bool)  # a letter behind a letter of the same text
    follows[1:] = letter[1:] & letter[:-1]
    begins = borders[:-1][np.diff(borders) > 0]
    follows[begins] = False
    token_starts = np.flatnonzero(starts_character & ~follows)
    token_of = np.searchsorted(token_starts, borders)  # tokens before each row
    n = np.diff(token_of)
    characters = np.concatenate([[0], np.cumsum(starts_character)])

    form = np.where(draws[:, 3] % 100 < spm_percent, 2, 1)
    form[(n == 0) | (draws[:, 2] % 100 >= fim_percent)] = 0
    for mark in (PREFIX, SUFFIX, MIDDLE):
        form[rows_of(found(flat, mark), borders, len(mark))] = 0

    picks = np.sort(draws[:, :2] % (n + 1)[:, None], axis=1)
    places = np.append(token_starts, len(flat))
    at = token_of[:-1, None] + picks
    cut = np.where(picks == n[:, None], borders[1:, None], places[np.minimum(at, len(places) - 1)])
    cut1, cut2 = cut[:, 0], cut[:, 1]
    a, b, c = cut1 - borders[:-1], cut2 - cut1, borders[1:] - cut2

    width, joined = len(PREFIX), form > 0
    sizes = np.diff(borders) + 3 * width * joined
    targets = np.concatenate([[0], np.cumsum(sizes)])
    base = targets[:-1]
    spm = form == 2
    # where each piece begins in its output
    to_prefix = base + np.where(spm, 2 * width + c, np.where(joined, width, 0))
    to_suffix = base + np.where(spm, width, np.where(joined, 2 * width + a, a + b))
    to_middle = base + np.where(joined, 3 * width + a + c, a)
    cuts = np.stack([borders[:-1], cut1, cut2], axis=1)
    shifts = np.stack([to_prefix, to_middle, to_suffix], axis=1) - cuts
    out = np.empty(int(targets[-1]), np.uint8)
    out[moved(borders, cuts, shifts)] = flat
    for mark, piece in ((PREFIX, to_prefix), (SUFFIX, to_suffix), (MIDDLE, to_middle)):
        spots = (piece - width)[joined]
        for k, byte in enumerate(mark):
            out[spots + k] = byte
    return out, targets, n, form, characters[cut1] - characters[borders[:-1]], characters[cut2] - characters[cut1]


def gather(out: np.ndarray, targets: np.ndarray, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts behind outputs: the marks that stand in them say where each piece lies, and one
    gather reads the pieces in their old order. A piece never holds a mark, and marks cannot
    arise where two pieces meet one, so each mark of a joined row stands exactly once."""
    width = len(PREFIX)
    base = targets[:-1]
    spot = {}
    for mark in (PREFIX, SUFFIX, MIDDLE):
        places = found(out, mark)
        rows = np.searchsorted(targets, places, "right") - 1
        inside = joined[rows] & (places + width <= targets[rows + 1])
        spot[mark] = base.copy()
        spot[mark][rows[inside]] = places[inside]
    p, s, m = spot[PREFIX], spot[SUFFIX], spot[MIDDLE]
    ends = targets[1:]
    a = np.where(joined, np.where(p < s, s, m) - p - width, 0)
    c = np.where(joined, np.where(p < s, m, p) - s - width, 0)
    b = np.where(joined, ends - m - width, ends - base)
    borders = np.concatenate([[0], np.cumsum(a + b + c)])
    cuts = np.stack([borders[:-1], borders[:-1] + a, borders[:-1] + a + b], axis=1)
    begins = np.stack([np.where(joined, p + width, base), np.where(joined, m + width, base), np.where(joined, s + width, ends)], axis=1)
    return out[moved(borders, cuts, begins - cuts)], borders


def draws(seed: int) -> list[Column]:
    """h1 to h4: the first four groups of eight hex digits of a row's digest."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


FORMS = pa.array(["plain", "psm", "spm"])


def fill_in_middle(docs: DataFrame, seed: int = 1, fim_percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output for every row of ``docs``.

    A text of n tokens (a run of ASCII letters, or one other character) is cut at two places that
    its doc_id draws. Null and empty texts, and texts that hold one of the marks, stay plain; so
    does one in ten of the others. Plain rows have no character counts. A null doc_id draws as if
    it were written as nothing. Repeated rows give repeated results; an empty table gives an
    empty one; other columns are not read. Texts are handled in blocks of BLOCK bytes, a longer
    one alone and whole. One pass, no shuffle.
    """

    def run(batches):
        for batch in batches:
            texts, numbers = batch.column(1), np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[2:6]], axis=1)
            flat, borders = text_bytes(texts)
            for first, last in blocks(np.diff(borders)):
                part = borders[first : last + 1]
                out, targets, n, form, prefix, middle = scatter(
                    flat[part[0] : part[-1]], part - part[0], numbers[first:last], fim_percent, spm_percent
                )
                plain = form == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first),
                        pa.array(n, pa.int64()),
                        FORMS.take(pa.array(form)),
                        pa.array(prefix, pa.int64(), mask=plain),
                        pa.array(middle, pa.int64(), mask=plain),
                        text_array(out, targets).cast(pa.string()),
                    ],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return docs.select("doc_id", text_or_empty().alias("text"), *draws(seed)).mapInArrow(
        run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    )


def restored(outputs: DataFrame) -> DataFrame:
    """``outputs`` (with form and output) and a column ``restored``: the exact texts before the
    transformation, from output and form alone. A null output stays null as the empty text."""
    schema = StructType([*outputs.schema.fields, StructField("restored", StringType())])
    names = outputs.columns
    form, output = names.index("form"), names.index("output")

    def run(batches):
        for batch in batches:
            flat, borders = text_bytes(batch.column(output).fill_null(""))
            joined = np.array([f not in (None, "plain") for f in batch.column(form).to_pylist()], bool)
            for first, last in blocks(np.diff(borders)):
                part = borders[first : last + 1]
                texts = text_array(*gather(flat[part[0] : part[-1]], part - part[0], joined[first:last]))
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(first, last - first).columns, texts.cast(pa.string())], names=[*names, "restored"]
                )

    return outputs.mapInArrow(run, schema)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restored(fill_in_middle(table(spark, sf_dir, "documents"))).select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"),
    )


OP13_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (
  SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS w,
         ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
         ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (
  SELECT *, len(w)::BIGINT AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (
  SELECT doc_id, t, n, form, coalesce(array_to_string(w[:a], ''), '') AS pre, coalesce(array_to_string(w[a + 1:b], ''), '') AS mid,
         coalesce(array_to_string(w[b + 1:], ''), '') AS suf FROM c)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(pre || mid || suf) AS restored_sha256
FROM p
"""
