"""Operator 6, byte-level BPE encoding and decoding with the tokenizers library."""

import base64
import hashlib
import os
import re
import struct

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import models

from panelia.llm.common import table, text_or_empty

#: Encoded words and matches that a worker remembers of each; beyond it the memory starts anew.
REMEMBERED = 500_000
#: A space after white space and before more of it, or before the end, belongs to a run that one
#: match may take whole.
INNER_SPACE = re.compile(r"\s (?:\s|\Z)")


def byte_characters() -> list[str]:
    """One printable character for each byte: itself where printable, else the next from 256 on."""
    printable = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class ByteBpe:
    """The tokenizers BPE model over byte characters; each match of the pattern is encoded alone."""

    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.of_byte = byte_characters()
        self.byte_of = {c: b for b, c in enumerate(self.of_byte)}
        self.pattern = regex.compile(pattern)
        self.cuts_at_spaces = pattern == public_tokenizers.PATTERN
        self.translate = str.maketrans({chr(b): c for b, c in enumerate(self.of_byte)})
        vocabulary = {self.characters(token): i for token, i in ranks.items()}
        self.model = models.BPE(vocabulary, merges_of(ranks, self.characters), ignore_merges=True)
        self.bytes_of = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, i in vocabulary.items():
            self.bytes_of[i] = bytes(self.byte_of[c] for c in token)
        self.sizes = np.array([len(x) for x in self.bytes_of], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def characters(self, raw: bytes) -> str:
        return raw.decode("latin-1").translate(self.translate)

    def piece(self, piece: str) -> bytes:
        """Ids of one match of the pattern as little-endian unsigned 32-bit integers."""
        ids = [t.id for t in self.model.tokenize(self.characters(piece.encode("utf-8", "replace")))]
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(self.pieces) >= REMEMBERED:
            self.pieces.clear()
        if len(piece) < 40:
            self.pieces[piece] = packed
        return packed

    def word(self, text: str) -> bytes:
        """Each match of the pattern by itself."""
        known, piece = self.pieces, self.piece
        packed = b"".join([known.get(p) or piece(p) for p in self.pattern.findall(text)])
        if len(self.words) >= REMEMBERED:
            self.words.clear()
        if len(text) < 40:
            self.words[text] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """In ``public_tokenizers.PATTERN`` a space before something visible always begins a match
        and one alone at the end is a match, so the text can be cut before such spaces and equal
        words are encoded once. Texts with other spaces, and texts under another pattern, are
        encoded whole."""
        if not text:
            return b""
        if not self.cuts_at_spaces or INNER_SPACE.search(text):
            return self.word(text)
        first, *rest = text.split(" ")
        known, word = self.words, self.word
        return word(first) + b"".join([known.get(w) or word(w) for w in map(" ".__add__, rest)])

    def decode(self, packed: bytes) -> bytes:
        """The bytes behind the ids. A character split over tokens is whole again here, since
        the bytes are joined before anything reads them as UTF-8."""
        ids = np.frombuffer(packed, "<u4")
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.starts[ids] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)].tobytes()

    def offsets(self, text: str, packed: bytes) -> list[tuple[int, int]]:
        """(start, end) of every token in code points; a token inside a character covers it."""
        sizes = [len(self.bytes_of[i]) for i in np.frombuffer(packed, "<u4").tolist()]
        ends = np.cumsum(sizes, dtype=np.int64)
        raw = np.frombuffer(text.encode("utf-8"), np.uint8)
        character = np.cumsum((raw & 0xC0) != 0x80) - 1  # of each byte
        starts = ends - np.array(sizes, dtype=np.int64)
        return [(int(character[a]), int(character[b - 1]) + 1) for a, b in zip(starts, ends)]


def merges_of(ranks: dict[bytes, int], characters) -> list[tuple[str, str]]:
    """The merge that forms each token: the last pair left when only lower ranks may merge."""
    merges = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(
                (r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None and r < rank
            )[1]
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        if len(parts) == 2:
            merges.append((characters(parts[0]), characters(parts[1])))
    return merges


_LOADED: dict[tuple[str, str], ByteBpe] = {}


def loaded(ranks_path: str, pattern: str) -> ByteBpe:
    """One instance for each Python worker, kept over tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if (ranks_path, pattern) not in _LOADED:
        _LOADED[ranks_path, pattern] = ByteBpe(ranks_path, pattern)
    return _LOADED[ranks_path, pattern]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids array<long>, starts and ends array<int> (code points), decoded binary."""

    def run(batches):
        bpe = loaded(ranks_path, pattern)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                packed = bpe.encode(text)
                spans = bpe.offsets(text, packed)
                rows.append((np.frombuffer(packed, "<u4").tolist(), [a for a, _ in spans], [b for _, b in spans], bpe.decode(packed)))
            ids, starts, ends, decoded = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int64())), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32())), pa.array(decoded, pa.binary())],
                names=["doc_id", "ids", "starts", "ends", "decoded"],
            )

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(
        run, "doc_id long, ids array<long>, starts array<int>, ends array<int>, decoded binary"
    )


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, text: the inverse of encode_documents from the ids alone."""

    def run(batches):
        bpe = loaded(ranks_path, pattern)
        for batch in batches:
            texts = [bpe.decode(np.array(ids or [], "<u4").tobytes()).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def encoding_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of ``docs``.

    Every text is encoded whole and its ids are decoded again; only the digests leave the task.
    Null and empty texts have no tokens. Repeated rows give repeated results; an empty table
    gives an empty one; other columns are not read. No shuffle: one pass over the texts, with
    one batch and a bounded memory of pieces in a worker.
    """

    def run(batches):
        bpe = loaded(ranks_path, pattern)
        for batch in batches:
            counts, ids, decoded = [], [], []
            for value in batch.column(1):
                packed = bpe.encode(value.as_py())
                counts.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(packed)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digests(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )
