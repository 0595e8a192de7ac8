"""Operator 2, token counts: overlapping chunks of huge documents, spliced where that is proven."""

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelia.llm.common import table, text_or_empty

#: Texts of more bytes are cut into chunks of CHUNK code points.
HUGE = 1 << 16
CHUNK = 1 << 14
OVERLAP = 64
LIMIT = 4096


class Pieces:
    """A SentencePiece BPE model and the pairs of characters that one of its pieces can hold."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pairs = set()
        for i in range(self.model.get_piece_size()):
            if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i)):
                piece = self.model.id_to_piece(i)
                self.pairs.update(zip(piece, piece[1:]))

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)]

    def stable(self, text: str, at: int) -> bool:
        """Whether no piece can lie across ``at``: merges only ever build pieces, so none joins
        a pair of characters that no piece holds, and both sides are encoded independently."""
        a, b = text[at - 1].replace(" ", "▁"), text[at].replace(" ", "▁")
        return (a, b) not in self.pairs

    def ends(self, text: str) -> list[int]:
        """Where every token ends, in code points."""
        return [b for _, b in self.model.encode(text, return_type="offset_mapping")["offsets"]]

    def splice(self, text: str, edge: int, overlap: int = OVERLAP) -> int:
        """The place near ``edge`` where the chunks on both sides meet.

        The chunk that ends ``overlap`` behind the edge and the one that begins ``overlap``
        before it are both encoded around the edge. Their common token boundaries in the
        overlap that are proven stable qualify; the one nearest to the edge is taken. Where
        there is none the overlap doubles, up to the whole text (then: the end of the text).
        """
        while True:
            low, high = max(0, edge - overlap), min(len(text), edge + overlap)
            start = max(0, low - overlap)
            left = {start + e for e in self.ends(text[start:high])}
            right = {low + e for e in self.ends(text[low : min(len(text), high + overlap)])}
            common = [p for p in left & right if max(low, 1) <= p < high and self.stable(text, p)]
            if common:
                return min(common, key=lambda p: (abs(p - edge), p))
            if low == 0 and high == len(text):
                return len(text)
            overlap *= 2

    def chunk_count(self, text: str, start: int) -> int:
        """Tokens after ``start``, a stable place or 0: those of the context before it go off.
        The context keeps the space that the model puts before a text away from the chunk."""
        return len(self.model.encode(text)) - (len(self.model.encode(text[:start])) if start else 0)


def cut(pieces: Pieces, text: str, chunk: int, overlap: int = OVERLAP) -> list[tuple[str, int]]:
    """(chunk text with some context before it, where the chunk begins in it), in order."""
    places = [0]
    while (edge := places[-1] + chunk) < len(text):
        place = pieces.splice(text, edge, overlap)
        if place <= places[-1]:  # met a boundary that is already used
            place = len(text)
        places.append(place)
    if places[-1] < len(text):
        places.append(len(text))
    out = []
    for a, b in zip(places, places[1:]):
        context = max(0, a - 1)
        out.append((text[context:b], a - context))
    return out


_LOADED: dict[str, Pieces] = {}


def loaded(path: str) -> Pieces:
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def token_counts(docs: DataFrame, model_path: str, limit: int = LIMIT, huge: int = HUGE, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``.

    Texts of up to ``huge`` bytes are encoded whole where they are read. Longer ones are cut at
    proven places into chunks, which are dealt out over all tasks and summed by row. A chunk has
    about ``chunk`` code points; it is longer only where no place near its edge can be proven, up
    to the whole of a text that has none. Null and empty texts have no bytes and no
    tokens. Repeated rows give repeated results; an empty table gives an empty one; other
    columns are not read.
    """
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    small = rows.filter(F.octet_length("text") <= huge)
    large = rows.filter(F.octet_length("text") > huge)

    def whole(batches):
        pieces = loaded(model_path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sizes = [len(t.encode()) for t in texts]
            counts = [n for k in range(0, len(texts), 64) for n in pieces.counts(texts[k : k + 64])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    def chunks(batches):
        pieces = loaded(model_path)
        for batch in batches:
            for row, (doc, key, value) in enumerate(zip(*(batch.column(k) for k in range(3)))):
                text = value.as_py()
                size = len(text.encode())
                for number, (part, start) in enumerate(cut(pieces, text, chunk)):
                    yield pa.RecordBatch.from_pydict(
                        {"doc_id": [doc.as_py()], "key": [key.as_py()], "n_bytes": [size if number == 0 else 0], "part": [part], "start": [start]},
                        schema=pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n_bytes", pa.int64()), ("part", pa.string()), ("start", pa.int32())]),
                    )

    def counted(batches):
        pieces = loaded(model_path)
        for batch in batches:
            counts = [pieces.chunk_count(p, s) for p, s in zip(batch.column("part").to_pylist(), batch.column("start").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), batch.column("n_bytes"), pa.array(counts, pa.int64())],
                names=["doc_id", "key", "n_bytes", "n_tokens"],
            )

    # the key tells repeated rows apart
    dealt = (
        large.select("doc_id", F.monotonically_increasing_id().alias("key"), "text")
        .mapInArrow(chunks, "doc_id long, key long, n_bytes long, part string, start int")
        .repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    )
    spliced = (
        dealt.mapInArrow(counted, "doc_id long, key long, n_bytes long, n_tokens long")
        .groupBy("doc_id", "key")
        .agg(F.sum("n_bytes").alias("n_bytes"), F.sum("n_tokens").alias("n_tokens"))
        .drop("key")
    )
    counts = small.mapInArrow(whole, "doc_id long, n_bytes long, n_tokens long").unionByName(spliced)
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
