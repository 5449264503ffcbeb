"""Concatenate and cut: pack token streams of documents into fixed windows.

Pass one tokenizes each partition once and writes its ids, with the number of tokens before each
document inside the partition. The partition totals, one row each, give every partition its global
offset by a prefix sum. Pass two reads the written ids, adds the offset and cuts at multiples of
the window; a document that crosses a boundary yields one record on each side of it. No document
is moved between tasks and only the last sequence can be short.

Tokenizing is exact: text made of characters that the tokenizer lower-cases one by one and splits
at white space is encoded piece by piece through a table of pieces seen before; any other text goes
to the tokenizer whole. The last sequence is padded to the window unless its length is a power of
two; ``padded_length`` says to what.

Defined results: null text is empty and yields only the end id; a null doc_id is carried as null;
repeated rows are packed as often as they are there; an empty table gives no pieces.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftgate.llm.work import Recent, held, slices, stored, table

WINDOW = 2048
END_ID = 1
#: Characters whose lower case is one character regardless of neighbours and that need no composing.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-\xffĀ-įĲ-ňŊ-ſ‐-‧‰-⁞€]*")
#: Pieces whose ids a worker keeps.
KEPT_PIECES = 300_000
#: Byte-level vocabularies write printable bytes as themselves and the others, in order, from U+0100 on.
BYTE_SIGNS = {b: chr(0x100 + k) for k, b in enumerate([*range(33), *range(127, 161), 173])}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Token ids of whole texts as bytes of a fixed-width unsigned integer type."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() < 2**16 else "<u4")
        self.end = np.array([END_ID], self.kind).tobytes()
        whole = self.whole
        #: whether this tokenizer encodes pieces between white space alone, and commas and full stops apart from words
        self.by_piece = whole("Über and, so. on") == b"".join(map(whole, ("über", "and", ",", "so", ".", "on")))
        #: words of letters skip the tokenizer's outer steps where its model alone gives the same ids
        self.word = self._by_model if all(self._by_model(w) == whole(w) for w in ("and", "über", "ñandú", "a", "straße", "œuvre", "tion")) else whole
        self.marks = {m: whole(m) for m in ".,"}
        self.pieces = Recent(self._piece, KEPT_PIECES)

    def _by_model(self, word: str) -> bytes:
        tokens = self.tokenizer.model.tokenize(word.encode().decode("latin-1").translate(BYTE_SIGNS))
        return np.array([t.id for t in tokens], self.kind).tobytes()

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def __call__(self, text: str) -> bytes:
        if not self.by_piece or "<|" in text or not PLAIN.fullmatch(text):
            return self.whole(text) + self.end
        return b"".join(map(self.pieces.__getitem__, text.lower().split())) + self.end

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece; a word with a comma or full stop behind it is put together."""
        if (mark := self.marks.get(piece[-1])) and (word := piece[:-1]).isalpha():
            return self.pieces[word] + mark
        return self.word(piece) if piece.isalpha() else self.whole(piece)


def encoder(path: str) -> Encoder:
    """One encoder a worker process."""
    return held(f"encoder {path}", lambda: Encoder(path))


def _tokenize(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, before = encoder(path), TaskContext.get().partitionId(), 0
        width = encode.kind.itemsize
        for batch in slices(batches):
            ids = [encode(t or "") for t in batch.column(1).to_pylist()]
            sizes = np.array([len(x) // width for x in ids], np.int64)
            starts = before + np.cumsum(sizes) - sizes
            before += int(sizes.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part, np.int32)), batch.column(0), pa.array(starts), pa.array(sizes), pa.array(ids, pa.binary())], names=["part", "doc_id", "start_in_part", "doc_tokens", "ids"])

    return run


def _cut(window: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, bases, starts, sizes, ids, total = (batch.column(k) for k in range(6))
            at = bases.to_numpy() + starts.to_numpy()
            sizes = sizes.to_numpy()
            last = (at + sizes - 1) // window
            count = last - at // window + 1
            row = np.repeat(np.arange(len(at)), count)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            sequence = (at // window)[row] + nth
            begin = np.maximum(at[row], sequence * window)
            end = np.minimum((at + sizes)[row], (sequence + 1) * window)
            start, length = begin - at[row], end - begin
            crc, held, wide = np.empty(len(row), np.int64), -1, b""
            for k, (r, s, n) in enumerate(zip(row.tolist(), start.tolist(), length.tolist(), strict=True)):
                if r != held:
                    held, wide = r, np.frombuffer(ids[r].as_buffer(), kind).astype("<u4").tobytes()
                crc[k] = zlib.crc32(memoryview(wide)[4 * s : 4 * (s + n)])
            filled = np.minimum(total.to_numpy()[row] - sequence * window, window)
            padded = np.where(filled & (filled - 1) == 0, filled, window)
            yield pa.RecordBatch.from_arrays([docs.take(pa.array(row)), *(pa.array(x) for x in (start, length, crc, sizes[row], sequence, begin - sequence * window, padded))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_length"])

    return run


def token_table(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Ids of every document, written once: part, doc_id, start_in_part, doc_tokens, ids."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return stored(rows.mapInArrow(_tokenize(tokenizer), "part int, doc_id long, start_in_part long, doc_tokens long, ids binary"), "tokens")


def offsets(tokens: DataFrame) -> DataFrame:
    """Global offset of each partition: a prefix sum over one row a partition."""
    totals = tokens.groupBy("part").agg(F.sum("doc_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return totals.select("part", before.alias("base"), F.sum("n").over(Window.partitionBy()).alias("all_tokens"))


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per piece of a document in a sequence of ``window`` tokens."""
    path = tokenizer or default_tokenizer()
    tokens = token_table(docs, path, text, doc_id)
    # 20 bytes a partition of the token table, whatever its rows: a million partitions are 20 MB
    base = F.broadcast(offsets(tokens))
    placed = tokens.join(base, "part").select("doc_id", "base", "start_in_part", "doc_tokens", "ids", "all_tokens")
    return placed.mapInArrow(_cut(window, encoder(path).kind.str), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_length long")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op10_packing": op10_packing}
