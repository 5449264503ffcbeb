"""Cross-tokenizer alignment: token intervals of two tokenizers over the same bytes, joined in DuckDB per Arrow batch.

Both tokenizers read space + text. Where the bytes of their tokens, put together, are those of space +
text, their tokens are intervals of one line of bytes. In each worker a DuckDB connection holds one
table of intervals a tokenizer. An ASOF join finds, for a token of the first, the last token of the
second that ends no later; one that ends in the same place is linked, and is a cut. Window sums over
cuts number the groups. A second ASOF join puts the tokens of the second into the intervals between
cuts, with a range condition on both of their ends. Each document's pairs leave DuckDB counted; Spark merges
these partial counts over the corpus and joins them back to the documents' pairs.

Long texts are taken in chunks cut at a single space between two other characters, where both
tokenizers begin a token: the first by its pattern, the second since no piece of it has a space behind
another character. So a worker holds intervals of one slice of about ``SLICE_BYTES`` bytes, whatever a text's length;
a run without such a space stays whole. Byte-level ids come from the vocabulary by ranks for texts of
ASCII and Latin letters, where that is the same and quicker, and from the tokenizer itself for all other texts.

Defined results: null and empty texts, and texts whose tokens don't give back space + text (U+2581 in the text),
have no tokens and zeros; strings of special tokens are plain text; null ids are carried; repeated rows
are aligned, and counted, as often as they are there; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftgate.llm.packing import BYTE_SIGNS, PLAIN
from driftgate.llm.work import attach, held, slices, stored, table

#: Characters of a chunk of a long text, and bytes whose tokens DuckDB joins at a time.
CHUNK, SLICE_BYTES = 100_000, 750_000
#: Pairs of ids whose counts are broadcast, 24 bytes each; beyond that they are joined by a shuffle.
MOST_BROADCAST = 1_000_000
#: Where a text may be cut.
CUT = re.compile("(?<=[^\\s▁]) (?=[^\\s▁])")
#: Runs for which a merge by ranks would take time with the square of their length.
LONG_RUN = re.compile(r"\S{1000}|\s{1000}")
#: Fixed value: the pattern that splits text before byte-level merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = "▁"


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class ByteLevel:
    """Ids of a byte-level BPE and the bytes of each id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {sign: b for b, sign in BYTE_SIGNS.items()} | {chr(b): b for b in range(256) if b not in BYTE_SIGNS}
        vocab = spec["model"]["vocab"]
        self.bytes = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
        for token, k in vocab.items():
            self.bytes[k] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.path, self.ranked, self._whole = path, None, None
        special = {t["content"] for t in spec["added_tokens"]}
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
        ids = [vocab[m] for m in merged]
        split = spec.get("pre_tokenizer") or {}
        if not spec.get("normalizer") and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and ids == sorted(ids) and len(vocab) == 256 + len(ids) + len(special & set(vocab)):
            import tiktoken

            ranks = {self.bytes[k]: k for token, k in vocab.items() if token not in special}
            self.ranked = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.ranked and PLAIN.fullmatch(text) and not LONG_RUN.search(text):
            return self.ranked.encode_ordinary(text)
        if self._whole is None:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self.path)
            self._whole.encode_special_tokens = True
        return self._whole.encode(text, add_special_tokens=False).ids


class Pieces:
    """Ids of a piece model, which puts a space before a text itself, and the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [(k, self.model.id_to_piece(k)) for k in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(k) else p.replace(SPACE, " ").encode() for k, p in pieces]
        #: whether a space can only begin a piece, so that a text can be cut before one
        self.cuts = not any(SPACE in p.lstrip(SPACE) for _, p in pieces)

    def __call__(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)


def chunks(text: str, size: int = CHUNK) -> list[str]:
    """Parts of space + text that both tokenizers read alike alone; each begins with a space."""
    out, begin = [], 0
    while len(text) - begin > size and (m := CUT.search(text, begin + size)):
        out.append(" " + text[begin : m.start()])
        begin = m.end()
    return [*out, " " + text[begin:]]


@dataclass
class Open:
    """A document on its way through DuckDB, a slice at a time."""

    row: int
    doc_id: int | None
    tokens: tuple[int, int] = (0, 0)
    links: int = 0
    n_groups: int = 0
    groups: list[str] = field(default_factory=list)
    pairs: list[np.ndarray] = field(default_factory=list)
    times: list[np.ndarray] = field(default_factory=list)


#: Tokens of the first with the cut at their end and the number of their group: cuts before them.
FIRST = """CREATE OR REPLACE TEMP TABLE first AS
SELECT doc, id, stop, other, cut, (sum(cut::INTEGER) OVER (ORDER BY stop ROWS UNBOUNDED PRECEDING))::INTEGER - cut::INTEGER AS grp
FROM (SELECT a.doc, a.id, a.stop, b.id AS other, coalesce(b.stop = a.stop, false) AS cut FROM a ASOF LEFT JOIN b ON a.stop >= b.stop)"""
#: Both tokenizers' tokens as text in the order of groups; those of the second lie in the group whose bytes hold them.
GROUPS = """WITH span AS (SELECT grp, coalesce(lag(stop) OVER (ORDER BY stop), 0) AS start, stop FROM first WHERE cut),
second AS (SELECT b.doc, b.id, b.stop, b.stop = span.stop AS cut, span.grp FROM b ASOF JOIN span ON b.stop <= span.stop WHERE b.start >= span.start),
written AS (
  SELECT doc, id || CASE WHEN NOT cut THEN ',' WHEN side = 0 THEN '|' ELSE ';' END AS token, (cut AND side = 1)::INTEGER AS ends
  FROM (SELECT doc, id, stop, cut, grp, 0 AS side FROM first UNION ALL SELECT doc, id, stop, cut, grp, 1 FROM second) ORDER BY 2 * grp + side, stop)
SELECT doc, string_agg(token, '') AS groups, sum(ends)::BIGINT AS n FROM written GROUP BY doc"""
#: Links of each document by pair of ids.
PAIRS = """SELECT doc, list(pair) AS pairs, list(n) AS times, sum(n)::BIGINT AS links
FROM (SELECT doc, id::BIGINT << 32 | other AS pair, count(*)::INTEGER AS n FROM first WHERE cut GROUP BY ALL) GROUP BY doc"""


class Joiner:
    """Takes documents' tokens and gives finished documents back."""

    def __init__(self, first: ByteLevel, second: Pieces):
        import duckdb

        self.sides = (first, second)
        # bytes of a slice are counted in 32 bits
        self.widths = tuple(np.array([len(b) for b in side.bytes], np.int32) for side in self.sides)
        self.starts = tuple(np.cumsum(w, dtype=np.int32) - w for w in self.widths)
        self.flat = tuple(np.frombuffer(b"".join(side.bytes), np.uint8) for side in self.sides)
        # slices are small, so nothing is ever spilled to a local folder
        self.db = duckdb.connect(config={"threads": 1, "temp_directory": ""})
        self.waiting: list[tuple[Open, np.ndarray, np.ndarray]] = []
        self.bytes = 0

    def tokens(self, text: str) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both tokenizers chunk by chunk, or nothing where they don't give the text back."""
        first, second = self.sides
        out = []
        for part in chunks(text) if second.cuts else [" " + text]:
            both, whole = (np.array(first(part), np.int32), np.array(second(part[1:]), np.int32)), np.frombuffer(part.encode(), np.uint8)
            if not all(self._gives_back(side, ids, whole) for side, ids in enumerate(both)):
                return []
            out.append(both)
        return out

    def _gives_back(self, side: int, ids: np.ndarray, whole: np.ndarray) -> bool:
        """Whether the bytes of the tokens, put together, are these."""
        widths = self.widths[side][ids]
        if int(widths.sum()) != len(whole):
            return False
        at = np.arange(len(whole), dtype=np.int32) + np.repeat(self.starts[side][ids] - (np.cumsum(widths, dtype=np.int32) - widths), widths)
        return bool((self.flat[side][at] == whole).all())

    def add(self, doc: Open, text: str) -> None:
        parts = self.tokens(text)
        doc.tokens = (sum(len(a) for a, _ in parts), sum(len(b) for _, b in parts))
        for a, b in parts:
            self.waiting.append((doc, a, b))
            self.bytes += int(self.widths[0][a].sum())
            if self.bytes >= SLICE_BYTES:
                self.join()

    def _table(self, side: int) -> pa.Table:
        parts = [w[1 + side] for w in self.waiting]
        ids = np.concatenate(parts)
        widths = self.widths[side][ids]
        stop = np.cumsum(widths, dtype=np.int32)
        return pa.table({"doc": np.repeat(np.arange(len(parts), dtype=np.int32), [len(x) for x in parts]), "id": ids, "start": stop - widths, "stop": stop})

    def join(self) -> None:
        """Align the chunks that wait; each document gets its groups and counted pairs."""
        if not self.waiting:
            return
        self.db.register("a", self._table(0))
        self.db.register("b", self._table(1))
        self.db.execute(FIRST)
        for k, text, n in sorted(self.db.execute(GROUPS).fetchall()):
            self.waiting[k][0].groups.append(text)
            self.waiting[k][0].n_groups += n
        found = self.db.sql(PAIRS).to_arrow_table().combine_chunks()
        for k, pairs, times, links in zip(*(found.column(c).combine_chunks() if c != "links" else found.column(c).to_pylist() for c in ("doc", "pairs", "times", "links")), strict=True):
            doc = self.waiting[k.as_py()][0]
            doc.pairs.append(pairs.values.to_numpy())
            doc.times.append(times.values.to_numpy())
            doc.links += links
        self.waiting, self.bytes = [], 0


COLUMNS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>"


def _lists(parts: list[list[np.ndarray]], kind: type) -> pa.ListArray:
    sizes = [sum(map(len, p)) for p in parts]
    values = np.concatenate([x for p in parts for x in p] or [np.empty(0)]).astype(kind)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values))


def _batch(docs: list[Open]) -> pa.RecordBatch:
    longs = [[d.row for d in docs], [d.doc_id for d in docs], [d.tokens[0] for d in docs], [d.tokens[1] for d in docs], [d.n_groups for d in docs], [d.links for d in docs]]
    texts = pa.array(["".join(d.groups).removesuffix(";") for d in docs], pa.string())
    lists = [_lists([d.pairs for d in docs], np.int64), _lists([d.times for d in docs], np.int32)]
    return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in longs), texts, *lists], names=[c.split()[0] for c in COLUMNS.split(", ")])


def _align(first: str, second: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joiner = Joiner(*held(f"tokenizers {first} {second}", lambda: (ByteLevel(first), Pieces(second))))
        row, docs, size = TaskContext.get().partitionId() << 33, [], 0
        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                docs.append(Open(row, doc_id))
                row += 1
                if text:
                    joiner.add(docs[-1], text)
                    size += len(text)
                if size >= SLICE_BYTES:
                    joiner.join()
                    yield _batch(docs)
                    docs, size = [], 0
        joiner.join()
        joiner.db.close()
        if docs:
            yield _batch(docs)

    return run


def align(docs: DataFrame, first: str | None = None, second: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row a document: numbers of tokens, groups and links, the groups as ``a1,a2|b1;a3|b2,b3``, and its linked
    pairs of ids (first id in the upper half of a long) with how often each is linked; a pair of a long text may come twice.
    """
    known = default_tokenizers() if first is None or second is None else (first, second)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_align(first or known[0], second or known[1]), COLUMNS)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n (links of the corpus that hold it) and best (whether no other first id is linked to the second more often)."""
    partial = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("x.pairs", "x.times")
    counts = partial.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("n"))
    # a second id has as many rows as the first vocabulary has ids, at most
    most = F.max("n").over(Window.partitionBy(F.col("pair").bitwiseAND(F.lit(2**32 - 1))))
    return counts.select("pair", "n", (F.col("n") == most).alias("best"))


def scores(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """row, n_best and count_sum of the documents of a stored table that have links, by a stored table of counts."""
    links = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    if counts.count() <= MOST_BROADCAST:
        found = links.join(F.broadcast(counts), "pair")
    else:
        found = attach(links, ["pair"], counts, ["row"])
    return found.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    aligned = stored(align(table(spark, sf_dir, "documents")).withColumn("groups_sha256", digest).drop("groups"), "alignments")
    counts = stored(pair_counts(aligned), "pair-counts")
    whole = aligned.drop("pairs", "times").join(scores(aligned, counts), "row", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")]
    return whole.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256")


QUERIES = {"op13_token_alignment": op13_token_alignment}
