"""Exact dedup by a cuckoo-filter index of live digests.

Each shuffle partition owns the digests that hash to it and indexes them in one cuckoo filter:
four slots a bucket, 16-bit fingerprints, two possible buckets a digest. A slot also names the
stored key behind it, so a fingerprint hit is verified against the whole digest in that slot; a
false hit never joins two texts. An insertion that finds no free slot after a bounded number of
moves doubles the table and refills it from the stored keys. Deletion clears the verified slot.

What stands for a text's content is its SHA-256, in the filter and where hits are verified.
``exact_dedup`` shuffles digests only; ``keep_exact`` sends the texts to the rows that stay. A text
that a third of all rows share is first counted by (digest, salt), so no task sees more than one
row per salt of it.

Defined results: a null text counts as empty; a null id never wins over another id; among rows
that repeat both id and text one is kept; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftgate.llm.work import fresh, salted, table

SLOTS = 4
MAX_MOVES = 200


class CuckooIndex:
    """Cuckoo filter whose slots point at stored keys; keys are digests of at least 16 bytes."""

    def __init__(self, buckets: int = 64):
        self.keys: list[bytes | None] = []
        self.live = 0
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints = array("H", bytes(2 * SLOTS * buckets))
        self.slots = array("q", bytes(8 * SLOTS * buckets))

    def _place(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[:2], "little") or 1
        first = int.from_bytes(key[2:10], "little") & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x9E3779B1 >> 3)) & self.mask

    def find(self, key: bytes) -> int:
        """Entry of a live key, or -1. Every fingerprint hit is compared with the stored key."""
        slot = self._slot(key)
        return self.slots[slot] if slot >= 0 else -1

    def _slot(self, key: bytes) -> int:
        mark, first, second = self._place(key)
        for bucket in (first, second):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.prints[slot] == mark and self.keys[self.slots[slot]] == key:
                    return slot
        return -1

    def insert(self, key: bytes) -> int:
        """Entry of the key, new or live already."""
        entry = self.find(key)
        if entry >= 0:
            return entry
        entry = len(self.keys)
        self.keys.append(key)
        self.live += 1
        if self.live > 0.9 * len(self.prints) or not self._store(entry):
            self._grow()
        return entry

    def delete(self, key: bytes) -> bool:
        slot = self._slot(key)
        if slot < 0:
            return False
        self.keys[self.slots[slot]] = None
        self.prints[slot] = 0
        self.live -= 1
        return True

    def _store(self, entry: int) -> bool:
        mark, bucket, other = self._place(self.keys[entry])
        for at in (bucket, other):
            for slot in range(at * SLOTS, at * SLOTS + SLOTS):
                if not self.prints[slot]:
                    self.prints[slot], self.slots[slot] = mark, entry
                    return True
        for move in range(MAX_MOVES):
            slot = other * SLOTS + (move * 7 + entry) % SLOTS
            self.prints[slot], mark = mark, self.prints[slot]
            self.slots[slot], entry = entry, self.slots[slot]
            other = self._other(other, mark)
            for free in range(other * SLOTS, other * SLOTS + SLOTS):
                if not self.prints[free]:
                    self.prints[free], self.slots[free] = mark, entry
                    return True
        return False

    def _grow(self) -> None:
        """Double until each stored key has a slot; the fingerprints alone could not be re-dealt."""
        buckets = self.mask + 1
        while True:
            buckets *= 2
            self._clear(buckets)
            if all(self._store(e) for e, key in enumerate(self.keys) if key is not None):
                return


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, _salt, top, n) -> the same rows with the winner and size of the whole group."""
    index, tops, sizes, seen = CuckooIndex(), [], [], []
    for batch in batches:
        digests, salts, top, n = (batch.column(k) for k in range(4))
        entries = []
        for key, t, k in zip(digests.to_pylist(), top.to_pylist(), n.to_pylist(), strict=True):
            entry = index.insert(key)
            if entry == len(tops):
                tops.append(t)
                sizes.append(k)
            else:
                sizes[entry] += k
                tops[entry] = t if tops[entry] is None else tops[entry] if t is None else max(t, tops[entry])
            entries.append(entry)
        seen.append((digests, salts, array("q", entries)))
    for digests, salts, entries in seen:
        yield pa.RecordBatch.from_arrays([digests, salts, pa.array([tops[e] for e in entries], pa.int64()), pa.array([sizes[e] for e in entries], pa.int64())], names=["digest", "_salt", "keep_id", "group_size"])


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; of equal texts the row with the largest id stays.
    """
    sha = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    rows = salted(docs.select(F.col(doc_id).cast("long").alias("doc_id"), sha.alias("text_sha256")), ["doc_id"]).withColumn("digest", F.unhex("text_sha256"))
    counted = rows.groupBy("digest", "_salt").agg(F.max("doc_id").alias("top"), F.count(F.lit(1)).alias("n"))
    groups = counted.repartition("digest").mapInArrow(_resolve, "digest binary, _salt int, keep_id long, group_size long")
    found = rows.join(groups, ["digest", "_salt"])
    # equal rows have one salt, so this window needs no exchange beyond the join's
    turn = F.row_number().over(Window.partitionBy("digest", "_salt", "doc_id").orderBy("text_sha256"))
    return found.withColumn("turn", turn).select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("turn") == 1)).alias("kept"), "text_sha256")


def _maintain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index, counts = CuckooIndex(), {}
    for batch in batches:
        for key, step in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            entry = index.insert(key)
            counts[entry] = counts.get(entry, 0) + step
    for entry, n in counts.items():
        if n <= 0:
            index.delete(index.keys[entry])
    live = [(index.keys[e], n) for e, n in counts.items() if index.keys[e] is not None]
    for k in range(0, len(live), 10_000):
        keys, n = zip(*live[k : k + 10_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(n, pa.int64())], names=["digest", "copies"])


def live_digests(inserted: DataFrame, deleted: DataFrame | None = None, text: str = "text") -> DataFrame:
    """The index after insertions and deletions of texts: digest and the copies still live.

    A deletion takes one copy; the digest leaves the filter with its last copy. Deleting a text
    that isn't there changes nothing below zero copies.
    """
    digest = F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("digest")
    changes = inserted.select(digest, F.lit(1).alias("step"))
    if deleted is not None:
        changes = changes.unionByName(deleted.select(digest, F.lit(-1).alias("step")))
    summed = salted(changes, [F.monotonically_increasing_id()]).groupBy("digest", "_salt").agg(F.sum("step").alias("step"))
    return summed.select("digest", "step").repartition("digest").mapInArrow(_maintain, "digest binary, copies long")


def keep_exact(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each text, all columns kept. Rows match by id and text digest."""
    names = [fresh(docs, n) for n in ("dedup_key", "dedup_sha", "dedup_turn")]
    key, sha = F.coalesce(F.col("doc_id"), F.lit(-(2**63))), F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    kept = exact_dedup(docs).where("kept").select(key.alias(names[0]), F.col("text_sha256").alias(names[1]))
    held = docs.withColumn(names[0], key).withColumn(names[1], sha).join(kept, names[:2], "left_semi")
    # a repeated row matches its one kept entry as often as it is there; the join has dealt it already
    turn = F.row_number().over(Window.partitionBy(*names[:2]).orderBy(F.lit(0)))
    return held.withColumn(names[2], turn).where(F.col(names[2]) == 1).select(*docs.columns)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = {
    "op1_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""
}
QUERIES = {"op1_exact_dedup": op1_exact_dedup}
