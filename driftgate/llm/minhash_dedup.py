"""Near-duplicate groups by min-max hashing, confirmed on full shingle sets.

A document's set holds the 64-bit hashes of its distinct five-word shingles. Each of ``PERMS``
permutations is evaluated once per shingle and gives two signature values, its minimum and its
maximum. A band is ``ROWS`` values: the first half of the bands takes minima, the second maxima, so
band k and band k + 16 look at the same six permutations from both ends. With 32 bands of 6, a pair
at similarity 0.85 shares no band with probability 3e-7.

Documents with the same set are one class from here on, represented by their least id. Classes that
share a band bucket are tied to the bucket's least class (one row per class and bucket, never a
pair of members), and the components of those ties are *families*: two classes that share any
bucket are in one family. Two classes are linked where they share a bucket and their full sets
overlap enough, whatever the size of their family; that size only decides where their texts meet. A
family meets in one task, a larger one is dealt out in blocks and each pair of blocks is a task, and
one of more than ``MOST_BLOCKS`` blocks meets bucket by bucket. A task returns a spanning forest of
the links it confirms; components of these links are the answer.

Only texts of family members are shuffled: up to ``MOST_BROADCAST`` members their ids are sent to
the scan of the texts, beyond that the texts are shuffled to them.

Defined results: documents without words have an empty set and link with nothing; a null id is
kept, has a null component and links with nothing; rows that repeat an id are judged each by its own
text, and groups that have the same least id are one; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgate.llm.components import components
from driftgate.llm.work import Recent, attach, fresh, held, stored, table

WORDS = 5
BANDS, ROWS = 32, 6
PERMS = BANDS * ROWS // 2
#: Texts and shingles that meet in one block of a task; a family of more blocks meets bucket by bucket.
BLOCK_DOCS, BLOCK_SHINGLES, MOST_BLOCKS = 1500, 1_500_000, 24
#: Ids of 8 bytes that are sent to every executor at most.
MOST_BROADCAST = 2_000_000
#: Words whose hashes a worker keeps.
KEPT_WORDS = 100_000

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_RANDOM = np.random.default_rng(0x5EED)
_FACTOR = _RANDOM.integers(0, 2**63, PERMS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _RANDOM.integers(0, 2**63, PERMS, dtype=np.uint64)
_PLACE = _RANDOM.integers(0, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = _RANDOM.integers(0, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x + _MIX[0]
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def _hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))


def _hashes() -> Recent:
    return held("word hashes", lambda: Recent(_hash, KEPT_WORDS))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles of the whole text."""
    words = _WORD.findall(text.translate(_LOWER) if text and text.isascii() else _ascii_lower(text or ""))
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes().__getitem__, words), np.uint64, len(words))
    n = min(len(h), WORDS)
    total = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        total += h[k : k + len(total)] * _PLACE[k]
    return np.unique(_mixed(total + np.uint64(n)))


def _ascii_lower(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def min_max(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minimum and maximum of each permutation over a set that isn't empty."""
    least = np.full(PERMS, np.iinfo(np.uint64).max, np.uint64)
    most = np.zeros(PERMS, np.uint64)
    for k in range(0, len(hashes), 2048):
        values = _FACTOR[:, None] * hashes[None, k : k + 2048] + _SHIFT[:, None]
        np.minimum(least, values.min(axis=1), out=least)
        np.maximum(most, values.max(axis=1), out=most)
    return least, most


def bands(hashes: np.ndarray) -> np.ndarray:
    """One signed 64-bit key per band: the first half from minima, the second from maxima."""
    values = np.concatenate(min_max(hashes)).reshape(BANDS, ROWS)
    return _mixed((values * _FOLD).sum(axis=1) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for k in range(0, batch.num_rows, 2000):
            sizes, marks, keys = [], [], []
            for text in batch.column(1).slice(k, 2000).to_pylist():
                found = shingles(text)
                sizes.append(len(found))
                marks.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                keys.append(bands(found) if len(found) else None)
            yield pa.RecordBatch.from_arrays([ids.slice(k, 2000), pa.array(sizes, pa.int64()), pa.array(marks, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "mark", "bands"])


def signatures(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, a digest of the whole set and its band keys, written once."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return stored(rows.mapInArrow(_sign, "doc_id long, n_shingles long, mark binary, bands array<long>"), "signatures")


class _Sets:
    """Exact links among the classes of one task that share a bucket, found through an inverted index of shingles."""

    def __init__(self, ids: list[int], sets: list[np.ndarray], block: list[int]):
        self.ids, self.sets, self.block = ids, sets, block
        self.ends: dict[tuple[int, int], np.ndarray] = {}
        place = {i: k for k, i in reversed(list(enumerate(ids)))}
        self.root = [place[i] for i in ids]  # several texts of an id are one node

    def find(self, k: int) -> int:
        while self.root[k] != k:
            self.root[k] = k = self.root[self.root[k]]
        return k

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.root[max(a, b)] = min(a, b)
        return True

    def candidates(self, a: int, b: int) -> bool:
        """Whether two sets share a bucket; most that are similar do so at the first permutations."""
        for first in range(0, PERMS, ROWS):
            for k in (a, b):
                if (k, first) not in self.ends:
                    perms = slice(first, first + ROWS)
                    values = _FACTOR[perms, None] * self.sets[k][None] + _SHIFT[perms, None]
                    self.ends[k, first] = np.stack([values.min(axis=1), values.max(axis=1)])
            if (self.ends[a, first] == self.ends[b, first]).all(axis=1).any():
                return True
        return False

    def links(self, least_percent: int) -> list[tuple[int, int]]:
        sizes = np.array([len(x) for x in self.sets], np.int64)
        order = np.argsort(sizes, kind="stable")
        out = []
        if len(order) <= 3:
            for a, b in itertools.combinations(range(len(order)), 2):
                if self._enough(len(np.intersect1d(self.sets[a], self.sets[b], assume_unique=True)), sizes[a], sizes[b], least_percent) and self.candidates(a, b) and self.join(a, b):
                    out.append((self.ids[a], self.ids[b]))
            return out
        # postings in the order of set sizes: values, then for each value the members that hold it
        member = np.repeat(np.arange(len(order)), sizes[order])
        values, place = np.unique(np.concatenate([self.sets[k] for k in order]), return_inverse=True)
        by_value = np.argsort(place, kind="stable")
        holders = member[by_value]
        first = np.concatenate(([0], np.cumsum(np.bincount(place, minlength=len(values)))))
        at = np.concatenate(([0], np.cumsum(sizes[order])))
        block = np.array(self.block)[order]
        across = len(set(self.block)) > 1
        for k in range(1, len(order)):
            own = place[at[k] : at[k + 1]]
            counts = _counts(holders, first, own, k, len(order))
            mine, theirs = sizes[order[k]], sizes[order[:k]]
            hits = np.flatnonzero(100 * counts[:k] >= least_percent * (mine + theirs - counts[:k]))
            for j in hits.tolist():
                if across and block[j] == block[k] or self.find(int(order[j])) == self.find(int(order[k])):
                    continue
                if self.candidates(int(order[j]), int(order[k])) and self.join(int(order[j]), int(order[k])):
                    out.append((self.ids[order[j]], self.ids[order[k]]))
        return out

    @staticmethod
    def _enough(both: int, a: int, b: int, least_percent: int) -> bool:
        return 100 * both >= least_percent * (a + b - both)


def _counts(holders: np.ndarray, first: np.ndarray, own: np.ndarray, below: int, n: int) -> np.ndarray:
    """How many of ``own`` each member holds."""
    start, length = first[own], first[own + 1] - first[own]
    counts = np.zeros(n, np.int64)
    ends = np.cumsum(length)
    for a in range(0, len(own), 4096):
        b = min(len(own), a + 4096)
        size = length[a:b]
        base = ends[a:b] - size - (ends[a] - length[a])
        where = np.arange(int(size.sum())) + np.repeat(start[a:b] - base, size)
        counts += np.bincount(holders[where], minlength=n)
    return counts


def _resolve(least_percent: int):
    """Rows sorted by task -> the links that each task confirms."""

    def rows(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            columns = [batch.column(k) for k in range(batch.num_columns)]
            keys = list(zip(*(columns[k].to_pylist() for k in range(3)), strict=True))
            ids, own = columns[3].to_pylist(), columns[4].to_pylist()
            for k, key in enumerate(keys):
                yield key, ids[k], own[k], columns[5][k].as_py()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for _, group in itertools.groupby(rows(batches), key=lambda r: r[0]):
            there = {}
            for _, i, block, text in group:
                own = shingles(text)
                there.setdefault((i, xxhash.xxh3_128_digest(own.tobytes())), (own, block))
            found = _Sets([i for i, _ in there], [x for x, _ in there.values()], [x for _, x in there.values()])
            for x, y in found.links(least_percent):
                a.append(min(x, y))
                b.append(max(x, y))
            if len(a) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _tasks(members: DataFrame) -> DataFrame:
    """(grp, id, n_shingles) -> (grp, i, j, id, own): the pairs of blocks in which a member meets others."""
    size = members.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_DOCS), F.ceil(F.col("s") / BLOCK_SHINGLES), F.lit(1)).cast("int")
    dealt = members.join(size.where("n > 1").select("grp", blocks.alias("blocks")), "grp")
    own = F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")).cast("int")
    dealt = dealt.select("grp", "id", own.alias("own"), "blocks")
    dealt = dealt.select("grp", "id", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return dealt.select("grp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "own")


def near_duplicates(docs: DataFrame, least_percent: int = 85, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    signed = signatures(docs, text, doc_id)
    classes = signed.where("mark is not null and doc_id is not null").groupBy("mark").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n_shingles"))
    classes = stored(classes, "classes")
    # one signature row per class: that of its least id
    own = signed.select(F.col("doc_id").alias("id"), "mark", "bands").join(classes, ["id", "mark"]).dropDuplicates(["id", "mark"])
    buckets = stored(own.select("id", "n_shingles", F.explode("bands").alias("bucket")), "buckets")
    # written, so that the join below reads it as it is and a hot bucket can be split
    least = stored(buckets.groupBy("bucket").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "least")
    shared = buckets.join(least, "bucket")
    families = components(shared.select(F.col("id").alias("a"), F.col("least").alias("b")))
    # every member of a family, its least one too
    members = families.select("id", F.col("component").alias("grp")).unionByName(families.select(F.col("component").alias("id"), F.col("component").alias("grp")).distinct())
    members = stored(members.join(classes.select("id", "n_shingles"), "id"), "members")
    extent = members.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    vast = extent.where((F.col("n") > BLOCK_DOCS * MOST_BLOCKS) | (F.col("s") > BLOCK_SHINGLES * MOST_BLOCKS)).select("grp")
    by_family = members.join(vast, "grp", "left_anti").select("grp", "id", "n_shingles")
    in_vast = members.join(vast, "grp", "left_semi").select("id")
    by_bucket = shared.join(in_vast, "id", "left_semi").select(F.col("bucket").alias("grp"), "id", "n_shingles")
    tasks = _tasks(by_family).withColumn("kind", F.lit(0)).unionByName(_tasks(by_bucket).withColumn("kind", F.lit(1)))
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    if members.count() <= MOST_BROADCAST:
        rows = rows.join(F.broadcast(members.select("id")), "id", "left_semi")
    task = F.xxhash64("kind", "grp", "i", "j")
    met = rows.join(tasks, "id").select(task.alias("task"), "i", "j", "id", "own", "text")
    dealt = met.repartition("task").sortWithinPartitions("task", "i", "j", "id")
    links = stored(dealt.mapInArrow(_resolve(least_percent), "a long, b long"), "links")
    linked = components(links)
    answer = classes.join(linked, "id", "left").select("mark", F.coalesce("component", "id").alias("component_id"))
    found = attach(signed.drop("bands"), ["mark"], answer, by=["doc_id"])
    component = F.coalesce("component_id", "doc_id")
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


#: Similarity in percent from which the pipeline takes documents for near-duplicates.
KEEP_PERCENT = 80


def keep_near(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each near-duplicate group, that of the least id; all columns kept.

    Where an id is null or comes twice, rows are numbered and take part by their numbers, so
    that no text is taken for another of its id; this writes the table once more. A null id comes after others.
    """
    repeated = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null")
    if repeated.isEmpty():
        dropped = near_duplicates(docs, KEEP_PERCENT).where("not kept").select("doc_id")
        return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
    number = fresh(docs, "row_number")
    rows = stored(docs.withColumn(number, F.monotonically_increasing_id()), "near-rows")
    groups = near_duplicates(rows, KEEP_PERCENT, doc_id=number).select(F.col("doc_id").alias(number), F.col("component_id").alias("_component"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", number)).alias("_first")
    kept = rows.select(number, "doc_id").join(groups, number).groupBy("_component").agg(first).select(F.col("_first")[number].alias(number))
    return rows.join(kept, number, "left_semi").select(*docs.columns)


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = {
    "op8_minhash_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS ss FROM w),
u AS (SELECT doc_id, unnest(ss) AS x FROM s),
n AS (SELECT doc_id, len(ss) AS n FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 85 * (na.n + nb.n - common)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS reached FROM n UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reached)
SELECT n.doc_id, n.n AS n_shingles, min(reached) AS component_id, n.doc_id = min(reached) AS kept FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id, n.n"""
}
QUERIES = {"op8_minhash_dedup": op8_minhash_dedup}
