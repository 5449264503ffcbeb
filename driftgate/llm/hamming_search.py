"""Exact k nearest binary codes by incremental multi-index hashing.

A code is as wide as the longest vector, in words of 64 bits. Each word is cut into eight segments
(four wider ones for tables of many codes) and every distinct code is listed under each of its
segment values. A query looks at segment values within radius 0, then exactly 1, 2 and so on. After
radius s all codes within m (s + 1) - 1 bits have been met, since a code farther than s in all m
segments is at least m (s + 1) bits away. A query leaves the search when its kth verified distance
is covered; the others go on to the next radius, at most to a segment's width, where everything has been met.

Rows with the same code are one class with its k + 1 least ids, which suffice for any answer, so a
vector with many copies is met once. Buckets and the queries that look into them come in chunks of
bounded size: a chunk of a bucket meets each chunk of its queries once, in one sweep, and returns at
most k + 1 classes a query (by distance and least id), so candidates are never rows of a join.

Rank ties are broken by id. Defined results: null vectors, null elements and null ids take no part
in the index or as queries; elements that a shorter vector lacks count as not positive; rows that
repeat an id are met as often as they are there; fewer than k other rows give all of them; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftgate.llm.work import attach, stored, table

#: Bits of a word; codes of a bucket and queries that meet at a time.
WORD, CHUNK, ASKING = 64, 512, 512
#: Segments of a word, up to so many distinct codes and beyond.
FEW, SEGMENTS_FEW, SEGMENTS_MANY = 4_000_000, 8, 4


def sign_code(vector: str, bits: int) -> Column:
    """Words of 64 bits, the first element's sign first; null for a null vector or element."""
    words = []
    for first in range(0, max(1, bits), WORD):
        part = F.slice(F.col(vector), first + 1, WORD)
        packed = F.aggregate(part, F.lit(0).cast("long"), lambda code, x: F.shiftleft(code, 1).bitwiseOR((x > 0).cast("long")))
        words.append(F.call_function("shiftleft", packed, F.lit(WORD) - F.size(part)))
        words[-1] = F.when(F.size(part) == 0, F.lit(0).cast("long")).otherwise(words[-1])
    # a shift by the whole width would be none, so words without elements are set apart above
    return F.when(F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull()), F.array(*words))


def _segment(code: str, per: int) -> Column:
    """Value of the segment that column ``segment`` names, of ``per`` a word."""
    width = WORD // per
    return F.expr(f"cast(shiftrightunsigned({code}[segment div {per}], cast(segment % {per} * {width} as int)) & {2**width - 1} as int)")


def _verify(keep: int, words: int):
    """(queries, codes, least ids, sizes) of two chunks that meet -> the nearest classes of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list[np.ndarray]] = [[], [], [], []]
            for k in range(batch.num_rows):
                queries, codes = (np.asarray(batch.column(c)[k].values).reshape(-1, words) for c in (0, 1))
                least, weight = (np.asarray(batch.column(c)[k].values) for c in (2, 3))
                away = np.zeros((len(queries), len(codes)), np.int32)
                for w in range(words):
                    away += np.bitwise_count((queries[:, w, None] ^ codes[None, :, w]).view(np.uint64))
                order = np.argsort(least, kind="stable")
                # by distance, then least id: a stable sort of columns in the order of ids
                near = order[np.argsort(away[:, order], axis=1, kind="stable")[:, :keep]]
                row = np.repeat(np.arange(len(queries)), near.shape[1])
                pick = near.ravel()
                for part, value in zip(found, (queries[row], away[row, pick], least[pick], weight[pick]), strict=True):
                    part.append(value)
            if found[0]:
                query, distance, ids, n = (np.concatenate(x) for x in found)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, query.size + 1, words, dtype=np.int32)), pa.array(query.ravel()))
                yield pa.RecordBatch.from_arrays([lists, pa.array(distance), pa.array(ids), pa.array(n)], names=["query", "distance", "least", "n"])

    return run


def _chunked(rows: DataFrame, code: str, size: int) -> DataFrame:
    """Rows with the chunk, of ``size`` rows or so, that they belong to in their bucket."""
    extent = rows.groupBy("segment", "value").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("chunks"))
    return attach(rows, ["segment", "value"], extent, by=[code]).withColumn("chunk", F.pmod(F.xxhash64(code), F.col("chunks"))).drop("chunks")


def nearest(rows: DataFrame, is_query: Column, k: int = 10, row_id: str = "vec_id", code: Column | None = None, vector: str = "embedding") -> DataFrame:
    """query_id, rank, neighbor_id, distance: the k nearest other rows of each query row.

    ``code`` gives words of 64 bits where codes exist already; else the signs of ``vector`` are the code.
    """
    if code is None:
        code = sign_code(vector, rows.agg(F.max(F.size(vector))).first()[0] or 1)
    coded = rows.select(F.col(row_id).cast("long").alias("id"), code.alias("code"), F.coalesce(is_query, F.lit(False)).alias("asks")).where("id is not null and code is not null")
    coded = stored(coded, "codes")
    words = coded.agg(F.max(F.size("code"))).first()[0] or 1
    # row_number with a limit is cut down before the exchange, so a class sends k + 1 rows a task
    least = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    few = coded.withColumn("nth", least).where(F.col("nth") <= k + 1)
    classes = stored(few.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.min("id").alias("least"), F.count(F.lit(1)).cast("int").alias("n")), "classes")
    per = SEGMENTS_FEW if classes.count() <= FEW else SEGMENTS_MANY
    width, segments = WORD // per, per * words
    all_segments = F.explode(F.sequence(F.lit(0), F.lit(segments - 1)))
    listed = classes.select("code", "least", "n", all_segments.alias("segment")).withColumn("value", _segment("code", per))
    lists = (F.flatten(F.collect_list("code")).alias("codes"), F.collect_list("least").alias("leasts"), F.collect_list("n").alias("sizes"))
    index = stored(_chunked(listed, "code", CHUNK).groupBy("segment", "value", "chunk").agg(*lists).drop("chunk"), "segments")
    asked = coded.where("asks").select(F.col("code").alias("query")).distinct()
    active, done, best = stored(asked, "queries"), [], None
    spread = 0
    while True:
        masks = [sum(1 << b for b in bits) for bits in combinations(range(width), spread)]
        probes = active.select("query", all_segments.alias("segment")).withColumn("own", _segment("query", per))
        probes = probes.select("query", "segment", F.explode(F.array(*(F.lit(m) for m in masks))).alias("mask"), "own").select("query", "segment", F.col("own").bitwiseXOR(F.col("mask")).cast("int").alias("value"))
        asking = _chunked(probes, "query", ASKING).groupBy("segment", "value", "chunk").agg(F.flatten(F.collect_list("query")).alias("queries"))
        met = asking.join(index, ["segment", "value"]).select("queries", "codes", "leasts", "sizes")
        met = met.mapInArrow(_verify(k + 1, words), "query array<long>, distance int, least long, n int")
        if best is not None:
            met = met.unionByName(best.select("query", F.inline("top")))
        top = F.slice(F.array_sort(F.collect_set(F.struct("distance", "least", "n"))), 1, k + 1)
        ranked = met.groupBy("query").agg(top.alias("top"))
        # distance of the (k + 1)th row, the query row itself among them
        far = WORD * words + 1
        reached = F.expr(f"aggregate(top, named_struct('seen', 0, 'd', {far}), (a, x) -> if(a.seen > {k}, a, named_struct('seen', a.seen + x.n, 'd', if(a.seen + x.n > {k}, x.distance, {far}))))").getField("d")
        ranked = stored(ranked.withColumn("reached", reached), "nearest")
        covered = segments * (spread + 1) - 1
        done.append(ranked.where(F.col("reached") <= covered) if spread < width else ranked)
        if spread == width:
            break
        best = ranked.where(F.col("reached") > covered)
        active = best.select("query")
        if active.isEmpty():
            break
        spread += 1
    answers = done[0]
    for more in done[1:]:
        answers = answers.unionByName(more)
    flat = answers.select(F.col("query").alias("code"), F.posexplode("top").alias("place", "x")).select("code", "x.distance", "x.least")
    found = flat.join(classes.select("least", "ids"), "least")
    found = found.groupBy("code").agg(F.array_sort(F.flatten(F.collect_list(F.expr("transform(ids, i -> named_struct('distance', distance, 'id', i))")))).alias("near"))
    asking = coded.where("asks").select("id", "code")
    own = attach(asking, ["code"], found.select("code", F.expr(f"slice(near, 1, {k + 1})").alias("near")), by=["id"])
    # the query row itself is left out once; a class longer than k + 1 may not list it at all
    at = F.expr("array_position(near, named_struct('distance', 0, 'id', id))")
    others = F.expr(f"slice(if(at > 0, concat(slice(near, 1, cast(at - 1 as int)), slice(near, cast(at + 1 as int), {k + 1})), near), 1, {k})")
    return own.withColumn("at", at).select("id", F.posexplode(others).alias("place", "x")).select(F.col("id").alias("query_id"), (F.col("place") + 1).cast("long").alias("rank"), F.col("x.id").alias("neighbor_id"), F.col("x.distance").cast("long").alias("distance"))


def op3_hamming_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


SQL = {
    "op3_hamming_search": """
WITH d AS (
  SELECT q.vec_id AS query_id, r.vec_id AS neighbor_id,
         list_sum(list_transform(range(1, greatest(len(q.embedding), len(r.embedding)) + 1), lambda i: (coalesce(q.embedding[i] > 0, false) <> coalesce(r.embedding[i] > 0, false))::INT))::BIGINT AS distance
  FROM embeddings q JOIN embeddings r ON q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM d)
SELECT query_id, rank, neighbor_id, distance FROM n WHERE rank <= 10"""
}
QUERIES = {"op3_hamming_search": op3_hamming_search}
