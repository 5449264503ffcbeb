"""Merkle manifest of a dataset: one leaf a row, a subtree per group, a root over the groups, a proof per row.

Rows are range-sorted by group and order, and the number of rows that each partition has of each
group gives every row its place in its group by a prefix sum. A task then builds every subtree that
is complete and aligned inside its partition: a node is made where all its children are. The nodes
at ragged edges, at most 2 x 15 a level for a group's stretch of a partition, are shuffled by
coordinate (group, level, place / 16) and finish the upper levels, a level a job. On the way down each of
them gets the siblings above it, and a second pass over the sorted partitions puts local and upper
siblings together into one proof per row. The subroots are rows of a second tree of the same kind.

Texts are read once and are never shuffled: a sorted row is a digest, its group and its order. A
group of any size spreads over as many partitions as its rows fill, identical rows included. The
tables between jobs lie in the shared folder, so places stay what they were when a task is repeated.

Defined results: a null field is written ``-``, any other one as its UTF-8 byte count, a colon and the value,
so an empty text differs from a null one; a null group comes first, then groups in byte order; a null
order value comes first; rows of equal order follow by leaf, and identical rows each have a place of
their own; an empty table gives no rows; extra columns are ignored unless they are carried, and
carried names may clash with nothing but the four result columns, which raises an error.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftgate.llm.work import shuffle_partitions, stored, table

#: Children of a node.
FAN = 16
#: Rows of a sorted partition, about.
PART_ROWS = 100_000
#: Rows of a sorted partition at least, where there are that many.
LEAST_ROWS = 1000
#: Rows that leave a worker at a time; each has several kilobytes of siblings.
OUT_ROWS = 500

SIDE = "struct<left:string,right:string>"
RESULT = ("leaf", "subroot", "root", "proof")
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def written(field: str | Column) -> Column:
    """A field of a leaf: ``-`` for null, else byte count, colon and value."""
    value = (F.col(field) if isinstance(field, str) else field).cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(*fields: str | Column) -> Column:
    return F.sha2(F.concat(*map(written, fields)), 256)


def fold(leaf: str | Column, proof: str | Column) -> Column:
    """The root that a leaf and the siblings of its proof give."""
    return F.aggregate(proof, leaf if isinstance(leaf, Column) else F.col(leaf), lambda node, side: F.sha2(F.concat(side["left"], node, side["right"]), 256))


def proof_digest(proof: str | Column) -> Column:
    """SHA-256 of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda side: F.concat(side["left"], side["right"])), ""), 256)


def _node(children: Sequence[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def climb(first: int, nodes: list[str], n: int) -> list[tuple[int, list[str], int]]:
    """Levels (first place, nodes, nodes of the whole group) that a stretch of a group's leaves completes."""
    levels = [(first, nodes, n)]
    while n > 1:
        end, low = first + len(nodes), -(-first // FAN)
        high = -(-n // FAN) if end == n else end // FAN
        if high <= low:
            break
        nodes = [_node(nodes[FAN * p - first : FAN * p - first + FAN]) for p in range(low, high)]
        first, n = low, -(-n // FAN)
        levels.append((first, nodes, n))
    return levels


def _ragged(levels: list[tuple[int, list[str], int]]) -> Iterator[tuple[int, int, int, str]]:
    """(level, place, nodes of the level, digest) of nodes whose parent the stretch doesn't complete."""
    for level, (first, nodes, n) in enumerate(levels):
        low, above = (levels[level + 1][0], len(levels[level + 1][1])) if level + 1 < len(levels) else (0, 0)
        for k, digest in enumerate(nodes):
            if not low <= (first + k) // FAN < low + above:
                yield level, first + k, n, digest


def _path(levels: list[tuple[int, list[str], int]], upper: dict[tuple[int, int], list[dict]], over: list[list[dict]], level: int, k: int) -> list[dict]:
    """Siblings above node ``k`` of a level, where ``over`` has those above the next level's nodes."""
    first, nodes, _ = levels[level]
    place = first + k
    parent = place // FAN - (levels[level + 1][0] if over else 0)
    if not 0 <= parent < len(over):
        return upper[level, place]
    run = FAN * (place // FAN) - first
    return [{"left": "".join(nodes[run:k]), "right": "".join(nodes[k + 1 : run + FAN])}, *over[parent]]


def _paths(levels: list[tuple[int, list[str], int]], upper: dict[tuple[int, int], list[dict]]) -> Iterator[list[dict]]:
    """The siblings of each leaf of a stretch from its level to the root, made when asked for."""
    over: list[list[dict]] = []
    for level in range(len(levels) - 1, 0, -1):
        over = [_path(levels, upper, over, level, k) for k in range(len(levels[level][1]))]
    return (_path(levels, upper, over, 0, k) for k in range(len(levels[0][1])))


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaves by part, group and place -> ragged nodes: part, grp, level, place, n, digest."""
    out: list[tuple] = []

    def close(key: tuple | None, leaves: list[str]) -> None:
        if key:
            part, grp, first, size = key
            out.extend((part, grp, *node) for node in _ragged(climb(first, leaves, size)))

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["part", "grp", "level", "place", "n", "digest"])

    key, leaves = None, []
    for b in batches:
        for part, grp, place, size, leaf in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
            if key is None or (part, grp) != key[:2]:
                close(key, leaves)
                key, leaves = (part, grp, place, size), []
            leaves.append(leaf)
        if len(out) >= 10_000:
            yield batch()
    close(key, leaves)
    if out:
        yield batch()


def _prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ragged nodes with what is above them, then leaves, by part and group -> carried columns, leaf, subroot, root, proof.

    Every leaf gives one row, in the order of the stream; rows wait until their group's stretch is whole.
    """
    waiting: deque[pa.RecordBatch] = deque()
    closed: deque[tuple[Iterator[list[dict]], str, str]] = deque()
    free = 0  # rows whose stretch is whole and that haven't left yet
    key, upper, roots, first, size, leaves = None, {}, ("", ""), 0, 0, []

    def close() -> int:
        if leaves:
            closed.append((_paths(climb(first, leaves, size), upper), *roots))
        return len(leaves)

    def take(rows: int) -> tuple[list, list, list]:
        proofs, subroots, tops = [], [], []
        while len(proofs) < rows:
            source, subroot, root = closed[0]
            some = list(islice(source, rows - len(proofs)))
            if not some:
                closed.popleft()
            proofs += some
            subroots += [subroot] * len(some)
            tops += [root] * len(some)
        return proofs, subroots, tops

    def leave() -> Iterator[pa.RecordBatch]:
        nonlocal free
        while waiting and waiting[0].num_rows <= free:
            rows = waiting.popleft()
            free -= rows.num_rows
            for k in range(0, rows.num_rows, OUT_ROWS):
                part = rows.slice(k, OUT_ROWS)
                proofs, subroots, tops = take(part.num_rows)
                made = [pa.array(subroots, pa.string()), pa.array(tops, pa.string()), pa.array(proofs, pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])))]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, "subroot", "root", "proof"])

    for b in batches:
        # the carried columns stand in one struct, so that their names can't clash with those of the pass
        carried = b.column("carried").filter(b.column("is_leaf"))
        leaf = b.column("digest").filter(b.column("is_leaf"))
        waiting.append(pa.RecordBatch.from_arrays([carried, leaf], names=["carried", "leaf"]))
        names = ("part", "grp", "is_leaf", "level", "place", "n", "digest", "subroot", "root", "path")
        for part, grp, is_leaf, level, place, n, digest, subroot, root, path in zip(*(b.column(c).to_pylist() for c in names), strict=True):
            if (part, grp) != key:
                free += close()
                key, upper, leaves = (part, grp), {}, []
            if not is_leaf:
                upper[level, place], roots = path, (subroot, root)
                continue
            if not leaves:
                first, size = place, n
            leaves.append(digest)
        yield from leave()
    free += close()
    yield from leave()


@dataclass
class Tree:
    """The stored tables of one tree: placed leaves, ragged nodes, runs by level and the top of each group."""

    placed: DataFrame
    ragged: DataFrame
    runs: list[DataFrame]
    tops: DataFrame
    parts: int


def grow(leaves: DataFrame, order: Sequence[str]) -> Tree:
    """Build the tree of a stored table with ``grp``, order columns, ``leaf`` and ``carried``."""
    spark = leaves.sparkSession
    rows = leaves.count()
    # few rows, such as those of most trees over groups, stay together, which leaves no ragged nodes
    parts = max(-(-rows // PART_ROWS), min(shuffle_partitions(spark), -(-rows // LEAST_ROWS)), 1)
    by = ["grp", *order, "leaf", "tie"]
    sorted_ = leaves.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parts, *by).sortWithinPartitions(*by)
    # ids grow with the partition and inside it, so they follow the whole order
    dealt = stored(sorted_.select("grp", "leaf", "carried", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("seq")), "merkle-sorted")
    counts = dealt.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("rows"), F.min("seq").alias("least"))
    before = F.sum("rows").over(Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("grp", "part", "least", F.coalesce(before, F.lit(0)).alias("before"), F.sum("rows").over(Window.partitionBy("grp")).alias("n"))
    placed = stored(dealt.join(offsets, ["grp", "part"]).select("part", "grp", (F.col("before") + F.col("seq") - F.col("least")).alias("place"), "n", "leaf", "carried"), "merkle-placed")
    stretches = placed.select("part", "grp", "place", "n", "leaf").repartition(parts, "part").sortWithinPartitions("part", "grp", "place")
    ragged = stored(stretches.mapInArrow(_grow, "part int, grp string, level int, place long, n long, digest string"), "merkle-ragged")
    # groups that one partition holds whole need no level here
    largest = ragged.where("n > 1").agg(F.max(F.col("n") * F.pow(F.lit(FAN), "level").cast("long"))).first()[0] or 1
    runs, tops, level = [], ragged.where("n = 1").select("grp", "digest"), 0
    made = ragged.select("grp", "place", "n", "digest", "part").limit(0)
    while largest > 1:
        here = ragged.where(F.col("level") == level).select("grp", "place", "n", "digest", "part").unionByName(made).where("n > 1")
        # at most sixteen rows a run, by the coordinate of its parent
        run = here.groupBy("grp", F.floor(F.col("place") / FAN).alias("parent")).agg(F.array_sort(F.collect_list(F.struct("place", "digest", "part"))).alias("run"), F.ceil(F.max("n") / FAN).alias("n"))
        runs.append(stored(run.withColumn("digest", F.sha2(F.array_join("run.digest", ""), 256)), f"merkle-level-{level + 1}"))
        made = runs[-1].select("grp", F.col("parent").alias("place"), "n", "digest", F.lit(None).cast("int").alias("part"))
        tops = tops.unionByName(made.where("n = 1").select("grp", "digest"))
        largest, level = -(-largest // FAN), level + 1
    return Tree(placed, ragged, runs, tops, parts)


def prove(tree: Tree, above: DataFrame) -> DataFrame:
    """carried, leaf, subroot, root and proof of every leaf; ``above`` has, by ``grp``, the path and roots above its top."""
    nothing = tree.ragged.where("n = 1").select("part", "grp", "level", "place")
    edges = nothing.join(above, "grp").select("part", "grp", "level", "place", "path", "subroot", "root")
    from_above = None
    for level in range(len(tree.runs) - 1, -1, -1):
        run = tree.runs[level].select("grp", "parent", "run", "n")
        up = run.where("n = 1").join(above, "grp").select("grp", "run", "path", "subroot", "root")
        if from_above is not None:
            rest = run.where("n > 1").join(from_above.withColumnRenamed("place", "parent"), ["grp", "parent"])
            up = up.unionByName(rest.select("grp", "run", "path", "subroot", "root"))
        child = up.select("grp", "run", "path", "subroot", "root", F.explode("run").alias("child"))
        sides = [F.array_join(F.filter("run", keep)["digest"], "").alias(name) for name, keep in (("left", lambda x: x["place"] < F.col("child.place")), ("right", lambda x: x["place"] > F.col("child.place")))]
        child = stored(child.select("grp", F.col("child.part").alias("part"), F.col("child.place").alias("place"), F.concat(F.array(F.struct(*sides)), "path").alias("path"), "subroot", "root"), f"merkle-paths-{level}")
        edges = edges.unionByName(child.where("part is not null").select("part", "grp", F.lit(level).alias("level"), "place", "path", "subroot", "root"))
        from_above = child.where("part is null").drop("part")
    kind = tree.placed.schema["carried"].dataType
    null = lambda t: F.lit(None).cast(t)
    leaves = tree.placed.select("part", "grp", F.lit(True).alias("is_leaf"), F.lit(0).alias("level"), "place", "n", F.col("leaf").alias("digest"), null("string").alias("subroot"), null("string").alias("root"), null(f"array<{SIDE}>").alias("path"), "carried")
    nodes = edges.select("part", "grp", F.lit(False).alias("is_leaf"), "level", "place", null("long").alias("n"), null("string").alias("digest"), "subroot", "root", "path", null(kind).alias("carried"))
    rows = leaves.unionByName(nodes).repartition(tree.parts, "part").sortWithinPartitions("part", "grp", "is_leaf", "place")
    return rows.mapInArrow(_prove, f"carried {kind.simpleString()}, leaf string, subroot string, root string, proof array<{SIDE}>")


def manifest(docs: DataFrame, fields: Sequence[str | Column] = FIELDS, group: str = "source", order: Sequence[str] = ("doc_id",), carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``carry``, then leaf, subroot, root and proof (array of left and right siblings, from the leaf up) of every row."""
    if clash := {c.lower() for c in carry} & set(RESULT):
        raise ValueError(f"carried columns can't be named {sorted(clash)}")
    named = [F.col(c).alias(f"order_{k}") for k, c in enumerate(order)]
    # null first: '-' is less than '='
    grp = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-")).alias("grp")
    leaves = stored(docs.select(grp, *named, leaf_digest(*fields).alias("leaf"), F.struct(*carry).alias("carried")), "merkle-leaves")
    by_group = grow(leaves, [f"order_{k}" for k in range(len(order))])
    subroots = stored(by_group.tops.select(F.lit("").alias("grp"), F.col("grp").alias("order_0"), F.col("digest").alias("leaf"), F.struct("grp").alias("carried")), "merkle-subroots")
    whole = grow(subroots, ["order_0"])
    nothing = whole.tops.select("grp", F.array().cast(f"array<{SIDE}>").alias("path"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    above = prove(whole, nothing).select("carried.grp", F.col("proof").alias("path"), F.col("leaf").alias("subroot"), "root")
    return prove(by_group, stored(above, "merkle-above")).select("carried.*", *RESULT)


CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of documents, and what its proofs say of rows some of which were tampered with."""
    docs = table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long"))
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    changed = F.when(chosen, leaf_digest("doc_id", "source", "lang", "n_chars", F.translate("text", CAPITALS, SMALL)))
    rows = manifest(docs.withColumn("changed", changed), carry=("doc_id", "changed"))
    folded = rows.select("doc_id", "leaf", "subroot", "root", proof_digest("proof").alias("proof_sha256"), fold(F.coalesce("changed", "leaf"), "proof").alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


_H = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = " || ".join(_H.format(c) for c in ("doc_id", "source", "lang", "n_chars"))

SQL = {
    "op12_merkle_manifest": f"""
WITH RECURSIVE crc AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, [ord(x)::BIGINT FOR x IN string_split(doc_id::VARCHAR, '')]),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda s, z: xor(s >> 1, (s & 1) * 3988292384)))) AS crc
  FROM documents
), leaves AS (
  SELECT doc_id, source, sha256({_LEAF} || {_H.format("text")}) AS leaf,
         CASE WHEN crc % 5 = 0 THEN sha256({_LEAF} || {_H.format(f"translate(text, '{CAPITALS}', '{SMALL}')")}) END AS changed
  FROM crc
), placed AS (
  SELECT *, row_number() OVER () AS r, coalesce('=' || source, '-') AS grp, count(*) OVER (PARTITION BY source) AS n,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place
  FROM leaves
), lower_part AS (
  SELECT r, grp, place, n, leaf AS node, coalesce(changed, leaf) AS fold, '' AS proof FROM placed
  UNION ALL
  SELECT u.r, u.grp, u.place // 16, (u.n + 15) // 16, sha256(string_agg(m.node, '' ORDER BY m.place)),
         sha256(coalesce(string_agg(m.node, '' ORDER BY m.place) FILTER (m.place < u.place), '') || u.fold || coalesce(string_agg(m.node, '' ORDER BY m.place) FILTER (m.place > u.place), '')),
         u.proof || coalesce(string_agg(m.node, '' ORDER BY m.place) FILTER (m.place <> u.place), '')
  FROM lower_part u JOIN (SELECT DISTINCT grp, place, node FROM lower_part) m ON m.grp = u.grp AND m.place // 16 = u.place // 16
  WHERE u.n > 1 GROUP BY u.r, u.grp, u.place, u.n, u.fold, u.proof
), tops AS (
  SELECT grp, node, row_number() OVER (ORDER BY grp) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT grp, node FROM lower_part WHERE n = 1)
), upper_part AS (
  SELECT l.r, t.place, t.n, l.node AS subroot, l.node, l.fold, l.proof FROM lower_part l JOIN tops t ON t.grp = l.grp WHERE l.n = 1
  UNION ALL
  SELECT u.r, u.place // 16, (u.n + 15) // 16, u.subroot, sha256(string_agg(m.node, '' ORDER BY m.place)),
         sha256(coalesce(string_agg(m.node, '' ORDER BY m.place) FILTER (m.place < u.place), '') || u.fold || coalesce(string_agg(m.node, '' ORDER BY m.place) FILTER (m.place > u.place), '')),
         u.proof || coalesce(string_agg(m.node, '' ORDER BY m.place) FILTER (m.place <> u.place), '')
  FROM upper_part u JOIN (SELECT DISTINCT place, node FROM upper_part) m ON m.place // 16 = u.place // 16
  WHERE u.n > 1 GROUP BY u.r, u.place, u.n, u.subroot, u.fold, u.proof
)
SELECT p.doc_id, p.leaf, u.subroot, u.node AS root, sha256(u.proof) AS proof_sha256, u.fold AS folded_root, u.fold = u.node AS verified
FROM placed p JOIN upper_part u ON u.r = p.r AND u.n = 1"""
}
QUERIES = {"op12_merkle_manifest": op12_merkle_manifest}
