import hashlib
import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("driftgate.llm.registry")
from driftgate.llm import merkle_manifest as mm  # noqa: E402


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(*fields):
    return h(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def plain_tree(leaves):
    """The top, and for each leaf the (left, right) siblings of each level."""
    places, paths, level = list(range(len(leaves))), [[] for _ in leaves], list(leaves)
    while len(level) > 1:
        for k, p in enumerate(places):
            run = p // 16 * 16
            paths[k].append(("".join(level[run:p]), "".join(level[p + 1 : run + 16])))
            places[k] = p // 16
        level = [h(*level[k : k + 16]) for k in range(0, len(level), 16)]
    return level[0], paths


def plain(rows):
    """(doc_id, leaf, subroot, root, proof) of rows (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0], leaf_of(*r)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([leaf for _, leaf in sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))]) for g in names}
    root, above = plain_tree([trees[g][0] for g in names]) if names else ("", [])
    out = []
    for g, up in zip(names, above, strict=True):
        ordered = sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        out += [(d, leaf, trees[g][0], root, path + up) for (d, leaf), path in zip(ordered, trees[g][1], strict=True)]
    return out


def key(row):
    return repr(row)


def result(frame):
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, [(s.left, s.right) for s in r.proof]) for r in frame.collect()), key=key)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("cuts", [1, 2, 3, 7])
def test_stretches_and_their_ragged_nodes_give_the_whole_tree(cuts):
    draw = random.Random(cuts)
    for n in (1, 2, 15, 16, 17, 31, 256, 257, 300, 700):
        leaves = [h(str(k)) for k in range(n)]
        top, paths = plain_tree(leaves)
        edges = sorted({0, n, *(draw.randrange(n + 1) for _ in range(cuts))})
        stretches = [mm.climb(a, leaves[a:b], n) for a, b in zip(edges, edges[1:], strict=False)]
        ragged = {node[:2]: node for levels in stretches for node in mm._ragged(levels)}
        # no node is given by two stretches, and each stretch gives a bounded number
        assert len(ragged) == sum(1 for levels in stretches for _ in mm._ragged(levels))
        assert all(sum(1 for _ in mm._ragged(levels)) <= 30 * len(levels) for levels in stretches)
        # the path above a ragged node is that of any leaf below it
        upper = {(level, place): [{"left": a, "right": b} for a, b in paths[min(place * 16**level, n - 1)][level:]] for level, place in ragged}
        got = [[(s["left"], s["right"]) for s in path] for levels in stretches for path in mm._paths(levels, upper)]
        assert got == paths


def test_manifest_equals_plain_python(spark, monkeypatch):
    draw = random.Random(12)
    sources = [None, "", "a", "b", "é", "\U0001f600", "￿", *(f"s{k}" for k in range(40))]
    rows = [(draw.choice([None, 0, *range(-3, 900)]), "hot" if draw.random() < 0.4 else draw.choice(sources), draw.choice([None, "de"]), draw.choice([None, 5]), draw.choice([None, "", "Text", "tExt é"])) for _ in range(1500)]
    rows += [(7, "hot", "en", 1, "same")] * 600 + [(1, "single", None, None, None)]
    got = result(mm.manifest(spark.createDataFrame(rows, SCHEMA)))
    assert got == sorted(plain(rows), key=key)


def test_small_cases(spark):
    one = [(None, None, None, None, None)]
    (row,) = mm.manifest(spark.createDataFrame(one, SCHEMA)).collect()
    assert row.leaf == row.subroot == row.root == h("-----") and row.proof == []
    assert mm.manifest(spark.createDataFrame([], SCHEMA)).count() == 0
    # other columns don't matter, carried ones come along, clashes are refused
    wide = spark.createDataFrame([(1, "a", "x", 1, "t"), (2, "a", "x", 1, "t")], SCHEMA).withColumn("leaf", F.lit(1)).withColumn("part", F.lit("p")).withColumn("grp", F.lit("g"))
    assert sorted(mm.manifest(wide, carry=("doc_id", "part", "grp")).select("doc_id", "part", "grp").collect()) == [(1, "p", "g"), (2, "p", "g")]
    with pytest.raises(ValueError, match="leaf"):
        mm.manifest(wide, carry=("leaf",))


def test_any_change_is_noticed(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = mm.manifest(docs, carry=mm.FIELDS)
    good = rows.where(mm.fold("leaf", "proof") == F.col("root"))
    bad = rows.where(mm.fold(mm.leaf_digest("doc_id", "source", "lang", F.col("n_chars") + 1, "text"), "proof") == F.col("root"))
    assert good.count() == docs.count() and bad.count() == 0
