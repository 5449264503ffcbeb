import collections
import itertools
import random
import re

import numpy as np
import pytest

from driftgate.llm import components as cc
from driftgate.llm import exact_dedup as ed
from driftgate.llm import minhash_dedup as md

DOCS = "doc_id long, text string, lang string, _salt string, mark string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, None, "s", "m") for r in rows], DOCS)


def test_cuckoo_index_inserts_deletes_and_grows():
    rng = random.Random(1)
    index, live = ed.CuckooIndex(2), {}
    for step in range(6000):
        key = rng.randrange(2500).to_bytes(4, "little") * 8
        if rng.random() < 0.3:
            assert index.delete(key) == (live.pop(key, None) is not None)
        else:
            live[key] = index.insert(key)
        if step % 500 == 0:
            assert all(index.find(k) == v for k, v in live.items())
    assert index.live == len(live) and index.find(b"x" * 32) == -1


def test_cuckoo_verifies_keys_with_one_fingerprint():
    index = ed.CuckooIndex(2)
    keys = [b"\x01\x02" + b"\x00" * 8 + bytes([k]) * 22 for k in range(40)]
    assert [index.insert(k) for k in keys[:6]] == list(range(6))
    assert index.find(keys[30]) == -1


def test_exact_dedup_edge_cases(spark):
    rows = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b"), (5, "b"), (None, "c"), (7, "c"), (8, "x" * 200_000)]
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in ed.exact_dedup(docs(spark, rows)).collect()), key=str)
    want = sorted([(1, 2, 2, False), (2, 2, 2, True), (3, 4, 2, False), (4, 4, 2, True), (5, 5, 2, True), (5, 5, 2, False), (None, 7, 2, False), (7, 7, 2, True), (8, 8, 1, True)], key=str)
    assert got == want
    kept = ed.keep_exact(docs(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "_salt", "mark"] and sorted(r.doc_id for r in kept.collect()) == [2, 4, 5, 7, 8]
    assert ed.exact_dedup(docs(spark, [(1, "a")]).limit(0)).count() == 0


def test_live_digests(spark):
    left = ed.live_digests(docs(spark, [(1, "a"), (2, "a"), (3, "b"), (4, None)]), docs(spark, [(1, "a"), (2, "b"), (9, "zz")]))
    assert sorted(r.copies for r in left.collect()) == [1, 1]


def brute(rows, percent=85):
    sets = {}
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) if len(words) > 4 else frozenset([tuple(words)] if words else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def family(seed=3):
    """Near copies with edits of several strengths, exact copies, short and empty texts, capitals."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for base in range(6):
        text = [word() for _ in range(rng.choice([7, 40, 160]))]
        for copy in range(25):
            own = list(text)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                own[rng.randrange(len(own))] = word()
            rows.append((base * 100 + copy, " ".join(own).upper() if copy % 7 == 0 else "\n".join(own)))
    return [*rows, (900, None), (901, ""), (902, "  \t"), (903, "one two"), (904, "One  two"), (905, "ünï Ö"), (906, "ünï ö")]


@pytest.mark.parametrize(("blocks", "most", "sent"), [(1500, 24, 10**6), (8, 24, 0), (8, 1, 10**6)])
def test_near_duplicates_agree_with_brute_force(spark, monkeypatch, blocks, most, sent):
    for name, value in (("BLOCK_DOCS", blocks), ("MOST_BLOCKS", most), ("MOST_BROADCAST", sent)):
        monkeypatch.setattr(md, name, value)
    rows = family()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in md.near_duplicates(docs(spark, rows)).collect()}
    assert got == brute(rows)


def test_links_are_the_same_for_any_block_size(spark, monkeypatch):
    """At 30 percent many pairs share no bucket; the pairs compared must not follow from block sizes."""
    rows = family(seed=11)
    sets = {i: md.shingles(t) for i, t in rows}
    keys = {i: set(md.bands(h).tolist()) for i, h in sets.items() if len(h)}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    passed_over = 0
    for a, b in itertools.combinations(sorted(keys), 2):
        both = len(np.intersect1d(sets[a], sets[b]))
        if 100 * both >= 30 * (len(sets[a]) + len(sets[b]) - both) and both:
            if keys[a] & keys[b]:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
            else:
                passed_over += 1
    assert passed_over > 20
    for blocks, most in ((1500, 24), (4, 100), (4, 1)):
        monkeypatch.setattr(md, "BLOCK_DOCS", blocks)
        monkeypatch.setattr(md, "MOST_BLOCKS", most)
        got = {r.doc_id: r.component_id for r in md.near_duplicates(docs(spark, rows), 30).collect()}
        assert got == {i: find(i) for i in sets}


def test_repeated_ids_with_other_texts(spark):
    a, b = "a b c d e f g h i j k l", "m n o p q r s t u v w x"
    rows = [(3, a), (3, b), (4, a), (5, b), (1, "one of its own here, really")]
    for order in (rows, rows[::-1]):
        got = sorted((r.doc_id, r.component_id) for r in md.near_duplicates(docs(spark, order)).collect())
        assert got == [(1, 1), (3, 3), (3, 3), (4, 3), (5, 3)]


def test_stage_keeps_other_texts_of_repeated_ids(spark):
    x, y = "a b c d e f g h i j k l", "m n o p q r s t u v w x"
    stay = lambda rows: sorted(((r.doc_id, r.text) for r in md.keep_near(docs(spark, rows)).collect()), key=str)
    assert stay([(3, y), (5, y), (5, x)]) == [(3, y), (5, x)]
    # one id joins no unlike texts, and of copies one row stays
    assert stay([(3, x), (3, y), (4, x), (2, y)]) == [(2, y), (3, x)]
    assert stay([(None, x), (None, x), (7, x), (None, y), (None, "")]) == [(7, x), (None, ""), (None, y)]


def test_scratch_tables_go_and_lasting_ones_stay(spark):
    from driftgate.llm import work

    with work.scratch(spark) as lasting:
        inner = work.stored(spark.range(3), "inner")
        outer = lasting(inner.where("id > 0"), "outer")
    assert outer.count() == 2
    with pytest.raises(Exception, match="(?i)not.exist|doesn't exist|FileNotFound"):
        spark.read.parquet(inner.inputFiles()[0])


def test_near_duplicates_edge_cases(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (3, "z " * 60_000)]
    got = md.near_duplicates(docs(spark, rows)).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in got), key=str) == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (None, 1, True), (3, 3, True)], key=str)
    assert md.near_duplicates(docs(spark, rows).limit(0)).count() == 0
    assert md.keep_near(docs(spark, [(1, "a b c d e f"), (2, "a b c d e f")])).columns == ["doc_id", "text", "lang", "_salt", "mark"]


def test_min_max_estimates_similarity():
    a, b = (np.unique(md._mixed(np.arange(x, x + 1000, dtype=np.uint64))) for x in (0, 200))
    same = np.mean([np.mean(x == y) for x, y in zip(md.min_max(a), md.min_max(b), strict=True)])
    assert abs(same - 800 / 1200) < 0.1


def test_components(spark):
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(50)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(200)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in cc.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert collections.Counter(got.values())[0] == 50
