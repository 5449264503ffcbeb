import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftgate.llm import language_id as li
from driftgate.llm import mixing as mx
from driftgate.llm import toxicity as tx
from driftgate.llm.work import held_out, table

DOCS = "doc_id long, text string, lang string, score string, row long"
SF = "/root/testdata/sf0.01"


def auc(rows):
    bad, good = [s for s, y in rows if y], [s for s, y in rows if not y]
    return sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(bad) * len(good))


def test_held_out_matches_crc32(spark):
    rows = spark.range(60).select("id", held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in rows)
    assert not spark.range(1).select(held_out(F.lit(None).cast("long")).alias("h")).first().h


def test_toxicity_on_held_out_labels(spark):
    got = tx.op5_toxicity(spark, SF).join(table(spark, SF, "labels"), "doc_id").where("held_out").collect()
    assert auc([(r.score, r.toxic) for r in got]) > 0.85
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in got)


def test_toxicity_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, None, "", 1), (2, "", "en", "", 1), (None, "word " * 50_000 + "idiot", "en", "", 2), (4, "fine", "en", "", 1), (4, "fine", "en", "", 1)], DOCS)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = tx.score(docs, tx.fit(docs, none)).collect()
    assert len(got) == 5 and {r.score for r in got} == {0.0}
    rng = random.Random(2)
    rows = [(" ".join(rng.choice(["the", "of", "and", "to"]) for _ in range(30)) + (" awful" if k % 4 == 0 else ""), "en", int(k % 4 == 0)) for k in range(200)]
    scorer = tx.Scorer(tx.train(rows))
    long_text = "the of and to " * 12_000
    assert scorer.score(long_text + "awful")[0] > 0.7 > scorer.score(long_text)[0]
    assert scorer.score(None) == scorer.score("") and scorer.score("awful")[0] > 0.7
    model = tx.train(rows)
    shared = spark.sparkContext.broadcast(model)
    kept = docs.mapInArrow(tx._kept(shared), docs.schema)
    assert kept.columns == docs.columns and tx.score(docs.limit(0), model).count() == 0


def test_language_on_held_out_documents(spark):
    got = li.op6_language_id(spark, SF).join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) / len(got) > 0.95


def test_language_edge_cases(spark):
    docs = spark.createDataFrame([(1, "der und die das " * 30, "de", "", 1), (2, "the and of that " * 30, "en", "", 1), (3, None, "en", "", 1), (5, "12 34 !!", None, "", 1), (None, "und das", None, "", 1), (7, "the of " * 60_000, "en", "", 1), (7, "", "en", "", 1)], DOCS)
    got = li.identify(docs, li.learn(docs)).collect()
    assert len(got) == 7 and {r.lang_pred for r in got if r.doc_id in (3, 5)} == {"und"}
    nothing = li.identify(docs, li.learn(docs.limit(0)))
    assert {(r.lang_pred, r.score) for r in nothing.collect()} == {("und", 0.0)}


def test_ngrams_in_pieces(monkeypatch):
    import numpy as np

    text = "Ab  ab,c é 1ab x" * 9
    whole = li.ngrams(text)
    monkeypatch.setattr(li, "_PIECE", 4)
    parts = li.ngrams(text)
    assert np.array_equal(whole[0], parts[0]) and np.array_equal(whole[1], parts[1])


def test_mixing_meets_targets(spark):
    got = mx.op2_mixing(spark, SF)
    sums = got.agg(*(F.sum(F.col("rate") * F.col("tokens") * F.col(f"p_{d}")).alias(d) for d in mx.TARGETS), F.sum("tokens").alias("all"), F.min("rate").alias("low"), F.max("rate").alias("high"), F.max("fit_error").alias("error")).first()
    for d in mx.TARGETS:
        assert sums[d] / sums["all"] == pytest.approx(mx.TARGETS[d], abs=1e-4)
    assert 0 <= sums.low <= sums.high <= 4 and sums.error < 1e-4 and got.count() == table(spark, SF, "documents").count()


def test_posteriors_on_held_out_labels(spark):
    """Recall of the domains that have rows enough, and expected tokens against labelled tokens."""
    sf = "/root/testdata/sf0.1"
    labels = table(spark, sf, "labels")
    docs = table(spark, sf, "documents").join(labels.select("doc_id"), "doc_id", "left_semi")
    model = mx.fit(docs, labels, mx.label_domain())
    rows = mx.posteriors(docs, model).join(labels, "doc_id").where(held_out()).withColumn("domain", mx.label_domain()).where("domain is not null").collect()
    p, tokens = np.array([[r[f"p_{d}"] for d in model.domains] for r in rows]), np.array([r.tokens for r in rows])
    best = [model.domains[k] for k in p.argmax(1)]
    for k, d in enumerate(model.domains):
        own = np.array([r.domain == d for r in rows])
        if own.sum() > 100:
            assert np.mean([b == d for b, y in zip(best, own, strict=True) if y]) > 0.6
            assert (tokens * p[:, k]).sum() == pytest.approx(tokens[own].sum(), rel=0.35)


def _fitted(spark, p, tokens, weights, most):
    names = "abc"[: p.shape[1]]
    found = spark.createDataFrame([(k, int(n), *map(float, x)) for k, (n, x) in enumerate(zip(tokens, p, strict=True))], "doc_id long, tokens long, " + ", ".join(f"p_{c} double" for c in names))
    steps, error = mx.fit_rates(found, list(names), dict(zip(names, weights, strict=True)), most)
    rates = found.withColumn("rate", mx._rate([f"p_{c}" for c in names], steps, most)).orderBy("doc_id").select("rate").collect()
    return np.array([r.rate for r in rates]), error


@pytest.mark.parametrize(("weights", "met"), [([0.45, 0.35, 0.2], True), ([0.97, 0.02, 0.01], False)])
def test_rates_are_as_good_as_brute_force(spark, weights, met):
    """Targets within reach, with bounds active, and targets that four copies of all can't reach."""
    rng, most = np.random.default_rng(7), 4.0
    p = rng.dirichlet([0.25, 0.5, 0.5] if met else [0.02, 0.5, 0.5], 500)
    tokens, w = rng.integers(0, 300, 500), np.array(weights)
    got, error = _fitted(spark, p, tokens, weights, most)
    # least squares within bounds by very many plain gradient steps
    best, inverse = np.ones(500), np.linalg.pinv((p * tokens[:, None]).T @ p)
    for _ in range(30_000):
        best = np.clip(best - p @ (inverse @ ((best * tokens) @ p - tokens.sum() * w)), 0, most)
    off, least = ((r * tokens) @ p - tokens.sum() * w for r in (got, best))
    assert off @ inverse @ off <= 1.2 * (least @ inverse @ least) + 1e-6 * tokens.sum()
    assert error == pytest.approx(np.abs(off).max() / tokens.sum(), abs=1e-9) and (error < 0.001) == met
    assert got.min() >= 0 and got.max() <= most and ((got == 0) | (got == most)).any()


@pytest.mark.parametrize(("spread", "target"), [([0.3, 0.7], 0.1), ([0.1, 1.0], 0.05), ([0.02, 0.5], 0.3)])
def test_thinning_meets_its_shares_and_keeps_nearly_all_it_can(spark, spread, target):
    """Too much of the first domain, and too little of it, where the other one has to go."""
    rng = np.random.default_rng(7)
    p, tokens = rng.dirichlet(spread, 2000), rng.integers(0, 300, 2000)
    got, error = _fitted(spark, p, tokens, [target, 1 - target], 1.0)
    kept = (got * tokens) @ p
    assert error < 0.001 and kept[0] / kept.sum() == pytest.approx(target, abs=0.001) and 0 <= got.min() <= got.max() <= 1
    # the most that can be kept: documents by their share of the domain that is over its target
    k, limit = (0, target) if (tokens @ p)[0] > target * tokens.sum() else (1, 1 - target)
    over = p[:, k]
    order = np.argsort(over)
    fits = np.cumsum((tokens * over)[order]) <= limit * np.cumsum(tokens[order])
    assert kept.sum() >= 0.9 * np.cumsum(tokens[order])[fits].max()


def test_mixing_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "en", "", 1), (2, "", "en", "", 1), (None, "a b", "en", "", 1), (4, "w " * 90_000, "en", "", 1), (4, "w x", "en", "", 1), (4, "w x", "en", "", 1)], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.rate for r in mx.mix(docs, none, mx.label_domain(), mx.TARGETS).collect()} == {1.0}
    labels = spark.createDataFrame([(4, 1, 0), (2, 0, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    rows = mx.mix(docs, labels, mx.label_domain(), {"q1t0": 1.0}).collect()
    assert len(rows) == 6 and all(0 <= r.rate <= 4 for r in rows)
    kept = mx.keep_mixed(docs, labels, mx.label_domain(), {"q0t0": 0.5, "q1t0": 0.5})
    assert kept.columns == docs.columns
    copies = spark.range(4000).withColumn("r", F.lit(2.25)).select(mx.drawn("id", "r").alias("n")).agg(F.avg("n")).first()[0]
    assert abs(copies - 2.25) < 0.05
