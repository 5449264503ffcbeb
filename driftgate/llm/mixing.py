"""Mixing to target weights by soft membership.

A softmax classifier, trained in numpy on a bounded sample of the labelled table, gives every
document a posterior over domains. It reads the mean of hashed words, the shape of the text, and for
each domain the strongest evidence of any one word, since a domain can hang on a single word of a
long text. Evidence of a training row's words comes from the other half of the sample, so it means
as much there as on new texts. Rates r are then fitted by distributed projected gradient so
that the expected tokens of each domain, sum of r * tokens * posterior, meet the targets:

    minimise  e' A^-1 e,  e = sum_i r_i tokens_i p_i - targets,  A = sum_i tokens_i p_i p_i',
    subject to 0 <= r_i <= most.

In the metric of tokens the gradient of a document is p_i' A^-1 e and a step of one is safe. Once
many rates stop at a bound such steps get short, so the same gradient is also tried in the metric of
the documents that can still move, whole, halved and quartered; the best of the four is taken. A
step needs only sums over all documents, a few short vectors, so a document's rate is a function
of its own posterior and the short list of past steps: no rate is stored between steps, and a lost
executor costs the recomputation of its own rows. Where the targets can be met, e goes to zero;
where bounds or soft posteriors keep them out of reach, the least-squares compromise stands and
``fit_error`` says by how much of all target tokens the worst domain is off.

Sampled rows: ``MOST_LABELLED`` labelled documents in a hash order of ids, of texts up to
``MOST_TRAIN_CHARS`` characters. Posteriors, sums and rates cover all documents.

Defined results: null and empty texts have no tokens and get a rate that moves no total; repeated
rows are counted as often as they are there; a domain without labels has posterior 0 and takes part
in no total; without labels the rate is 1 for all; null ids are carried.
"""

from __future__ import annotations

import logging
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgate.llm.work import Recent, fresh, held, held_out, slices, stable_order, stored, table

MOST_LABELLED, MOST_TRAIN_CHARS = 4000, 20_000
BUCKETS, MOST_STEPS = 2**16, 25
#: A word is evidence from so many texts and standard errors on.
LEAST_TEXTS, LEAST_Z, MOST_Z = 3, 3.0, 12.0
#: Error of a fit that is worth a warning.
MOST_OFF = 0.01
#: Words whose buckets a worker keeps.
KEPT_WORDS = 100_000
#: Share of expected tokens by domain of the labelled table: quality 0 or 1, toxic 0 or 1.
TARGETS = {"q0t0": 0.10, "q0t1": 0.01, "q1t0": 0.85, "q1t1": 0.04}
_LOG = logging.getLogger(__name__)


def _bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) % BUCKETS


def features(text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Word buckets, shape of the text (byte frequencies, length, variety), and its number of words."""
    found = (text or "").split()
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    # half precision of a frequency is plenty; long texts are counted in one pass
    freq = np.bincount(raw & 127, minlength=128) / max(1, len(raw))
    shape = np.concatenate([np.sqrt(freq), [np.log1p(len(found)) / 8, len(set(found)) / max(1, len(found)), 1.0]])
    buckets = held("word buckets", lambda: Recent(_bucket, KEPT_WORDS))
    return np.fromiter(map(buckets.__getitem__, found), np.int64, len(found)), shape, len(found)


SHAPES = 131


@dataclass
class Model:
    domains: list[str]
    words: np.ndarray  # (BUCKETS, 2 domains): weights, then evidence
    shape: np.ndarray  # (SHAPES + domains, domains)

    def posterior(self, buckets: np.ndarray, shape: np.ndarray) -> np.ndarray:
        n = len(self.domains)
        if not n:
            return np.zeros(0)
        if not len(buckets):
            return _softmax(shape @ self.shape[:SHAPES])
        rows = self.words[buckets]
        z = shape @ self.shape[:SHAPES] + rows[:, :n].sum(0) / np.sqrt(len(buckets)) + rows[:, n:].max(0) @ self.shape[SHAPES:]
        return _softmax(z)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _evidence(held: list[np.ndarray], y: np.ndarray, n: int) -> np.ndarray:
    """Per bucket and domain: by how many standard errors its texts hold the bucket oftener than others, or 0."""
    texts = np.zeros((BUCKETS, n))
    for own, domain in zip(held, y, strict=True):
        texts[own, domain] += 1
    size, every = np.bincount(y, minlength=n), texts.sum(1, keepdims=True)
    rate = every / max(1, len(y))
    others = np.maximum(1, len(y) - size)
    gap = texts / np.maximum(1, size) - (every - texts) / others
    z = gap / np.sqrt(np.maximum(rate * (1 - rate), 1e-9) * (1 / np.maximum(1, size) + 1 / others))
    return np.where((texts >= LEAST_TEXTS) & (z >= LEAST_Z), np.minimum(z, MOST_Z) / MOST_Z, 0).astype(np.float32)


def train(rows: list[tuple[str, str]], domains: list[str], seed: int = 5, epochs: int = 12, rate: float = 0.02) -> Model:
    """Softmax regression with Adam over (text, domain) rows."""
    n, rng = len(domains), np.random.default_rng(seed)
    if not n:
        return Model(domains, np.zeros((BUCKETS, 0), np.float32), np.zeros((SHAPES, 0)))
    held = [features(t)[:2] for t, _ in rows]
    y = np.array([domains.index(d) for _, d in rows])
    used = [np.unique(b, return_counts=True) for b, _ in held]
    half = rng.permutation(len(rows)) % 2 == 0
    x = np.zeros((len(rows), SHAPES + n))
    for side in (half, ~half):
        other = np.flatnonzero(~side)
        evidence = _evidence([used[i][0] for i in other], y[other], n)
        for i in np.flatnonzero(side):
            x[i] = np.concatenate([held[i][1], evidence[used[i][0]].max(0) if len(used[i][0]) else np.zeros(n)])
    words, shape = np.zeros((BUCKETS, n), np.float32), np.zeros((SHAPES + n, n))
    moments = [np.zeros_like(words), np.zeros_like(words), np.zeros_like(shape), np.zeros_like(shape)]
    share = [(c / np.sqrt(max(1, len(held[i][0])))).astype(np.float32) for i, (_, c) in enumerate(used)]
    t = 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), 64):
            some = order[k : k + 64]
            z = x[some] @ shape + np.stack([share[i] @ words[used[i][0]] for i in some])
            d = _softmax(z)
            d[np.arange(len(some)), y[some]] -= 1
            d /= 64
            gw, gs = 1e-4 * words, 1e-4 * shape + x[some].T @ d
            for i, own in zip(some, d.astype(np.float32), strict=True):
                gw[used[i][0]] += share[i][:, None] * own
            t += 1
            for p, g, m, v in ((words, gw, moments[0], moments[1]), (shape, gs, moments[2], moments[3])):
                m *= 0.9
                m += 0.1 * g
                v *= 0.99
                v += 0.01 * g * g
                p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Model(domains, np.hstack([words, _evidence([b for b, _ in used], y, n)]), shape)


def fit(docs: DataFrame, labels: DataFrame, domain: Column) -> Model:
    """Classifier of the domain that ``domain`` names on the labelled table; null domains teach nothing."""
    known = labels.select("doc_id", domain.alias("domain")).where("domain is not null").where(~held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.min("domain").alias("domain"))
    ids = F.broadcast(known.orderBy(stable_order(), "doc_id").limit(MOST_LABELLED))
    some = docs.where(F.length("text") <= MOST_TRAIN_CHARS).select("doc_id", "text").join(ids, "doc_id")
    rows = [(r.text, r.domain) for r in some.orderBy("doc_id", "text").limit(2 * MOST_LABELLED).collect()]
    return train(rows, sorted({d for _, d in rows}))


def _posteriors(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches):
            tokens, p = [], []
            for text in batch.column(1).to_pylist():
                buckets, shape, n = features(text)
                tokens.append(n)
                p.append(model.posterior(buckets, shape).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.int64()), pa.array(p, pa.list_(pa.float64()))], names=["doc_id", "tokens", "p"])

    return run


def posteriors(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, tokens and one column p_<domain> each, written once."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_posteriors(shared), "doc_id long, tokens long, p array<double>")
    return stored(found.select("doc_id", "tokens", *(F.col("p")[k].alias(f"p_{d}") for k, d in enumerate(model.domains))), "posteriors")


def _rate(columns: list[str], steps: list[np.ndarray], most: float) -> Column:
    """Rate as an expression of the posterior columns: every past step, each cut to the bounds."""
    rate = F.lit(1.0)
    for g in steps:
        move = sum((F.col(c) * float(x) for c, x in zip(columns, g, strict=True)), F.lit(0.0))
        rate = F.greatest(F.lit(0.0), F.least(F.lit(float(most)), rate - move))
    return rate


def fit_rates(found: DataFrame, domains: list[str], weights: dict[str, float], most: float) -> tuple[list[np.ndarray], float]:
    """The steps that make a rate of a posterior, and the error of the rates after the last of them.

    The targets add up to all tokens. Where rates stop at one, they add up to the tokens that the
    rates keep: rates begin at one and fall only where a domain is over its share, so about as much
    is kept as the targets allow. The error is the largest of a domain, as a share of all target tokens.
    """
    if not domains:
        return [], 0.0
    w = np.array([max(0.0, weights.get(d, 0.0)) for d in domains])
    w = w / w.sum() if w.sum() else np.full(len(domains), 1 / len(domains))
    names = [f"p_{d}" for d in domains]
    p = [F.col(n) for n in names]
    squares = [F.sum(F.col("tokens") * x * y) for x in p for y in p]
    first = found.agg(*(F.sum(F.col("tokens") * x) for x in p), *squares).first()
    have = np.array([first[k] or 0.0 for k in range(len(p))])
    if not have.sum():
        return [], 0.0

    def inverse(sums, least: float) -> np.ndarray:
        return np.linalg.pinv(np.array([x or 0.0 for x in sums]).reshape(len(p), len(p)), rcond=least)

    def missed(got: np.ndarray) -> np.ndarray:
        """Errors by domain, as shares of all target tokens."""
        total = have.sum() if most > 1 else got.sum(-1, keepdims=True)
        return got / np.maximum(total, 1e-9) - w

    metric = inverse(first[len(p) :], 1e-9)
    steps: list[np.ndarray] = []
    got, errors = have, []
    while True:
        error = missed(got)
        errors.append(float(np.abs(error).max()))
        if errors[-1] < 1e-5 or len(steps) == MOST_STEPS or len(errors) > 3 and errors[-4] - errors[-1] < 1e-2 * errors[-4]:
            break
        tokens = error * (have.sum() if most > 1 else got.sum())
        plain = metric @ tokens
        rate = _rate(names, steps, most)
        move = sum((x * float(g) for x, g in zip(p, plain, strict=True)), F.lit(0.0))
        moves = ((rate > 0) | (move < 0)) & ((rate < most) | (move > 0))
        free = inverse(found.where(moves).agg(*squares).first(), 1e-6) @ tokens
        # nine digits: sums in another order must not change a rate
        tried = [np.array([float(f"{x:.9g}") for x in step]) for step in (plain, free, free / 2, free / 4)]
        after = found.agg(*(F.sum(_rate(names, [*steps, step], most) * F.col("tokens") * x) for step in tried for x in p)).first()
        each = np.array([x or 0.0 for x in after]).reshape(len(tried), len(p))
        left = missed(each)
        best = int(np.einsum("ij,jk,ik->i", left, metric, left).argmin())
        steps.append(tried[best])
        got = each[best]
    if errors[-1] > MOST_OFF:
        _LOG.warning("mix: after %d steps a domain is off its target by %.4f of all tokens", len(steps), errors[-1])
    return steps, errors[-1]


def mix(docs: DataFrame, labels: DataFrame, domain: Column, weights: dict[str, float], most: float = 4.0) -> DataFrame:
    """doc_id, tokens, posteriors, the fitted rate of every document, and the error of the fit."""
    model = fit(docs, labels, domain)
    found = posteriors(docs, model)
    steps, error = fit_rates(found, model.domains, weights, most)
    return found.withColumns({"rate": _rate([f"p_{d}" for d in model.domains], steps, most), "fit_error": F.lit(error)})


def drawn(doc_id: str, rate: str) -> Column:
    """Copies of a document: the whole part of its rate, and one more by chance of the rest.

    Chance is a hash of the id, so a retried task draws alike.
    """
    uniform = F.pmod(F.xxhash64(F.col(doc_id), F.lit(77)), F.lit(2**30)) / float(2**30)
    return (F.floor(rate) + (uniform < F.col(rate) - F.floor(rate)).cast("long")).cast("long")


def keep_mixed(docs: DataFrame, labels: DataFrame, domain: Column, weights: dict[str, float]) -> DataFrame:
    """``docs`` thinned to the target weights (rates at most one), all columns kept.

    The posterior is computed again beside the texts instead of joining the rates to them.
    """
    model = fit(docs, labels, domain)
    steps, _ = fit_rates(posteriors(docs, model), model.domains, weights, 1.0)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.schema
    names = [fresh(docs, f"p_{d}") for d in model.domains]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            p = [shared.value.posterior(*features(t)[:2]).tolist() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([x[k] for x in p], pa.float64()) for k in range(len(names)))], names=[*batch.schema.names, *names])

    beside = docs.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), *(f"`{n}` double" for n in names)]))
    rate = fresh(docs, "rate")
    return beside.withColumn(rate, _rate(names, steps, 1.0)).where(drawn("doc_id", rate) > 0).select(*docs.columns)


def label_domain() -> Column:
    return F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit("t"), F.col("toxic").cast("string"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), label_domain(), TARGETS)


QUERIES = {"op2_mixing": op2_mixing}
