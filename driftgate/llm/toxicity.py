"""Toxicity by a small convolutional text classifier, trained in numpy.

A word's embedding is the mean of hashed rows: one for the word, one for its end and one for each of
its beginnings of 4 to 12 bytes, so that inflected and compound forms share evidence. Filters of
one, two and three words run over the whole text, each is max-pooled, and a linear layer gives the
logit. A convolution is linear in its words, so each distinct word is multiplied by the filters once
and kept; a document costs a gather, a sum and a maximum per filter width.

Thresholds are calibrated by language. The language is read off the text itself, by log odds of
common words learned beside the filters; for each language the raw logit that separates the
calibration rows best is moved to the fixed score ``LINE``. Labels, lang, source and ids never enter
a score.

The labelled sample is bounded: ``MOST_TOXIC`` and ``MOST_CLEAN`` rows in a hash order of ids, of
texts up to ``MOST_TRAIN_CHARS`` characters. Scoring reads every whole text.

Defined results: null and empty texts get the score of a text without words; repeated labels of an
id count as toxic if any of them does, null labels not at all; without labels of both kinds every
score is the share of toxic labels (0 without any); extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgate.llm.work import Recent, held_out, slices, stable_order, table

MOST_TOXIC, MOST_CLEAN, MOST_TRAIN_CHARS = 2000, 3000, 20_000
BUCKETS, DIMS, WIDTHS, FILTERS = 2**15, 12, (1, 2, 3), 16
LINE = 0.7
LEAST_STEPS, EPOCHS, BATCH, RATE = 500, (3, 20), 32, 0.003
COMMON = 1500
#: Bounds of what a scorer keeps: words, rows of its table (a row is 384 bytes), and words of a text at a time.
KEPT_WORDS, KEPT_ROWS, PIECE = 120_000, 2**17, 8_000
LEAST_TEXTS, LEAST_Z = 3, 1.2
#: A language whose rows no cut separates this well takes the threshold of all languages.
LEAST_F1 = 0.6
OFFSETS = sum(WIDTHS)

_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def features(word: str) -> list[int]:
    """32-bit hashes of a word, its end and its beginnings; an embedding row is a hash modulo BUCKETS."""
    raw = word.encode("utf-8", "replace")
    crc = zlib.crc32
    return [crc(raw, 1), crc(raw[-4:], 2), *[crc(raw[:k]) for k in range(4, min(len(raw), 13))]]


@dataclass
class Model:
    embed: np.ndarray
    filters: np.ndarray  # (OFFSETS, DIMS, FILTERS)
    bias: np.ndarray  # (widths, FILTERS)
    out: np.ndarray
    out_bias: float
    languages: list[str] = field(default_factory=list)
    common: dict[str, np.ndarray] = field(default_factory=dict)
    shift: dict[str, float] = field(default_factory=dict)
    live: frozenset[int] = frozenset()
    constant: float | None = None


def _spans(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end position of each text when every text is followed by two empty words."""
    start = np.cumsum(sizes + 2) - sizes - 2
    return start, start + sizes


def _flat(rows: list[np.ndarray], blank: int) -> np.ndarray:
    pad = np.full(2, blank, np.int64)
    return np.concatenate([x for r in rows for x in (r, pad)])


class _Net:
    """Filters and embeddings in training; a batch is a list of arrays of word numbers."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.p = {
            "embed": rng.normal(0, 0.03, (BUCKETS, DIMS)).astype(np.float32),
            "filters": rng.normal(0, 0.5, (OFFSETS, DIMS, FILTERS)).astype(np.float32),
            "bias": np.zeros((len(WIDTHS), FILTERS), np.float32),
            "out": rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32),
            "out_bias": np.array([-2.0], np.float32),
        }
        self.m = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.t = 0
        self.alive = np.zeros(BUCKETS, bool)

    def start(self, every: np.ndarray, of_toxic: np.ndarray, hashes: np.ndarray, n: int, toxic: int) -> np.ndarray:
        """Begin from what texts share, and return which hashes are learned at all.

        ``every`` and ``of_toxic`` count the texts that hold a hash. Those are learned that
        LEAST_TEXTS texts or more hold and that tell the labels apart by LEAST_Z standard errors, so
        no text is learned by heart and most words of a text need no embedding. One dimension starts
        at that z score, and the first filter of each width looks at it alone.
        """
        rate = every / n
        gap = of_toxic / max(1, toxic) - (every - of_toxic) / max(1, n - toxic)
        z = gap / np.sqrt(np.maximum(rate * (1 - rate), 1e-9) * (1 / max(1, toxic) + 1 / max(1, n - toxic)))
        keep = (every >= LEAST_TEXTS) & (np.abs(z) >= LEAST_Z)
        rows = hashes[keep] % BUCKETS
        self.alive[rows] = True
        self.p["embed"][rows, 0] = np.clip(z[keep] / 4, -0.5, 3)
        self.p["embed"][~self.alive] = 0
        offset = 0
        for w, width in enumerate(WIDTHS):
            self.p["filters"][offset : offset + width, 0] *= 0.2
            self.p["filters"][offset : offset + width, :, 0] = 0
            self.p["filters"][offset : offset + width, 0, 0] = 1
            self.p["out"][w * FILTERS] = 1
            offset += width
        return keep

    def vectors(self, used: np.ndarray, feats: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = first[used + 1] - first[used]
        ends = np.cumsum(size)
        rows = feats[np.arange(ends[-1]) + np.repeat(first[used] - ends + size, size)]
        sums = np.add.reduceat(self.p["embed"][rows], ends - size, axis=0)
        return sums / size[:, None], rows, size

    def step(self, batch: list[np.ndarray], y: np.ndarray, weight: np.ndarray, feats: np.ndarray, first: np.ndarray) -> None:
        used, flat = np.unique(np.concatenate(batch), return_inverse=True)
        vec, rows, size = self.vectors(used, feats, first)
        vec = np.vstack([vec, np.zeros((1, DIMS), np.float32)])
        sizes = np.array([len(x) for x in batch])
        parts = np.split(flat, np.cumsum(sizes)[:-1])
        idx = _flat(parts, len(used))
        start, end = _spans(sizes)
        d_vec, g = np.zeros_like(vec), {k: np.zeros_like(v) for k, v in self.p.items() if k != "embed"}
        pooled, best = [], []
        offset = 0
        for w, width in enumerate(WIDTHS):
            by_word = [vec @ self.p["filters"][offset + j] for j in range(width)]
            value = sum(np.vstack([b[idx[j:]], np.zeros((j, FILTERS), np.float32)]) for j, b in enumerate(by_word)) + self.p["bias"][w]
            at = np.stack([s + value[s:e].argmax(0) for s, e in zip(start, end, strict=True)])
            best.append(at)
            pooled.append(np.maximum(np.take_along_axis(value, at, 0), 0))
            offset += width
        h = np.concatenate(pooled, 1)
        p = 1 / (1 + np.exp(-np.clip(h @ self.p["out"] + self.p["out_bias"][0], -30, 30)))
        d = ((p - y) * weight / len(y)).astype(np.float32)
        g["out"] = h.T @ d + 1e-4 * self.p["out"]
        g["out_bias"][0] = d.sum()
        d_h = d[:, None] * self.p["out"][None] * (h > 0)
        offset = 0
        for w, width in enumerate(WIDTHS):
            grad, at = d_h[:, w * FILTERS : (w + 1) * FILTERS], best[w]
            g["bias"][w] = grad.sum(0)
            n, f = np.nonzero(grad)
            for j in range(width):
                word = idx[np.minimum(at[n, f] + j, len(idx) - 1)]
                gv = grad[n, f][:, None]
                np.add.at(d_vec, word, gv * self.p["filters"][offset + j].T[f])
                gf = np.zeros((FILTERS, DIMS), np.float32)
                np.add.at(gf, f, gv * vec[word])
                g["filters"][offset + j] = gf.T
            offset += width
        touched = np.flatnonzero(np.abs(d_vec[:-1]).sum(1))
        self.t += 1
        if len(touched):
            ends = np.cumsum(size)
            picks = [np.arange(ends[k] - size[k], ends[k]) for k in touched]
            where = rows[np.concatenate(picks)]
            each = np.repeat(d_vec[touched] / size[touched][:, None], size[touched], axis=0)
            hit, inverse = np.unique(where, return_inverse=True)
            ge = np.zeros((len(hit), DIMS), np.float32)
            np.add.at(ge, inverse, each)
            self._adam("embed", ge[self.alive[hit]], hit[self.alive[hit]])
        for k, v in g.items():
            self._adam(k, v, slice(None))

    def _adam(self, k: str, g: np.ndarray, at) -> None:
        self.m[k][at] = 0.9 * self.m[k][at] + 0.1 * g
        self.v[k][at] = 0.99 * self.v[k][at] + 0.01 * g * g
        self.p[k][at] -= RATE * (self.m[k][at] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k][at] / (1 - 0.99**self.t)) + 1e-6)


def train(rows: list[tuple[str, str | None, int]], seed: int = 7) -> Model:
    """Fit on (text, lang, toxic) rows; every fifth row is kept from the filters to set thresholds."""
    net = _Net(seed)
    y = np.array([r[2] for r in rows], np.float32)
    if not len(y) or y.min() == y.max():
        return Model(*(net.p[k] for k in ("embed", "filters", "bias", "out")), 0.0, constant=float(y.mean()) if len(y) else 0.0)
    number: dict[str, int] = {}
    coded = [np.array([number.setdefault(w, len(number)) for w in words(r[0]) or [""]], np.int32) for r in rows]
    flat, size = array("I"), array("B")
    for w in number:
        own = features(w)
        flat.extend(own)
        size.append(len(own))
    all_size = np.frombuffer(size, np.uint8).astype(np.int64)
    all_first = np.concatenate(([0], np.cumsum(all_size)))
    hashes, place = np.unique(np.frombuffer(flat, np.uint32), return_inverse=True)
    place = place.astype(np.int32)
    del flat, size
    rng = np.random.default_rng(seed)
    # the kept rows are spread over both labels
    kept = np.zeros(len(rows), bool)
    for label in (0, 1):
        own = np.flatnonzero(y == label)
        kept[own[rng.permutation(len(own))[: len(own) // 5]]] = True
    fit = np.flatnonzero(~kept)
    every, of_toxic = np.zeros(len(hashes), np.int32), np.zeros(len(hashes), np.int32)
    for i in fit:
        used = np.unique(coded[i])
        held = np.unique(np.concatenate([place[all_first[k] : all_first[k + 1]] for k in used]))
        every[held] += 1
        if y[i]:
            of_toxic[held] += 1
    learned = net.start(every, of_toxic, hashes, len(fit), int(y[fit].sum()))
    live = frozenset(hashes[learned].tolist())
    # a word keeps its learned rows; one without any gets a row that stays zero
    blank = int(np.flatnonzero(~net.alive)[0])
    keep = learned[place]
    word = np.repeat(np.arange(len(all_size)), all_size)[keep]
    count = np.bincount(word, minlength=len(all_size))
    none = count == 0
    first = np.concatenate(([0], np.cumsum(np.where(none, 1, count))))
    feats = np.full(first[-1], blank, np.int64)
    feats[np.repeat(~none, np.where(none, 1, count))] = hashes[place[keep]] % BUCKETS
    del every, of_toxic, place, word, keep
    weight = np.where(y == 1, min(5.0, (y[fit] == 0).sum() / max(1, (y[fit] == 1).sum())), 1.0).astype(np.float32)
    for _ in range(min(EPOCHS[1], max(EPOCHS[0], LEAST_STEPS * BATCH // len(fit)))):
        order = rng.permutation(fit)
        for k in range(0, len(order), BATCH):
            some = order[k : k + BATCH]
            net.step([coded[i] for i in some], y[some], weight[some], feats, first)
    model = Model(net.p["embed"], net.p["filters"], net.p["bias"], net.p["out"], float(net.p["out_bias"][0]), live=live)
    _learn_languages(model, number, coded, [r[1] for r in rows])
    del number, coded, net, feats, first
    scorer = Scorer(model)
    found = [scorer.raw(r[0]) for r in rows]
    _calibrate(model, [x for x, k in zip(found, kept, strict=True) if k], y[kept], [x for x, k in zip(found, kept, strict=True) if not k], y[~kept])
    return model


def _learn_languages(model: Model, number: dict[str, int], coded: list[np.ndarray], langs: list[str | None]) -> None:
    """Log odds by language of the most common words."""
    model.languages = sorted({x for x in langs if x is not None})
    if not model.languages:
        return
    counts = np.zeros((len(model.languages), len(number)), np.int64)
    for words_of, lang in zip(coded, langs, strict=True):
        if lang is not None:
            np.add.at(counts[model.languages.index(lang)], words_of, 1)
    common = np.argsort(-counts.sum(0), kind="stable")[:COMMON]
    share = np.log((counts[:, common] + 0.5) / (counts.sum(1, keepdims=True) + COMMON)).astype(np.float32)
    name = list(number)
    for k, w in enumerate(common.tolist()):
        model.common[name[w]] = share[:, k] - share[:, k].mean()


def _threshold(logit: np.ndarray, y: np.ndarray) -> float | None:
    """The cut with the best F1; within the gap nearer to the toxic side."""
    if y.sum() < 5 or (y == 0).sum() < 5:
        return None
    order = np.argsort(logit)
    logit, y = logit[order], y[order]
    hits = y.sum() - np.concatenate(([0], np.cumsum(y)))[:-1]
    f1 = 2 * hits / (np.arange(len(y), 0, -1) + y.sum())
    k = int(f1.argmax())
    if f1[k] < LEAST_F1:
        return None
    return float(logit[0] - 1 if k == 0 else 0.25 * logit[k - 1] + 0.75 * logit[k])


def _calibrate(model: Model, kept: list[tuple[float, str]], y: np.ndarray, fitted: list[tuple[float, str]], y_fit: np.ndarray) -> None:
    """Shift of the logit for each language and for those with too few rows (under '')."""
    line = float(np.log(LINE / (1 - LINE)))
    both, y_both = kept + fitted, np.concatenate([y, y_fit])
    for lang in ["", *model.languages]:
        for rows, labels in ((kept, y), (both, y_both)):
            mine = np.array([not lang or x[1] == lang for x in rows], bool)
            cut = _threshold(np.array([x[0] for x in rows])[mine], labels[mine]) if mine.any() else None
            if cut is not None:
                break
        model.shift[lang] = line - cut if cut is not None else model.shift.get("", line)


class Scorer:
    """Scores of whole texts; what it keeps of words seen before is bounded."""

    def __init__(self, model: Model):
        self.model = model
        self.number = Recent(self.add, KEPT_WORDS)
        self.shared: dict[tuple, int] = {}
        self.table = np.zeros((KEPT_ROWS, OFFSETS * FILTERS), np.float32)
        self.odds = np.zeros((KEPT_ROWS, max(1, len(model.languages))), np.float32)
        self.flat_filters = model.filters.transpose(1, 0, 2).reshape(DIMS, OFFSETS * FILTERS)

    def _rows(self, found: list[str]) -> np.ndarray:
        """Table rows of words; words whose learned rows are the same share one."""
        if len(self.shared) + len(found) > KEPT_ROWS:
            self.number = Recent(self.add, KEPT_WORDS)
            self.shared.clear()
        return np.fromiter(map(self.number.__getitem__, found), np.int64, len(found))

    def add(self, word: str) -> int:
        common = self.model.common.get(word)
        live = self.model.live
        key = (tuple([f % BUCKETS for f in features(word) if f in live]), word if common is not None else "")
        row = self.shared.get(key)
        if row is None:
            row = self.shared[key] = len(self.shared)
            self.table[row] = self.model.embed[list(key[0])].mean(0) @ self.flat_filters if key[0] else 0
            self.odds[row] = 0 if common is None else common
        return row

    def raw(self, text: str | None) -> tuple[float, str]:
        """Logit and the language that the text's common words speak for."""
        m, found = self.model, words(text)
        if not found:
            return m.out_bias, ""
        pooled, odds, tail = None, np.zeros(self.odds.shape[1]), []
        for k in range(0, len(found), PIECE):  # two words more for the windows that cross
            rows = self._rows(found[k : k + PIECE + 2])
            odds += self.odds[rows[:PIECE]].sum(0)
            part, offset = [], 0
            for w, width in enumerate(WIDTHS):
                n = len(rows)
                value = self.table[rows, offset * FILTERS : (offset + 1) * FILTERS]
                for j in range(1, min(width, n)):
                    value[: n - j] += self.table[rows[j:], (offset + j) * FILTERS : (offset + j + 1) * FILTERS]
                keep = value[: PIECE if k + PIECE < len(found) else n]
                part.append(np.maximum(keep.max(0) + m.bias[w], 0))
                offset += width
            part = np.concatenate(part)
            pooled = part if pooled is None else np.maximum(pooled, part)
        return float(pooled @ m.out + m.out_bias), m.languages[int(odds.argmax())] if m.languages and odds.any() else ""

    def score(self, text: str | None) -> tuple[float, str]:
        if self.model.constant is not None:
            return self.model.constant, ""
        logit, lang = self.raw(text)
        return float(1 / (1 + np.exp(-np.clip(logit + self.model.shift.get(lang, self.model.shift[""]), -30, 30)))), lang


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in slices(batches):
            found = [scorer.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.float64()), pa.array([x or "und" for _, x in found], pa.string())], names=["row", "score", "lang_read"])

    return run


def labelled_sample(docs: DataFrame, labels: DataFrame) -> list[tuple[str, str | None, int]]:
    """The bounded training rows; rows held out give none."""
    known = labels.where("toxic is not null").where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    part = [known.where(F.col("toxic") == k).orderBy(stable_order(), "doc_id").limit(n) for k, n in ((0, MOST_CLEAN), (1, MOST_TOXIC))]
    ids = F.broadcast(part[0].unionByName(part[1]))  # at most MOST_CLEAN + MOST_TOXIC rows of two numbers
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    fit = docs.where(F.length("text") <= MOST_TRAIN_CHARS).select("doc_id", "text", lang.alias("lang"))
    rows = fit.join(ids, "doc_id").orderBy("doc_id", "text").limit(2 * (MOST_CLEAN + MOST_TOXIC)).collect()
    return [(r.text, r.lang, int(r.toxic > 0)) for r in rows]


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    return train(labelled_sample(docs, labels))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, lang_read of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    found = docs.select(F.col("doc_id").cast("long").alias("row"), "text").mapInArrow(_score(shared), "row long, score double, lang_read string")
    return found.select(F.col("row").alias("doc_id"), held_out("row").alias("held_out"), "score", (F.col("score") >= LINE).cast("int").alias("predicted"), "lang_read")


def _kept(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in slices(batches):
            keep = [scorer.score(t)[0] < LINE for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those predicted toxic, all columns kept; one pass, no shuffle of texts."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    return docs.mapInArrow(_kept(shared), docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op5_toxicity": op5_toxicity}
