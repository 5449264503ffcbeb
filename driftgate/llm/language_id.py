"""Language by rank-order profiles: out-of-place distance of frequent n-grams.

Letters are lower-cased, every other character is a gap, and n-grams of one to three characters are
counted over the whole text with gaps between words. A language's profile is the order of its most
frequent n-grams; a document's own order is compared with each profile, an n-gram that a profile
lacks costs the profile's length. The least mean distance wins, equal distances go to the first
language by name. The score is one minus the winner's distance over the largest possible.

Profiles are learned from a bounded sample: a hash of the id draws ``SAMPLE`` documents of each
language, give or take the chance of the draw, whose n-grams are counted and summed on the executors. Only ``PROFILE`` n-grams of each
language come to the driver.

Defined results: a null text or one without a letter is ``und`` with score 0, as is every text when
nothing could be learned; null languages are not learned from; ids are only carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftgate.llm.work import held_out, slices, stable_order, table

PROFILE, SAMPLE = 300, 1500
_BITS, _GAP = 21, 1  # bits of a code point; the sign for all that isn't a letter
_PIECE = 1_000_000  # characters of a text that are counted at once


def _letters() -> np.ndarray:
    """1 for each code point that is a letter; built once a process."""
    return np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), np.uint8)


_ALPHA: list[np.ndarray] = []


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, as numbers, and how often each occurs; nothing for a text without letters."""
    if not _ALPHA:
        _ALPHA.append(_letters())
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    is_letter = _ALPHA[0][codes]
    if not is_letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.where(is_letter, codes, _GAP).astype(np.int64)
    gap = codes == _GAP
    codes = np.concatenate(([_GAP], codes[~(gap & np.concatenate(([True], gap[:-1])))], [_GAP]))
    found, counts = [], []
    for k in range(0, len(codes), _PIECE):
        one = codes[k : k + _PIECE]
        two, three = codes[k + 1 : k + 1 + _PIECE], codes[k + 2 : k + 2 + _PIECE]
        pair = (one[: len(two)] << _BITS) | two
        whole = two[: len(three)] != _GAP  # else it would span two words
        triple = ((pair[: len(three)] << _BITS) | three)[whole]
        grams, n = np.unique(np.concatenate((one[one != _GAP], pair, triple)), return_counts=True)
        found.append(grams)
        counts.append(n)
    if len(found) == 1:
        return found[0], counts[0]
    grams, place = np.unique(np.concatenate(found), return_inverse=True)
    return grams, np.bincount(place, weights=np.concatenate(counts)).astype(np.int64)


def ranked(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The most frequent n-grams, most frequent first, equal counts by number."""
    return grams[np.lexsort((grams, -counts))[:PROFILE]]


class Profiles:
    def __init__(self, profiles: dict[str, list[int]]):
        self.names = sorted(profiles)
        self.grams = np.unique(np.array([g for p in profiles.values() for g in p], np.int64))
        self.rank = np.full((len(self.names), len(self.grams) + 1), -1, np.int64)
        for k, name in enumerate(self.names):
            self.rank[k, np.searchsorted(self.grams, np.array(profiles[name], np.int64))] = np.arange(len(profiles[name]))

    def predict(self, text: str | None) -> tuple[str, float]:
        own = ranked(*ngrams(text))
        if not len(own) or not self.names:
            return "und", 0.0
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        at = np.where(self.grams[at] == own, at, len(self.grams))
        rank = self.rank[:, at]
        away = np.where(rank < 0, PROFILE, np.abs(rank - np.arange(len(own)))).mean(axis=1)
        best = int(away.argmin())
        return self.names[best], float(1 - away[best] / PROFILE)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> n-gram counts of the partition by language."""
    sums: dict[str, dict[int, int]] = {}
    for batch in slices(batches):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = sums.setdefault(lang, {})
            for g, n in zip(*(x.tolist() for x in ngrams(text)), strict=True):
                own[g] = own.get(g, 0) + n
    for lang, own in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(own.keys(), pa.int64()), pa.array(own.values(), pa.int64())], names=["lang", "gram", "n"])


def learn(docs: DataFrame) -> Profiles:
    """Profiles of each language from about SAMPLE documents of it that aren't held out."""
    known = docs.where("lang is not null and text is not null").where(~held_out("doc_id"))
    langs = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = F.broadcast(langs.select("lang", F.least(F.lit(1.0), F.lit(float(SAMPLE)) / F.col("n")).alias("share")))  # a row a language
    draw = F.pmod(stable_order(), F.lit(1_000_000)) / 1_000_000.0
    some = known.join(share, "lang").where(draw < F.col("share")).select("lang", "text")
    sums = some.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    profiles: dict[str, list[int]] = {}
    for r in sums.withColumn("rank", first).where(F.col("rank") <= PROFILE).select("lang", "gram", "rank").orderBy("lang", "rank").collect():
        profiles.setdefault(r.lang, []).append(r.gram)
    return Profiles(profiles)


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = shared.value
        for batch in slices(batches):
            found = [profiles.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=["row", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    found = docs.select(F.col("doc_id").cast("long").alias("row"), "text").mapInArrow(_predict(shared), "row long, lang_pred string, score double")
    return found.select(F.col("row").alias("doc_id"), held_out("row").alias("held_out"), "lang_pred", "score")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn(docs))


QUERIES = {"op6_language_id": op6_language_id}
