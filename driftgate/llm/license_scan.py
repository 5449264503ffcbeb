"""Licences by sparse TF-IDF cosine to templates, and inheritance from the nearest ancestor.

A text is compared twice. As a whole it meets the whole texts of licences; if the largest cosine
reaches ``LEAST_WHOLE``, it is a copy of that licence. Otherwise windows of it, as long as each
notice, meet the notices: one-sentence notices, the standard headers, and the licences short enough
to be headers themselves. A window's licence is the notice with the largest cosine if that reaches
``LEAST``. Weights are term counts times inverse document frequency; the frequencies of the
licences' words are counted over all documents, words outside them weigh as the rarest.

Most texts hold none of a template's distinctive words. Those words are the fewest, rarest ones
without which no cosine can reach ``LEAST`` (the rest of the template is too light, by the
Cauchy-Schwarz inequality), so a text without any of them is passed over without loss. Elsewhere
a window's cosine is first bounded from above by running sums (its norm is at least that of as many
different words). Where a bound can still win, the cosines of all windows of that length follow from sums over
pairs of equal words, and of the windows that then share the largest, those of different words are weighed exactly.

A file speaks for its directory if it is a copy of a licence, if its name says so (LICENSE, COPYING)
and it has a notice, or if it is mostly notice. A file without a notice
takes the licence of its nearest ancestor directory that has one: distinct directories meet their
ancestors by joins on paths, and files take their directory's answer by a salted join, so a
directory with a third of all files is no larger task than others.

Defined results: null texts have no notice; a null path is the root; equal cosines go to the first
template by name; several licence files of a directory: copies and named files before others, then the
largest cosine, then the first name; repeated rows are judged one by one; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftgate.llm.licence_texts import HEADERS, SHORT, whole_texts
from driftgate.llm.work import attach, slices, stored, table

LEAST, LEAST_WHOLE, OF_FILE = 0.55, 0.8, 0.3
PIECE = 50_000
#: Windows that are weighed one by one without a look at the cosines of all.
FEW = 8
#: Names of licence files.
NAMED = r"(?i)(^|/)([^/]*[-_.])?(un)?(licen[cs]es?|copying)(\.lesser|\.lib)?(-[a-z0-9+]+(\.[0-9]+)*)*(\.(txt|md|rst|html?))?$"
#: Notices by which files are put under a licence.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
_WORD = re.compile(r"[a-z0-9]+")


def terms(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


#: What windows are compared with.
NOTICES = sorted({*TEMPLATES.items(), *HEADERS.items(), *SHORT.items()})
VOCABULARY = sorted({w for _, t in NOTICES for w in terms(t)})


def _document_frequency(shared):
    """One row a partition and word of the licences: documents that hold it; '' counts all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sums = shared.value, Counter()
        for batch in slices(batches):
            sums[""] += batch.num_rows
            for text in batch.column(0).to_pylist():
                sums.update(known.intersection(terms(text)))
        yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.string()), pa.array(sums.values(), pa.int64())], names=["word", "n"])

    return run


@lru_cache(maxsize=1)
def _whole_terms() -> dict[str, Counter]:
    return {name: Counter(terms(t)) for name, t in sorted(whole_texts().items())}


def _pairs(kinds: np.ndarray, square: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """For the windows that begin at 0, 1, ...: the sum of a word's square over pairs of its places."""
    starts, out = np.arange(len(ends)), np.zeros(len(ends))
    for apart in range(1, min(size, len(kinds))):
        here = np.concatenate([[0.0], np.cumsum(np.where(kinds[apart:] == kinds[:-apart], square[:-apart], 0.0))])
        last = np.maximum(ends - apart, starts)
        out += here[np.minimum(last, len(here) - 1)] - here[np.minimum(starts, len(here) - 1)]
    return out


class Weights:
    """Inverse document frequencies, vectors of length one of notices and whole texts, and the distinctive words."""

    def __init__(self, n: int, df: dict[str, int]):
        self.rare = math.log(1 + n) + 1
        whole = _whole_terms()
        known = sorted({*VOCABULARY, *(w for c in whole.values() for w in c)})
        self.idf = {w: math.log((1 + n) / (1 + df.get(w, 0))) + 1 for w in known}
        self.at = {w: k for k, w in enumerate(known)}
        # the last place stands for all words outside
        self.square = np.array([*(self.idf[w] ** 2 for w in known), self.rare**2])
        self.names, self.wholes = [name for name, _ in NOTICES], list(whole)
        # what one occurrence of a word adds to the product with each notice, and to that with each whole text
        self.part, self.whole = np.zeros((len(known) + 1, len(NOTICES))), np.zeros((len(known) + 1, len(whole)))
        distinctive = set()
        for k, (_, text) in enumerate(NOTICES):
            vector = self._unit(Counter(terms(text)))
            for w, x in vector.items():
                self.part[self.at[w], k] = x * self.idf[w]
            rest = 1.0
            for w in sorted(vector, key=lambda w: (-self.idf[w], w)):
                if rest < LEAST**2:
                    break
                distinctive.add(w)
                rest -= vector[w] ** 2
        for k, counts in enumerate(whole.values()):
            for w, x in self._unit(counts).items():
                self.whole[self.at[w], k] = x * self.idf[w]
        self.distinctive = frozenset(distinctive)

    def _unit(self, counts: Counter) -> dict[str, float]:
        norm = math.sqrt(sum((k * self.idf[w]) ** 2 for w, k in counts.items()))
        return {w: k * self.idf[w] / norm for w, k in counts.items()}

    def copied(self, counts: Counter) -> tuple[str | None, float]:
        """The licence whose whole text a text with these counts is a copy of, and the cosine."""
        inside = [(self.at[w], counts[w]) for w in self.at.keys() & counts.keys()]
        if not inside:
            return None, 0.0
        at, k = np.array(sorted(inside)).T
        squares = float((k * k * self.square[at]).sum())
        norm = math.sqrt(squares + (sum(x * x for x in counts.values()) - int((k * k).sum())) * self.rare**2)
        if math.sqrt(squares) / norm < LEAST_WHOLE:  # no cosine can be larger
            return None, 0.0
        cosines = k @ self.whole[at] / norm
        first = int(np.flatnonzero(cosines > cosines.max() - 1e-12)[0])
        return (self.wholes[first] if cosines[first] >= LEAST_WHOLE else None), min(1.0, float(cosines[first]))

    def best(self, window: list[str]) -> tuple[str | None, float]:
        """The notice nearest to a window, and the cosine."""
        at, k = np.array(sorted(Counter(self.at.get(w, -1) for w in window).items()), int).reshape(-1, 2).T
        outside = sum(x * x for x in Counter(w for w in window if w not in self.at).values())
        norm = math.sqrt(float((k * k * self.square[at])[at >= 0].sum()) + outside * self.rare**2)
        cosines = k @ self.part[at] / norm if norm else np.zeros(len(self.names))
        first = int(np.flatnonzero(cosines > cosines.max() - 1e-12)[0])
        return (self.names[first] if cosines[first] >= LEAST else None), float(cosines[first])

    def notice(self, text: str | None) -> tuple[str | None, float, float, bool]:
        """Licence, cosine, the notice's share of the text, and whether the text is a copy of the licence."""
        found = terms(text)
        counts = Counter(found)
        name, cosine = self.copied(counts)
        if name:
            return name, cosine, 1.0, True
        if self.distinctive.isdisjoint(counts.keys()):
            return None, 0.0, 0.0, False
        places = dict(self.at)  # words outside get places of their own
        kinds = np.fromiter((places.setdefault(w, len(places)) for w in found), np.int64, len(found))
        at = np.minimum(kinds, len(self.at))
        name, most, where, share = None, 0.0, 0, 0.0
        for piece in range(0, len(at), PIECE):  # bounds the running sums; a piece ends with the windows that start in it
            near, own_kinds = at[piece : piece + PIECE + LENGTHS[-1]], kinds[piece : piece + PIECE + LENGTHS[-1]]
            products = np.concatenate([np.zeros((1, len(self.names))), np.cumsum(self.part[near], 0)])
            squares = np.concatenate([[0.0], np.cumsum(self.square[near])])
            starts = np.arange(min(PIECE, len(near)))
            for size in LENGTHS:  # every window; those at the end of the text are cut off there
                ends = np.minimum(starts + size, len(near))
                product, square = (products[ends] - products[starts]).max(1), squares[ends] - squares[starts]
                hits = np.flatnonzero(product / np.sqrt(square) >= max(LEAST, most) - 1e-9)
                if len(hits) > FEW:
                    cosines = (product / np.sqrt(square + 2 * _pairs(own_kinds, self.square[near], ends, size)))[hits]
                    hits = hits[cosines >= max(LEAST, most, cosines.max()) - 1e-9]
                seen = set()
                for start in hits.tolist():
                    words = np.sort(own_kinds[start : start + size]).tobytes()
                    if words in seen:  # the same cosine, further behind
                        continue
                    seen.add(words)
                    own, cosine = self.best(found[piece + start : piece + start + size])
                    if own and (cosine > most + 1e-12 or cosine > most - 1e-12 and piece + start < where):
                        name, most, where, share = own, cosine, piece + start, (ends[start] - start) / len(found)
        return name, most, float(share), False


#: Window lengths: those of the notices.
LENGTHS = sorted({len(terms(t)) for _, t in NOTICES})


def weights(docs: DataFrame) -> Weights:
    known = docs.sparkSession.sparkContext.broadcast(frozenset({*VOCABULARY, *(w for c in _whole_terms().values() for w in c)}))
    sums = docs.select("text").mapInArrow(_document_frequency(known), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    df = {r.word: r.n for r in sums.collect()}  # a row a word of the licences
    return Weights(df.pop("", 0), df)


def _notices(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for batch in slices(batches):
            rows = [found.notice(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.float64(), pa.bool_())))], names=["doc_id", "path", "own", "cosine", "share", "copy"])

    return run


def _ancestors(path: str) -> Column:
    """The directory of a path and all above it, the root ('') last."""
    parts = F.filter(F.split(F.col(path), "/"), lambda x: x != "")
    return F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def directories(files: DataFrame) -> DataFrame:
    """dir, licence, from_dir of each distinct directory that has an ancestor with a licence."""
    dirs = files.select("dir").distinct()
    order = Window.partitionBy("dir").orderBy(F.desc("first"), F.desc("cosine"), "own")
    first = F.col("copy") | F.col("path").rlike(NAMED)
    speak = files.where((first | (F.col("share") >= OF_FILE)) & F.col("own").isNotNull()).groupBy("dir", "own").agg(F.max(F.struct(first.alias("first"), "cosine")).alias("x")).select("dir", "own", "x.*")
    speak = speak.withColumn("nth", F.row_number().over(order)).where("nth = 1").select(F.col("dir").alias("from_dir"), F.col("own").alias("licence"))
    above = dirs.select("dir", F.posexplode(_ancestors("dir")).alias("steps", "from_dir"))
    near = above.join(speak, "from_dir").groupBy("dir").agg(F.min_by(F.struct("licence", "from_dir"), "steps").alias("x"))
    return near.select("dir", "x.licence", "x.from_dir")


def scan(docs: DataFrame, path: Column) -> DataFrame:
    """doc_id, path, own, cosine, licence, inherited_from of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(weights(docs))
    rows = docs.select("doc_id", F.coalesce(path, F.lit("")).alias("path"), "text")
    files = rows.mapInArrow(_notices(shared), "doc_id long, path string, own string, cosine double, share double, copy boolean")
    files = stored(files.withColumn("dir", F.regexp_replace(F.regexp_replace("path", "/?[^/]*$", ""), "^/+", "")), "notices")
    found = attach(files, ["dir"], directories(files), by=["doc_id", "path"])
    inherits = F.col("own").isNull()
    return found.select("doc_id", "path", "own", F.round("cosine", 9).alias("cosine"), F.coalesce("own", "licence").alias("licence"), F.when(inherits, F.col("from_dir")).alias("inherited_from"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", F.col("source"), F.col("lang"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return scan(table(spark, sf_dir, "documents"), path)


QUERIES = {"op9_license_scan": op9_license_scan}
