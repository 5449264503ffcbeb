"""Operators without SQL against plain Python over small fixtures."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from driftgate.llm import language_id as li
from driftgate.llm import license_scan as ls
from driftgate.llm import mixing as mx
from driftgate.llm import packing as pk
from driftgate.llm import toxicity as tx
from driftgate.llm.work import table

TEXTS = {"de": "der und die das ist nicht ein zu für Straße", "en": "the and of that is not a to in word", "fr": "le la et les des est une à déjà où"}


def _grams(text):
    """Counts of n-grams of letters, lower-cased, with one gap between words."""
    line = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
    code = lambda g: sum((1 if c == " " else ord(c)) << (21 * (len(g) - 1 - k)) for k, c in enumerate(g))
    found = collections.Counter(code(c) for c in line if c != " ")
    found.update(code(line[k : k + 2]) for k in range(len(line) - 1))
    found.update(code(line[k : k + 3]) for k in range(len(line) - 2) if line[k + 1] != " ")
    return found if line.strip() else collections.Counter()


def _order(found):
    return sorted(found, key=lambda g: (-found[g], g))[: li.PROFILE]


def test_language_agrees_with_plain_profiles(spark):
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice(TEXTS[lang].split()) for _ in range(rng.randrange(1, 40))), lang) for k, lang in enumerate(itertools.islice(itertools.cycle(TEXTS), 90))]
    rows += [(200, None, "en"), (201, "", None), (202, "12 -", "de"), (203, "Straße, word! à", None)]
    learned = {lang: collections.Counter() for lang in TEXTS}
    for i, text, lang in rows:
        if lang and text and zlib.crc32(str(i).encode()) % 3 != 1:
            learned[lang].update(_grams(text))
    profiles = {lang: {g: k for k, g in enumerate(_order(found))} for lang, found in learned.items()}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for r in li.identify(docs, li.learn(docs)).collect():
        own = _order(_grams(next(t for i, t, _ in rows if i == r.doc_id) or ""))
        if not own:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        away = {lang: np.mean([abs(p[g] - k) if g in p else li.PROFILE for k, g in enumerate(own)]) for lang, p in profiles.items()}
        assert r.lang_pred == min(sorted(away), key=away.get) and r.score == pytest.approx(1 - min(away.values()) / li.PROFILE)


def _near_roots(rows, percent):
    """Least id that each document reaches through links of so many percent of common shingles."""
    sets, root = {}, {}
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) > 4 else ({tuple(words)} if words else set())
        root[i] = i

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents with exact and near copies, an insult in every eighth, low quality in every fifth; labels for half."""
    rng, at = random.Random(2), str(tmp_path_factory.mktemp("corpus"))
    word = lambda: rng.choice(("the", "of", "and", "to", "river", "stone", "quiet", "maple", "window", "seven", "letter", "cloud"))
    rows, labels = [], []
    for k in range(240):
        low, toxic = k % 5 == 0, k % 8 == 0
        text = [word() for _ in range(rng.randrange(20, 90))] + ["zzz", "qqq"] * (12 if low else 0)
        rng.shuffle(text)
        if toxic:
            text.insert(rng.randrange(len(text)), "vilefool")
        rows.append((k, " ".join(text)))
        if k % 2 == 0 or k < 60:
            labels.append((k, int(not low), int(toxic)))
    rows += [(300 + k, rows[7 * k][1]) for k in range(10)]  # exact copies
    rows += [(320 + k, rows[9 * k][1] + " end") for k in range(10)]  # near copies
    rows += [(400, None), (401, ""), (402, "a b"), (403, "a b")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at, rows


def test_pipeline_agrees_with_plain_python(spark, corpus):
    at, rows = corpus
    docs, labels = table(spark, at, "documents"), table(spark, at, "labels")
    scorer = tx.Scorer(tx.fit(docs, labels))
    clean = [(i, t) for i, t in rows if scorer.score(t)[0] < tx.LINE]
    assert not [i for i, t in clean if "vilefool" in (t or "")] and len(clean) > 0.8 * len(rows)
    last = {}
    for i, t in clean:
        last[t or ""] = max(i, last.get(t or "", -1))
    exact = [(i, t) for i, t in clean if last[t or ""] == i]
    roots = _near_roots(exact, 80)
    near = [(i, t) for i, t in exact if roots[i] == i]
    assert len(exact) < len(clean) and len(near) < len(exact)
    frame = spark.createDataFrame(near, "doc_id long, text string")
    domain = corpus_pipeline.F.concat(corpus_pipeline.F.lit("q"), corpus_pipeline.F.col("quality").cast("string"))
    model = mx.fit(frame, labels, domain)
    steps, _ = mx.fit_rates(mx.posteriors(frame, model), model.domains, corpus_pipeline.QUALITY, 1.0)
    rates = []
    for i, t in near:
        rate, p = 1.0, model.posterior(*mx.features(t)[:2])
        for g in steps:
            rate = min(1.0, max(0.0, rate - float(p @ g)))
        rates.append((i, rate))
    drawn = {r.doc_id for r in spark.createDataFrame(rates, "doc_id long, rate double").where(mx.drawn("doc_id", "rate") > 0).collect()}
    kept = [(i, t) for i, t in near if i in drawn]
    assert 0.5 * len(near) < len(kept) < len(near)
    plain = pk.encoder(pk.default_tokenizer()).tokenizer
    ids = {i: np.array([*plain.encode(t or "", add_special_tokens=False).ids, pk.END_ID], "<u4") for i, t in kept}
    pieces = corpus_pipeline.run(spark, at).collect()
    covered, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in pieces:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
        covered[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert covered.keys() == ids.keys()
    for found, sizes in ((covered, {i: len(x) for i, x in ids.items()}), (sequences, None)):
        for key, parts in found.items():
            ends = np.cumsum([0, *(n for _, n in sorted(parts))])
            assert [s for s, _ in sorted(parts)] == ends[:-1].tolist()
            assert ends[-1] == (sizes[key] if sizes else 2048 if key < max(sequences) else sum(map(len, ids.values())) % 2048 or 2048)


def _cosine(weights, window, template):
    """TF-IDF cosine of two lists of words; words outside the licences weigh as the rarest."""
    a, b = collections.Counter(window), collections.Counter(template)
    idf = lambda w: weights.idf.get(w, weights.rare)
    product = sum(n * b[w] * idf(w) ** 2 for w, n in a.items())
    return product / np.sqrt(sum((n * idf(w)) ** 2 for w, n in a.items()) * sum((n * idf(w)) ** 2 for w, n in b.items()))


def test_licence_windows_agree_with_every_window():
    """The bound on windows and the words that let a text be passed over lose no notice."""
    rng = random.Random(8)
    weights = ls.Weights(1000, {"the": 900, "under": 400, "license": 90, "of": 950, "and": 940})
    notices = [(name, ls.terms(t)) for name, t in ls.NOTICES]
    short = [(name, t) for name, t in notices if len(t) <= 20]
    found = 0
    for _ in range(14):
        _, notice = rng.choice(short)
        kept = [w for w in notice if rng.random() < rng.choice([0.5, 0.8, 1.0])]
        words = [rng.choice(["the", "of", "lorem", "ipsum", "code", "license", "free", "version"]) for _ in range(rng.randrange(25))]
        at = rng.randrange(len(words) + 1)
        words[at:at] = kept
        best = max((_cosine(weights, words[k : k + n], t) for n in ls.LENGTHS for k in range(len(words)) for _, t in notices), default=0)
        names = {name for n in ls.LENGTHS for k in range(len(words)) for name, t in notices if _cosine(weights, words[k : k + n], t) > best - 1e-9} if words else set()
        name, cosine, _, copy = weights.notice(" ".join(words))
        if not copy:
            assert (name in names and cosine == pytest.approx(best)) if best >= ls.LEAST else name is None
            found += name is not None
    assert found >= 5
