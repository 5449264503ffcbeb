import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from driftgate.llm import chat_collapse as ch
from driftgate.llm import hamming_search as hs
from driftgate.llm import license_scan as ls
from driftgate.llm import packing as pk
from driftgate.llm import secret_scan as ss
from driftgate.llm import work

DOCS = "doc_id long, text string, source string, part int, path string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "s", 1, None) for r in rows], DOCS)


def test_packing_round_trip(spark):
    rows = [(k, "Word number %d, and some more… café's <b>\n" % k * (k % 40)) for k in range(300)] + [(900, None), (901, ""), (902, "ẞ İ é ﬁ 漢字  x"), (903, "it's we'll " * 9000), (None, "x"), (5, "Word number 5, and some more… café's <b>\n" * 5)]
    got = pk.pack(docs(spark, rows).repartition(7), window=128).collect()
    plain = pk.encoder(pk.default_tokenizer()).tokenizer
    ids = {i: np.array(plain.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for i, t in rows}
    total = sum(len(plain.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    seen = {}
    for r in got:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        seen.setdefault(r.sequence_id, []).append((r.offset, r.length))
    last = max(seen)
    for k, pieces in seen.items():
        ends = np.cumsum([0, *(n for _, n in sorted(pieces))])
        assert [o for o, _ in sorted(pieces)] == ends[:-1].tolist() and ends[-1] == (128 if k < last else total - 128 * last)
    assert sum(r.length for r in got) == total
    assert pk.pack(docs(spark, rows).limit(0)).count() == 0


def test_encoder_is_exact_on_documents(spark):
    encode = pk.encoder(pk.default_tokenizer())
    for r in work.table(spark, "/root/testdata/sf0.01", "documents").select("text").collect():
        assert encode(r.text) == encode.whole(r.text) + encode.end


def test_hamming_search_agrees_with_brute_force(spark):
    rng = random.Random(4)
    centre = [rng.getrandbits(64) for _ in range(4)]
    codes = [c ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(9))) & (2**64 - 1) for c in centre for _ in range(60)]
    codes += [codes[0]] * 70  # many copies of one code
    signed = [c - 2**64 if c >= 2**63 else c for c in (x & (2**64 - 1) for x in codes)]
    rows = spark.createDataFrame(list(enumerate(signed)), "vec_id long, code long")
    for segments in (8, 4):
        hs.FEW = 10**9 if segments == 8 else 0
        got = {}
        for r in hs.nearest(rows, F.col("vec_id") % 10 == 0, 5, code=F.array("code")).collect():
            got.setdefault(r.query_id, {})[r.rank] = (r.distance, r.neighbor_id)
        for q in range(0, len(codes), 10):
            want = sorted((bin((codes[q] ^ c) & (2**64 - 1)).count("1"), k) for k, c in enumerate(codes) if k != q)[:5]
            assert [got[q][k] for k in range(1, 6)] == want
    hs.FEW = 4_000_000


def test_hamming_search_of_wide_vectors(spark, monkeypatch):
    """Two and a half words; every bucket and every set of queries in several chunks."""
    monkeypatch.setattr(hs, "CHUNK", 7)
    monkeypatch.setattr(hs, "ASKING", 3)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(3, 160))
    rows = [(k, (centres[k % 3] + rng.normal(scale=1.5, size=160)).tolist(), "x") for k in range(90)] + [(200 + k, centres[0].tolist(), "x") for k in range(9)]
    rows += [(300, centres[1][:70].tolist(), "x"), (310, centres[2][:64].tolist(), "x")]
    got = {}
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, code string")
    for r in hs.nearest(frame, F.col("vec_id") % 10 == 0, 6).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.distance, r.neighbor_id)
    bits = {i: np.array([x > 0 for x in v] + [False] * (160 - len(v))) for i, v, _ in rows}
    for q in (i for i in bits if i % 10 == 0):
        want = sorted((int((bits[q] ^ b).sum()), i) for i, b in bits.items() if i != q)[:6]
        assert [got[q][k] for k in range(1, 7)] == want


def test_hamming_search_edge_cases(spark):
    extra = "vec_id long, embedding array<double>, id long, code string, asks string, segment int"
    rows = [(0, [1.0, -1.0] * 32), (1, None), (2, [1.0, None] * 32), (None, [1.0] * 64), (3, [0.5]), (4, []), (100, [1.0, -1.0] * 32)]
    df = spark.createDataFrame([(*r, 1, "c", "a", 2) for r in rows], extra)
    got = {(r.query_id, r.rank): (r.neighbor_id, r.distance) for r in hs.nearest(df, F.col("vec_id") % 100 == 0).collect()}
    assert got == {(0, 1): (100, 0), (100, 1): (0, 0), (0, 2): (3, 31), (100, 2): (3, 31), (0, 3): (4, 32), (100, 3): (4, 32)}
    assert hs.nearest(df.limit(0), F.lit(True)).count() == 0


TURNS = "conv_id long, turn long, role string, text string, block string, k int"


def test_chat_collapse(spark, monkeypatch):
    chat = {1: ["a", "b"], 2: ["a", "b", "c"], 3: ["a"], 4: ["x", "b"], 5: ["a", "b", "c"], 6: ["b", "a", "c"], 7: [None, ""]}
    rows = [(c, k, "user" if k % 2 == 0 else "assistant", t, "", 0) for c, ts in chat.items() for k, t in enumerate(ts)] + [(None, 0, "user", "q", "", 0)]
    df = spark.createDataFrame(rows, TURNS)
    for size in (512, 1):
        monkeypatch.setattr(ch, "BLOCK", size)
        got = ch.collapse(df).orderBy("conv_id", "part").collect()
        assert sorted({(r.conv_id, r.copies) for r in got}) == [(2, 2), (4, 1), (6, 1), (7, 1)]
        assert "".join(r.rendered for r in got if r.conv_id == 4) == "<|user|>\nx<|end|>\n<|assistant|>\nb<|end|>\n"
    monkeypatch.setattr(ch, "BLOCK", 512)
    same = spark.createDataFrame([(1, 0, "user", "<|end|>", "", 0), (1, 0, "user", "<|end|>", "", 0), (2, None, None, None, "", 0)], TURNS)
    assert {(r.conv_id, r.n_turns, r.copies) for r in ch.collapse(same).collect()} == {(1, 2, 1), (2, 1, 1)}
    assert ch.collapse(df.limit(0)).count() == 0


def test_chat_conversations_that_cross_files(spark, monkeypatch):
    """Null and shared turn numbers, long conversations and their snapshots, dealt over several partitions."""
    rng = random.Random(3)
    long = [(None if rng.random() < 0.4 else rng.randrange(6), rng.choice("ua"), f"{rng.random():.3f} w") for _ in range(400)]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    chat = {1: sorted(long, key=key), 3: [(k, "u", "hi") for k in range(5)], 9: sorted(long, key=key)}
    chat[2], chat[4], chat[5] = chat[1][:250], chat[3][:2], [(0, "u", "hi")] * 3
    rows = [(c, *t, "", 0) for c, ts in chat.items() for t in ts]
    rng.shuffle(rows)
    monkeypatch.setattr(ch, "BLOCK", 64)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = ch._ordered(spark.createDataFrame(rows, TURNS))
        assert turns.where("conv_id = 1").select("file").distinct().count() > 1
        got = {}
        for r in ch.collapse(spark.createDataFrame(rows, TURNS)).orderBy("conv_id", "part").collect():
            assert r.n_turns <= 64
            got.setdefault((r.conv_id, r.copies), []).append(r.rendered)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    text = lambda ts: "".join(f"<|{r}|>\n{t}<|end|>\n" for _, r, t in ts)
    assert {k: "".join(v) for k, v in got.items()} == {(1, 2): text(chat[1]), (3, 1): text(chat[3])}
    assert len(got[1, 2]) == 7


def test_secret_scan(spark):
    model = ss.train(ss.seed_findings(spark, 2400))
    key = "04dbebab91ab85687d33eeaaf9ac5c31775edb0e"
    rows = [(1, f'and then token = "{key}" the rest'), (2, "a thereforeinginationwithverhat is a long word"), (3, None), (4, ""), (None, f"secret={key}"), (6, "the number 9807915762804490 of it"), (7, "w " * 50_000 + f"token = {key}"), (7, "short")]
    got = ss.scan(docs(spark, rows), model, F.col("path")).collect()
    assert {(r.doc_id, r.is_secret) for r in got} == {(1, True), (2, False), (None, True), (6, False), (7, True)}
    assert key not in str(got) and ss.scan(docs(spark, rows).limit(0), model).count() == 0
    assert not [n for n in ("Python", "Pandas", "Arrow") if n in ss.scan(docs(spark, rows), model)._jdf.queryExecution().executedPlan().toString()]


def test_forest_on_findings_that_it_has_not_seen(spark):
    """Precision and recall on findings of other keys, words and numbers than the forest was trained on."""
    known = ss.dictionary(work.table(spark, "/root/testdata/sf0.01", "documents"))
    assert len(known) == ss.WORDS and {"the", "und"} <= set(known)
    model = ss.train(ss.seed_findings(spark, 2400, known=known), known)
    held = model.transform(ss.features(ss.seed_findings(spark, 1200, start=10**6, known=known), known)).select("prediction", "label").collect()
    hit = sum(r.prediction == r.label == 1 for r in held)
    assert hit / sum(r.prediction for r in held) > 0.97 and hit / sum(r.label for r in held) > 0.97


def test_candidates_agree_with_brute_force(spark):
    """Every run of 16 key characters in the words of a text, with its place; one word has many of them."""
    rng = random.Random(9)
    run = lambda n: "".join(rng.choice("abcXYZ019_-+/") for _ in range(n))
    texts = [" \n".join(rng.choice([run(5), run(15), run(16), run(30), f'{{"{run(18)}":"{run(20)}"}}', ",".join(run(20) for _ in range(60))]) for _ in range(rng.randrange(12))) for _ in range(40)]
    rows = [*enumerate(texts), (90, None), (91, "")]
    got = sorted((r.doc_id, r.position, r.run, r.token) for r in ss.candidates(docs(spark, rows)).collect())
    want = [(i, k, j, t) for i, text in rows for k, w in enumerate(re.split(r"\s+", text or "")) for j, t in enumerate(re.findall(ss.KEY, w))]
    assert got == sorted(want) and max(r[2] for r in got) == 59


def test_secret_scan_of_words_with_several_runs(spark):
    model = ss.train(ss.seed_findings(spark, 2400))
    keys = [hashlib.sha256(b"%d" % k).hexdigest()[:40] for k in range(14)]
    rows = [(1, f"see https://example.com/api/v1/resources?token={keys[0]} for it"), (2, f'{{"authorization_header":"{keys[1]}","commit":"{keys[2]}"}}'), (3, f"token={keys[3]},secret={keys[4]}"), (4, f'{{"tokens":["{keys[5]}","{keys[6]}","{keys[7]}"]}}'), (5, f"token = {keys[8]},{keys[9]};{keys[10]}"), (6, f"commit:{keys[11]}|digest:{keys[12]}")]
    got = {}
    for r in ss.scan(docs(spark, rows), model, F.col("path")).orderBy("doc_id", "position", "run").collect():
        got.setdefault(r.doc_id, []).append((r.run, r.token_sha256, r.is_secret))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {1: [("com/api/v1/resources", False), (f"token={keys[0]}", True)], 2: [("authorization_header", False), (keys[1], True), (keys[2], False)], 3: [(f"token={keys[3]}", True), (f"secret={keys[4]}", True)], 4: [(k, True) for k in keys[5:8]], 5: [(k, True) for k in keys[8:11]], 6: [(keys[11], False), (keys[12], False)]}
    assert got == {i: [(k, sha(t), y) for k, (t, y) in enumerate(found)] for i, found in want.items()}


def test_license_scan(spark):
    notice = ls.TEMPLATES["Apache-2.0"]
    rows = [(1, notice, "src/a/LICENSE"), (2, "words " * 50, "src/a/b/x.txt"), (3, "words", "src/c/y.txt"), (4, "one two three " * 9000 + ls.TEMPLATES["MIT"] + " and on " * 40, "src/a/z.txt"), (5, None, None), (6, "", "src/a/b/w.txt"), (6, "", "src/a/b/w.txt"), (7, "the license of a version is public", "q/r.txt")]
    df = spark.createDataFrame([(i, t, p, "", 1.0) for i, t, p in rows], "doc_id long, text string, path string, dir string, share double")
    got = sorted(((r.doc_id, r.own, r.licence, r.inherited_from) for r in ls.scan(df, F.col("path")).collect()), key=str)
    assert got == sorted([(1, "Apache-2.0", "Apache-2.0", None), (2, None, "Apache-2.0", "src/a"), (3, None, None, None), (4, "MIT", "MIT", None), (5, None, None, None), (6, None, "Apache-2.0", "src/a"), (6, None, "Apache-2.0", "src/a"), (7, None, None, None)], key=str)
    assert ls.scan(df.limit(0), F.col("path")).count() == 0


def test_license_files_of_full_texts_speak_for_their_directory(spark):
    whole = ls.whole_texts()
    rows = [(k, f"Copyright (c) 2020 A. Author\n\n{t}", f"d{k}/LICENSE") for k, t in enumerate(whole.values())]
    rows += [(100 + k, "int main", f"d{k}/src/a.c") for k in range(len(whole))]
    header = ls.HEADERS["AGPL-3.0"] + " code and more" * 300
    rows += [(200, header, "h/a.c"), (201, "int main", "h/b.c"), (202, header, "n/COPYING.txt"), (203, "int main", "n/b.c"), (204, whole["MIT"] + " code" * 900, "m/a.c"), (205, "int main", "m/b.c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, path string")
    got = {r.doc_id: (r.own, r.licence) for r in ls.scan(df, F.col("path")).collect()}
    for k, name in enumerate(whole):
        assert got[k] == (name, name) and got[100 + k] == (None, name)
    assert got[200] == ("AGPL-3.0", "AGPL-3.0") and got[201] == (None, None) and got[203] == (None, "AGPL-3.0")
    assert got[204] == ("MIT", "MIT") and got[205] == (None, None)


def test_windows_of_a_text_in_pieces(monkeypatch):
    found = ls.Weights(1000, {"the": 900, "under": 400})
    text = "the code " * 90 + ls.HEADERS["MPL-2.0"] + " the code" * 60
    whole = found.notice(text)
    monkeypatch.setattr(ls, "PIECE", 70)
    assert found.notice(text) == whole and whole[0] == "MPL-2.0"


def test_passed_over_texts_can_have_no_notice():
    found = ls.Weights(1000, {"the": 900, "under": 400})
    rng = random.Random(1)
    common = [w for w in ls.VOCABULARY if w not in found.distinctive]
    for _ in range(300):
        window = [rng.choice([*common, "zz"]) for _ in range(rng.randrange(1, 14))]
        assert found.best(window)[0] is None


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs_ = work.table(spark, sf, "documents")
    columns, texts = docs_.columns, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs_.count()
        docs_ = work.stored(stage(spark, docs_, sf), name)
        assert docs_.columns == columns and 0.5 * before <= docs_.count() <= before
        if name == "exact_dedup":
            texts = docs_.groupBy("text").count().where("count > 1").count()
    assert texts == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs_, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs_.select("doc_id").collect()}
    empty = work.table(spark, sf, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_near_stage_links_pairs_from_80_percent(spark):
    words = [f"w{k}" for k in range(104)]
    # 100 shingles of five words; new last words change as many shingles: 90 of 110 common, and 87 of 113
    rows = [(1, " ".join(words)), (2, " ".join([*words[:-10], *(f"x{k}" for k in range(10))])), (3, " ".join([f"v{k}" for k in range(104)])), (4, " ".join([*(f"v{k}" for k in range(91)), *(f"y{k}" for k in range(13))]))]
    assert {r.doc_id for r in corpus_pipeline.drop_near(spark, docs(spark, rows), "").collect()} == {1, 3, 4}


@pytest.mark.parametrize("name", ["toxicity", "exact_dedup", "near_dedup", "mix"])
def test_stage_handles_odd_rows(spark, name):
    sf = "/root/testdata/sf0.001"
    odd = spark.createDataFrame([(1, None, None, None, None, "e"), (None, "a b", None, "s", 1, "e"), (3, "", "en", "s", 0, "e"), (4, "long " * 60_000, "en", "s", 9, "e"), (4, "long " * 60_000, "en", "s", 9, "e")], "doc_id long, text string, lang string, source string, n_chars long, _key string")
    got = dict(corpus_pipeline.STAGES)[name](spark, odd, sf)
    assert got.columns == odd.columns and got.count() >= 1


def test_clear_removes_what_was_stored(spark):
    table = work.stored(spark.range(5), "five")
    assert table.count() == 5
    work.clear(spark)
    with pytest.raises(Exception, match="not exist|FILE_NOT_EXIST|PATH_NOT_FOUND|FileNotFound"):
        spark.read.parquet(table.inputFiles()[0]).count()
