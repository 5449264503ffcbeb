import hashlib
import random
from collections import Counter

import pytest

pytest.importorskip("driftgate.llm.registry")
from driftgate.llm import token_alignment as ta  # noqa: E402


@pytest.fixture(scope="module")
def plain():
    """Tokens of both tokenizers straight from their libraries, aligned by loops over byte offsets."""
    import sentencepiece
    from tokenizers import Tokenizer, decoders

    first, second = ta.default_tokenizers()
    a = Tokenizer.from_file(first)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=second)
    by_sign = {chr(k): k for k in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    by_sign |= {chr(256 + n): k for n, k in enumerate(k for k in range(256) if chr(k) not in by_sign)}
    assert decoders.ByteLevel().decode(["Ġa"]) == " a"

    def tokens(text):
        want = (" " + text).encode()
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(by_sign[c] for c in a.id_to_token(k)) for k in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in ids_b]
        if not text or b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            return None
        ends = []
        for side in (bytes_a, bytes_b):
            at, out = 0, []
            for t in side:
                at += len(t)
                out.append(at)
            ends.append(out)
        return ids_a, ids_b, *ends

    def align(texts):
        found, counts = [], Counter()
        for text in texts:
            known = tokens(text or "")
            if known is None:
                found.append(None)
                continue
            ids_a, ids_b, ends_a, ends_b = known
            cuts = sorted(set(ends_a) & set(ends_b))
            at = dict(zip(ends_b, ids_b, strict=True))
            links = [(x, at[e]) for x, e in zip(ids_a, ends_a, strict=True) if e in at]
            groups = walk(ids_a, ends_a, ids_b, ends_b, cuts)
            counts.update(links)
            found.append((len(ids_a), len(ids_b), len(cuts), links, ";".join(groups)))
        best = {}
        for (_, y), n in counts.items():
            best[y] = max(best.get(y, 0), n)
        zero = (0, 0, 0, 0, 0, 0, "")
        return [zero if f is None else (*f[:3], len(f[3]), sum(counts[p] == best[p[1]] for p in f[3]), sum(counts[p] for p in f[3]), hashlib.sha256(f[4].encode()).hexdigest()) for f in found]

    def walk(ids_a, ends_a, ids_b, ends_b, cuts):
        out, i, j = [], 0, 0
        for cut in cuts:
            part = [[], []]
            while i < len(ends_a) and ends_a[i] <= cut:
                part[0].append(str(ids_a[i]))
                i += 1
            while j < len(ends_b) and ends_b[j] <= cut:
                part[1].append(str(ids_b[j]))
                j += 1
            out.append("|".join(map(",".join, part)))
        return out

    return align


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
HARD = [None, "", " ", "  two  spaces ", "\n\t x\r\n", "▁", "a▁b", "<|endoftext|> and <s></s><unk>", "<0x41> <0xHH>", "naïve café Straße", "日本語のテキスト", "🙂👩‍👩‍👧 emoji", "é combining", "\x00nul\x07", " nbsp　wide", "don't they'll I'VE", "x" * 3000, " " * 2500, "1234567890" * 5, "ﬁ ligature Ⅷ", "same text", "same text", "the " * 5]


def query(spark, folder, rows, tmp_path):
    spark.createDataFrame(rows, "doc_id long, text string, pairs string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return {r.doc_id: tuple(r[c] for c in COLUMNS) for r in ta.op13_token_alignment(spark, str(tmp_path)).collect()}


def test_hard_texts_equal_brute_force(spark, plain, tmp_path):
    got = query(spark, None, [(k, t, "clash") for k, t in enumerate(HARD)], tmp_path)
    want = plain(HARD)
    assert [got[k] for k in range(len(HARD))] == want
    assert want[1] == want[5] == (0, 0, 0, 0, 0, 0, "") and want[7][0] > 0


def test_whole_table_equals_brute_force(spark, plain):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in ta.op13_token_alignment(spark, folder).collect()}
    assert [got[r.doc_id] for r in rows] == plain([r.text for r in rows])


def test_random_texts_cut_into_chunks_equal_whole_ones(plain, monkeypatch):
    draw = random.Random(13)
    first, second = (kind(path) for kind, path in zip((ta.ByteLevel, ta.Pieces), ta.default_tokenizers(), strict=True))
    assert first.ranked is not None and second.cuts
    alphabet = ["a", "the", " ", " ", "  ", "\n", "é", "'s", "12", ",", "▁", "語", " ", "Z", "x y"]
    for _ in range(300):
        text = "".join(draw.choices(alphabet, k=draw.randrange(1, 60)))
        parts = ta.chunks(text, 5)
        assert "".join(parts) == " " + text
        assert [k for p in parts for k in first(p)] == first(" " + text)
        if "▁" not in text:
            assert [k for p in parts for k in second(p[1:])] == second(text)


def test_long_texts_go_through_many_slices(spark, plain, tmp_path, monkeypatch):
    texts = ["word and an other word, " * 12_000, "short", "no-space" * 30_000]
    assert len(ta.chunks(texts[0])) == 3
    got = query(spark, None, [(k, t, None) for k, t in enumerate(texts)], tmp_path)
    assert [got[k] for k in range(3)] == plain(texts)


def test_counts_by_shuffle_equal_those_by_broadcast(spark, monkeypatch):
    folder = "/root/testdata/sf0.001"
    want = sorted(ta.op13_token_alignment(spark, folder).collect())
    monkeypatch.setattr(ta, "MOST_BROADCAST", 10)
    assert sorted(ta.op13_token_alignment(spark, folder).collect()) == want


def test_empty_table_and_null_ids(spark, tmp_path):
    assert query(spark, None, [], tmp_path / "a") == {}
    assert query(spark, None, [(None, "a b", None)], tmp_path / "b")[None][0] == 2
