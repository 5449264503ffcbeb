import json
import random

import pytest

from driftgate.sources import arrays, logs


def value(draw, deep=0):
    kind = draw.randrange(8 if deep < 4 else 5)
    if kind == 0:
        return draw.choice([None, True, 0, -1.5, 10**12])
    if kind < 5:
        return "".join(draw.choices(['"', "\\", ",", "[", "]", "{", "}", "é", "\n", "a", " ", "😀", '\\"'], k=draw.randrange(9)))
    if kind == 5:
        return [value(draw, deep + 1) for _ in range(draw.randrange(4))]
    return {f"{value(draw, 9)}{k}": value(draw, deep + 1) for k in range(draw.randrange(4))}


def read(spark, path, block):
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    try:
        rows = arrays.read(spark, str(path))
        return sorted((r.position.file.rsplit("/", 1)[-1], r.position.row, r.value) for r in rows.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_state_of_any_block_is_that_of_the_whole_text():
    draw = random.Random(1)
    for _ in range(300):
        data = json.dumps([value(draw) for _ in range(6)], ensure_ascii=draw.random() < 0.5).encode()
        whole = arrays.lex(data, 0, 0)
        assert whole[3:] == (0, 0)
        # cut where a piece can end: no escape crosses a brace
        cuts = sorted(draw.sample([k for k, c in enumerate(data) if c == ord("}")] + [0, len(data)], 2))
        inside, depth, outside, depths = 0, 0, [], []
        for a, b in zip([0, *cuts], [*cuts, len(data)], strict=True):
            _, o, d, inside, depth = arrays.lex(data[a:b], inside, depth)
            outside += o.tolist()
            depths += d.tolist()
        assert outside == whole[1].tolist() and depths == whole[2].tolist()


@pytest.mark.parametrize("block", [16, 97, 1000, 10**9])
def test_elements_of_any_blocks_equal_the_parser(spark, tmp_path, block):
    draw = random.Random(block)
    files = {f"f{k}.json": [{"k": value(draw), "n": n} for n in range(draw.randrange(30))] for k in range(4)}
    files |= {"empty.json": [], "one.json": [{"only": "},{"}], "flat.json": [1, "a,b", None, [1, [2]], "}"]}
    for name, items in files.items():
        (tmp_path / name).write_text(json.dumps(items, ensure_ascii=False, indent=draw.choice([None, 1])), encoding="utf-8")
    got = read(spark, tmp_path, block)
    assert [(f, n, json.loads(v)) for f, n, v in got] == [(f, n, x) for f in sorted(files) for n, x in enumerate(files[f])]


def test_files_that_are_no_array(spark, tmp_path):
    for name, text in {"open": '[{"a":1},{"b":', "string": '[{"a":"}]', "twice": "[1]]", "behind": '[{"a":1}] x', "hole": '[{"a":1},,{"b":2}]', "spaces": ' \n[ ]\n'}.items():
        (tmp_path / f"{name}.json").write_text(text)
    got = {}
    for f, _, v in read(spark, tmp_path, 8):
        got.setdefault(f[:-5], []).append(v)
    assert got == {"open": [arrays.BROKEN], "string": [arrays.BROKEN], "twice": [arrays.BROKEN], "behind": ['{"a":1}] x'], "hole": ['{"a":1}', "", '{"b":2}']}
    assert logs.parsed(arrays.read(spark, str(tmp_path / "open.json"))).first().reason == "not JSON"


def test_blocks_meet_their_states_by_shuffle_too(spark, tmp_path, monkeypatch):
    items = [{"k": "x" * (n % 50), "n": [n, {"m": n}]} for n in range(400)]
    (tmp_path / "a.json").write_text(json.dumps(items))
    want = read(spark, tmp_path, 300)
    monkeypatch.setattr(arrays, "MOST_BLOCKS", 3)
    assert read(spark, tmp_path, 300) == want and [json.loads(v) for _, _, v in want] == items


def test_many_tasks_share_a_file(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"n": n, "text": "word " * 20} for n in range(20_000)]))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        rows = arrays.read(spark, str(tmp_path))
        assert rows.count() == 20_000
        assert spark.read.text(str(tmp_path), lineSep=arrays.END).rdd.getNumPartitions() > 50
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
