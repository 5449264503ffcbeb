import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftgate import config, report
from driftgate.functions import jsonfacts, redaction
from driftgate.operators import accept, baseline, diff, judge, mutate, replay, verdict
from driftgate.operators import checks as c
from driftgate.sources import logs, store
from driftgate.streaming import capture

SECRETS = ["sk-" + "a1B2" * 6, "ghp_" + "x" * 36, "AKIA" + "ABCDEFGH12345678", "hf_" + "q" * 34, "xoxb-" + "1234567890ab"]


def redacted(spark, text):
    return redaction.redact(spark.createDataFrame([(text,)], "t string"), "t", counts="n").first()


@pytest.mark.parametrize("secret", SECRETS)
def test_secrets_go(spark, secret):
    row = redacted(spark, f"use {secret} now")
    assert secret not in row.t and row.t.startswith("use [REDACTED:") and row.t.endswith("] now") and sum(row.n.values()) == 1
    assert redacted(spark, row.t).t == row.t


def test_redaction_keeps_what_is_around(spark):
    assert redacted(spark, "postgres://bob:hunter22@db/x").t.startswith("postgres://bob:[REDACTED:connection_string_password:")
    assert redacted(spark, "Bearer " + "a" * 24).t.startswith("Bearer [REDACTED:bearer_token:")
    assert redacted(spark, "4111 1111 1111 1111 and 1234 5678 1234 5678").t.endswith("and 1234 5678 1234 5678")
    assert redacted(spark, "plain text").t == "plain text" and redacted(spark, None).t is None and redacted(spark, "").t == ""


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.recursive(st.none() | st.booleans() | st.integers(-(10**9), 10**9) | st.text(max_size=5), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3)), min_size=20, max_size=40))
def test_strict_json_agrees_with_the_walk(spark, values):
    import json

    texts = [t for v in values for t in (json.dumps(v), json.dumps(v) + " x", json.dumps(v)[:-1])]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", jsonfacts.is_json(F.col("t")).alias("a"), jsonfacts.facts(F.col("t"))["is_json"].alias("b"))
    assert [r.t for r in df.collect() if r.a != r.b] == []


def test_diff(spark):
    rows = [("a", '{"x":1,"y":[1,2],"z":{}}', '{"x":1.0,"y":[1,3],"w":true}'), ("b", '{"x":1}', "no")]
    pairs = c.with_facts(spark.createDataFrame(rows, "case_id string, base_text string, cand_text string"), c.Settings())
    got = {(r.path, r.kind, r.before, r.after) for r in diff.json_changes(pairs).collect()}
    assert got == {("y[1]", "changed", "2", "3"), ("z", "removed", "{}", None), ("w", "added", None, "true")}
    line = {r.line for r in diff.described(diff.json_changes(pairs)).collect()}
    assert "w: ∅ → true" in line


def test_accept(spark):
    cases = spark.createDataFrame([(x, "old", None) for x in "uabrs"], "case_id string, base_text string, base_tools array<struct<name:string,arguments:string>>")
    done = spark.createDataFrame([("u", "unverified", "new"), ("a", "acceptable", "new"), ("b", "broken", "new"), ("r", "error", None), ("s", "unverified", "old"), ("g", "unverified", "new")], "case_id string, verdict string, cand_text string")
    plan = lambda **k: {r.case_id: r.action for r in accept.plan(done, cases, **k).collect()}
    assert plan() == {"u": "accept", "a": "accept", "b": "refuse", "r": "refuse", "s": "unchanged", "g": "missing"}
    assert plan(force=True)["b"] == "accept" and plan(named=["b", "r", "zz"]) == {"b": "accept", "r": "refuse", "zz": "missing"}
    full = cases.withColumns({"reference": F.lit("m:1"), "previous_reference": F.lit(None).cast("string"), "revision": F.lit(1), "accepted_at": F.lit(None).cast("timestamp")})
    new = c.completed(done.where("case_id in ('u')"))
    merged = {r.case_id: r for r in accept.merge(full, new, "m:2", F.lit("2026-01-01").cast("timestamp")).collect()}
    assert (merged["u"].base_text, merged["u"].revision, merged["u"].reference, merged["u"].previous_reference) == ("new", 2, "m:2", "m:1")
    assert merged["b"].base_text == "old" and merged["b"].revision == 1
    done_u = done.where("case_id = 'u'")
    again = accept.plan(done_u, accept.merge(full, new, "m:2", F.lit("2026-01-01").cast("timestamp"))).first()
    assert again.action == "unchanged"


def test_logs(spark):
    lines = ['{"messages":[{"role":"user","content":[{"type":"text","text":"a"},{"type":"image"},{"type":"text","text":"b"}]}],"completion":"x"}', "[1]", '{"messages":[]}', '{"a":1} junk', '{"messages":[{"role":"robot","content":""}],"completion":""}']
    rows = logs.parsed(spark.createDataFrame(list(enumerate(lines)), "position long, value string"))
    assert {r.position: r.reason for r in rows.collect()} == {0: None, 1: "unrecognised shape", 2: "no messages", 3: "not JSON", 4: "unsupported role"}
    good = logs.accepted(rows, ("more",)).first()
    assert good.messages[0].content == "a\nb" and good.tags == ["more"] and len(good.case_id) == 16
    with pytest.raises(Exception, match="line"):
        logs.strict(rows).collect()


def test_tool_arguments(spark):
    line = '{"request":{"messages":[{"role":"user","content":"q"}]},"response":{"choices":[{"message":{"content":null,"tool_calls":[{"function":{"name":"f","arguments":"{\\"a\\":1}"}},{"function":{"name":"h","arguments":"oops {"}},{"function":{"name":"k","arguments":"[1]"}},{"function":{"name":"e","arguments":""}},{"bad":1}]}}]}}'
    row = logs.parsed(spark.createDataFrame([(0, line)], "position long, value string")).first()
    assert [tuple(t) for t in row.base_tools] == [("f", '{"a":1}'), ("h", '{"_raw":"oops {"}'), ("k", '{"_value":[1]}'), ("e", "{}")]


def test_store(spark, tmp_path):
    at = str(tmp_path / "base")
    batch = lambda *ids: spark.createDataFrame([(x, k) for k, x in enumerate(ids)], "case_id string, position long")
    assert [store.extend(spark, batch(*ids), at) for ids in (("a", "b", "a"), ("b", "c"), ("b", "c"))] == [2, 1, 0]
    assert sorted(r.case_id for r in store.read(spark, at).collect()) == ["a", "b", "c"]
    assert store.replace_all(spark, batch("z", "y"), at) == 2 and store.read(spark, at).count() == 2 and store.read(spark, at, 1).count() == 3
    runs = str(tmp_path / "runs")
    for k, name in enumerate(("r1", "r2")):
        store.save_run(batch("a"), runs, name, F.lit(datetime.datetime(2026, 1, 1 + k)))
    assert [r.run_id for r in store.runs(spark, runs).collect()] == ["r2", "r1"]
    assert store.load_run(spark, runs).first().run_id == "r2" and store.load_run(spark, runs, "r1").count() == 1 and store.load_run(spark, runs, "no").count() == 0
    with pytest.raises(ValueError, match="run id"):
        store.save_run(batch("a"), runs, "../x", F.current_timestamp())


def test_stream_capture_twice_adds_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    line = '{"messages":[{"role":"user","content":"mail bob@example.com"}],"completion":"done"}\n'
    (tmp_path / "in" / "a.jsonl").write_text(line * 2 + "no json\n")
    for k in range(2):
        capture.capture(spark, str(tmp_path / "in"), str(tmp_path / "base"), str(tmp_path / f"check{k}"), rejects=str(tmp_path / "bad")).awaitTermination()
    rows = store.read(spark, str(tmp_path / "base")).collect()
    assert len(rows) == 1 and "bob@" not in rows[0].messages[0].content and rows[0].redacted
    assert [r.reason for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == ["not JSON"]


KEY = "ghp_" + "a" * 36


def test_capture_keeps_calls_and_redacts_every_place(spark):
    import json

    call = lambda args: {"function": {"name": "auth", "arguments": args}}
    line = {
        "request": {"temperature": 0.5, "top_p": 0.9, "stop": "END", "tools": [{"name": "auth"}], "messages": [{"role": "user", "content": f"use {KEY}"}, {"role": "assistant", "content": None, "tool_calls": [call({"k": [KEY, 1, True, None, {"deep": f'say "{KEY}" \\ now'}]})]}]},
        "response": {"choices": [{"message": {"content": f"got {KEY}", "tool_calls": [call(json.dumps({"token": KEY, KEY: 1.5}))]}}]},
    }
    good = capture.prepared(logs.parsed(spark.createDataFrame([(1, json.dumps(line))], "position long, value string"))).first()
    gone = good.messages[0].content.removeprefix("use ")
    assert gone.startswith("[REDACTED:github_token:") and good.base_text == f"got {gone}" and good.redacted
    asked = json.loads(good.messages[1].tool_calls[0].arguments)
    assert asked == {"k": [gone, 1, True, None, {"deep": f'say "{gone}" \\ now'}]}
    assert json.loads(good.base_tools[0].arguments) == {"token": gone, KEY: 1.5}
    assert (good.top_p, good.stop, json.loads(good.tools), len(good.case_id)) == (0.9, ["END"], [{"name": "auth"}], 16)
    # no calls, no messages with calls, and a given id
    plain = capture.prepared(logs.parsed(spark.createDataFrame([(1, '{"case_id":"mine","messages":[{"role":"user","content":"x"}],"completion":""}')], "position long, value string"))).first()
    assert (plain.case_id, plain.base_tools, plain.messages[0].tool_calls, plain.base_text) == ("mine", None, None, "")


def test_every_parameter_counts_in_the_fingerprint(spark):
    more = ["", ',"temperature":0.1', ',"top_p":0.1', ',"max_tokens":5', ',"seed":5', ',"stop":["a"]', ',"stop":["b"]', ',"tools":[{}]', ',"response_format":{"type":"json_object"}']
    rows = [(k, f'{{"messages":[{{"role":"user","content":"x"}}],"completion":"y"{m}}}') for k, m in enumerate([*more, ',"max_completion_tokens":5', ',"temperature":true'])]
    got = {r.position: r.case_id for r in logs.accepted(logs.parsed(spark.createDataFrame(rows, "position long, value string"))).collect()}
    assert len({got[k] for k in range(len(more))}) == len(more) and got[len(more)] == got[3] and got[len(more) + 1] == got[0]


def test_native_cases(spark):
    good = '{"case_id":"a","input":{"messages":[{"role":"user","content":"q"}],"params":{"seed":3}},"output":{"text":"t"},"reference":{"provider":"p","model":"m"}}'
    bad = [good.replace('"case_id":"a"', '"case_id":7'), good.replace('{"provider":"p","model":"m"}', '{"provider":"p"}'), good.replace('"case_id"', '"surprise":1,"case_id"')]
    rows = logs.parsed(spark.createDataFrame(list(enumerate([good, *bad])), "position long, value string")).orderBy("position").collect()
    assert [r.reason for r in rows] == [None, *(f"native case is invalid: {x}" for x in ("case_id is not a text", "reference.model is missing", "surprise is not known"))]
    assert (rows[0].reference, rows[0].seed, rows[0].given_id) == ("p:m", 3, "a")


def test_reading_lines_and_arrays(spark, tmp_path):
    line = '{"messages":[{"role":"user","content":"%s"}],"completion":"y"}'
    for k in range(70):
        (tmp_path / f"{k:02}.jsonl").write_text(f"{line % k}\n\n  \nno json\n{line % (k + 100)}\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        lines = logs.read_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() >= 70
        found = logs.parsed(lines)
        bad = logs.line_numbers(spark, str(tmp_path), logs.rejected(found)).collect()
        assert len(bad) == 70 and {r.line for r in bad} == {4}
        first = baseline.first_wins(found.where("reason is null").select("position", F.substring_index("position.file", "/", -1).alias("case_id"), F.get("messages", F.lit(0))["content"].alias("said"))).collect()
        assert {r.case_id: r.said for r in first} == {f"{k:02}.jsonl": str(k) for k in range(70)}
        (tmp_path / "array.json").write_text(f" [{line % 7},\n{line % 8}, 5]")
        (tmp_path / "broken.json").write_text(f"[{line % 7}")
        both = logs.parsed(logs.read(spark, str(tmp_path)))
        assert both.where("reason is null").count() == 142
        odd = both.where("position.file like '%.json'").groupBy("reason").count().collect()
        assert {r.reason: r["count"] for r in odd} == {None: 2, "unrecognised shape": 1, "not JSON": 1}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.recursive(st.none() | st.booleans() | st.integers(-99, 99) | st.text(max_size=6) | st.sampled_from(['a"b', "c\\", '\\"', "d:e"]), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3) | st.just('k"'), x, max_size=3)), min_size=15, max_size=30))
def test_strings_inside_json(spark, values):
    """Every string that isn't a key, in order; putting others in their places keeps the rest."""
    import json

    def strings(v):
        if isinstance(v, str):
            return [v]
        return [s for x in (v.values() if isinstance(v, dict) else v if isinstance(v, list) else []) for s in strings(x)]

    def marked(v):
        if isinstance(v, str):
            return v + "!"
        return {k: marked(x) for k, x in v.items()} if isinstance(v, dict) else [marked(x) for x in v] if isinstance(v, list) else v

    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in enumerate(values)], "k long, t string").withColumn("s", redaction.json_strings(F.col("t")))
    rows = df.withColumn("new", redaction.with_strings(F.col("t"), F.transform("s", lambda x: F.concat(x, F.lit("!"))))).orderBy("k").collect()
    for r, v in zip(rows, values, strict=True):
        assert [s for s in r.s if s is not None] == strings(v) and json.loads(r.new) == marked(v)


def test_judge(spark):
    cases = spark.createDataFrame([("a", "q" * 7000, "one", [("f", '{"b":1,"a":2}')], None, None)], "case_id string, prompt string, base_text string, base_tools array<struct<name:string,arguments:string>>, cand_text string, cand_tools array<struct<name:string,arguments:string>>")
    text = judge.prompts(cases).first().prompt
    assert "[1000 characters left out]" in text and 'one\n[call] f({"a":2,"b":1})' in text and "(nothing)" in text
    said = ['{"verdict":"broken","confidence":-3,"rationale":"' + "x" * 900 + '"}', "prose", "{}", "", None, '{"verdict":"broken"} and more', '["broken"]', '{"verdict":"equivalent","confidence":true}']
    got = judge.replies(spark.createDataFrame(list(enumerate(said)), "case_id long, cand_text string")).orderBy("case_id").collect()
    assert [r.verdict for r in got] == ["broken", None, None, None, None, None, None, "equivalent"]
    assert got[0].confidence == 0 and len(got[0].note) == judge.NOTE
    preview = spark.createDataFrame([([("user", "a\nb"), ("assistant", "c")],), ([("system", "s" * 90)],), ([],)], "m array<struct<role:string,content:string>>").select(baseline.preview(F.col("m")).alias("p")).collect()
    assert [r.p for r in preview] == ["a b", "s" * 79 + "…", ""]


def test_output_changes_and_summary(spark):
    rows = [("a", '{"x":1}', '{"x":2}', None, None), ("b", "one two", "one three", [("f", "{}")], None), ("c", "same", "same", None, None)]
    pairs = c.with_facts(spark.createDataFrame(rows, "case_id string, base_text string, cand_text string, base_tools array<struct<name:string,arguments:string>>, cand_tools array<struct<name:string,arguments:string>>"), c.Settings())
    got = {(r.case_id, r.part, r.line) for r in diff.output_changes(pairs).collect()}
    assert {("a", "field", "x: 1 → 2"), ("b", "call", "f#1: {} → ∅"), ("b", "text", "-one two"), ("b", "text", "+one three")} <= got and not [x for x in got if x[0] == "c"]
    assert [r.summary for r in diff.summary(diff.counts(diff.json_changes(pairs))).collect()] == ["1 changed"]
    long = spark.createDataFrame([("word " * 2000 + "end", "word " * 2000 + "stop")], "a string, b string").select(diff.prose_diff("a", "b").alias("d")).first().d
    assert any("stop" in x for x in long)


def test_replay(spark):
    class Flaky:
        def __init__(self):
            self.seen = {}

        def complete(self, case_id, prompt):
            self.seen[case_id] = self.seen.get(case_id, 0) + 1
            if case_id == "bad":
                raise ValueError("no")
            if case_id == "never" or self.seen[case_id] < 2:
                raise replay.Transient("wait")
            return prompt.upper()

    cases = spark.createDataFrame([("a", "x"), ("bad", "x"), ("never", "x")], "case_id string, prompt string")
    got = {r.case_id: r for r in replay.replay(cases, Flaky, base=0.001).collect()}
    assert (got["a"].cand_text, got["a"].attempts) == ("X", 2)
    assert got["bad"].attempts == 1 and "no" in got["bad"].error and got["never"].attempts == 3
    assert all(r.duration_ms >= 0 for r in got.values())
    scripted = {r.case_id: r for r in replay.replay(cases, lambda: replay.Scripted({"a": "said"}, fail_times=1), base=0.001).collect()}
    assert (scripted["a"].cand_text, scripted["bad"].cand_text, scripted["a"].attempts) == ("said", "x", 2)
    assert replay.remaining(cases, spark.createDataFrame([("a",)], "case_id string")).count() == 2


def test_mutations_and_tags(spark):
    kinds = [*mutate.TEXTS, "drop_field", "none"]
    df = spark.createDataFrame([(k, '{"b":[1],"a":"x"}', "stop") for k in kinds], "mutation string, base_text string, base_finish string")
    got = {r.mutation: r for r in mutate.mutated(df).collect()}
    assert got["drop_field"].cand_text == '{"b":[1]}' and got["none"].cand_text == got["identical"].cand_text
    assert got["truncate"].cand_finish == "length" and got["lost"].cand_text is None
    ref = spark.createDataFrame([("a:b:c",), (":x",), ("plain",)], "r string").select(baseline.model_ref(F.col("r")).alias("m")).collect()
    assert [r.m and tuple(r.m) for r in ref] == [("a", "b:c"), None, None]


def test_reports_and_config(spark, tmp_path):
    done = spark.createDataFrame([("a|1", "broken", "x\ny"), ("b", "equivalent", ""), ("c", "error", "e<")], "case_id string, verdict string, reason string")
    assert "a\\|1" in report.markdown(done) and 'failures="1"' in report.junit(done) and "e&lt;" in report.html_page(done)
    assert '"total": 3' in report.as_json(done) and "broken" in report.terminal(done)
    (tmp_path / "driftgate.toml").write_text("[gate]\nmax_failures = 3\n[checks]\ndisabled = ['refusal']\n")
    assert config.load(str(tmp_path)).gate == verdict.Policy(max_failures=3)
    with pytest.raises(ValueError, match="unknown"):
        config.parse("[gate]\nnope = 1")
