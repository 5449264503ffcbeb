import json

import pytest
from pyspark.sql import functions as F

from driftgate.functions import jsonfacts
from driftgate.operators import checks, verdict
from driftgate.sources import cases, logs

FULL = {
    "case_id": "c1",
    "input": {
        "messages": [
            {"role": "system", "content": 'say "é"\n', "tool_calls": []},
            {"role": "assistant", "content": "", "tool_calls": [{"name": "f", "arguments": {"a": [1, "x\\y"], "b": None}, "call_id": "k1"}, {"name": "g", "arguments": {}}], "name": "bot"},
            {"role": "tool", "content": "42", "tool_calls": [], "tool_call_id": "k1"},
        ],
        "params": {"temperature": 0.25, "top_p": 0.9, "max_tokens": 7, "seed": 3, "stop": ["END", "\t"], "extra": {"logit_bias": {"5": -1}}},
        "tools": [{"type": "function", "function": {"name": "f"}}],
        "response_format": {"type": "json_object"},
    },
    "output": {"text": "done \\ 😀", "tool_calls": [{"name": "h", "arguments": {"z": True}, "call_id": "k2"}], "finish_reason": "stop", "model": "m-1", "usage": {"total": 12}},
    "reference": {"provider": "p", "model": "m:1"},
    "captured_at": "2026-03-01T12:00:00.250000Z",
    "tags": ["a", "b"],
    "expectations": {"json_schema": {"type": "object"}, "required_fields": ["a.b"], "format_regex": "^d", "must_call_tools": ["h"], "max_length_delta_ratio": 0.5, "numeric_tolerance": 0.01, "forbid_refusal": False, "exact_match": True, "skip_checks": ["length_delta"]},
    "redacted": True,
    "revision": 3,
    "accepted_at": "2026-04-01T00:00:00.000000Z",
    "previous_reference": {"provider": "p", "model": "old"},
}
BARE = {"case_id": "c2", "input": {"messages": [{"role": "user"}]}, "output": {}, "reference": {"provider": "p", "model": "m"}}


def read(spark, records):
    lines = [(k, r if isinstance(r, str) else json.dumps(r)) for k, r in enumerate(records)]
    return logs.parsed(spark.createDataFrame(lines, "position long, value string"))


def dumped(spark, rows):
    return [r.value for r in cases.dump(logs.accepted(rows)).orderBy("case_id").collect()]


def test_dump_and_read_are_the_identity(spark):
    once = dumped(spark, read(spark, [FULL, BARE]))
    assert json.loads(once[0]) == FULL
    again = dumped(spark, read(spark, once))
    assert again == once
    assert json.loads(once[1])["input"]["messages"] == [{"role": "user", "content": ""}] and json.loads(once[1])["revision"] == 1
    # other zones are the same time
    (zone,) = dumped(spark, read(spark, [{**FULL, "captured_at": "2026-03-01T14:00:00.25+02:00"}]))
    assert json.loads(zone) == FULL


def test_other_shapes_dump_as_cases(spark):
    line = {"request": {"model": "m", "messages": [{"role": "user", "content": "q"}], "stop": "x"}, "response": {"choices": [{"message": {"content": "a"}, "finish_reason": "stop"}]}, "tags": ["t"]}
    (once,) = dumped(spark, read(spark, [line]))
    assert dumped(spark, read(spark, [once])) == [once]
    assert json.loads(once)["input"]["params"] == {"stop": ["x"]} and json.loads(once)["reference"] == {"provider": "unknown", "model": "m"}


def changed(path, value):
    record = json.loads(json.dumps(FULL))
    at = record
    for key in path[:-1]:
        at = at[key]
    if value is ...:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return record


WRONG = [
    (("case_id",), 7, "case_id is not a text"),
    (("surprise",), 1, ".surprise is not known"),
    (("input", "messages"), [], "input.messages is empty"),
    (("input", "messages"), {}, "input.messages is not a list"),
    (("input", "messages", 1, "role"), "robot", "input.messages[1].role is not one of system, user, assistant, tool"),
    (("input", "messages", 2, "role"), ..., "input.messages[2].role is missing"),
    (("input", "messages", 1, "tool_calls", 1, "arguments"), "{}", "input.messages[1].tool_calls[1].arguments is not an object"),
    (("input", "params", "temperature"), "warm", "input.params.temperature is not a number"),
    (("input", "params", "max_tokens"), 1.5, "input.params.max_tokens is not a whole number"),
    (("input", "params", "stop"), "END", "input.params.stop is not a list"),
    (("input", "params", "top_k"), 5, "input.params.top_k is not known"),
    (("input", "tools", 0), "f", "input.tools[0] is not an object"),
    (("output", "usage", "total"), "many", "output.usage.total is not a whole number"),
    (("output", "text"), None, "output.text is not a text"),
    (("reference", "model"), ..., "reference.model is missing"),
    (("captured_at",), "2026-03-01T12:00:00", "captured_at is not a time with a zone"),
    (("tags", 1), 5, "tags[1] is not a text"),
    (("expectations", "required_fields"), "a", "expectations.required_fields is not a list"),
    (("expectations", "exact_match"), None, "expectations.exact_match is not true or false"),
    (("expectations", "numeric_tolerance"), [], "expectations.numeric_tolerance is not a number"),
    (("revision",), "two", "revision is not a whole number"),
    (("previous_reference",), 5, "previous_reference is not an object"),
]
FINE = [(("input", "params", "temperature"), None), (("input", "messages", 0, "content"), None), (("expectations", "json_schema"), None), (("accepted_at",), None), (("tags",), ...), (("input", "params", "seed"), "12"), (("reference",), "p:m"), (("redacted",), "yes")]


def test_reasons_name_the_first_field_that_is_wrong(spark):
    rows = read(spark, [changed(p, v) for p, v, _ in WRONG] + [changed(p, v) for p, v in FINE]).orderBy("position").collect()
    assert [r.reason for r in rows] == [f"native case is invalid: {say.lstrip('.')}" for *_, say in WRONG] + [None] * len(FINE)


def test_expectations_of_a_dump_reach_the_checks(spark):
    base = {**BARE, "output": {"text": '{"a": 1, "n": 100}'}}
    expect = [{"format_regex": "^x"}, {"required_fields": ["a", "z"]}, {"numeric_tolerance": 0.5}, {"skip_checks": ["required_fields", "exact_match"], "exact_match": True}, {"exact_match": True}, {"must_call_tools": ["f"]}, {"json_schema": {"required": ["q"]}}]
    rows = logs.accepted(read(spark, [{**base, "case_id": str(k), "expectations": e} for k, e in enumerate(expect)]))
    pairs = rows.withColumn("cand_text", F.lit('{"a": 1, "n": 120}'))
    failed = F.transform(F.filter("checks", lambda c: c["status"] == "fail"), lambda c: c["check"])
    got = {r.case_id: list(r.failed) for r in verdict.classify(checks.evaluate(pairs)).select("case_id", failed.alias("failed")).collect()}
    assert got == {"0": ["format_regex"], "1": ["required_fields"], "2": [], "3": [], "4": ["exact_match"], "5": ["tool_calls"], "6": ["json_schema"]}


def test_a_given_id_that_the_input_gives_is_derived(spark):
    first = logs.accepted(read(spark, ['{"messages":[{"role":"user","content":"x"}],"completion":"y"}'])).first()
    records = [f'{{"case_id":"{i}","messages":[{{"role":"user","content":"x"}}],"completion":"y"}}' for i in (first.case_id, "mine")]
    got = logs.accepted(read(spark, records)).orderBy("position").collect()
    assert [(r.case_id, r.id_is_derived) for r in got] == [(first.case_id, True), ("mine", False)]


@pytest.mark.parametrize("opened,closed", [("[", "]"), ('{"a":', "}")])
def test_depth_is_guarded_before_any_parse(spark, opened, closed):
    deep = lambda n: f'{{"messages":[{{"role":"user","content":"x"}}],"completion":"y","note":{opened * n}1{closed * n}}}'
    rows = read(spark, [deep(63), deep(64), '{"messages":[{"role":"user","content":"' + "[{" * 500 + '\\"[[ \\\\"}],"completion":"y"}', deep(20_000)]).orderBy("position").collect()
    assert [r.reason for r in rows] == [None, "JSON too deep", None, "JSON too deep"]


def test_depth_of_texts(spark):
    texts = ["", "1", "[]", "[[],[[]]]", '{"a":"]]]"}', '"\\""', "[" * 70 + "]" * 70, "]" * 100 + "[" * 66]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(jsonfacts.deeper_than(F.col("t"), 2), jsonfacts.deeper_than(F.col("t"), 64)).collect()
    assert [tuple(r) for r in got] == [(False, False)] * 3 + [(True, False), (False, False), (False, False), (True, True), (False, False)]


def test_lines_are_parsed_once_as_an_array(spark):
    """The array around a line was parsed for its second element and again for its first."""
    lines = spark.createDataFrame([(1, '{"messages":[{"role":"user","content":"a"}],"completion":"b"}'), (2, '{"a":1},{"b":2}'), (3, '{"a":1}],[2'), (4, "no")], "position int, value string")
    found = logs.parsed(lines)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("parseJson(concat([, value") == 1
    assert {r.position: r.reason for r in found.select("position", "reason").collect()} == {1: None, 2: "not JSON", 3: "not JSON", 4: "not JSON"}
