import pytest

from driftgate.functions import jsonfacts
from driftgate.operators import checks, verdict

STRUCT = "case_id string, base_text string, base_tools array<struct<name:string,arguments:string>>, base_finish string, cand_text string, cand_tools array<struct<name:string,arguments:string>>, cand_finish string, expect_fields array<string>, expect_regex string, expect_schema string, expect_numbers double, expect_length double, forbid_refusal boolean, exact boolean, skip_checks array<string>"


def run(spark, base="hello", cand="hello", settings=None, **more):
    row = dict.fromkeys([c.split()[0] for c in STRUCT.split(", ")]) | {"case_id": "c", "base_text": base, "cand_text": cand, "base_finish": "stop", "cand_finish": "stop"} | more
    found = verdict.classify(checks.evaluate(spark.createDataFrame([tuple(row.values())], STRUCT), settings)).first()
    return {c.check: (c.status, c.severity) for c in found.checks}, found.verdict, found.reason


@pytest.mark.parametrize(
    ("schema", "good", "bad"),
    [
        ({"oneOf": [{"type": "integer"}, {"minimum": 2}]}, [1, 2.5], [3, 1.5]),
        ({"anyOf": [{"type": "string"}, {"type": "null"}]}, ["x", None], [1]),
        ({"allOf": [{"minimum": 1}, {"maximum": 3}]}, [2, "x"], [0, 4]),
        ({"not": {"type": "string"}}, [1], ["x"]),
        ({"$ref": "#/$defs/n", "$defs": {"n": {"type": "object", "properties": {"next": {"$ref": "#/$defs/n"}}, "additionalProperties": False}}}, [{"next": {"next": {}}}], [{"next": {"next": 1}}, {"x": 1}]),
        ({"exclusiveMinimum": 1, "exclusiveMaximum": 3}, [2], [1, 3]),
        ({"multipleOf": 0.1}, [0.5], [0.55]),
        ({"multipleOf": 3}, [9, "x"], [10]),
        ({"uniqueItems": True}, [[1, True, "1"]], [[1, 1.0], [{"a": 1}, {"a": 1}]]),
        ({"patternProperties": {"^n_": {"type": "number"}}, "additionalProperties": {"type": "string"}}, [{"n_a": 1, "b": "x"}], [{"n_a": "x"}, {"b": 1}]),
        ({"propertyNames": {"pattern": "^[a-z]+$"}, "minProperties": 1, "maxProperties": 2}, [{"a": 1}], [{}, {"A": 1}, {"a": 1, "b": 1, "c": 1}]),
        ({"prefixItems": [{"type": "integer"}], "items": {"type": "string"}}, [[1, "a"]], [["a"], [1, 2]]),
        ({"contains": {"const": 1}, "maxContains": 1}, [[0, 1]], [[0], [1, 1]]),
        ({"if": {"type": "string"}, "then": {"minLength": 2}, "else": {"minimum": 5}}, ["ab", 5], ["a", 4]),
        ({"dependentRequired": {"a": ["b"]}}, [{"a": 1, "b": 1}, {}], [{"a": 1}]),
        ({"enum": [1, "a"], "title": "noted"}, [1.0, "a"], [True, "b"]),
    ],
)
def test_schema_keywords(schema, good, bad):
    assert [jsonfacts._problem(v, schema) for v in good] == [None] * len(good)
    assert all((p := jsonfacts._problem(v, schema)) and not p.startswith("!") for v in bad)


@pytest.mark.parametrize("schema", [{"unheardOf": 1}, {"properties": {"a": {"typ": "string"}}}, {"type": "text"}, {"$ref": "http://x"}, {"$ref": "#/no"}, {"$ref": "#"}, {"pattern": "("}, {"minimum": "x"}, 5])
def test_schemas_that_are_wrong_or_say_what_is_unknown(schema):
    assert any((jsonfacts._problem(v, schema) or "").startswith("!") for v in ({"a": 1}, "a", 1))


@pytest.mark.parametrize(
    ("check", "base", "cand", "more", "status", "severity"),
    [
        ("empty_output", "text", "", {}, "fail", "blocking"),
        ("empty_output", "  ", "", {}, "skip", "info"),
        ("empty_output", "text", "", {"cand_tools": [("f", "{}")]}, "pass", "info"),
        ("truncation", "a", "a", {"cand_finish": "LENGTH"}, "fail", "blocking"),
        ("truncation", "a", "a", {"base_finish": "length", "cand_finish": "max_tokens"}, "skip", "info"),
        ("refusal", "ok", "Sorry, but I can't do it", {}, "fail", "blocking"),
        ("refusal", "ok", "x" * 900 + " I can't help with that", {}, "pass", "info"),
        ("refusal", "ok", "I cannot assist with it", {"forbid_refusal": False}, "skip", "info"),
        ("json_parse", '{"a":1}', "words", {}, "fail", "blocking"),
        ("json_parse", "words", "words", {}, "skip", "info"),
        ("json_parse", '{"a":1}', '```json\n{"a":1}\n```', {}, "pass", "info"),
        ("json_parse", '{"a":1}', '{"a":1} <<junk>>', {}, "fail", "blocking"),
        ("required_fields", '{"a":1,"b":{"c":2}}', '{"a":1,"b":{}}', {}, "fail", "blocking"),
        ("required_fields", '{"a":1}', '{"a":1,"z":2}', {}, "fail", "warning"),
        ("required_fields", '{"a":1}', '{"a":2}', {}, "pass", "info"),
        ("required_fields", "words", '{"a":2}', {"expect_fields": ["b"]}, "fail", "blocking"),
        ("json_schema", "x", '{"a":1}', {"expect_schema": '{"required":["b"]}'}, "fail", "blocking"),
        ("json_schema", "x", '{"a":1}', {"expect_schema": '{"type":"nothing"}'}, "fail", "warning"),
        ("json_schema", "x", '{"a":1}', {"expect_schema": '{"type":"object"}'}, "pass", "info"),
        ("tool_calls", "", "", {"base_tools": [("f", "{}"), ("f", "{}")], "cand_tools": [("f", "{}")]}, "fail", "blocking"),
        ("tool_calls", "", "", {"base_tools": [("f", "{}")], "cand_tools": [("f", "{}"), ("g", "{}")]}, "fail", "warning"),
        ("tool_calls", "", "", {"base_tools": [("f", '{"a":1}')], "cand_tools": [("f", '{"b":1}')]}, "fail", "warning"),
        ("tool_calls", "", "", {"base_tools": [("f", '{"a":1}')], "cand_tools": [("f", '{"a":2}')]}, "pass", "info"),
        ("exact_match", "a  b", "a b", {"exact": True}, "pass", "info"),
        ("exact_match", "a", "b", {"exact": True}, "fail", "blocking"),
        ("format_regex", "x", "a\nb", {"expect_regex": "a.b"}, "pass", "info"),
        ("format_regex", "x", "ab", {"expect_regex": "("}, "fail", "warning"),
        ("numeric_tolerance", '{"a":100}', '{"a":110}', {"expect_numbers": 0.02}, "fail", "blocking"),
        ("numeric_tolerance", '{"a":[100]}', '{"a":[101]}', {"expect_numbers": 0.02}, "pass", "info"),
        ("numeric_tolerance", '{"a":true}', '{"a":false}', {"expect_numbers": 0.02}, "skip", "info"),
        ("length_delta", "x" * 100, "x" * 300, {}, "fail", "warning"),
        ("length_delta", "x" * 100, "x" * 300, {"expect_length": 0.0}, "skip", "info"),
    ],
)
def test_check(spark, check, base, cand, more, status, severity):
    assert run(spark, base, cand, **more)[0][check] == (status, severity)


def test_order_and_verdicts(spark):
    found, v, reason = run(spark, "words", "")
    assert tuple(found) == checks.NAMES and v == "broken" and reason.startswith("nothing came back")
    assert run(spark, "a b", " a  b ")[1] == "equivalent"
    assert run(spark, "a b", "a c")[1] == "unverified"
    assert run(spark, "a", None)[1] == "error"


def test_settings(spark):
    assert run(spark, "x" * 10, "x" * 40, checks.Settings(warnings_break=True))[1] == "broken"
    assert "refusal" not in run(spark, settings=checks.Settings(disabled=("refusal",)))[0]
    assert "refusal" not in run(spark, skip_checks=["refusal"])[0]
    with pytest.raises(ValueError, match="no such check"):
        checks.Settings(disabled=("nope",))


def test_gate_and_worst(spark):
    rows = lambda *v: spark.createDataFrame([(str(k), x) for k, x in enumerate(v)], "case_id string, verdict string")
    assert verdict.gate(rows("equivalent")).first().passed
    assert not verdict.gate(rows("equivalent", "broken")).first().passed
    assert verdict.gate(rows("equivalent", "broken"), verdict.Policy(max_failures=1)).first().passed
    assert not verdict.gate(rows()).first().passed
    twice = verdict.Policy(fail_on=("unverified",), fail_on_unverified=True)
    assert verdict.gate(rows("unverified"), twice).first().counted == 2
    assert verdict.worst(rows()).first().worst == "equivalent"
    assert verdict.worst(rows("broken", "error", "acceptable")).first().worst == "error"
