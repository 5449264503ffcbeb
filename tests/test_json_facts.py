import json
import math
import re
import time

from pyspark.sql import functions as F

from driftgate import queries
from driftgate.functions import jsonfacts
from driftgate.operators import checks, diff

SMALL = "/root/testdata/sf0.001"
EVENT = "event_id long, user_id long, event_type string, value double, props string"


def events(spark, folder, rows) -> str:
    spark.createDataFrame(rows, EVENT).coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_schema_query_where_a_value_is_zero(spark, oracle, tmp_path):
    """A digit behind the cents of such an event gave 07, which isn't JSON."""
    folder = events(spark, tmp_path, [(k, 5, "view", v, '{"k": 1}') for k, v in ((3, 0.0), (9, None), (15, 0.004), (21, -0.5), (27, 1.2), (33, 0.07), (4, 0.0), (0, 0.0))])
    rows = f"{folder}/events.parquet/*.parquet"
    sql = f"WITH events AS (SELECT * FROM '{rows}'), {queries.SQL['json_schema'].strip().removeprefix('WITH')}"
    oracle(spark, queries.QUERIES["json_schema"], sql, folder)


ODD = [
    '{"a":1,"b":{"c":[1,2.50,{"d":null}],"e":{}},"f":[]}', "[]", "{}", "[1,[2,{\"x\":true}]]", '"text"', "12", "null", '{"":1,"a":{"":2}}', '{"a":1e400,"b":-0.0,"c":NaN,"d":Infinity}', '{"a.b":1,"a":{"b":"x"}}',
    '{"k":"say \\"hi\\" é\\n\\u0001"}', "no", "", None, '```json\n{"a":[{"b":1}]}\n```', '{"a":07}', '{"a":1} x', "[" * 30 + "1" + "]" * 30, '{"a":' * 30 + "{}" + "}" * 30, '{"a":' * 24 + '{"b":1}' + "}" * 24, '{"n":[0,false,"",null,{}]}', '{"a":1,"a":"2"}',
]


def _old(text):
    """The walk that all facts came from before."""
    out = {"fields": set(), "numbers": {}, "leaves": {}}

    def walk(value, path, loose, depth):
        if depth > jsonfacts.DEPTH or (not isinstance(value, dict | list)) or not value:
            if path or not isinstance(value, dict | list):
                out["leaves"][path or "<root>"] = json.dumps(value, sort_keys=True, ensure_ascii=False)
            if isinstance(value, int | float) and not isinstance(value, bool) and math.isfinite(value):
                out["numbers"][path or "<root>"] = float(value)
            return
        for key, child in value.items() if isinstance(value, dict) else enumerate(value):
            if isinstance(value, dict):
                at, loosely = (f"{path}.{key}", f"{loose}.{key}") if path or loose else (key, key)
                if depth < jsonfacts.DEPTH:
                    out["fields"].add(loosely)
            else:
                at, loosely = f"{path}[{key}]", f"{loose}[]"
            walk(child, at, loosely, depth + 1)

    try:
        walk(jsonfacts._load(text), "", "", 0)
    except ValueError:
        return False, [], {}, {}
    return True, sorted(out["fields"]), out["numbers"], out["leaves"]


def test_facts_are_those_of_one_walk(spark):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(ODD)], "k int, t string").select("k", jsonfacts.facts(F.col("t")).alias("f")).orderBy("k").collect()
    assert [tuple(r.f) for r in rows] == [_old(t) for t in ODD]


def test_a_number_beyond_doubles_is_no_number(spark):
    """Such an integer failed the job."""
    row = spark.createDataFrame([('{"a":1' + "0" * 400 + ',"b":2}',)], "t string").select(jsonfacts.facts(F.col("t")).alias("f")).first().f
    assert row.is_json and row.numbers == {"b": 2.0} and set(row.leaves) == {"a", "b"}


def test_changes_of_leaves_are_those_of_a_full_join(spark):
    """The difference stays in the row; a case's leaves were shuffled by path before."""
    pairs = [(f"{a}-{b}", x, y) for a, x in enumerate(ODD) for b, y in enumerate(ODD)]
    found = diff.json_changes(spark.createDataFrame(pairs, "case_id string, base_text string, cand_text string"))
    assert "Exchange" not in found._jdf.queryExecution().optimizedPlan().toString() and "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.case_id, r.path): (r.kind, r.before, r.after) for r in found.collect()}
    want = {}
    for case, x, y in pairs:
        (ok, _, _, old), (well, _, _, new) = _old(x), _old(y)
        for path in (old.keys() | new.keys()) if ok and well else ():
            a, b = old.get(path), new.get(path)
            if a != b and not (a and b and _double(a) is not None and _double(a) == _double(b)):
                want[case, path] = ("removed" if b is None else "added" if a is None else "changed", a, b)
    assert got == want


def _double(text):
    try:
        return float(text)
    except ValueError:
        return None


def _functions(spark, name: str, folder: str) -> list[str]:
    """Python functions in the plan of a query, one entry for each call."""
    plan = queries.QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    return sorted(re.findall(r"\b(reads|fields|numbers|leaves|listed|schema_problem|pattern_result|changed_leaves)\((?:concat|CASE|base_text|cand_text)", plan))


def test_field_paths_walks_each_document_once(spark):
    """A condition on the exploded paths, pushed below, walked each document twice."""
    assert _functions(spark, "field_paths", SMALL) == ["fields", "fields"]


def test_numeric_tolerance_looks_for_numbers_alone(spark):
    assert _functions(spark, "check_numeric_tolerance", SMALL) == ["numbers", "numbers"]


def test_json_parse_only_parses(spark):
    assert _functions(spark, "check_json_parse", SMALL) == ["reads", "reads"]
    assert _functions(spark, "check_required_fields", SMALL) == ["fields", "fields"]


def test_facts_and_evidence_without_json(spark):
    """Facts in one struct are empty, not null, where a text isn't JSON, and so is the evidence of missing fields."""
    pairs = spark.createDataFrame([("a", '{"x":1}', "no"), ("b", "no", "no")], "case_id string, base_text string, cand_text string")
    rows = checks.evaluate(pairs).orderBy("case_id").collect()
    assert [tuple(r.cand_facts) for r in rows] == [(False, [], {}, {})] * 2 and tuple(rows[0].base_facts) == (True, ["x"], {"x": 1.0}, {"x": "1"})
    found = {c.check: c for c in rows[0].checks}["required_fields"]
    assert (found.status, found.severity, found.evidence) == ("fail", "blocking", '{"missing":["x"],"added":[]}')
    assert {c.check: c.status for c in rows[1].checks}["required_fields"] == "skip"


def _tolerance_results(spark, pairs) -> dict:
    frame = spark.createDataFrame(pairs, "case_id string, base_text string, cand_text string")
    found = checks.evaluate(frame, checks.Settings(numeric_tolerance=0.05), only=("numeric_tolerance",))
    return {r.case_id: (r.status, r.evidence) for r in found.select("case_id", F.inline("checks")).collect()}


def test_numbers_of_a_wide_document_meet_by_path(spark):
    """Each number was looked up among all of the other document: 10,000 of them took 54 s, four times as long as 5,000."""
    first = {f"key{k}": k for k in range(10_000)}
    second = {f"key{k}": k + 10**6 * (k % 1000 == 7) for k in reversed(range(10_000))}
    began = time.monotonic()
    found = _tolerance_results(spark, [("wide", json.dumps(first), json.dumps(second))])
    assert time.monotonic() - began < 20
    assert found == {"wide": ("fail", ", ".join(f"key{1000 * k + 7}" for k in range(8)))}


def test_moved_numbers_are_those_of_a_loop(spark):
    """Over pairs of odd texts: numbers that one side lacks don't move, those at zero move by the absolute gap."""
    texts = [*ODD, '{"a":0,"b":100,"c":3}', '{"b":104,"a":0.04,"d":3}', '{"c":3.2,"b":106,"a":-0.06}', '{"a":1e308,"b":-1e308}', '{"a":-1e308,"b":1e-320}']
    pairs = [(f"{a}-{b}", x, y) for a, x in enumerate(texts) for b, y in enumerate(texts)]
    want = {}
    for case, x, y in pairs:
        (ok, _, old, _), (well, _, new, _) = _old(x), _old(y)
        gap = lambda a, b: abs(b - a) if abs(a) < 1e-9 else abs(b - a) / abs(a)
        moved = [k for k, a in old.items() if k in new and a != new[k] and not gap(a, new[k]) <= 0.05]
        want[case] = ("skip", None) if not (ok and well and old) else ("fail", ", ".join(moved[:8])) if moved else ("pass", None)
    assert _tolerance_results(spark, pairs) == want
