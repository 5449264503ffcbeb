"""Checks, verdicts, gate, diffs and acceptance over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgate.operators import accept, baseline, checks, diff, judge, ledger, verdict
from driftgate.plans import views


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdict.classify(checks.evaluate(views.text_pairs(spark, sf_dir), json=False))


def one_check(name: str, view=views.text_pairs, json: bool = False, settings: checks.Settings | None = None):
    """case_id, status and severity of one check over all pairs of a view."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = checks.evaluate(view(spark, sf_dir), settings, json=json, only=(name,))
        r = F.get(F.filter("checks", lambda x: x["check"] == name), F.lit(0))
        return found.select("case_id", r["status"].alias("status"), r["severity"].alias("severity"))

    return query


def _one_check_sql(column: str, severity: str = "blocking") -> str:
    return f"WITH {views.SQL_CHECKED.strip()} SELECT case_id, {column} AS status, CASE WHEN {column} = 'fail' THEN '{severity}' ELSE 'info' END AS severity FROM checked"


def own_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two checks of one's own that raise on some rows: a cast, and a search in Python; results by case."""

    def mentions(text: str | None) -> tuple[str, str]:
        text.index("the")  # raises where it isn't there, and on null
        return "pass", ""

    own = {
        "first_number": checks.Check(F.when(F.regexp_extract("cand_text", "[0-9]+", 0).cast("int") >= 100, "fail").otherwise("pass"), message="a large number"),
        "mentions": checks.Hosted(mentions, ("cand_text",)),
    }
    found = checks.evaluate(views.text_pairs(spark, sf_dir), json=False, extra=own, only=tuple(own)).select("case_id", F.inline("checks"))
    return found.select("case_id", "check", "status", "severity")


def verdict_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdict.tally(outcomes(spark, sf_dir))


def verdict_by_mutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes(spark, sf_dir).groupBy("mutation", "verdict").agg(F.count(F.lit(1)).alias("cases"))


def case_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = F.transform(F.filter("checks", lambda x: x["status"] == "fail"), lambda x: x["check"])
    return outcomes(spark, sf_dir).select("case_id", "verdict", F.array_join(failed, ",").alias("failed"))


def gate_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    policy = verdict.Policy(max_failures=10, fail_on_unverified=True, min_cases=5)
    return verdict.gate(outcomes(spark, sf_dir), policy).select("passed", F.size("reasons").cast("long").alias("n_reasons"), "counted", "total")


def worst_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdict.worst(outcomes(spark, sf_dir), "conv_id")


def review_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdict.review(outcomes(spark, sf_dir), 25).select("case_id", "verdict")


def tag_filter_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline.tagged(views.text_pairs(spark, sf_dir), ["turn1", "long"], 40).select("case_id", "position")


def judged_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scripted judge accepts what was only reworded; its confidence follows from the case."""
    checked = checks.evaluate(views.text_pairs(spark, sf_dir), json=False)
    judge = verdict.residual(checked).select("case_id", F.when(F.col("mutation") == "reword", "acceptable").otherwise("broken").alias("verdict"), ((F.col("conv_id") % 10) / 10.0).alias("confidence"), F.lit("scripted").alias("note"))
    return verdict.classify(verdict.with_judgements(checked, judge)).groupBy("verdict").agg(F.count(F.lit(1)).alias("cases"))


class _Judge:
    """A judge without a model: accepts what says that it was only reworded."""

    def complete(self, case_id: str, prompt: str) -> str:
        word = "acceptable" if "<second>\nRephrased: " in prompt else "broken"
        return f'{{"verdict": "{word}", "confidence": 0.9, "rationale": "as it says"}}'


def judged_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open cases go to a judge through a ledger of calls; verdict and reason of every case."""
    checked = checks.evaluate(views.text_pairs(spark, sf_dir), json=False)
    found = judge.judged(checked, _Judge, "scripted", ledger.shared_path(spark, "judge-ledger"), buckets=8, commit_every=200)
    return found.select("case_id", "verdict", F.coalesce("judge_note", F.lit("")).alias("note"))


def accept_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accept.plan(outcomes(spark, sf_dir), views.baseline(spark, sf_dir)).select("case_id", "action")


def accept_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases, done = views.baseline(spark, sf_dir), outcomes(spark, sf_dir)
    go = accept.plan(done, cases).where("action = 'accept'").select("case_id")
    new = checks.completed(done.drop("base_text")).join(go, "case_id", "left_semi")
    merged = accept.merge(cases, new, "log:candidate", F.lit("2026-01-01 00:00:00").cast("timestamp"))
    return merged.select("case_id", "base_text", "reference", "previous_reference", F.col("revision").cast("long").alias("revision"))


def field_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = checks.with_facts(views.json_pairs(spark, sf_dir), checks.Settings())
    # both sides in one generator: a condition on what is exploded, pushed below it, would walk each document once more
    sides = F.inline(F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"{s}_fields").alias("fields")) for s in ("base", "cand"))))
    return pairs.select(sides).select("side", F.explode("fields").alias("path")).groupBy("side", "path").agg(F.count(F.lit(1)).alias("cases"))


def json_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.json_changes(checks.with_facts(views.json_pairs(spark, sf_dir), checks.Settings()))


def json_diff_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.counts(json_diff(spark, sf_dir))


def tool_call_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.tool_changes(views.tool_pairs(spark, sf_dir)).select("case_id", "name", "nth", "kind")


def text_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = views.text_pairs(spark, sf_dir).where("cand_text <> base_text")
    return pairs.select("case_id", F.explode(diff.prose_diff("base_text", "cand_text")).alias("line"))


def json_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = '{"type":"object","required":["user","type"],"properties":{"user":{"type":"integer"},"cents":{"type":"integer"}},"additionalProperties":{"type":["object","array","string"]}}'
    # which events break the schema follows from their ids alone, so each number must be one
    view = lambda s, d: views.json_pairs(s, d, whole=True).withColumn("expect_schema", F.lit(schema))
    return one_check("json_schema", view, json=True)(spark, sf_dir)


QUERIES = {
    "own_checks": own_checks,
    "verdict_summary": verdict_summary,
    "verdict_by_mutation": verdict_by_mutation,
    "case_verdicts": case_verdicts,
    "gate_decision": gate_decision,
    "worst_verdict": worst_verdict,
    "review_topk": review_topk,
    "tag_filter_limit": tag_filter_limit,
    "judged_verdicts": judged_verdicts,
    "judged_calls": judged_calls,
    "check_empty_output": one_check("empty_output"),
    "check_truncation": one_check("truncation"),
    "check_refusal": one_check("refusal"),
    "check_exact_match": one_check("exact_match"),
    "check_length_delta": one_check("length_delta"),
    "check_json_parse": one_check("json_parse", views.json_pairs, json=True),
    "check_required_fields": one_check("required_fields", views.json_pairs, json=True),
    "check_numeric_tolerance": one_check("numeric_tolerance", views.json_pairs, True, checks.Settings(numeric_tolerance=0.05)),
    "check_format_regex": one_check("format_regex", lambda s, d: views.json_pairs(s, d).withColumn("expect_regex", F.lit(r'^\{"user": \d+, "type"')), json=True),
    "check_tool_calls": one_check("tool_calls", views.tool_pairs),
    "json_schema": json_schema,
    "accept_plan": accept_plan,
    "accept_merge": accept_merge,
    "field_paths": field_paths,
    "json_diff": json_diff,
    "json_diff_counts": json_diff_counts,
    "tool_call_diff": tool_call_diff,
    "text_diff": text_diff,
}

_T, _O, _J = f"WITH {views.SQL_TEXT.strip()}", f"WITH {views.SQL_CHECKED.strip()}", f"WITH {views.SQL_JSON.strip()}"
_RANK = "list_position(['equivalent','acceptable','unverified','broken','error'], verdict)"
_ACTION = "CASE WHEN verdict = 'error' THEN 'refuse' WHEN verdict = 'equivalent' OR base_text = cand_text THEN 'unchanged' WHEN verdict <> 'unverified' THEN 'refuse' ELSE 'accept' END"
_TALLY = "count(*) AS total, " + ", ".join(f"count(*) FILTER (verdict = '{v}') AS {v}" for v in verdict.ORDER)
_CHANGES = """changes AS (
  SELECT coalesce(b.case_id, c.case_id) AS case_id, coalesce(b.path, c.path) AS path,
         CASE WHEN c.path IS NULL THEN 'removed' WHEN b.path IS NULL THEN 'added' ELSE 'changed' END AS kind, b.atom AS before, c.atom AS after
  FROM (SELECT l.* FROM leaves l JOIN bodies p ON l.case_id = p.case_id AND l.side = 'base' AND json_valid(p.cand_body)) b
  FULL JOIN (SELECT * FROM leaves WHERE side = 'cand') c ON b.case_id = c.case_id AND b.path = c.path
  WHERE b.path IS NULL OR c.path IS NULL OR b.atom <> c.atom)"""
_TOOLS = """l AS (SELECT l_orderkey, 'ship_' || lower(l_linestatus) || lower(l_returnflag) AS name, l_partkey, l_linenumber,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, lower(l_linestatus) || lower(l_returnflag)) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
b AS (SELECT l_orderkey::VARCHAR AS case_id, l_orderkey % 4 AS m, k, n, name, l_partkey || '-' || l_linenumber AS args FROM l),
c AS (SELECT case_id, m, k, name, CASE WHEN m = 3 AND k = 1 THEN '0' ELSE args END AS args FROM b WHERE NOT (m = 1 AND k = n)
      UNION ALL SELECT DISTINCT case_id, m, n + 1, 'notify', '1' FROM b WHERE m = 2),
bn AS (SELECT *, row_number() OVER (PARTITION BY case_id, name ORDER BY k) AS nth FROM b),
cn AS (SELECT *, row_number() OVER (PARTITION BY case_id, name ORDER BY k) AS nth FROM c)"""

SQL = {
    "own_checks": f"""WITH {views.SQL_TEXT.strip()}, n AS (SELECT case_id, cand_text, TRY_CAST(regexp_extract(cand_text, '[0-9]+') AS INTEGER) AS d FROM pairs)
SELECT case_id, 'first_number' AS "check", CASE WHEN cand_text IS NULL OR d < 100 THEN 'pass' ELSE 'fail' END AS status,
  CASE WHEN cand_text IS NULL OR d < 100 THEN 'info' WHEN d IS NULL THEN 'warning' ELSE 'blocking' END AS severity FROM n
UNION ALL SELECT case_id, 'mentions', CASE WHEN contains(cand_text, 'the') THEN 'pass' ELSE 'fail' END, CASE WHEN contains(cand_text, 'the') THEN 'info' ELSE 'warning' END FROM n""",
    "verdict_summary": f"{_O} SELECT {_TALLY}, count(*) FILTER (verdict IN ('broken', 'error')) AS regressions FROM outcomes",
    "verdict_by_mutation": f"{_O} SELECT mutation, verdict, count(*) AS cases FROM outcomes GROUP BY ALL",
    "case_verdicts": f"{_O} SELECT case_id, verdict, array_to_string(list_filter([CASE WHEN c_empty = 'fail' THEN 'empty_output' END, CASE WHEN c_cut = 'fail' THEN 'truncation' END, CASE WHEN c_refusal = 'fail' THEN 'refusal' END, CASE WHEN c_exact = 'fail' THEN 'exact_match' END, CASE WHEN c_length = 'fail' THEN 'length_delta' END], lambda x: x IS NOT NULL), ',') AS failed FROM outcomes",
    "gate_decision": f"{_O}, t AS (SELECT count(*) AS total, count(*) FILTER (verdict IN ('broken', 'error', 'unverified')) AS counted FROM outcomes) SELECT total >= 5 AND counted <= 10 AS passed, (total < 5)::BIGINT + (counted > 10)::BIGINT AS n_reasons, counted, total FROM t",
    "worst_verdict": f"{_O} SELECT conv_id, ['equivalent','acceptable','unverified','broken','error'][max({_RANK})] AS worst FROM outcomes GROUP BY conv_id",
    "review_topk": f"{_O} SELECT case_id, verdict FROM outcomes WHERE verdict <> 'equivalent' ORDER BY {_RANK} DESC, case_id LIMIT 25",
    "tag_filter_limit": f"{_T} SELECT case_id, position FROM pairs WHERE list_has_any(tags, ['turn1', 'long']) ORDER BY position LIMIT 40",
    "judged_calls": f"{_O} SELECT case_id, CASE WHEN verdict <> 'unverified' THEN verdict WHEN mutation = 'reword' THEN 'acceptable' ELSE 'broken' END AS verdict, CASE verdict WHEN 'unverified' THEN 'as it says' ELSE '' END AS note FROM outcomes",
    "judged_verdicts": f"{_O} SELECT CASE WHEN verdict = 'unverified' AND (conv_id % 10) / 10.0 >= 0.34 THEN CASE WHEN mutation = 'reword' THEN 'acceptable' ELSE 'broken' END ELSE verdict END AS verdict, count(*) AS cases FROM outcomes GROUP BY 1",
    "check_empty_output": _one_check_sql("c_empty"),
    "check_truncation": _one_check_sql("c_cut"),
    "check_refusal": _one_check_sql("c_refusal"),
    "check_exact_match": _one_check_sql("c_exact"),
    "check_length_delta": _one_check_sql("c_length", "warning"),
    "check_json_parse": f"{_J}, r AS (SELECT case_id, CASE WHEN json_valid(cand_body) THEN 'pass' ELSE 'fail' END AS status FROM bodies) SELECT case_id, status, CASE status WHEN 'fail' THEN 'blocking' ELSE 'info' END AS severity FROM r",
    "check_required_fields": f"""{_J},
f AS (SELECT case_id, list(path) FILTER (side = 'base') AS b, list(path) FILTER (side = 'cand') AS c FROM fields GROUP BY case_id),
r AS (SELECT case_id, CASE WHEN c IS NULL OR NOT list_has_all(c, b) THEN 'blocking' WHEN NOT list_has_all(b, c) THEN 'warning' ELSE 'info' END AS severity FROM f)
SELECT case_id, CASE severity WHEN 'info' THEN 'pass' ELSE 'fail' END AS status, severity FROM r""",
    "check_numeric_tolerance": f"""{_J},
m AS (SELECT b.case_id, count(*) FILTER (b.atom::DOUBLE <> c.atom::DOUBLE AND CASE WHEN abs(b.atom::DOUBLE) < 1e-9 THEN abs(c.atom::DOUBLE - b.atom::DOUBLE) > 0.05 ELSE abs(c.atom::DOUBLE - b.atom::DOUBLE) / abs(b.atom::DOUBLE) > 0.05 END) AS moved
      FROM leaves b JOIN leaves c ON b.case_id = c.case_id AND b.path = c.path AND b.side = 'base' AND c.side = 'cand' AND TRY_CAST(b.atom AS DOUBLE) IS NOT NULL AND TRY_CAST(c.atom AS DOUBLE) IS NOT NULL GROUP BY 1),
r AS (SELECT p.case_id, CASE WHEN NOT json_valid(p.cand_body) THEN 'skip' WHEN coalesce(m.moved, 0) > 0 THEN 'fail' ELSE 'pass' END AS status FROM bodies p LEFT JOIN m USING (case_id))
SELECT case_id, status, CASE status WHEN 'fail' THEN 'blocking' ELSE 'info' END AS severity FROM r""",
    "check_format_regex": f"""{_J}, r AS (SELECT case_id, CASE WHEN regexp_matches(cand_text, '^\\{{"user": [0-9]+, "type"') THEN 'pass' ELSE 'fail' END AS status FROM pairs) SELECT case_id, status, CASE status WHEN 'fail' THEN 'blocking' ELSE 'info' END AS severity FROM r""",
    "check_tool_calls": f"""WITH {_TOOLS}, o AS (SELECT DISTINCT case_id, m FROM b)
SELECT case_id, CASE WHEN m IN (1, 2, 3) THEN 'fail' ELSE 'pass' END AS status, CASE m WHEN 1 THEN 'blocking' WHEN 2 THEN 'warning' WHEN 3 THEN 'warning' ELSE 'info' END AS severity FROM o""",
    "json_schema": f"{_J}, r AS (SELECT case_id, CASE WHEN event_id % 6 IN (1, 2, 4) THEN 'fail' ELSE 'pass' END AS status FROM pairs) SELECT case_id, status, CASE status WHEN 'fail' THEN 'blocking' ELSE 'info' END AS severity FROM r",
    "accept_plan": f"{_O} SELECT case_id, {_ACTION} AS action FROM outcomes",
    "accept_merge": f"{_O}, q AS (SELECT *, 'log:model-' || (conv_id % 3) AS ref, {_ACTION} AS action FROM outcomes) SELECT case_id, CASE action WHEN 'accept' THEN cand_text ELSE base_text END AS base_text, CASE action WHEN 'accept' THEN 'log:candidate' ELSE ref END AS reference, CASE action WHEN 'accept' THEN ref END AS previous_reference, CASE action WHEN 'accept' THEN 2 ELSE 1 END::BIGINT AS revision FROM q",
    "field_paths": f"{_J} SELECT side, path, count(*) AS cases FROM fields GROUP BY ALL",
    "json_diff": f"{_J}, {_CHANGES} SELECT case_id, path, kind, before, after FROM changes",
    "json_diff_counts": f"{_J}, {_CHANGES} SELECT case_id, count(*) FILTER (kind = 'removed') AS removed, count(*) FILTER (kind = 'added') AS added, count(*) FILTER (kind = 'changed') AS changed FROM changes GROUP BY case_id",
    "tool_call_diff": f"WITH {_TOOLS} SELECT coalesce(b.case_id, c.case_id) AS case_id, coalesce(b.name, c.name) AS name, coalesce(b.nth, c.nth) AS nth, CASE WHEN c.case_id IS NULL THEN 'removed' WHEN b.case_id IS NULL THEN 'added' ELSE 'changed' END AS kind FROM bn b FULL JOIN cn c ON b.case_id = c.case_id AND b.name = c.name AND b.nth = c.nth WHERE b.case_id IS NULL OR c.case_id IS NULL OR b.args <> c.args",
}
