"""Capture, identity, redaction and statistics over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgate.functions import redaction
from driftgate.operators import baseline, checks, judge, verdict
from driftgate.plans import views
from driftgate.sources import logs

_RULES = {r.name: r for r in redaction.RULES}


def dedup_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("case_id"), F.col("doc_id").alias("position"))
    return baseline.first_wins(docs).select("case_id", "position")


def dedup_against_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store holds the texts of source src0; a batch of all documents adds the rest once each."""
    docs = views.table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("case_id"), F.col("doc_id").alias("position"), "source")
    return baseline.unseen(docs, docs.where("source = 'src0'").select("case_id")).select("case_id", "position")


def fingerprint_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = views.table(spark, sf_dir, "conversations").where("role = 'user'")
    return turns.select("conv_id", "turn", baseline.fingerprint(F.col("role"), F.col("text")).alias("case_id"))


def baseline_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline.by_reference(views.baseline(spark, sf_dir))


def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline.by_tag(views.baseline(spark, sf_dir))


def redact_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.table(spark, sf_dir, "documents")
    return docs.select("doc_id", redaction.apply_rule(_RULES["email"], F.col("text")).alias("text"))


def redaction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values taken out by each of the rules, one after the other."""
    found = redaction.redact(views.table(spark, sf_dir, "documents"), "text", counts="found")
    return found.select(F.explode("found").alias("rule", "n")).groupBy("rule").agg(F.sum("n").alias("n"))


def redact_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redaction.redact(views.table(spark, sf_dir, "documents"), "text").select("doc_id", F.sha2("text", 256).alias("text_sha256"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines of four shapes and two that must be rejected, made from the conversations."""
    p = views.text_pairs(spark, sf_dir).select("conv_id", "turn", "case_id", "prompt", "base_text")
    ask = F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")))
    j = lambda *c: F.to_json(F.struct(*c))
    answer = F.struct(F.lit("m1").alias("model"), F.array(F.struct(F.lit("stop").alias("finish_reason"), F.struct(F.lit("assistant").alias("role"), F.col("base_text").alias("content")).alias("message"))).alias("choices"))
    k = (F.col("conv_id") + F.col("turn")) % 6
    line = (
        F.when(k == 0, j(F.struct(F.lit("m1").alias("model"), F.lit(0.5).alias("temperature"), ask.alias("messages")).alias("request"), answer.alias("response"), F.lit("proxy").alias("tags")))
        .when(k == 1, j(F.struct(ask.alias("messages")).alias("input"), F.col("base_text").alias("output")))
        .when(k == 2, j(ask.alias("messages"), F.col("base_text").alias("completion"), F.array(F.lit("flat"), F.lit("x")).alias("tags")))
        .when(k == 3, j(F.struct(F.lit("m2").alias("model"), ask.alias("messages")).alias("request"), F.struct(F.lit("m2").alias("model"), F.lit("end").alias("stop_reason"), F.array(F.struct(F.lit("text").alias("type"), F.col("base_text").alias("text"))).alias("content")).alias("response")))
        .when(k == 4, j(F.array(F.struct(F.lit("robot").alias("role"), F.col("prompt").alias("content"))).alias("messages"), F.col("base_text").alias("completion")))
        .otherwise(j(F.col("prompt").alias("something")))
    )
    return p.select((F.col("conv_id") * 1000 + F.col("turn")).alias("position"), line.alias("value"))


def capture_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = logs.parsed(log_lines(spark, sf_dir))
    good = logs.accepted(found)
    return good.select("position", "shape", F.get("messages", F.lit(0))["content"].alias("prompt"), "base_text", "base_finish", "reference", F.array_join("tags", ",").alias("tags"))


def capture_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.rejected(logs.parsed(log_lines(spark, sf_dir))).select("position", "reason")


def tool_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proxy log lines, one an order, whose answer is a call for each line item."""
    calls = F.transform("base_tools", lambda t: F.struct(t.alias("function")))
    answer = F.struct(F.array(F.struct(F.struct(calls.alias("tool_calls")).alias("message"))).alias("choices"))
    ask = F.struct(F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit("ship "), "case_id").alias("content"))).alias("messages"))
    return views.tool_pairs(spark, sf_dir).select("position", F.to_json(F.struct(ask.alias("request"), answer.alias("response"))).alias("value"))


def capture_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = logs.accepted(logs.parsed(tool_lines(spark, sf_dir)))
    calls = good.select("position", F.posexplode("base_tools").alias("nth", "t"))
    return calls.select("position", F.col("nth").cast("long").alias("nth"), F.col("t.name").alias("name"), F.col("t.arguments").alias("arguments"))


def secret_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases with a secret or an address in each place where a case holds text."""
    p = views.text_pairs(spark, sf_dir)
    key = F.concat(F.lit("ghp_"), F.substring(F.sha2("case_id", 256), 1, 36))
    mail = F.concat(F.lit("u"), F.col("conv_id").cast("string"), F.lit("@example.com"))
    call = lambda text: F.array(F.struct(F.lit("send").alias("name"), text.alias("arguments")))
    asked = F.concat(F.lit('{"token":"'), key, F.lit('","to":["'), mail, F.lit('",1,null],"u1@example.com":true}'))
    said = F.concat(F.lit('{"note":"say \\"hi\\" to '), mail, F.lit('"}'))
    message = F.struct(F.lit("user").alias("role"), F.concat("prompt", F.lit(" "), mail).alias("content"), call(asked).alias("tool_calls"))
    return p.select("position", F.array(message).alias("messages"), F.concat("base_text", F.lit(" "), key).alias("base_text"), call(said).alias("base_tools"))


def redact_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = redaction.redact_case(secret_cases(spark, sf_dir))
    first = F.get("messages", F.lit(0))
    return done.select("position", first["content"].alias("content"), F.get(first["tool_calls"], F.lit(0))["arguments"].alias("asked"), "base_text", F.get("base_tools", F.lit(0))["arguments"].alias("said"), "redacted")


def input_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = logs.accepted(logs.parsed(log_lines(spark, sf_dir)))
    return good.select("position", baseline.preview(F.col("messages"), 40).alias("preview"))


def judge_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of six kinds: sound, fenced, prose, another verdict, a confidence out of range and one in words."""
    k = F.col("position") % 6
    sound = F.lit('{"verdict": "acceptable", "confidence": 0.5, "rationale": "same facts"}')
    reply = (
        F.when(k == 0, sound).when(k == 1, F.concat(F.lit("```json\n"), sound, F.lit("\n```"))).when(k == 2, "I think it is fine")
        .when(k == 3, '{"verdict": "splendid", "confidence": 1}').when(k == 4, '{"verdict": "broken", "confidence": 5}').otherwise('{"verdict": "equivalent", "confidence": "high"}')
    )
    return judge.replies(views.text_pairs(spark, sf_dir).select("case_id", reply.alias("cand_text")))


def dumped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A baseline's own dump, made from the conversations: four kinds of expectations, and revisions."""
    p = views.text_pairs(spark, sf_dir)
    ask = F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")))
    k = F.col("position") % 4
    expect = F.struct(
        F.when(k == 0, F.lit(True)).alias("exact_match"), F.when(k == 1, F.lit(0.1)).alias("max_length_delta_ratio"), F.when(k == 2, F.lit(False)).alias("forbid_refusal"),
        F.when(k == 3, F.array(F.lit("empty_output"), F.lit("length_delta"))).alias("skip_checks"),
    )
    output = F.struct(F.col("base_text").alias("text"), F.col("base_finish").alias("finish_reason"))
    model = F.struct(F.lit("log").alias("provider"), F.lit("m").alias("model"))
    line = F.to_json(F.struct("case_id", F.struct(ask.alias("messages")).alias("input"), output.alias("output"), model.alias("reference"), (F.col("turn") % 3 + 1).alias("revision"), expect.alias("expectations")))
    return p.select("position", line.alias("value"))


def capture_expectations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases of a dump, checked as they expect: which checks fail and the verdict."""
    found = logs.accepted(logs.parsed(dumped_lines(spark, sf_dir))).drop("position")
    answers = views.text_pairs(spark, sf_dir).select("case_id", "cand_text", "cand_finish")
    outcomes = verdict.classify(checks.evaluate(found.join(answers, "case_id"), json=False))
    failed = F.array_join(F.transform(F.filter("checks", lambda c: c["status"] == "fail"), lambda c: c["check"]), ",")
    return outcomes.select("case_id", "reference", "revision", failed.alias("failed"), "verdict")


QUERIES = {
    "capture_expectations": capture_expectations,
    "capture_tools": capture_tools,
    "redact_case": redact_case,
    "input_previews": input_previews,
    "judge_replies": judge_replies,
    "dedup_first_wins": dedup_first_wins,
    "dedup_against_store": dedup_against_store,
    "fingerprint_ids": fingerprint_ids,
    "baseline_stats": baseline_stats,
    "tag_counts": tag_counts,
    "redact_email": redact_email,
    "redaction_counts": redaction_counts,
    "redact_all": redact_all,
    "capture_cases": capture_cases,
    "capture_rejects": capture_rejects,
}

_EMAIL = r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"


def _sql_rule(rule: redaction.Rule, before: str) -> str:
    """The rule as a step over a table of doc_id and text; ``n`` counts what it takes out."""
    pattern = rule.pattern.replace("{0,8192}?", "*?").replace("'", "''")
    found = lambda g: f"regexp_extract_all(text, '{pattern}', {g})"
    goes = "true"
    if rule.name == "credit_card":
        digit = "d[len(d) - i + 1]::INT"
        luhn = f"list_sum(list_transform(range(1, len(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {digit} WHEN {digit} > 4 THEN {digit} * 2 - 9 ELSE {digit} * 2 END)) % 10 = 0"
        d = "regexp_replace(v, '[ -]', '', 'g')"
        goes = f"len({d}) >= 13 AND {luhn.replace('d[', f'({d})[').replace('len(d)', f'len({d})')}"
    parts = [found(k) for k in (1, 2, 3)] if rule.grouped else [f"list_transform({found(0)}, lambda v: '')", found(0), f"list_transform({found(0)}, lambda v: '')"]
    new = f"list_transform(b, lambda v: CASE WHEN {goes} THEN '[REDACTED:{rule.name}:' || substr(sha256(v), 1, 8) || ']' ELSE v END)"
    return f"""(SELECT doc_id, len(list_filter(b, lambda v: {goes})) AS n,
      array_to_string(list_transform(range(1, len(p) + 1), lambda i: p[i] || CASE WHEN i <= len(t) THEN a[i] || t[i] || c[i] ELSE '' END), '') AS text
    FROM (SELECT *, {new} AS t FROM (SELECT doc_id, regexp_split_to_array(text, '{pattern}') AS p, {parts[0]} AS a, {parts[1]} AS b, {parts[2]} AS c FROM {before})))"""


def _sql_redacted() -> tuple[str, str]:
    """Steps of all rules, one after the other, and the name of the last."""
    steps, before = [], "documents"
    for k, rule in enumerate(redaction.RULES):
        steps.append(f"r{k} AS MATERIALIZED {_sql_rule(rule, before)}")
        before = f"r{k}"
    return "WITH " + ",\n".join(steps), before


_STEPS, _LAST = _sql_redacted()
_MAIL = "'u' || conv_id || '@example.com'"
_TOKEN = "'[REDACTED:{0}:' || substr(sha256({1}), 1, 8) || ']'"
_KEY_GONE, _MAIL_GONE = _TOKEN.format("github_token", "'ghp_' || substr(sha256(case_id), 1, 36)"), _TOKEN.format("email", _MAIL)
_T = f"WITH {views.SQL_TEXT.strip()}"
_K = "(conv_id + turn) % 6"
SQL = {
    "capture_expectations": f"""{_T}, f AS (SELECT *, array_to_string(list_filter([
    CASE WHEN position % 4 <> 3 AND {views.sql_trim("base_text")} <> '' AND {views.sql_trim("cand_text")} = '' THEN 'empty_output' END,
    CASE WHEN cand_finish = 'length' AND base_finish <> 'length' THEN 'truncation' END,
    CASE WHEN position % 4 <> 2 AND {views.sql_refuses("cand_text")} AND NOT {views.sql_refuses("base_text")} THEN 'refusal' END,
    CASE WHEN position % 4 = 0 AND {views.sql_norm("base_text")} <> {views.sql_norm("cand_text")} THEN 'exact_match' END,
    CASE WHEN position % 4 <> 3 AND abs(length({views.sql_trim("cand_text")}) - length({views.sql_trim("base_text")})) / nullif(length({views.sql_trim("base_text")}), 0)::DOUBLE > CASE position % 4 WHEN 1 THEN 0.1 ELSE 0.5 END THEN 'length_delta' END
  ], lambda x: x IS NOT NULL), ',') AS failed FROM pairs)
SELECT case_id, 'log:m' AS reference, turn % 3 + 1 AS revision, failed,
  CASE WHEN cand_text IS NULL THEN 'error' WHEN regexp_matches(failed, 'empty_output|truncation|refusal|exact_match') THEN 'broken'
       WHEN {views.sql_norm("base_text")} = {views.sql_norm("cand_text")} THEN 'equivalent' ELSE 'unverified' END AS verdict FROM f""",
    "capture_tools": """SELECT l_orderkey AS position, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, lower(l_linestatus) || lower(l_returnflag)) - 1 AS nth,
  'ship_' || lower(l_linestatus) || lower(l_returnflag) AS name, '{"part":' || l_partkey || ',"line":' || l_linenumber || '}' AS arguments FROM lineitem""",
    "redact_case": f"""{_T} SELECT position, prompt || ' ' || {_MAIL_GONE} AS content, '{{"token":"' || {_KEY_GONE} || '","to":["' || {_MAIL_GONE} || '",1,null],"u1@example.com":true}}' AS asked,
  base_text || ' ' || {_KEY_GONE} AS base_text, '{{"note":"say \\"hi\\" to ' || {_MAIL_GONE} || '"}}' AS said, true AS redacted FROM pairs""",
    "input_previews": f"""{_T}, q AS (SELECT position, trim(regexp_replace(prompt, '[\\r\\n]+', ' ', 'g')) AS line FROM pairs WHERE {_K} < 4)
SELECT position, CASE WHEN length(line) > 40 THEN substr(line, 1, 39) || '…' ELSE line END AS preview FROM q""",
    "judge_replies": f"""{_T} SELECT case_id, CASE position % 6 WHEN 0 THEN 'acceptable' WHEN 1 THEN 'acceptable' WHEN 4 THEN 'broken' WHEN 5 THEN 'equivalent' END AS verdict,
  CASE position % 6 WHEN 0 THEN 0.5 WHEN 1 THEN 0.5 ELSE 1.0 END::DOUBLE AS confidence,
  CASE position % 6 WHEN 0 THEN 'same facts' WHEN 1 THEN 'same facts' WHEN 2 THEN 'judge gave no verdict' WHEN 3 THEN 'judge gave no verdict' ELSE '' END AS note FROM pairs""",
    "redact_all": f"{_STEPS} SELECT doc_id, sha256(text) AS text_sha256 FROM {_LAST}",
    "redaction_counts": _STEPS + " SELECT rule, sum(n)::BIGINT AS n FROM (" + " UNION ALL ".join(f"SELECT '{r.name}' AS rule, n FROM r{k}" for k, r in enumerate(redaction.RULES)) + ") GROUP BY rule HAVING sum(n) > 0",
    "dedup_first_wins": "SELECT sha256(text) AS case_id, min(doc_id) AS position FROM documents GROUP BY text",
    "dedup_against_store": "SELECT sha256(text) AS case_id, min(doc_id) AS position FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE source = 'src0') GROUP BY text",
    "fingerprint_ids": "SELECT conv_id, turn, substr(sha256(to_json({'p0': role, 'p1': text})::VARCHAR), 1, 16) AS case_id FROM conversations WHERE role = 'user'",
    "baseline_stats": f"{_T} SELECT 'log:model-' || (conv_id % 3) AS reference, count(*) AS cases, count(*) FILTER (turn % 2 <> 0) AS unredacted FROM pairs GROUP BY 1",
    "tag_counts": f"{_T} SELECT tag, count(*) AS cases FROM (SELECT unnest(tags) AS tag FROM pairs) GROUP BY tag",
    "redact_email": f"""WITH d AS (SELECT doc_id, regexp_split_to_array(text, '{_EMAIL}') AS p, regexp_extract_all(text, '{_EMAIL}') AS m FROM documents)
SELECT doc_id, array_to_string(list_transform(range(1, len(p) + 1), lambda i: p[i] || CASE WHEN i <= len(m) THEN '[REDACTED:email:' || substr(sha256(m[i]), 1, 8) || ']' ELSE '' END), '') AS text FROM d""",
    "capture_cases": f"""{_T} SELECT position, CASE {_K} WHEN 0 THEN 'proxy' WHEN 3 THEN 'proxy' WHEN 1 THEN 'explicit' ELSE 'flat' END AS shape, prompt, base_text,
  CASE {_K} WHEN 0 THEN 'stop' WHEN 2 THEN 'stop' WHEN 3 THEN 'end' END AS base_finish, CASE {_K} WHEN 0 THEN 'unknown:m1' WHEN 3 THEN 'unknown:m2' ELSE 'unknown:unknown' END AS reference,
  CASE {_K} WHEN 0 THEN 'proxy' WHEN 2 THEN 'flat,x' ELSE '' END AS tags FROM pairs WHERE {_K} < 4""",
    "capture_rejects": f"{_T} SELECT position, CASE {_K} WHEN 4 THEN 'unsupported role' ELSE 'unrecognised shape' END AS reason FROM pairs WHERE {_K} >= 4",
}
