"""Reports of a run: one tally row and a bounded list of the worst cases come to the driver, no more.

The worst cases are found over narrow rows (id, verdict, reason). Requests, texts, durations and diffs are then read
for these few ids alone, which reach the scans of a stored run and baseline as a filter.
"""

from __future__ import annotations

import html
import json
import re
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgate.operators import baseline, checks, diff, verdict

SHOWN = 50
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f]")


#: Lines of a case's diff, and characters of a text, that a page shows at most.
MOST_LINES, MOST_TEXT = 200, 4000


def gathered(outcomes: DataFrame, shown: int = SHOWN) -> tuple[dict, list[dict]]:
    """The tally, and the worst cases with their durations where the run has any."""
    counts = verdict.tally(outcomes).first().asDict()
    rows = [r.asDict() for r in verdict.review(outcomes, shown).collect()]
    if rows and "duration_ms" in outcomes.columns:
        took = {r.case_id: r.duration_ms for r in _of(outcomes, rows).select("case_id", "duration_ms").collect()}
        rows = [{**r, "duration_ms": took.get(r["case_id"])} for r in rows]
    return counts, rows


def _of(frame: DataFrame, rows: list[dict]) -> DataFrame:
    return frame.where(F.col("case_id").isin([r["case_id"] for r in rows]))


def details(outcomes: DataFrame, rows: list[dict], cases: DataFrame | None = None) -> list[dict]:
    """``rows`` with request, base_text, cand_text and changes, a list of (part, line), of their outputs.

    Texts that the outcomes lack come from ``cases``, a baseline with messages.
    """
    if not rows:
        return []
    few = _of(outcomes, rows)
    few = few.select(*(c for c in checks.COLUMNS if c in few.columns))
    if cases is not None:
        known = _of(cases, rows)
        there = [c for c in known.columns if c in checks.COLUMNS and (c == "case_id" or c.startswith("base_"))]
        request = [baseline.preview(F.col("messages"), 200).alias("request")] if "messages" in known.columns else []
        few = few.drop(*(c for c in there if c != "case_id")).join(known.select(*there, *request), "case_id", "left")
    pairs = checks.with_facts(few, checks.Settings())
    texts = {r.case_id: r.asDict() for r in pairs.select("case_id", "base_text", "cand_text", *(["request"] if "request" in pairs.columns else [])).collect()}
    changes: dict[str, list] = {}
    for r in diff.output_changes(pairs.where("cand_text is not null")).limit(len(rows) * MOST_LINES).collect():
        changes.setdefault(r.case_id, []).append((r.part, r.line))
    return [{**texts.get(r["case_id"], {}), **r, "changes": changes.get(r["case_id"], [])[:MOST_LINES]} for r in rows]


def _cell(value: str) -> str:
    return str(value or "").replace("|", "\\|").replace("\n", " ")


def markdown(outcomes: DataFrame, shown: int = SHOWN) -> str:
    counts, rows = gathered(outcomes, shown)
    lines = ["| verdict | cases |", "|---|---|", *(f"| {v} | {counts[v]} |" for v in verdict.ORDER), ""]
    if rows:
        lines += ["| case | verdict | reason |", "|---|---|---|", *(f"| {_cell(r['case_id'])} | {r['verdict']} | {_cell(r['reason'])} |" for r in rows)]
    more = counts["total"] - counts["equivalent"] - len(rows)
    return "\n".join([*lines, *([f"\n{more} more not shown"] if more > 0 else [])]) + "\n"


def junit(outcomes: DataFrame, shown: int = SHOWN) -> str:
    counts, rows = gathered(outcomes, shown)
    tag = {"broken": "failure", "error": "error", "unverified": "skipped"}
    time = lambda ms: f' time="{(ms or 0) / 1000:.3f}"'
    whole = time(total_duration(outcomes).first()[0]) if "duration_ms" in outcomes.columns else ""
    out = [f'<testsuite name="drift" tests="{counts["total"]}" failures="{counts["broken"]}" errors="{counts["error"]}" skipped="{counts["unverified"]}"{whole}>']
    for r in rows:
        message = quoteattr(_CONTROL.sub("", r["reason"] or "")[:500])
        inner = f"<{tag[r['verdict']]} message={message}/>" if r["verdict"] in tag else ""
        took = time(r["duration_ms"]) if "duration_ms" in r else ""
        out.append(f"  <testcase name={quoteattr(_CONTROL.sub('', r['case_id']))}{took}>{inner}</testcase>")
    return "\n".join([*out, "</testsuite>"]) + "\n"


def html_page(outcomes: DataFrame, shown: int = SHOWN, cases: DataFrame | None = None) -> str:
    """A page that needs no other file; with outputs in ``outcomes`` or ``cases``, each case has its request, texts and diff."""
    counts, rows = gathered(outcomes, shown)
    if cases is not None or {"base_text", "cand_text"} <= set(outcomes.columns):
        rows = details(outcomes, rows, cases)
    head = "".join(f"<tr><td>{v}</td><td>{counts[v]}</td></tr>" for v in verdict.ORDER)
    cut = lambda text: html.escape(text if len(text) <= MOST_TEXT else text[:MOST_TEXT] + "…")

    def more(r: dict) -> str:
        kinds = {"+": "add", "-": "del"}
        lines = "".join(f'<div class="{kinds.get(line[:1], "same")}">{html.escape(line)}</div>' for _, line in r.get("changes", []))
        parts = [("request", cut(r.get("request") or "")), ("baseline", cut(r.get("base_text") or "")), ("candidate", cut(r.get("cand_text") or "")), ("changes", lines)]
        body = "".join(f"<h4>{name}</h4><pre>{text}</pre>" for name, text in parts if text)
        return f"<details><summary>{html.escape(_took(r))}</summary>{body}</details>" if body else html.escape(_took(r))

    body = "".join(f"<tr><td>{html.escape(r['case_id'])}</td><td>{r['verdict']}</td><td>{cut(r['reason'] or '')}</td><td>{more(r)}</td></tr>" for r in rows)
    style = "<style>table{border-collapse:collapse}td{border:1px solid #ccc;padding:.2em .5em;vertical-align:top}.add{background:#e6ffec}.del{background:#ffebe9}</style>"
    return f"<!doctype html><meta charset=utf-8><title>{escape('Drift report')}</title>{style}<table>{head}</table><table>{body}</table>\n"


def _took(r: dict) -> str:
    return f"{r['duration_ms'] / 1000:.3f} s" if r.get("duration_ms") is not None else "details"


def as_json(outcomes: DataFrame, shown: int = SHOWN) -> str:
    counts, rows = gathered(outcomes, shown)
    return json.dumps({"summary": counts, "review": rows}, ensure_ascii=False)


def terminal(outcomes: DataFrame, shown: int = 25) -> str:
    counts, rows = gathered(outcomes, shown)
    return "\n".join([*(f"{v:>12} {counts[v]}" for v in verdict.ORDER), *(f"  {r['case_id']}  {r['verdict']}  {r['reason']}" for r in rows)]) + "\n"


def total_duration(outcomes: DataFrame) -> DataFrame:
    return outcomes.agg(F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("duration_ms"))
