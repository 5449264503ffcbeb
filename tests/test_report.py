import re
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from driftgate import report
from driftgate.operators import checks, verdict


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """A run without baseline texts, and a baseline, both as stored tables."""
    at = tmp_path_factory.mktemp("report")
    rows = [("a", "one two three", "one two four"), ("b", '{"k": 1, "gone": 2}', '{"k": 5}'), ("c<&>", "x", ""), ("d", "same", "same"), ("e", "words", None)]
    pairs = spark.createDataFrame([(*r, 100 * k + 7) for k, r in enumerate(rows)], "case_id string, base_text string, cand_text string, duration_ms long")
    done = verdict.classify(checks.evaluate(pairs))
    done.select("case_id", "verdict", "reason", "error", "cand_text", "duration_ms").write.parquet(f"{at}/run")
    message = F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit("ask <"), "case_id").alias("content")))
    pairs.select("case_id", "base_text", message.alias("messages")).write.parquet(f"{at}/base")
    return spark.read.parquet(f"{at}/run"), spark.read.parquet(f"{at}/base")


def test_times_of_the_suite_are_the_sum_of_all(spark, stored):
    run, _ = stored
    suite = ElementTree.fromstring(report.junit(run))
    assert float(suite.get("time")) == report.total_duration(run).first()[0] / 1000 == pytest.approx(1.035)
    times = {c.get("name"): float(c.get("time")) for c in suite}
    assert times == {"a": 0.007, "b": 0.107, "c<&>": 0.207, "e": 0.407}
    # the sum doesn't depend on how many cases are shown
    assert ElementTree.fromstring(report.junit(run, 1)).get("time") == suite.get("time")


def test_page_has_context_texts_and_diffs_of_the_worst_cases(stored):
    run, base = stored
    page = report.html_page(run, cases=base)
    assert "ask &lt;c&lt;&amp;&gt;" in page and "<c<" not in page
    assert '<div class="del">-one two three</div>' in page and '<div class="add">+one two four</div>' in page
    assert re.search(r"gone", page) and "0.107 s" in page
    assert "same" not in re.sub("<style>.*?</style>|class=\"same\"", "", page)
    short = report.html_page(run, shown=1, cases=base)
    assert short.count("<details>") == 1 and "<td>e</td>" in short


def test_texts_are_read_for_the_shown_ids_alone(stored):
    run, base = stored
    plan = lambda frame: frame._jdf.queryExecution().toString()
    narrow = plan(verdict.review(run, 3))
    assert "ReadSchema: struct<case_id:string,verdict:string,reason:string>" in narrow
    few = plan(report._of(base, [{"case_id": "a"}, {"case_id": "b"}]))
    assert "PushedFilters: [In(case_id, [a,b])]" in few


def test_a_run_without_texts_or_rows(spark, stored):
    run, base = stored
    assert "<details>" not in report.html_page(run.drop("cand_text", "duration_ms"))
    assert "<details>" not in report.html_page(run.where("verdict = 'equivalent'"), cases=base)
    assert "time=" not in report.junit(run.drop("duration_ms"))
