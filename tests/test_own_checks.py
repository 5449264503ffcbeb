import pytest
from pyspark.sql import functions as F

from driftgate.operators import checks, verdict


def result(row, name):
    (one,) = [tuple(c) for c in row.checks if c.check == name]
    return one[1:4]


@pytest.fixture
def pairs(spark):
    texts = ["a1", "b2", "c3", "d4", "bad", None, "7", "0"]
    return spark.createDataFrame([(str(k), "same", t) for k, t in enumerate(texts)], "case_id string, base_text string, cand_text string")


def test_a_python_check_that_raises_warns_on_its_row_alone(pairs):
    def prefix(text):
        if text == "bad":
            raise KeyError("what")
        return {"a": True, "b": False, "c": None}.get(text[0], ("fail", f"begins with {text[0]}"))

    own = {"prefix": checks.Hosted(prefix, ("cand_text",), message="wrong letter"), "worse": checks.Hosted(lambda t: "perhaps", ("cand_text",))}
    rows = sorted(checks.evaluate(pairs, json=False, extra=own).collect(), key=lambda r: r.case_id)
    got = [result(r, "prefix") for r in rows]
    assert got[:4] == [("pass", "info", ""), ("fail", "blocking", "wrong letter"), ("skip", "info", ""), ("fail", "blocking", "begins with d")]
    assert got[4] == ("fail", "warning", "check raised KeyError: 'what'") and got[5][1] == "warning" and "TypeError" in got[5][2]
    assert {result(r, "worse")[:2] for r in rows} == {("fail", "warning")}
    assert [c for c in rows[0].asDict() if c.startswith(("s_", "h_"))] == []


def test_a_column_check_that_raises_warns_on_its_row_alone(spark, pairs):
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    number = F.col("cand_text").cast("int")
    # the cast stands in several places, and a second column shares it
    own = {"ratio": checks.Check(F.when(10 / number > 2, "fail").when(number > 100, "fail").otherwise("pass"), message=F.concat(F.lit("ratio "), (10 / number).cast("string")), evidence=number.cast("string"))}
    rows = sorted(checks.evaluate(pairs, json=False, extra=own).withColumn("length", F.length("cand_text")).collect(), key=lambda r: r.case_id)
    got = [result(r, "ratio") for r in rows]
    assert got[6] == ("pass", "info", "") and got[7] == got[0] == ("fail", "warning", "check raised an error")
    assert [g[1] for g in got].count("warning") == 6
    # warnings aren't verdicts, unless the settings say so
    verdicts = {r.case_id: r.verdict for r in verdict.classify(checks.evaluate(pairs.withColumn("base_text", F.col("cand_text")), json=False, extra=own)).collect()}
    assert verdicts["0"] == verdicts["6"] == "equivalent"
    strict = checks.Settings(warnings_break=True)
    assert verdict.classify(checks.evaluate(pairs.where("case_id = '0'"), strict, json=False, extra=own)).first().verdict == "broken"


def test_one_of_a_thousand(spark):
    pairs = spark.range(1000).select(F.col("id").cast("string").alias("case_id"), F.lit("x").alias("base_text"), F.when(F.col("id") == 500, "none").otherwise(F.col("id").cast("string")).alias("cand_text"))
    own = {"native": checks.Check(F.when(F.col("cand_text").cast("int") >= 0, "pass").otherwise("fail")), "hosted": checks.Hosted(lambda t: int(t) >= 0, ("cand_text",))}
    found = checks.evaluate(pairs, json=False, extra=own, only=("native", "hosted")).select("case_id", F.explode("checks").alias("c")).where("c.status <> 'pass'").collect()
    assert sorted((r.case_id, r.c.check, r.c.severity) for r in found) == [("500", "hosted", "warning"), ("500", "native", "warning")]
