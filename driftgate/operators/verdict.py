"""Verdicts of cases, their tally, the gate and the review list."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgate.operators import checks

#: From best to worst.
ORDER = ("equivalent", "acceptable", "unverified", "broken", "error")
REGRESSIONS = ("broken", "error")


def equivalent() -> Column:
    """Same normalised text and same calls, whatever their order and ids, of a checked pair."""
    return (F.col("base_norm") == F.col("cand_norm")) & checks.tool_signature("base").eqNullSafe(checks.tool_signature("cand"))


def classify(checked: DataFrame) -> DataFrame:
    """Adds ``verdict``, ``reason`` and ``regression``; ``judged`` may hold a judge's verdict or null."""
    failing = F.filter("checks", lambda x: x["status"] == "fail")
    blocking = F.filter(failing, lambda x: x["severity"] == "blocking")
    lost = F.col("error").isNotNull() | F.col("cand_text").isNull()
    judged = F.when(F.col("judged").isin("equivalent", "acceptable", "broken"), F.col("judged"))
    verdict = F.when(lost, "error").when(F.size(blocking) > 0, "broken").when(equivalent(), "equivalent").otherwise(F.coalesce(judged, F.lit("unverified")))
    first = lambda xs: F.nullif(F.get(xs, F.lit(0))["message"], F.lit(""))
    reason = F.coalesce(F.nullif("error", F.lit("")), F.when(lost, "no candidate"), first(blocking), first(failing), F.nullif("judge_note", F.lit("")), F.lit(""))
    # a generator of one row, so that a filter on the verdict isn't pushed below as a second evaluation
    return checked.withColumn("reason", reason).withColumn("verdict", F.explode(F.array(verdict))).withColumn("regression", F.col("verdict").isin(*REGRESSIONS))


def residual(checked: DataFrame) -> DataFrame:
    """Cases that only a judge can settle, filtered before any judge is called."""
    return classify(checked.withColumn("judged", F.lit(None).cast("string"))).where("verdict = 'unverified'")


def with_judgements(checked: DataFrame, judgements: DataFrame, least_confidence: float = 0.34) -> DataFrame:
    """Judge's rows (case_id, verdict, confidence, note) beside their cases; low confidence abstains."""
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(1.0)))) >= least_confidence
    found = judgements.select("case_id", F.when(sure, F.col("verdict")).alias("judged"), F.when(sure, F.col("note")).otherwise("judge abstained").alias("judge_note"))
    return checked.drop("judged", "judge_note").join(found, "case_id", "left")


def tally(outcomes: DataFrame) -> DataFrame:
    """One row: total, a count for each verdict and the regressions."""
    counts = [F.count_if(F.col("verdict") == v).alias(v) for v in ORDER]
    return outcomes.agg(F.count(F.lit(1)).alias("total"), *counts, F.count_if(F.col("verdict").isin(*REGRESSIONS)).alias("regressions"))


def worst(outcomes: DataFrame, *by: str) -> DataFrame:
    """Worst verdict of each group, or of all; equivalent where there is none."""
    ranks = F.array(*(F.lit(v) for v in ORDER))
    rank = F.coalesce(F.max(F.array_position(ranks, F.col("verdict"))), F.lit(1))
    return outcomes.groupBy(*by).agg(F.element_at(ranks, rank.cast("int")).alias("worst"))


@dataclass(frozen=True)
class Policy:
    fail_on: tuple[str, ...] = REGRESSIONS
    max_failures: int = 0
    fail_on_unverified: bool = False
    min_cases: int = 1


def gate(outcomes: DataFrame, policy: Policy | None = None) -> DataFrame:
    """One row: passed, reasons, counted failures, total. A verdict that is listed twice counts twice."""
    p = policy or Policy()
    counted = sum((F.col(v) for v in p.fail_on), F.lit(0)) + (F.col("unverified") if p.fail_on_unverified else F.lit(0))
    t = tally(outcomes).withColumn("counted", counted.cast("long"))
    few = F.when(F.col("total") < p.min_cases, F.format_string(f"%d cases, at least {p.min_cases} needed", "total"))
    many = F.when(F.col("counted") > p.max_failures, F.format_string(f"%d failures, {p.max_failures} allowed", "counted"))
    reasons = F.array_compact(F.array(few, many))
    return t.select((F.size(reasons) == 0).alias("passed"), reasons.alias("reasons"), "counted", "total")


def review(outcomes: DataFrame, limit: int = 25) -> DataFrame:
    """The worst cases first; a top-k, not a sort of all."""
    rank = F.array_position(F.array(*(F.lit(v) for v in ORDER)), F.col("verdict"))
    return outcomes.where("verdict <> 'equivalent'").orderBy(F.desc(rank), "case_id").limit(limit).select("case_id", "verdict", "reason")
