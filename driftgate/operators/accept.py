"""Acceptance: which candidates may become the baseline, and the merge that makes them so."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgate.operators import checks

ALLOWED = ("acceptable", "unverified")


def plan(outcomes: DataFrame, cases: DataFrame, named: Sequence[str] | None = None, force: bool = False, allowed: Sequence[str] = ALLOWED) -> DataFrame:
    """case_id, action (accept, refuse, unchanged, missing) and reason.

    ``outcomes`` has case_id, verdict, cand_text, cand_tools; ``cases`` has case_id, base_text,
    base_tools. Named ids narrow the plan and may be broken; an error is never accepted.
    """
    if named is not None:
        ids = outcomes.sparkSession.createDataFrame([(x,) for x in named], "case_id string")
        outcomes = ids.join(outcomes, "case_id", "left")
    rows = checks.completed(outcomes.drop("base_text", "base_tools")).drop("base_text", "base_tools").join(cases.select("case_id", "base_text", "base_tools", F.lit(True).alias("there")), "case_id", "left")
    same = (F.coalesce("base_text", F.lit("")) == F.coalesce("cand_text", F.lit(""))) & checks.tool_signature("base").eqNullSafe(checks.tool_signature("cand"))
    free = F.lit(force or named is not None)
    lost = F.col("cand_text").isNull() | F.col("verdict").isNull()
    action = F.when(F.col("there").isNull(), "missing").when((F.col("verdict") == "error") | lost, "refuse").when((F.col("verdict") == "equivalent") | same, "unchanged").when(~(F.col("verdict").isin(*allowed) | free), "refuse").otherwise("accept")
    reason = F.when(F.col("there").isNull(), "not in the baseline").when((F.col("verdict") == "error") | lost, "no candidate output").when(action == "refuse", F.concat(F.lit("verdict is "), F.col("verdict"))).otherwise("")
    return rows.select("case_id", action.alias("action"), reason.alias("reason"))


def merge(cases: DataFrame, accepted: DataFrame, reference: str, at) -> DataFrame:
    """The baseline with accepted candidates in place: same ids, revision one up, old reference kept.

    ``accepted`` has case_id, cand_text, cand_tools of the plan's accepted rows; ``at`` is the time
    as a column, so a run can be repeated.
    """
    new = accepted.select("case_id", F.col("cand_text").alias("_text"), F.col("cand_tools").alias("_tools"), F.lit(True).alias("_new"))
    rows = cases.join(new, "case_id", "left")
    moved = F.coalesce("_new", F.lit(False))
    put = lambda name, value: F.when(moved, value).otherwise(F.col(name)).alias(name)
    changed = {"base_text": F.col("_text"), "base_tools": F.col("_tools"), "previous_reference": F.col("reference"), "reference": F.lit(reference), "revision": F.col("revision") + 1, "accepted_at": at}
    return rows.select(*(put(c, changed[c]) if c in changed else F.col(c) for c in cases.columns))
