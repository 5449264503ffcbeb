"""Baselines: identity, first-wins dedup, tag filters and statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fingerprint(*parts: Column) -> Column:
    """16 hex digits of the canonical JSON of the input parts; nulls count."""
    packed = F.to_json(F.struct(*(p.alias(f"p{k}") for k, p in enumerate(parts))), {"ignoreNullFields": "false"})
    return F.substring(F.sha2(packed, 256), 1, 16)


def model_ref(text: Column) -> Column:
    """provider and model of 'provider:model', split at the first colon; null where a half is blank."""
    provider, model = F.trim(F.substring_index(text, ":", 1)), F.trim(F.regexp_replace(text, "^[^:]*:", ""))
    ok = text.contains(":") & (F.length(provider) > 0) & (F.length(model) > 0)
    return F.when(ok, F.struct(provider.alias("provider"), model.alias("model")))


def first_wins(cases: DataFrame, order: Sequence[str] = ("position",)) -> DataFrame:
    """One row of each case_id: the first in insertion order."""
    turn = F.row_number().over(Window.partitionBy("case_id").orderBy(*order))
    return cases.withColumn("_turn", turn).where("_turn = 1").drop("_turn")


def missing(batch: DataFrame, store: DataFrame) -> DataFrame:
    """Rows of a batch that a store lacks."""
    return batch.join(store.select("case_id"), "case_id", "left_anti")


def unseen(batch: DataFrame, store: DataFrame, order: Sequence[str] = ("position",)) -> DataFrame:
    """Rows of a batch that a store lacks, one of each id."""
    return missing(first_wins(batch, order), store)


def tagged(cases: DataFrame, wanted: Sequence[str], limit: int | None = None) -> DataFrame:
    """Cases with any of the tags, then the first ``limit`` in insertion order."""
    kept = cases.where(F.arrays_overlap("tags", F.array(*(F.lit(t) for t in wanted)))) if wanted else cases
    return kept.orderBy("position").limit(limit) if limit is not None else kept


def by_reference(cases: DataFrame) -> DataFrame:
    return cases.groupBy("reference").agg(F.count(F.lit(1)).alias("cases"), F.count_if(~F.coalesce("redacted", F.lit(False))).alias("unredacted"))


def by_tag(cases: DataFrame) -> DataFrame:
    return cases.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("cases"))


def lookup(cases: DataFrame, prefix: str) -> DataFrame:
    """The case of that id, else those whose id begins so; two rows mean that the prefix is ambiguous."""
    exact = F.col("case_id") == prefix
    return cases.where(exact | F.col("case_id").startswith(prefix)).orderBy(F.desc(exact), "case_id").limit(2)


def preview(messages: Column, width: int = 80) -> Column:
    """The last user message on one line, else the last message, else nothing."""
    asked = F.filter(messages, lambda m: m["role"] == "user")
    last = F.coalesce(F.try_element_at(asked, F.lit(-1))["content"], F.try_element_at(messages, F.lit(-1))["content"], F.lit(""))
    line = F.trim(F.regexp_replace(last, r"[\r\n]+", " "))
    return F.when(F.length(line) > width, F.concat(F.substring(line, 1, width - 1), F.lit("…"))).otherwise(line)


def merged_tags(own: Column, more: Sequence[str]) -> Column:
    """Distinct tags in order, own first."""
    return F.array_distinct(F.concat(F.coalesce(own, F.array().cast("array<string>")), F.array(*(F.lit(t) for t in more)).cast("array<string>")))
