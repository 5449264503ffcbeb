"""A corpus from documents to packed sequences: five stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgate.llm import exact_dedup, minhash_dedup, mixing, packing, toxicity
from driftgate.llm.work import scratch, table

#: Share of expected tokens by labelled quality that the mix stage aims at: one token in twenty of low quality, for variety.
QUALITY = {"q0": 0.05, "q1": 0.95}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return exact_dedup.keep_exact(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group the document with the least id stays."""
    return minhash_dedup.keep_near(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn at rates that bring expected tokens to the quality targets."""
    domain = F.concat(F.lit("q"), F.col("quality").cast("string"))
    return mixing.keep_mixed(docs, table(spark, sf_dir, "labels"), domain, QUALITY)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in a sequence of 2048 tokens."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_exact), ("near_dedup", drop_near), ("mix", mix), ("pack", pack)]

#: Classifiers, MinHash and tokenizers aren't expressible in SQL; tests/llm/test_brute_force.py compares run() with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; tables that a stage needs go with it, its result stays in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as lasting:
            docs = lasting(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
