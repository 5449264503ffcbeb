"""Shared helpers: tables between jobs, skew-safe lookups and words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator, Sequence
from contextlib import contextmanager
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; the path may be in any store that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a local session gets a temporary folder; a cluster must name one.
    """
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    there = tempfile.mkdtemp(prefix="driftgate-")
    spark.conf.set("spark.checkpoint.dir", there)
    return there


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again.

    This cuts the lineage: a lost executor costs a re-read, never a recomputation, and a
    nondeterministic column keeps the value it had when it was written.
    """
    return _written(df, "/".join([_own_dir(df.sparkSession), *_SCRATCH, f"{name}-{uuid.uuid4().hex}"]))


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"


def _written(df: DataFrame, at: str) -> DataFrame:
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def clear(spark: SparkSession, at: str | None = None) -> None:
    """Delete the tables that this application has written to the shared folder, once no result reads them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at or _own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Folders inside that of the application, the innermost last, in which tables are stored just now.
_SCRATCH: list[str] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables stored inside go when it ends, but for those stored by the function that it gives."""
    outside = list(_SCRATCH)
    _SCRATCH.append(f"scratch-{uuid.uuid4().hex}")
    inside = "/".join([_own_dir(spark), *_SCRATCH])
    try:
        yield lambda df, name: _written(df, "/".join([_own_dir(spark), *outside, f"{name}-{uuid.uuid4().hex}"]))
    finally:
        _SCRATCH[:] = outside
        clear(spark, inside)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def salted(rows: DataFrame, by: Sequence[str | Column]) -> DataFrame:
    """Add ``_salt``, a function of ``by`` alone, so that a retried task deals a row alike."""
    n = max(16, shuffle_partitions(rows.sparkSession))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(n)).cast("int"))


def attach(rows: DataFrame, keys: Sequence[str], values: DataFrame, by: Sequence[str]) -> DataFrame:
    """Left join ``values`` (unique on ``keys``) to ``rows``, where one key may hold most rows.

    Rows are dealt by key and salt. ``values`` meets the distinct pairs of key and salt first,
    of which a key has as many as there are shuffle partitions at most.
    """
    keys = list(keys)
    dealt = salted(rows, by)
    spread = dealt.select(*keys, "_salt").distinct().join(values, keys)
    return dealt.join(spread, [*keys, "_salt"], "left").drop("_salt")


#: Rows that a worker turns into Python objects at a time.
SLICE = 500


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Batches of ``rows`` rows at most, so that a worker holds few texts as Python strings."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


class Recent(dict):
    """Values made on demand by ``make``; the keys used last stay, ``most`` to twice as many."""

    def __init__(self, make: Callable[[Any], Any], most: int):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key: Hashable) -> Any:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


_HELD: dict[str, Any] = {}


def held(name: str, make: Callable[[], Any]) -> Any:
    """What a worker process keeps between the tasks of one operator; another operator's goes."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = make()
    return _HELD[name]


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 1 by 3: rows that no label is learned from.

    A null id has no remainder; such a row counts as not held out.
    """
    id_ = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def stable_order(doc_id: str = "doc_id") -> Column:
    """A pseudo-random order of rows that is the same in each run."""
    return F.xxhash64(F.col(doc_id), F.lit(20_07))
