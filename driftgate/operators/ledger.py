"""A ledger of paid calls: each call's result is written before the next call is made, and read before any is made again.

A call is known by the SHA-256 of its model and prompt, so cases that ask the same share one call. Calls are
dealt to buckets by that key. The task of a bucket writes every few results as a file of the ledger,
put in place by a rename, before it goes on; when the task is repeated after its executor is lost it first
reads what it has written in this run. A later run leaves out whatever the ledger holds. Only calls that were on
their way when the executor went, fewer than ``commit_every`` of them, are made twice. Turn speculation off:
two attempts of a task at once would both call.

The ledger lies in a folder that all executors reach through Arrow's file systems (local and mounted
paths, hdfs, s3, gs). A rate is shared out evenly: each running task has a token bucket with its part of it.
"""

from __future__ import annotations

import tempfile
import time
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgate.operators import replay

SCHEMA = "key string, model string, reply string, error string, attempts int, duration_ms long"
_ARROW = pa.schema([("key", pa.string()), ("model", pa.string()), ("reply", pa.string()), ("error", pa.string()), ("attempts", pa.int32()), ("duration_ms", pa.int64())])


class TokenBucket:
    """At most ``burst`` calls at once and ``rate`` a second in the long run."""

    def __init__(self, rate: float, burst: float = 1.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.burst, self.clock, self.sleep = rate, max(1.0, burst), clock, sleep
        self.tokens, self.at = self.burst, clock()

    def take(self) -> None:
        """Wait until there is a token, and take it."""
        now = self.clock()
        self.tokens = min(self.burst, self.tokens + (now - self.at) * self.rate)
        self.at = now
        if self.tokens < 1:
            wait = (1 - self.tokens) / self.rate
            self.sleep(wait)
            self.tokens, self.at = 1.0, self.at + wait
        self.tokens -= 1


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; a local session without one gets a temporary folder."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        there = tempfile.mkdtemp(prefix="driftgate-")
    return f"{there.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def _written(files: fs.FileSystem, folder: str, run: str) -> dict[str, dict]:
    """Results that this run has written to a bucket, by key."""
    found = files.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    rows = [r for f in found if f.base_name.startswith(f"{run}-") for r in pq.read_table(f.path, filesystem=files, schema=_ARROW).to_pylist()]
    return {r["key"]: r for r in rows}


def _calls(path: str, run: str, model: str, provider: Callable[[], replay.Provider], commit_every: int, rate: float | None, burst: float, retries: int, base: float, cap: float):
    """Rows (bucket, key, prompt), each bucket's together -> how many calls were made and how many were read."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _file_system(path)
        client, tokens = provider(), TokenBucket(rate, burst) if rate else None
        bucket, known, held, made, read = None, {}, [], 0, 0

        def commit() -> None:
            if held:
                folder = f"{root}/bucket={bucket}"
                files.create_dir(folder, recursive=True)
                name = f"{run}-{uuid.uuid4().hex}.parquet"
                pq.write_table(pa.Table.from_pylist(held, _ARROW), f"{folder}/.{name}", filesystem=files)
                files.move(f"{folder}/.{name}", f"{folder}/{name}")
                held.clear()

        for batch in batches:
            for own, key, prompt in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != bucket:
                    commit()
                    bucket, known = own, _written(files, f"{root}/bucket={own}", run)
                if key in known:
                    read += 1
                    continue
                if tokens:
                    tokens.take()
                reply, error, attempts, took = replay.attempt(client, key, prompt, retries, base, cap, tokens.take if tokens else None)
                held.append({"key": key, "model": model, "reply": reply, "error": error, "attempts": attempts, "duration_ms": took})
                made += 1
                if len(held) >= commit_every:
                    commit()
        commit()
        yield pa.RecordBatch.from_arrays([pa.array([made], pa.int64()), pa.array([read], pa.int64())], names=["made", "read"])

    return work


def read(spark: SparkSession, path: str) -> DataFrame:
    """Results in the ledger, one a key: a reply before an error."""
    files, root = _file_system(path)
    if not any(f.type == fs.FileType.Directory for f in files.get_file_info(fs.FileSelector(root, allow_not_found=True))):
        return spark.createDataFrame([], SCHEMA)
    rows = spark.read.schema(SCHEMA).parquet(path)
    best = F.min_by(F.struct("model", "reply", "error", "attempts", "duration_ms"), F.col("reply").isNull())
    return rows.groupBy("key").agg(best.alias("r")).select("key", "r.*")


def call(
    cases: DataFrame, provider: Callable[[], replay.Provider], model: str, path: str, buckets: int = 64, commit_every: int = 1, rate: float | None = None, burst: float = 1.0,
    retries: int = 2, base: float = 1.0, cap: float = 30.0,
) -> DataFrame:
    """case_id, cand_text, error, attempts, duration_ms of cases (case_id, prompt): from the ledger, after calls for what it lacks.

    Calls that ended in an error are made again by the next run. ``rate`` is in calls a second over all tasks.
    """
    spark = cases.sparkSession
    key = F.sha2(F.concat_ws("\n", F.lit(model), F.coalesce("prompt", F.lit(""))), 256)
    asked = cases.select("case_id", F.coalesce("prompt", F.lit("")).alias("prompt"), key.alias("key"))
    done = read(spark, path).where("reply is not null")
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int").alias("bucket")
    pending = asked.dropDuplicates(["key"]).join(done.select("key"), "key", "left_anti").select(bucket, "key", "prompt")
    tasks = min(buckets, spark.sparkContext.defaultParallelism)
    work = _calls(path, uuid.uuid4().hex[:12], model, provider, commit_every, rate / tasks if rate else None, burst / tasks, retries, base, cap)
    pending.repartition(buckets, "bucket").sortWithinPartitions("bucket", "key").mapInArrow(work, "made long, read long").agg(F.sum("made")).collect()
    found = read(spark, path).select("key", F.col("reply").alias("cand_text"), "error", "attempts", "duration_ms")
    return asked.drop("prompt").join(found, "key", "left").drop("key")


def compact(spark: SparkSession, path: str, to: str) -> None:
    """Write the ledger with few files to another folder, which is a ledger too."""
    rows = read(spark, path)
    rows.withColumn("bucket", F.lit(0)).repartition(max(1, rows.count() // 100_000)).write.partitionBy("bucket").parquet(to)
