"""Baselines as versions of Parquet tables, and runs.

A version is a manifest, a small file that names the folders of data which make it up. Manifests are
numbered, and one is put in place whole or not at all and only where its number is free: of two
writers that both build on version 7, one makes version 8 and the other finds 8 taken, looks at it
and tries again on top of it. Data folders are written before their manifest and are never changed, so
readers see whole versions only, whatever becomes of a job, and an older version can be read again.
Folders of jobs that died belong to no version; ``vacuum`` deletes them.

Rows lie sorted by case_id, with a Bloom filter and page statistics on it, and each folder has a
table of the least and greatest id of each of its files, by which a lookup opens the few files that can
have an id or a prefix. Runs are partitioned by ``run_id``.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from driftgate.operators import baseline

#: How often a writer builds on a newer version before it gives up.
TRIES = 20
DATA, VERSIONS, RANGES = "data", "versions", "ranges"


class StoreError(RuntimeError):
    """A baseline can't be written as asked."""


def _path(spark: SparkSession, path: str):
    """A path of Hadoop's and the file system that it is in."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there, there.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> dict[str, int]:
    """Names in a folder, with their times of change in milliseconds; none where there is no such folder."""
    there, files = _path(spark, path)
    return {s.getPath().getName(): s.getModificationTime() for s in files.listStatus(there)} if files.exists(there) else {}


def _put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Put a file in place whole; False where there is one of that name already."""
    there, files = _path(spark, path)
    draft, _ = _path(spark, f"{path}.{uuid.uuid4().hex}.draft")
    files.mkdirs(there.getParent())
    out = files.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if files.getScheme() == "file":
            # a rename replaces what is there, a link doesn't
            as_local = lambda p: spark._jvm.java.io.File(p.toUri().getPath()).toPath()
            spark._jvm.java.nio.file.Files.createLink(as_local(there), as_local(draft))
        else:
            # raises where the target exists, as the name node sees it
            context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(there.toUri(), spark._jsc.hadoopConfiguration())
            context.rename(draft, there, spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception as e:
        if files.exists(there):
            return False
        raise StoreError(f"can't write {path}") from e
    finally:
        files.delete(draft, False)
    return True


@dataclass(frozen=True)
class Version:
    """What a manifest says: its number, the data folders, how many rows they have, and the columns of all of them."""

    number: int
    parts: tuple[str, ...] = ()
    rows: int = 0
    schema: StructType = StructType()

    def with_part(self, part: str, rows: int, schema: StructType) -> Version:
        """The next version with one more folder; columns that either lacks are null there."""
        types = {f.name: f.dataType for f in self.schema}
        if other := [f.name for f in schema if types.get(f.name, f.dataType) != f.dataType]:
            raise StoreError(f"columns have other types in the store: {', '.join(other)}")
        more = [f for f in schema if f.name not in types]
        return Version(self.number + 1, (*self.parts, part), self.rows + rows, StructType([*self.schema, *more]))


def _manifest(spark: SparkSession, path: str, number: int) -> Version:
    there, files = _path(spark, f"{path}/{VERSIONS}/{number:012d}.json")
    if not files.exists(there):
        raise StoreError(f"no version {number} in {path}")
    stream = files.open(there)
    try:
        known = json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()
    return Version(number, tuple(known["parts"]), known["rows"], StructType.fromJson(known["schema"]))


def latest_version(spark: SparkSession, path: str) -> int | None:
    """Newest version; names of manifests only, no data file is opened."""
    return max((int(n[:12]) for n in _names(spark, f"{path}/{VERSIONS}") if re.fullmatch(r"\d{12}\.json", n)), default=None)


def _newest(spark: SparkSession, path: str) -> Version:
    number = latest_version(spark, path)
    return Version(-1) if number is None else _manifest(spark, path, number)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Cases of the latest version, or of the one named, in no order; sort by ``position`` for insertion order."""
    known = _newest(spark, path) if version is None else _manifest(spark, path, version)
    if not known.parts:
        raise StoreError(f"no baseline in {path}")
    return spark.read.schema(known.schema).parquet(*(f"{path}/{DATA}/{p}" for p in known.parts))


def _write(spark: SparkSession, cases: DataFrame, path: str) -> tuple[str, int]:
    """A new data folder, sorted by id, and the ranges of its files; nobody reads them yet."""
    part = uuid.uuid4().hex
    rows = cases.repartitionByRange("case_id").sortWithinPartitions("case_id")
    rows.write.option("parquet.bloom.filter.enabled#case_id", "true").parquet(f"{path}/{DATA}/{part}")
    written = spark.read.parquet(f"{path}/{DATA}/{part}")
    ranges = written.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.min("case_id").alias("least"), F.max("case_id").alias("most"), F.count(F.lit(1)).alias("rows"))
    ranges.coalesce(1).write.parquet(f"{path}/{RANGES}/{part}")
    return part, spark.read.parquet(f"{path}/{RANGES}/{part}").agg(F.sum("rows")).first()[0] or 0


def _commit(spark: SparkSession, path: str, version: Version) -> bool:
    return _put_if_absent(spark, f"{path}/{VERSIONS}/{version.number:012d}.json", json.dumps({"parts": version.parts, "rows": version.rows, "schema": version.schema.jsonValue()}))


def extend(spark: SparkSession, batch: DataFrame, path: str) -> int:
    """Append the cases that are new, the first of each id; how many there were.

    Where another writer was faster, what it added is seen before the next try, so an id is added
    once whoever wins.
    """
    kept = baseline.first_wins(batch).persist()
    try:
        for _ in range(TRIES):
            now = _newest(spark, path)
            new = baseline.missing(kept, read(spark, path, now.number)) if now.parts else kept
            part, n = _write(spark, new, path)
            if n == 0 and now.parts or _commit(spark, path, now.with_part(part, n, batch.schema)):
                return n
    finally:
        kept.unpersist()
    raise StoreError(f"{path} changed {TRIES} times while it was written")


def replace_all(spark: SparkSession, cases: DataFrame, path: str, unique: bool = True) -> int:
    """Write the cases as the next version; the version's number.

    An id that comes twice is an error, and nothing changes; with ``unique=False`` its rows all stay.
    """
    part, n = _write(spark, cases, path)
    if unique:
        twice = spark.read.parquet(f"{path}/{DATA}/{part}").groupBy("case_id").count().where("count > 1").select("case_id").first()
        if twice:
            raise StoreError(f"case id {twice.case_id} comes twice")
    for _ in range(TRIES):
        number = _newest(spark, path).number
        if _commit(spark, path, Version(number).with_part(part, n, cases.schema)):
            return number + 1
    raise StoreError(f"{path} changed {TRIES} times while it was written")


def merge(spark: SparkSession, path: str, change) -> int:
    """Replace the cases by ``change(cases)``, made again wherever another writer was faster; the new version's number."""
    for _ in range(TRIES):
        now = _newest(spark, path)
        changed = change(read(spark, path, now.number))
        if _commit(spark, path, Version(now.number).with_part(*_write(spark, changed, path), changed.schema)):
            return now.number + 1
    raise StoreError(f"{path} changed {TRIES} times while it was written")


def compact(spark: SparkSession, path: str) -> int:
    """Put the folders of many small extensions together; the new version's number."""
    return merge(spark, path, lambda cases: cases)


def vacuum(spark: SparkSession, path: str, versions: int = 10, older_than: float = 7 * 86_400) -> list[str]:
    """Delete data that none of the newest ``versions`` names and that is older than so many seconds; what went.

    Manifests of older versions go too. The age must exceed that of any job that still writes or reads.
    """
    numbers = sorted(int(n[:12]) for n in _names(spark, f"{path}/{VERSIONS}") if n.endswith(".json"))
    named = {p for n in numbers[-versions:] for p in _manifest(spark, path, n).parts}
    for n in numbers[:-versions]:
        there, files = _path(spark, f"{path}/{VERSIONS}/{n:012d}.json")
        files.delete(there, False)
    old = [p for p, changed in _names(spark, f"{path}/{DATA}").items() if p not in named and changed < 1000 * (time.time() - older_than)]
    for part in old:
        for kind in (DATA, RANGES):
            there, files = _path(spark, f"{path}/{kind}/{part}")
            files.delete(there, True)
    return old


def _files(spark: SparkSession, path: str, least: str, most: str) -> list[str]:
    """Data files that can have an id between the two, by the tables of ranges: a row a file, of which few are fetched."""
    parts = _newest(spark, path).parts
    if not parts:
        return []
    ranges = spark.read.parquet(*(f"{path}/{RANGES}/{p}" for p in parts))
    folder = F.element_at(F.split("_metadata.file_path", "/"), -2)
    found = ranges.where((F.col("least") <= most) & (F.col("most") >= least)).select(F.concat(F.lit(f"{path}/{DATA}/"), folder, F.lit("/"), "file").alias("at"))
    return [r.at for r in found.collect()]


def get(spark: SparkSession, path: str, case_id: str) -> DataFrame:
    """The row of an id, or none."""
    return lookup(spark, path, case_id).where(F.col("case_id") == case_id)


def lookup(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """The case of that id, else those whose id begins so; two rows mean that the prefix is ambiguous."""
    files = _files(spark, path, prefix, prefix + chr(0x10FFFF))
    if not files:
        return read(spark, path).limit(0)
    return baseline.lookup(spark.read.schema(_newest(spark, path).schema).parquet(*files), prefix)


def run_id(stamp: Column, candidate: str, cases: Column) -> Column:
    """UTC stamp and 8 digits of what was run."""
    return F.concat(F.date_format(stamp, "yyyyMMdd'T'HHmmss'Z'"), F.lit("-"), F.substring(F.sha2(F.concat(F.lit(f"{candidate}:"), cases.cast("string")), 256), 1, 8))


def save_run(outcomes: DataFrame, path: str, name: str, created_at: Column) -> None:
    if not re.fullmatch(r"[A-Za-z0-9._-]+", name) or ".." in name:
        raise ValueError("a run id has letters, digits, dots and dashes only")
    outcomes.drop("run_id", "created_at").select("*", F.lit(name).alias("run_id"), created_at.alias("created_at")).write.mode("append").partitionBy("run_id").parquet(path)


def load_run(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """Outcomes of a run, or of the newest; no rows where there is none of that name."""
    if name is None:
        newest = runs(spark, path).first()
        name = newest.run_id if newest else ""
    return spark.read.parquet(path).where(F.col("run_id") == name)


def runs(spark: SparkSession, path: str) -> DataFrame:
    """Runs, the newest first."""
    return spark.read.parquet(path).groupBy("run_id").agg(F.max("created_at").alias("created_at"), F.count(F.lit(1)).alias("cases")).orderBy(F.desc("created_at"), F.desc("run_id"))
