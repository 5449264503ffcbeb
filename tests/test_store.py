import threading
import time

import pytest
from pyspark.sql import functions as F

from driftgate.sources import store


@pytest.fixture
def batch(spark):
    return lambda *ids, start=0: spark.createDataFrame([(x, start + k) for k, x in enumerate(ids)], "case_id string, position long")


def ids(spark, at, version=None):
    return sorted(r.case_id for r in store.read(spark, at, version).collect())


def test_first_of_each_id_wins_and_columns_may_be_added(spark, batch, tmp_path):
    at = str(tmp_path / "base")
    assert store.extend(spark, batch("a", "b", "a"), at) == 2
    assert store.extend(spark, batch("b", "c", start=9).withColumn("note", F.lit("new")), at) == 1
    assert sorted((r.case_id, r.position, r.note) for r in store.read(spark, at).collect()) == [("a", 0, None), ("b", 1, None), ("c", 10, "new")]
    with pytest.raises(store.StoreError, match="other types.*position"):
        store.extend(spark, batch("d").withColumn("position", F.lit("x")), at)
    assert store.extend(spark, batch(), str(tmp_path / "empty")) == 0
    with pytest.raises(store.StoreError, match="no baseline"):
        store.read(spark, str(tmp_path / "none"))


def test_a_writer_that_was_overtaken_looks_again(spark, batch, tmp_path, monkeypatch):
    at, commit, others = str(tmp_path / "base"), store._commit, [("b", "c"), ("c", "d")]
    store.extend(spark, batch("a"), at)

    def late(session, path, version):
        if others:  # somebody else commits between the read and the commit of this writer, twice
            monkeypatch.setattr(store, "_commit", commit)
            store.extend(spark, batch(*others.pop(0)), at)
            monkeypatch.setattr(store, "_commit", late)
        return commit(session, path, version)

    monkeypatch.setattr(store, "_commit", late)
    assert store.extend(spark, batch("b", "c", "e"), at) == 1
    assert ids(spark, at) == ["a", "b", "c", "d", "e"] and store.latest_version(spark, at) == 3


def test_writers_at_once_lose_nothing(spark, batch, tmp_path):
    at, added = str(tmp_path / "base"), []
    names = [f"{k:02d}" for k in range(12)]
    run = lambda k: added.append(store.extend(spark, batch(*names[k : k + 6]), at))
    threads = [threading.Thread(target=run, args=(k,)) for k in range(0, 8, 2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert ids(spark, at) == names and sum(added) == len(names)


def test_a_job_that_dies_leaves_the_version_as_it_was(spark, batch, tmp_path, monkeypatch):
    at = str(tmp_path / "base")
    store.replace_all(spark, batch("a", "b"), at)
    bad = batch("c", "d").withColumn("position", F.when(F.col("case_id") == "d", F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("position")))
    with pytest.raises(Exception, match="lost"):
        store.replace_all(spark, bad, at)
    assert ids(spark, at) == ["a", "b"] and store.latest_version(spark, at) == 0
    # and so does one that dies after its data is written
    monkeypatch.setattr(store, "_commit", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        store.replace_all(spark, batch("z"), at)
    assert ids(spark, at) == ["a", "b"]
    monkeypatch.undo()
    assert store.replace_all(spark, batch("e"), at) == 1 and ids(spark, at, 0) == ["a", "b"]
    # what belongs to no version goes once it is old
    assert store.vacuum(spark, at) == []
    time.sleep(0.1)
    assert len(store.vacuum(spark, at, versions=1, older_than=0.05)) >= 2 and ids(spark, at) == ["e"]


def test_a_repeated_id_is_an_error_of_replacement(spark, batch, tmp_path):
    at = str(tmp_path / "base")
    store.replace_all(spark, batch("a"), at)
    with pytest.raises(store.StoreError, match="z comes twice"):
        store.replace_all(spark, batch("y", "z", "z"), at)
    assert ids(spark, at) == ["a"]
    store.replace_all(spark, batch("z", "z"), at, unique=False)
    assert ids(spark, at) == ["z", "z"]


def test_merge_is_made_again_on_top_of_other_writers(spark, batch, tmp_path, monkeypatch):
    at, commit, once = str(tmp_path / "base"), store._commit, [1]
    store.replace_all(spark, batch("a"), at)

    def late(*args):
        if once:
            once.pop()
            store.extend(spark, batch("b"), at)
        return commit(*args)

    monkeypatch.setattr(store, "_commit", late)
    store.merge(spark, at, lambda cases: cases.withColumn("case_id", F.concat("case_id", F.lit("!"))))
    assert ids(spark, at) == ["a!", "b!"]


def test_lookups_open_few_files(spark, tmp_path):
    at = str(tmp_path / "base")
    cases = spark.range(40_000).select(F.sha2(F.col("id").cast("string"), 256).alias("case_id"), F.col("id").alias("position"))
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store.replace_all(spark, cases, at)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)
    some = cases.where("id % 9999 = 7").collect()
    assert len(store.read(spark, at).inputFiles()) == 8
    for r in some:
        assert store.get(spark, at, r.case_id).collect() == [r]
        assert len(store._files(spark, at, r.case_id, r.case_id)) == 1
        assert len(store.lookup(spark, at, r.case_id[:8]).inputFiles()) <= 2
        assert [x.case_id for x in store.lookup(spark, at, r.case_id[:12]).collect()] == [r.case_id]
    assert store.lookup(spark, at, "a").count() == 2 and store.lookup(spark, at, "none").count() == 0 and store.get(spark, at, some[0].case_id[:9]).count() == 0
    # after extensions a lookup still opens a file a folder, and one in all once they are put together
    store.extend(spark, cases.limit(0).unionByName(spark.createDataFrame([("0" * 64, 1), ("f" * 64, 2)], "case_id string, position long")), at)
    assert len(store._files(spark, at, "0" * 64, "0" * 64)) == 1
    store.compact(spark, at)
    assert store.read(spark, at).count() == 40_002 and store.get(spark, at, "f" * 64).first().position == 2
