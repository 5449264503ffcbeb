from __future__ import annotations

import glob
import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", str(shared)).config("spark.log.level", "ERROR").getOrCreate()
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def oracle():
    """Rows of the SQL over a folder of tables, and of a Spark frame, in one comparable form."""
    import duckdb

    def rows(frame, columns):
        def plain(x):
            x = x.tolist() if hasattr(x, "tolist") else x
            if x is None or x != x:
                return "null"
            return repr(round(x, 6)) if isinstance(x, float) else repr(x)

        return sorted(tuple(plain(v) for v in r) for r in frame[columns].itertuples(index=False, name=None))

    def compare(spark, query, sql: str, folder: str):
        db = duckdb.connect()
        for f in glob.glob(f"{folder}/*.parquet"):
            db.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
        want = db.execute(sql).fetchdf()
        got = query(spark, folder).toPandas()
        columns = sorted(want.columns)
        assert sorted(got.columns) == columns
        assert rows(got, columns) == rows(want, columns)

    return compare
