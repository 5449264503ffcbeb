from pyspark.sql import functions as F

from driftgate.functions import text


def test_folding_equals_that_of_every_code_point(spark):
    points = [chr(k) for k in range(0x110000) if not 0xD800 <= k < 0xE000]
    # a character alone, between others, and in runs
    rows = [("".join(points[k : k + 997]),) for k in range(0, len(points), 997)] + [(f"a{c}ß",) for c in points[:0x2000]]
    got = spark.createDataFrame(rows, "t string").select("t", text.folded(F.col("t")).alias("f")).collect()
    assert len(got) == len(rows) and all(r.f == r.t.casefold() for r in got)


def test_folding_of_empty_and_null(spark):
    got = spark.createDataFrame([("",), (None,), ("İSTANBUL ŉ ﬃ",)], "t string").select(text.normalised(F.col("t"), ignore_case=True)).collect()
    assert [r[0] for r in got] == ["", None, "İSTANBUL ŉ ﬃ".casefold()]
