from pyspark.sql import functions as F

from gradewise.functions.repair import is_rejected, repair_decimal


def test_repair_edge_cases(spark):
    rows = [("12.345.678",), (" 3.5 ",), ("7",), ("",), (None,), ("abc",)]
    df = spark.createDataFrame(rows, "raw string")
    out = df.select(repair_decimal(F.col("raw")).alias("v"), is_rejected(F.col("raw")).alias("bad")).collect()
    assert [r.v for r in out] == [12.345678, 3.5, 7.0, None, None, None]
    assert [r.bad for r in out] == [False, False, False, False, False, True]
