from pyspark.sql import functions as F

from changeflow.functions import scalars

INTS = {0: "00", 1: "01", 127: "7F", 128: "8001", 300: "AC02", 2**63 - 1: "FFFFFFFFFFFFFFFF7F", -1: "FFFFFFFFFFFFFFFFFF01", -(2**63): "80808080808080808001", None: None}
TEXTS = {"": "0000000000000000F7", "a": "6100000000000000F8", "abcdefgh": "6162636465666768FF0000000000000000F7", "é": "C3A9000000000000F9", None: None}


def test_varints_there_and_back(spark):
    df = spark.createDataFrame([(k,) for k in INTS], "n long").withColumn("v", scalars.varint(F.col("n")))
    got = df.withColumn("back", scalars.from_varint(F.col("v"))).collect()
    assert {r["n"]: r["v"] for r in got} == INTS and all(r["n"] == r["back"] for r in got)


def test_comparable_bytes(spark):
    got = spark.createDataFrame([(k,) for k in TEXTS], "t string").withColumn("m", scalars.memcomparable(F.col("t"))).collect()
    assert {r["t"]: r["m"] for r in got} == TEXTS
    some = ["", "a", "a\0", "ab", "abcdefgh", "abcdefgh\0", "abcdefghi", "b", "é"]
    keyed = spark.createDataFrame([(k,) for k in some], "t string").withColumn("m", F.concat(scalars.memcomparable(F.col("t")), F.lit("FFFF")))
    assert [r["t"] for r in keyed.orderBy("m").collect()] == sorted(some, key=str.encode)


def test_windows_of_ten_seconds(spark):
    from changeflow.operators import metrics

    rows = [(0, 1.0), (3, 5.0), (9, 2.0), (10, 7.0), (25, None), (None, 9.0)]
    df = spark.createDataFrame(rows, "s int, v double").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["at"]: (r["n"], r["p50"], r["max"]) for r in metrics.tumbling(df, "ts", "v", {"p50": 0.5}).withColumn("at", F.unix_seconds("window_start")).collect()}
    assert got == {0: (3, 2.0, 5.0), 10: (1, 7.0, 7.0)}
