from pyspark.sql import functions as F

from graphloom.shared import cleanup, cut, drop, salted_lookup, trimmed


def test_cut_and_drop(spark):
    df = spark.range(5).withColumn("m", F.create_map(F.lit("a"), F.col("id")))
    back = cut(df, "x")
    assert back.dtypes == df.dtypes and back.count() == 5 and "Range" not in back._jdf.queryExecution().toString()
    drop(back)
    drop(None)
    assert cut(spark.range(0)).count() == 0
    cleanup(spark)


def test_salted_lookup_equals_a_join(spark):
    left = spark.range(500).select(F.when(F.col("id") < 300, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 7).cast("string"))).alias("k"), "id")
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3), ("unused", 4)], "k string, v int")
    for how in ("left", "inner"):
        a, b = salted_lookup(left, right, ["k"], how, parts=8), left.join(right, "k", how)
        assert sorted(map(tuple, a.select("k", "id", "v").collect()), key=str) == sorted(map(tuple, b.select("k", "id", "v").collect()), key=str)
    assert salted_lookup(left.limit(0), right, ["k"]).count() == 0


def test_trimmed(spark):
    df = spark.createDataFrame([("　 a b \n",), (None,)], "x string")
    assert [r[0] for r in df.select(trimmed(F.col("x"))).collect()] == ["a b", None]
