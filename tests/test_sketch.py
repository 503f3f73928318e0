from pyspark.sql import functions as F

from spanforge.operators import sketch


def data(spark, n):
    return spark.range(n).select((F.col("id") % 3).alias("g"), (F.col("id") % (n // 2)).alias("v"), F.lit("x").alias("bits"), F.lit(1).alias("row"))


def test_estimates_lie_within_their_bounds(spark):
    for n in (60, 3000, 90_000):
        df = data(spark, n)
        est = sketch.estimate(sketch.bit_rows(df, ["g"], {"v": F.col("v")}), ["g"])
        exact = {r.g: r.n for r in df.groupBy("g").agg(F.count_distinct("v").alias("n")).collect()}
        for r in est.collect():
            assert abs(r.estimate - exact[r.g]) <= 5 * r.std_error + 1
            assert r.low <= r.estimate <= r.high


def test_merged_partial_sketches_equal_the_sketch_of_all(spark):
    df = data(spark, 3000)
    parts = sketch.bit_rows(df.withColumn("part", F.col("v") % 7), ["g", "part"], {"v": F.col("v")})
    merged = sketch.merge(parts, ["g"])
    whole = sketch.bit_rows(df, ["g"], {"v": F.col("v")})
    assert merged.exceptAll(whole).count() == 0 and whole.exceptAll(merged).count() == 0


def test_relative_error_is_the_stated_one(spark):
    one = spark.range(200_000).select(F.lit(1).alias("g"), F.col("id").alias("v"))
    r = sketch.estimate(sketch.bit_rows(one, ["g"], {"v": F.col("v")}), ["g"]).first()
    assert abs(r.std_error / r.estimate - 0.649 / 32) < 0.002


def test_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (2, None), (None, "b")], "g int, v string")
    got = {r.g: round(r.estimate) for r in sketch.estimate(sketch.bit_rows(df, ["g"], {"v": F.col("v")}), ["g"]).collect()}
    assert got == {1: 1, None: 1}
    assert sketch.estimate(sketch.bit_rows(df.limit(0), ["g"], {"v": F.col("v")}), ["g"]).count() == 0
