import random

from pyspark.sql import functions as F

from spanforge.operators import tree

SCHEMA = "id long, host string, path string, status int, ms long, n string, _chunk string"


def run(df, **kw):
    return tree.tree_aggregate(df, ["host", "path"], "id", F.col("status") >= 400, F.col("ms"), **kw)


def rows(n=400, seed=1):
    r = random.Random(seed)
    out = []
    for k in range(n):
        host = r.choice(["hot"] * 6 + ["a", "b", None])
        out += [(k, host, r.choice(["/x", "/y", None]), r.choice([200, 404, None]), r.choice([None, 0, 1, 7, 1000 + k]), "clash", "clash")] * r.choice([1, 2])
    return out


def test_against_brute_force_for_several_trees(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    want = {}
    for _, host, path, status, ms, *_ in {d[0]: d for d in data}.values():
        w = want.setdefault((host, path), [0, 0, 0, 0])
        w[0] += 1
        w[1] += int(status is not None and status >= 400)
        w[2] += ms is not None
        w[3] += ms or 0
    for kw in ({}, {"fan_in": 2}, {"fan_in": 3}):
        got = {(r.host, r.path): [r.n, r.errors, r.timed, r.latency_sum] for r in run(df, **kw).collect()}
        assert got == want


def test_rounds():
    assert [tree.rounds(c, 8) for c in (1, 8, 9, 64, 65, 512, 513)] == [1, 1, 2, 2, 3, 3, 4]


def test_a_hot_key_leaves_each_chunk_as_a_few_states(spark):
    """However many rows a key has, the first shuffle gets its states of one chunk."""
    df = spark.range(40_000).select("id", F.lit("hot").alias("host"), F.lit("/").alias("path"), F.lit(200).alias("status"), (F.col("id") % 3).alias("ms"))
    plan = run(df)._jdf.queryExecution().toString()
    assert plan.count("spark_partition_id") or plan.count("SPARK_PARTITION_ID")
    r = run(df).collect()
    assert len(r) == 1 and r[0].n == 40_000 and len(r[0].hist) == 3


def test_heavy_keys_count_rows_without_key_in_the_total(spark):
    data = [(k, "h" if k < 10 else None, "/p", 200, 1, "", "") for k in range(1000)] + [(2000, "rare", "/p", 200, 1, "", "")]
    s = run(spark.createDataFrame(data, SCHEMA))
    assert tree.heavy_keys(s, ["host", "path"]).count() == 0
    assert [r.host for r in tree.heavy_keys(s, ["host", "path"], 0.9).collect()] == ["h"]


def test_quantiles_are_within_a_bin(spark):
    df = spark.range(1, 1001).select("id", F.lit("h").alias("host"), F.lit("/").alias("path"), F.lit(200).alias("status"), F.col("id").alias("ms"))
    r = run(df).select(tree.quantile(F.col("hist"), F.col("timed"), 0.5).alias("q"), tree.quantile(F.col("hist"), F.col("timed"), 0.99).alias("p")).first()
    assert 500 <= r.q <= 500 * 1.1 and 990 <= r.p <= 990 * 1.1


def test_empty_and_missing_ids(spark):
    assert run(spark.createDataFrame([], SCHEMA)).count() == 0
    assert run(spark.createDataFrame([(None, "h", "/", 200, 1, "", "")], SCHEMA)).count() == 0
    assert tree.heavy_keys(run(spark.createDataFrame([], SCHEMA)), ["host", "path"]).count() == 0
