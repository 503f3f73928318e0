import os

from spanforge import session
from spanforge.streaming.replay import replayed


def test_stored_tables_are_removed_on_request(spark):
    df = session.stored(spark.range(5).toDF("k"), "t")
    path = df.inputFiles()[0].removeprefix("file://")
    assert df.count() == 5 and os.path.exists(path)
    mine = [p for p in session._made if path.startswith(p.removeprefix("file://"))]
    assert len(mine) == 1
    session.discard(*mine)
    assert not os.path.exists(path) and not set(mine) & session._made


def test_a_replay_keeps_only_what_its_query_wrote(spark):
    out = replayed(spark.range(20).toDF("t"), "t", lambda s: s, slices=2)
    base = out.inputFiles()[0].removeprefix("file://").split("/out/")[0]
    assert out.count() == 20 and os.listdir(base) == ["out"]


def test_slices_follow_the_bytes(spark, monkeypatch):
    from pyspark.sql import functions as F

    from spanforge.streaming import replay as R

    monkeypatch.setattr(R, "SLICE_BYTES", 400)
    df = spark.range(400).select(F.col("id").alias("t"))
    out = R.replayed(df, "t", lambda s: s.select("t", F.current_timestamp().alias("at")))
    assert out.select("at").distinct().count() > R.LEAST_SLICES
