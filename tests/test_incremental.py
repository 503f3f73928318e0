import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_deliveries_without_time_have_survivors(spark, tmp_path):
    m = spark.read.parquet(f"{DATA}/wire_messages.parquet")
    m.selectExpr(*(c if c != "received_at" else "if(delivery_id % 3 = 0, null, received_at) AS received_at" for c in m.columns)).write.parquet(f"{tmp_path}/wire_messages.parquet")
    got, want = ([r[0] for r in entry.queries()[q](spark, str(tmp_path)).collect()] for q in ("p7_incremental", "p7_kept"))
    assert sorted(got) == sorted(want)
