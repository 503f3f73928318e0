"""body_preview and http3_headers against brute force on a fixture of all kinds of rows."""

import __spark_entry__ as entry


def test_previews_of_all_texts(spark, tmp_path):
    texts = [None, "", "a", "é", "x" * 9000, "é" * 4096, "x" + "é" * 5000, "xy" + "語" * 3000, "😀" * 3000, "xyz" + "😀" * 3000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for k, t in enumerate(texts):
        p = (t or "").encode()[:8192].decode("utf-8", "replace")
        want[k] = (len(p), p or None)
    assert {r.doc_id: (r.n, r.preview) for r in entry.queries()["body_preview"](spark, str(tmp_path)).collect()} == want


def test_fields_of_all_paths(spark, tmp_path):
    paths = [None, "/", "/é", *("/" + "p" * (n - 1) for n in (55, 58, 60, 61, 121, 126, 127, 128, 254, 255, 256, 5000, 16_370, 16_380, 40_000)), "/" + "ü語😀" * 400]
    spark.createDataFrame(list(enumerate(paths)), "txn_id long, req_path string").selectExpr("txn_id", "txn_id AS delivery_id", "req_path").write.parquet(f"{tmp_path}/transactions.parquet")
    got = {r.txn_id: (r.method, r.scheme, r.path) for r in entry.queries()["http3_headers"](spark, str(tmp_path)).collect()}
    assert got == {k: ("POST", "https", p or "/") for k, p in enumerate(paths)}
