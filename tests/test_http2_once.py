"""Pairing decodes its chunks once, and in its one pass gives what the rules of streams, resets, goaways and order ask for."""

import random
from collections import Counter

import pytest

import __spark_entry__ as entry
from spanforge.operators import transactions as T
from spanforge.sources.decode import fields


def test_query_decodes_once(spark, tmp_path):
    rows = [(k, k + 1, p) for k, p in enumerate(["/a", "/b/ü", "/" + "x" * 300, "/a"] * 50)]
    spark.createDataFrame(rows, "txn_id long, delivery_id long, req_path string").write.parquet(str(tmp_path / "transactions.parquet"))
    df = entry.queries()["http2_pairing"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") + plan.count("MapInPandas") == 1 and plan.count("Exchange hashpartitioning(conn") == 2
    assert Counter(map(tuple, df.collect())) == Counter(x for t, d, p in rows for x in ((t, d, p + "#1", 200), (t, d, p + "#5", 404)))


def _model(rows):
    """(request, response) by their numbers, said step by step."""
    out = []
    for conn in {r["conn"] for r in rows}:
        own = sorted((r for r in rows if r["conn"] == conn), key=lambda r: (r["ms"], r["seq"]))
        asked, answers = [r for r in own if r["method"]], [r for r in own if r["status"] and r["status"] != 100 and conn]
        waiting, pairs = [], {}
        for r in own:
            if r["stream"] is None and r["method"]:
                waiting.append(r["seq"])
                pairs[r["seq"]] = None
            elif r["stream"] is None and r in answers and waiting:
                pairs[waiting.pop(0)] = r["seq"]
        for q in {r["stream"]: r for r in asked if r["stream"]}.values():  # the last one of a stream
            a = next((r for r in reversed(answers) if r["stream"] == q["stream"]), None)
            when = lambda r: (r["ms"], r["seq"])
            ends = [r for r in own if conn and (r["event"] == "reset" and r["stream"] == q["stream"] or r["event"] == "goaway" and r["stream"] < q["stream"] and when(r) >= when(q))]
            if not any(a is None or when(e) < when(a) for e in ends):
                pairs[q["seq"]] = a["seq"] if a else None
        out += pairs.items()
    return Counter(out)


@pytest.mark.parametrize("seed", (1, 2))
def test_pairs_as_the_rules_say(spark, seed):
    r, rows = random.Random(seed), []
    for c in range(300):
        kind = r.choice(("streams", "order", "both"))
        for _ in range(r.randint(1, 12)):
            what = r.choice(("q", "q", "q", "r", "r", "r", "reset", "goaway"))
            stream = None if kind == "order" or kind == "both" and what in "qr" and r.random() < 0.5 else r.choice((1, 3, 5, 7))
            if stream or what in "qr":
                rows.append({"conn": f"c{c}" if c else None, "ms": r.randint(1, 5), "seq": len(rows), "method": "GET" if what == "q" else None, "status": r.choice((100, 200, 404)) if what == "r" else None, "stream": stream, "event": what if len(what) > 1 else None})
    df = spark.createDataFrame([tuple(x.values()) for x in rows], "conn string, ms long, seq long, method string, status int, stream int, event string")
    df = df.selectExpr("*", "if(method is null, null, '/') AS target", "map('n', string(seq)) AS headers", "cast(string(seq) AS binary) AS body", "1L AS body_total", *(f"'x' AS {n}" for n in T.NET))
    got = Counter((int(x.q_headers["n"]), int(x.r_headers["n"]) if x.r_headers else None) for x in T.paired(df).collect())
    assert got == _model(rows)


def test_packed_strings_bit_by_bit():
    def slow(data):
        out, code, n = bytearray(), 0, 0
        for byte in data:
            for bit in range(7, -1, -1):
                code, n = code << 1 | byte >> bit & 1, n + 1
                if (s := fields.HUFFMAN.get((n, code))) is not None:
                    if s == 256:
                        return None
                    out.append(s)
                    code = n = 0
        return bytes(out) if n < 8 and code == (1 << n) - 1 else None

    r = random.Random(3)
    for _ in range(3000):
        data = r.choice((r.randbytes(r.randint(0, 9)), fields.huffman_encode(r.randbytes(r.randint(0, 70))), b"\xff" * r.randint(0, 5)))
        try:
            got = fields.huffman_decode(data)
        except fields.Malformed:
            got = None
        assert got == slow(data)
