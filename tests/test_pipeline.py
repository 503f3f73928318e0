import gzip
import ipaddress
import json
import random

import pytest
from pyspark.sql import functions as F

from spanforge.functions import misc, sql, tokens
from spanforge.operators import transactions as T
from spanforge.options import Options
from spanforge.sources import chunks as C
from spanforge.sources import ingest
from spanforge.sources.decode import fields, frames
from spanforge.sources.decode.auto import AutoStream
from spanforge.streaming.decode import messages_stream, walk
from spanforge.streaming.replay import replayed

KEY = tokens.TEST_KEY


def test_chunks_become_transactions(spark):
    q = b"POST /a?token=abc HTTP/1.1\r\nHost: h\r\nX-User-Id: u9\r\nContent-Length: 25\r\n\r\nmail bob@corp.example ok!"
    r = b"HTTP/1.1 100 Continue\r\n\r\nHTTP/1.1 201 Created\r\nContent-Length: 2\r\n\r\nok"
    rows = [("c1", 0, k, d) for k, d in enumerate((q[:30], q[30:] + b"GET /b HTTP/1.1\r\nHost: h\r\n\r\n"))] + [("c1", 1, 0, r), ("c2", 0, 0, b"GET /c HTTP/1.1\r\n\r\n")]
    df = spark.createDataFrame([(c, d, k, p, False) for c, d, k, p in rows], "conn string, direction byte, k int, payload binary, cut boolean")
    m = C.decode(df, ["k"]).withColumns({"ms": F.lit(1000) + F.col("direction") * 50 + F.col("n"), "seq": F.col("n"), "cgroup_id": F.lit(1).cast("long"), "source_ip": F.lit("10.0.0.1"), "dest_ip": F.lit("10.0.0.2"), "source_port": F.lit(1), "dest_port": F.lit(2), "comm": F.lit("nginx\0x")})
    closed = spark.createDataFrame([("c2",)], "conn string")
    t = T.transactions(T.paired(m), KEY, 10_000_000, closed)
    dim = spark.createDataFrame([(1, "c", "pod", "shop", "n")], "cgroup_id long, container_id string, pod_name string, pod_namespace string, node_name string")
    dns = spark.createDataFrame([("10.0.0.2", "srv", None)], "ip string, hostname string, resolved_at timestamp")
    got = {x.req_path.split("?")[0]: x for x in T.enriched(t, dim, dns, ["shop"]).collect()}
    a, b, c = got["/a"], got["/b"], got["/c"]
    assert (a.resp_status, a.resp_latency_ms, a.outcome, a.user_id, a.process_name, a.pod_namespace, a.dest_hostname, a.source_hostname) == (201, 51, None, "u9", "nginx", "shop", "srv", None)
    assert "abc" not in a.req_path and "bob" not in a.req_body and a.req_body.endswith("ok!") and a.resp_body == "ok"
    assert (b.resp_status, b.resp_latency_ms, b.outcome) == (0, None, "no_response_observed") and c.outcome == "connection_closed"


def test_records_and_framed_columns(spark):
    raw = frames.CHUNK.pack(1, 42, 43, 4096, 5, 1, 4, b"nginx\0\0", 7, 1, 43210, 443, b"", b"", b"", b"", 2, 1, 5, 5, 0, 9, 0, 1, 2, 1, 8) + b"hello"
    assert [(r.pid, r.payload) for r in C.read_records(spark.createDataFrame([(raw,), (b"x",)], "record binary")).collect()] == [(42, b"hello")]
    df = spark.createDataFrame([(b"\0\0\0\0\x02\x08\x01",), (None,)], "b binary")
    assert [r.f for r in df.select(C.grpc("b").alias("f")).collect()][0][0].value == "1"
    assert df.select(C.websocket("b").alias("f")).count() == 2


def test_decoder_walks_over_gaps_and_repeats():
    q = b"GET /a HTTP/1.1\r\nHost: h\r\n\r\n"
    last, skipping, out = walk(("c", 0), AutoStream(), None, False, iter([(0, 1, q, False), (0, 1, q, False), (1, 2, q[:9], False), (3, 3, b"rest", False), (4, 4, q, False), (5, 5, b"junk\r\n\r\n", False), (6, 6, q, True)]))
    assert [(r[4], r[-1]) for r in out] == [("/a", None), ("/a", None), (None, "first line"), ("/a", None)] and last == 6 and skipping


def test_streamed_decoding(spark):
    r = random.Random(1)
    rows, want = [], set()
    for c in range(6):
        data = b"".join(f"GET /c{c}/{k} HTTP/1.1\r\nContent-Length: 3\r\n\r\nabc".encode() for k in range(5))
        want |= {f"/c{c}/{k}" for k in range(5)}
        at = sorted(r.sample(range(1, len(data)), 7))
        rows += [(f"c{c}", 0, k, 1_740_960_000_000 + k * 1000, data[a:b], False) for k, (a, b) in enumerate(zip([0, *at], [*at, len(data)]))]
    df = spark.createDataFrame(rows, "conn string, direction byte, seq long, ms long, payload binary, cut boolean")
    got = replayed(df, "ms", messages_stream, slices=3).collect()
    assert {x.target for x in got} == want and len(got) == len(want) and all(x.body == b"abc" for x in got)


def test_ingest(spark):
    body = json.dumps({"MsgHeader": {}, "Batch": []}).encode()
    cases = [(1, body), (2, gzip.compress(body)), (3, gzip.compress(body)[:-12]), (4, b"\x1f\x8bxx"), (5, b""), (6, None), (7, b"{"), (8, gzip.compress(b"x" * 100_000))]
    df = spark.createDataFrame(cases, "k int, content binary")
    got = {r.k: r.reason for r in ingest.bodies(df, most=50_000).collect()}
    assert got == {1: "MsgHeader missing Version", 2: "MsgHeader missing Version", 3: "truncated gzip", 4: "invalid gzip", 5: "empty body", 6: "empty body", 7: "invalid JSON", 8: "body too large"}
    assert ingest.events(ingest.bodies(df)).count() == 0


def test_options():
    ok = {"url": "https://r", "token_key": KEY, "namespaces": ("a",)}
    assert Options(**ok).batch_events == 200 and Options(**ok | {"url": "http://r"}, allow_http=True)
    for bad in ({"url": "http://r"}, {"token_key": ""}, {"namespaces": ()}, {"batch_bytes": 10}, {"sample_rate": 101}):
        with pytest.raises(ValueError):
            Options(**ok | bad)


def test_sql_names_and_addresses(spark):
    assert "host_name" in sql.register(spark)
    r = spark.sql("SELECT target_path('/a?b') p, target_query('/a?b=1') q, host_name('H.X.:80') h, instant_ms(1740961572979543171) m, is_truncated(0, 5, 3) t, drop_rate_bps(1, 3) d, is_interim(101) i").first()
    assert tuple(r) == ("/a", "b=1", "h.x", 1740961572979, True, 3333, False)
    for a in ("::1", "::", "fe80::1", "2001:db8::ff00:42:8329", "2001:db8:0:1:1:1:1:1", "1:0:0:2:0:0:0:3", "1:2:3:4:5:6:7:8", "1::"):
        h = ipaddress.ip_address(a).exploded.replace(":", "")
        assert spark.createDataFrame([(h,)], "h string").select(misc.ipv6(F.col("h")).alias("r")).first().r == str(ipaddress.ip_address(a))


def test_versions_are_told_by_the_first_bytes():
    q = frames.PREFACE + frames.h2_frame(frames.HEADERS, 5, 1, fields.hpack_encode([(":method", "GET"), (":path", "/x"), (":authority", "h")]))
    r = frames.h2_frame(frames.SETTINGS, 0, 0, b"") + frames.h2_frame(frames.HEADERS, 4, 1, fields.hpack_encode([(":status", "200")])) + frames.h2_frame(frames.DATA, 1, 1, b"ok")
    one = b"PUT /p HTTP/1.1\r\nContent-Length: 0\r\n\r\n"
    for data, want in ((q, ("GET", "/x", None)), (r, (None, None, 200)), (one, ("PUT", "/p", None))):
        for k in range(len(data)):
            s = AutoStream()
            (m,) = s.feed(data[:k]) + s.feed(data[k:])
            assert (m.method, m.target, m.status) == want and m.complete
    s = AutoStream()
    s.feed(r[:-5])
    assert [m.complete for m in s.end()] == [False]
    s.resync()
    assert not s.resumable and s.feed(r) == []
    s = AutoStream()
    assert s.feed(b"PR") == [] and s.end() == []
