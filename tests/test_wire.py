import json
import random

from pyspark.sql import functions as F

from spanforge.operators import enrich, metrics, order, wire
from spanforge.streaming import sinks


def test_packing_equals_a_fold(spark):
    r = random.Random(4)
    rows = [(r.choice("ab"), k, r.choice([1, 10, 50, 99, 100, 101])) for k in range(300)]
    got = {x.k: x.batch for x in wire.pack(spark.createDataFrame(rows, "g string, k int, size int"), ["g"], ["k"], "size", 5, 100).collect()}
    want = {}
    for g in "ab":
        batch = n = total = 0
        for _, k, s in sorted(x for x in rows if x[0] == g):
            if s > 100:
                want[k] = None
                continue
            if n and total + s > 100:
                batch, n, total = batch + 1, 0, 0
            want[k] = batch
            n, total = n + 1, total + s
            if n >= 5 or total >= 100:
                batch, n, total = batch + 1, 0, 0
    assert got == want
    assert wire.pack(spark.createDataFrame([], "g string, k int, size int"), ["g"], ["k"], "size").count() == 0


def good():
    event = {k: 1 if t == "int" else {} if t == "dict" else "x" for k, t in wire.EVENT_FIELDS.items()} | {"L7Protocol": "GRPC"}
    return {"MsgHeader": {k: 1 if t == "int" else "x" for k, t in wire.HEADER_FIELDS.items()}, "Batch": [event]}


def test_validation(spark):
    def why(change):
        o = good()
        change(o)
        return spark.createDataFrame([(json.dumps(o),)], "b string").transform(lambda d: wire.rejected(d, F.col("b"), "r")).first().r

    assert why(lambda o: None) is None
    assert why(lambda o: o.pop("MsgHeader")) == "missing MsgHeader" and why(lambda o: o.update(Batch=[])) == "Batch is empty" and why(lambda o: o.update(Batch={})) == "Batch must be a list"
    assert why(lambda o: o["MsgHeader"].update(Sequence=True)) == "MsgHeader.Sequence must be int" and why(lambda o: o["MsgHeader"].pop("TenantId")) == "MsgHeader missing TenantId"
    assert why(lambda o: o["Batch"][0].pop("Id")) == "missing Id" and why(lambda o: o["Batch"][0].update(APIID=True)) == "APIID must be int" and why(lambda o: o["Batch"][0].update(L7Protocol="SMTP")) == "unknown L7Protocol"
    assert why(lambda o: o["Batch"].append(3)) == "event must be an object"
    got = [r.r for r in spark.createDataFrame([("{",), ("[]",), ('{"events":[]}',), ("",), (None,)], "b string").transform(lambda d: wire.rejected(d, F.col("b"), "r")).collect()]
    assert got == ["invalid JSON", "envelope must be an object", "legacy schema", "invalid JSON", "invalid JSON"]


def test_envelopes_pass_validation(spark):
    t = spark.createDataFrame([(1, 5, None, "GET", "/a?b=1", "h", "https", {"x": "1", "host": "h"}, {}, "body", 200, 3, None, "u", None, None, None, "HTTP/2", None, None, None, None, "incoming", 1_740_961_572_979)],
        "txn_id long, batch long, x int, req_method string, req_path string, req_host string, req_scheme string, req_headers map<string,string>, req_query map<string,string>, req_body string, resp_status int, resp_latency_ms long, outcome string, user_id string, user_role string, session_id string, auth_session_id string, protocol string, source_ip string, dest_ip string, source_port int, dest_port int, direction string, ts_ns long")
    w = wire.wire_rows(t).withColumn("batch", F.lit(0))
    e = wire.envelopes(w.drop("txn_id"), "batch", F.lit("t"), F.lit("p"), F.lit(1_740_961_572_979))
    r = wire.rejected(e.select("envelope"), F.col("envelope"), "r").first()
    assert r.r is None
    o = json.loads(r.envelope)
    assert o["Batch"][0]["HTTPReq.Uri"] == "/a" and o["Batch"][0]["HTTPReq.Query"] == "b=1" and o["Batch"][0]["Req.Header.extra"] == '{"x":"1"}' and o["Batch"][0]["user_role"] == "unknown"


def test_delivery():
    def tries(*answers):
        left, waits = list(answers), []
        out = sinks.send("{}", "u", lambda *_: left.pop(0), waits.append)
        return out[:2], len(left), waits

    assert tries((200, "", None)) == ((True, 1), 0, [])
    got, _, waits = tries((503, "", 2.0), (None, "refused", None), (200, "", None))
    assert got == (True, 3) and waits[0] == 2.0 and 0 <= waits[1] <= 10
    assert tries((500, "e", None))[0] == (False, 1) and tries((0, "timeout", None))[0] == (False, 1)
    assert tries(*[(429, "", None)] * 3)[0] == (False, 3)
    assert sinks.encode("x" * 5000)[1]["content-encoding"] == "gzip" and "content-encoding" not in sinks.encode("x")[1]


def test_scope_fails_closed_and_second_entries_do_not_multiply(spark):
    dim = spark.createDataFrame([(1, "c1", "p", "shop", "n"), (1, "c0", "p", None, "n"), (2, "c2", "p", None, "n"), (None, "c3", "p", "shop", "n")], "cgroup_id long, container_id string, pod_name string, pod_namespace string, node_name string")
    rows = spark.createDataFrame([(1, 10), (2, 11), (3, 12), (None, 13)], "cgroup_id long, k int")
    assert [r.k for r in enrich.in_scope(rows, dim, ["shop"]).collect()] == [10]
    assert {(r.k, r.container_id) for r in enrich.with_container(rows, dim).collect()} == {(10, "c1"), (11, "c2"), (12, None), (13, None)}


def test_orders_and_counters(spark):
    df = spark.createDataFrame([("a", k, v) for k, v in enumerate([1, 1, 0, 1, 0, 0, 1])], "g string, k int, f int")
    assert sorted((r.length, r.first, r.last) for r in order.streaks(df, ["g"], ["k"], F.col("f") == 1).collect()) == [(1, 4, 4), (1, 7, 7), (2, 1, 2)]
    many = [(r.choice("ab"), k, int(r.random() < 0.8)) for r in [random.Random(6)] for k in range(3000)]
    want = []
    for g in "ab":
        length = 0
        place = [f for x, _, f in many if x == g]
        for n, f in enumerate([*place, 0], 1):
            if f:
                length += 1
            elif length:
                want.append((g, length, n - length, n - 1))
                length = 0
    got = order.streaks(spark.createDataFrame(many, "g string, k int, f int").repartition(3), ["g"], ["k"], F.col("f") == 1)
    assert sorted((r.g, r.length, r.first, r.last) for r in got.collect()) == sorted(want)
    assert {(r.k, r.missing) for r in order.gaps(spark.createDataFrame([(1, 0), (1, 1), (1, 5)], "g int, k int"), ["g"], "k").collect()} == {(5, 3)}
    assert [r.line for r in metrics.exposition(metrics.counters(df, {"f": F.col("f") == 1})).collect()] == ["engine_f 4"]
