"""Queries of captured bytes as they come: streamed pairing and decoding, transactions built from bytes, ingest and delivery."""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.functions import labels, misc, tokens
from spanforge.functions.normal import epoch_ms
from spanforge.operators import metrics, order, transactions, wire
from spanforge.plans.reference import FIFO_SQL, MS, _bytes, _h3_bytes, _heads, _ws_bytes
from spanforge.plans.registry import Registry
from spanforge.sources import chunks, ingest
from spanforge.sources.decode import frames
from spanforge.sources.tables import table
from spanforge.streaming import sinks
from spanforge.streaming.decode import messages_stream
from spanforge.streaming.pairing import pair_stored
from spanforge.streaming.replay import replayed

registry = Registry()
query = registry.query
#: Connections over which the messages of a stream are laid.
CONNS = 200


# ---------------------------------------------------------------- pairing

@query("stream_fifo", FIFO_SQL + "SELECT user_id, request_id, response_id, CAST(latency_ms AS BIGINT) AS latency_ms FROM p WHERE response_id IS NOT NULL UNION ALL SELECT user_id, NULL, event_id, NULL FROM u WHERE unpaired")
def stream_fifo(spark, d):
    """Pairs and unpaired responses by the state of each connection, without time to live; the query stops and goes on from its checkpoint between slices."""
    kind = F.when(F.col("event_type").isin("view", "click"), "request").when(F.col("event_type").isin("purchase", "error"), "response")
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("conn"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), F.col("event_id").alias("seq"), kind.alias("kind"), F.col("event_id").alias("id"))
    p = pair_stored(e, ttl_ms=10**12, most=10**9)
    return p.where("response_id is not null").select(F.col("conn").cast("long").alias("user_id"), "request_id", "response_id", "latency_ms")


EXPIRY_SQL = """
WITH q AS (SELECT *, epoch_us(ts) // 1000 AS ms FROM events WHERE event_type = 'view'), c AS (SELECT *, epoch_us(ts) // 1000 AS ms FROM events WHERE event_type = 'signup'),
n AS (SELECT q.event_id, q.ms, min(c.ms) AS closed FROM q LEFT JOIN c ON c.user_id = q.user_id AND (c.ms, c.event_id) > (q.ms, q.event_id) GROUP BY ALL), z AS (SELECT max(ms) AS now FROM (SELECT ms FROM q UNION ALL SELECT ms FROM c))
SELECT event_id, CASE WHEN closed < ms + 3600000 THEN 'connection_closed' WHEN ms + 3600000 <= now THEN 'no_response_observed' ELSE 'sensor_shutdown' END AS outcome FROM n, z
"""


@query("stream_expiry", EXPIRY_SQL)
def stream_expiry(spark, d):
    """Requests that nothing answers leave the state: by a close, by the time to live, or when the stream ends."""
    kind = F.when(F.col("event_type") == "view", "request").when(F.col("event_type") == "signup", "close")
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("conn"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), F.col("event_id").alias("seq"), kind.alias("kind"), F.col("event_id").alias("id"))
    return pair_stored(e, ttl_ms=3_600_000, most=10**9).select(F.col("request_id").alias("event_id"), "outcome")


# ---------------------------------------------------------------- decoding

def _laid(spark: SparkSession, d: str) -> DataFrame:
    """All requests one behind the other on ``CONNS`` connections, each in two chunks, cut at a place its number tells."""
    h = _heads(spark, d).where("head is not null").withColumn("b", F.encode("head", "UTF-8"))
    at = F.row_number().over(Window.partitionBy(F.col("txn_id") % CONNS).orderBy("txn_id", "delivery_id"))
    h = h.withColumn("at", at).withColumn("cut", (F.lit(10) + F.col("txn_id") % (F.octet_length("b") - 11)).cast("int"))
    parts = F.array(F.struct(F.lit(0).alias("k"), F.substring("b", F.lit(1), F.col("cut")).alias("payload")), F.struct(F.lit(1).alias("k"), F.expr("substring(b, cut + 1, octet_length(b))").alias("payload")))
    p = h.select("txn_id", (F.col("txn_id") % CONNS).cast("string").alias("conn"), "at", F.explode(parts).alias("p")).select("txn_id", "conn", "at", "p.*")
    seq = (F.col("at") * 2 + F.col("k")).cast("long")
    return p.select("txn_id", "conn", F.lit(0).cast("byte").alias("direction"), seq.alias("seq"), (F.lit(1_740_960_000_000) + seq).alias("ms"), "payload", F.lit(False).alias("cut"), "k")


def _streamed(c: DataFrame) -> DataFrame:
    return replayed(c.select("conn", "direction", "seq", "ms", "payload", "cut"), "ms", messages_stream)


STREAM_SQL = "SELECT CAST(txn_id % 200 AS VARCHAR) AS conn, req_method AS method, req_path AS target, CAST(coalesce(strlen(req_body), 0) AS BIGINT) AS body_total FROM transactions"


@query("stream_decode", STREAM_SQL)
def stream_decode(spark, d):
    """Messages reassembled from a stream of chunks, the decoder's state kept between micro-batches."""
    return _streamed(_laid(spark, d)).where("complete").select("conn", "method", "target", "body_total")


@query("stream_gaps", STREAM_SQL + " WHERE txn_id % 7 <> 0")
def stream_gaps(spark, d):
    """The same with the second chunk of every seventh request lost: that message is given up, and reading goes on at the next start."""
    return _streamed(_laid(spark, d).where("not (txn_id % 7 = 0 and k = 1)")).where("complete").select("conn", "method", "target", "body_total")


@query("stream_gap_reports", "SELECT CAST(count(*) > 0 AS BOOLEAN) AS reported, true AS partial FROM transactions WHERE txn_id % 7 = 0 AND req_body IS NOT NULL")
def stream_gap_reports(spark, d):
    """Messages that a gap ended leave as partial, with the reason."""
    m = _streamed(_laid(spark, d).where("not (txn_id % 7 = 0 and k = 1)")).where("problem = 'gap'")
    return m.agg((F.count(F.lit(1)) > 0).alias("reported"), F.coalesce(F.bool_and(~F.col("complete")), F.lit(True)).alias("partial"))


@query("stream_websocket", "SELECT CAST(txn_id % 200 AS VARCHAR) AS conn, 'text' AS opcode, CAST(strlen(req_path) AS BIGINT) AS length, req_path AS text FROM transactions")
def stream_websocket(spark, d):
    """Connections that begin with a request for a WebSocket: all that follows is read as frames, however the chunks cut them."""
    t = _bytes(spark, d, _ws_bytes, ["req_path"]).withColumn("conn", (F.col("txn_id") % CONNS).cast("string"))
    t = t.withColumn("at", F.row_number().over(Window.partitionBy("conn").orderBy("txn_id", "delivery_id")))
    cut = (F.col("txn_id") % F.octet_length("bytes")).cast("int")
    t = t.withColumn("cut_at", cut)
    parts = F.array(F.struct(F.lit(0).alias("k"), F.substring("bytes", F.lit(1), F.col("cut_at")).alias("payload")), F.struct(F.lit(1).alias("k"), F.expr("substring(bytes, cut_at + 1, octet_length(bytes))").alias("payload")))
    body = t.select("conn", F.explode(parts).alias("p"), "at").select("conn", (F.col("at") * 2 + F.col("p.k")).cast("long").alias("seq"), F.col("p.payload").alias("payload"))
    head = t.select("conn").distinct().select("conn", F.lit(1).cast("long").alias("seq"), F.encode(F.lit("GET /chat HTTP/1.1\r\nHost: h\r\nConnection: Upgrade\r\nUpgrade: websocket\r\n\r\n"), "UTF-8").alias("payload"))
    c = head.unionByName(body).select("conn", F.lit(0).cast("byte").alias("direction"), "seq", (F.lit(1_740_960_000_000) + F.col("seq")).alias("ms"), "payload", F.lit(False).alias("cut"))
    return _streamed(c).where("event is not null").select("conn", F.col("event").alias("opcode"), F.col("body_total").alias("length"), F.col("body").cast("string").alias("text"))


def _early(txn):
    out = frames.h2_frame(frames.SETTINGS, 0, 0, b"")
    if txn % 2:
        out += frames.h2_frame(frames.PING, 0, 0, b"12345678")
    return out + frames.h2_frame(frames.HEADERS, 4, 1, b"\x88") if txn % 3 == 0 else out


@query("early_server_frames", "SELECT txn_id, delivery_id, txn_id % 3 <> 0 AS early FROM transactions")
def early_server_frames(spark, d):
    """Whether bytes are only frames that a server sends before the preface is seen."""
    t = table(spark, d, "transactions").select("txn_id", "delivery_id")
    early = F.pandas_udf(lambda s: s.map(lambda n: frames.early_server_frames(_early(n))), "boolean")
    return t.select("txn_id", "delivery_id", early("txn_id").alias("early"))


@query("http3_pairing", "SELECT txn_id, delivery_id, 'POST' AS method, coalesce(req_path, '/') AS target, 200 AS status FROM transactions")
def http3_pairing(spark, d):
    """Requests and responses in chunks of a QUIC provider, told by their frames and paired in order of the connection."""
    t = _bytes(spark, d, _h3_bytes, ["req_path"])
    answer = F.lit(bytearray(b"\x01\x03\0\0" + bytes([0xC0 | 25]) + b"\0\x02ok"))
    c = t.select(F.concat_ws("-", "txn_id", "delivery_id").alias("conn"), F.explode(F.array(F.struct(F.lit(0).cast("byte").alias("direction"), F.col("bytes").alias("payload")), F.struct(F.lit(1).cast("byte").alias("direction"), answer.alias("payload")))).alias("p")).select("conn", "p.*", F.lit(0).alias("k"), F.lit(False).alias("cut"), F.lit(True).alias("quic"))
    m = chunks.decode(c, ["k"]).withColumns({"ms": F.col("direction").cast("long"), "seq": F.col("direction").cast("long")} | {n: F.lit(None).cast("string") for n in transactions.NET})
    p = transactions.paired(m)
    part = F.split("conn", "-")
    return p.select(F.get(part, 0).cast("long").alias("txn_id"), F.get(part, 1).cast("long").alias("delivery_id"), F.col("q_method").alias("method"), F.col("q_target").alias("target"), F.col("r_status").alias("status"))


NO_BODY = (204, 304)


@query("built_transactions", f"""
WITH t AS (SELECT txn_id, delivery_id, req_method, req_host, {MS} AS ms, coalesce(resp_latency_ms, 0) AS latency, coalesce(resp_status BETWEEN 200 AND 599, false) AS answered, resp_status FROM transactions), n AS (SELECT max(ms) AS now FROM t)
SELECT txn_id, delivery_id, req_method, coalesce(req_host, 'none') AS req_host, CASE WHEN answered THEN resp_status ELSE 0 END AS resp_status, CASE WHEN answered THEN latency END AS resp_latency_ms,
 CASE WHEN answered THEN NULL WHEN now - ms >= 300000 THEN 'no_response_observed' ELSE 'sensor_shutdown' END AS outcome FROM t, n""")
def built_transactions(spark, d):
    """Transactions from bytes: chunks decoded, requests and responses paired, rows built."""
    h = _heads(spark, d)
    t = table(spark, d, "transactions").select("txn_id", "delivery_id", epoch_ms(F.col("ts_ns")).alias("at"), F.coalesce("resp_latency_ms", F.lit(0).cast("long")).alias("latency"), "resp_status")
    now = t.agg(F.max("at")).first()[0] or 0
    t = h.join(t, ["txn_id", "delivery_id"])
    text = F.concat(F.lit("HTTP/1.1 "), F.col("resp_status").cast("string"), F.lit(" x\r\n"), F.when(F.col("resp_status").isin(*NO_BODY), "\r\n").otherwise("Content-Length: 2\r\n\r\nok"))
    answer = F.when(F.col("resp_status").between(200, 599), F.encode(text, "UTF-8"))
    t = t.select(F.concat_ws("-", "txn_id", "delivery_id").alias("conn"), "at", "latency", F.explode(F.array(F.struct(F.lit(0).cast("byte").alias("direction"), F.encode("head", "UTF-8").alias("payload")), F.struct(F.lit(1).cast("byte").alias("direction"), answer.alias("payload")))).alias("p")).select("conn", "at", "latency", "p.*").where("payload is not null")
    m = chunks.decode(t.withColumns({"k": F.lit(0), "cut": F.lit(False)}), ["k"])
    times = t.where("direction = 0").select("conn", "at", "latency")
    m = m.join(times, "conn").withColumns({"ms": F.col("at") + F.when(F.col("direction") == 1, F.col("latency")).otherwise(0), "seq": F.col("direction").cast("long")} | {n: F.lit(None).cast("string") for n in transactions.NET})
    b = transactions.transactions(transactions.paired(m), tokens.TEST_KEY, now)
    part = F.split("conn", "-")
    return b.select(F.get(part, 0).cast("long").alias("txn_id"), F.get(part, 1).cast("long").alias("delivery_id"), "req_method", "req_host", "resp_status", "resp_latency_ms", "outcome")


def _h2_request(path, number):
    from spanforge.sources.decode import fields

    out = frames.PREFACE + frames.h2_frame(frames.SETTINGS, 0, 0, b"")
    method, host = fields.hpack_encode([(":method", "GET")]), fields.hpack_encode([(":authority", f"h{number}")])
    for stream in (1, 3, 5):
        block = method + fields.hpack_encode([(":path", f"{path or '/'}#{stream}")]) + host
        out += frames.h2_frame(frames.HEADERS, 5, stream, block)
    return out


def _h2_response():
    from spanforge.sources.decode import fields

    answer = lambda stream, status: frames.h2_frame(frames.HEADERS, 5, stream, fields.hpack_encode([(":status", status)]))
    return frames.h2_frame(frames.SETTINGS, 0, 0, b"") + answer(5, "404") + frames.h2_frame(frames.RST, 0, 3, b"\0\0\0\x08") + answer(1, "200")


@query("http2_pairing", "SELECT txn_id, delivery_id, req_path || '#1' AS target, 200 AS status FROM transactions UNION ALL SELECT txn_id, delivery_id, req_path || '#5', 404 FROM transactions")
def http2_pairing(spark, d):
    """Three requests of a connection, answered out of order and one of them reset: each answer joins its own stream, the reset one is left out."""
    t = table(spark, d, "transactions").select("txn_id", "delivery_id", "req_path")
    sent = F.pandas_udf(lambda a, b: pd.Series([_h2_request(x, y) for x, y in zip(a, b)]), "binary")("req_path", "txn_id")
    c = t.select(F.concat_ws("-", "txn_id", "delivery_id").alias("conn"), sent.alias("q"), F.lit(_h2_response()).alias("r"), "txn_id")
    # each side in two chunks, cut at a place the number tells
    side = lambda name, n: [F.struct(F.lit(n).cast("byte").alias("direction"), F.lit(k).alias("k"), F.expr(f"substring({name}, {'1, cast(txn_id % octet_length(' + name + ') as int)' if k == 0 else 'cast(txn_id % octet_length(' + name + ') as int) + 1'})").alias("payload")) for k in (0, 1)]
    c = c.select("conn", F.explode(F.array(*side("q", 0), *side("r", 1))).alias("p")).select("conn", "p.*", F.lit(False).alias("cut"))
    m = chunks.decode(c, ["k"]).withColumns({"ms": F.col("direction").cast("long"), "seq": F.col("n").cast("long")} | {n: F.lit(None).cast("string") for n in transactions.NET})
    part = F.split("conn", "-")
    return transactions.paired(m).select(F.get(part, 0).cast("long").alias("txn_id"), F.get(part, 1).cast("long").alias("delivery_id"), F.col("q_target").alias("target"), F.col("r_status").alias("status"))


@query("http1_chunked", "SELECT txn_id || '-' || delivery_id AS conn, CAST(coalesce(strlen(req_body), 0) AS BIGINT) AS body_total, CASE WHEN coalesce(strlen(req_body), 0) <= 8192 THEN coalesce(req_body, '') END AS body, true AS complete FROM transactions")
def http1_chunked(spark, d):
    """Bodies sent in chunks of thirty bytes with a trailer, the connection cut at a place its number tells."""
    def made(body, number):
        raw = (body or "").encode()
        parts = [raw[k : k + 30] for k in range(0, len(raw), 30)]
        return b"POST / HTTP/1.1\r\nTransfer-Encoding: chunked\r\n\r\n" + b"".join(b"%x;x=1\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\nx-sum: 1\r\n\r\n"

    t = _bytes(spark, d, made, ["req_body", "txn_id"]).withColumn("at", (F.col("txn_id") % F.octet_length("bytes")).cast("int"))
    parts = F.array(F.struct(F.lit(0).alias("k"), F.expr("substring(bytes, 1, at)").alias("payload")), F.struct(F.lit(1).alias("k"), F.expr("substring(bytes, at + 1)").alias("payload")))
    c = t.select(F.concat_ws("-", "txn_id", "delivery_id").alias("conn"), F.lit(0).cast("byte").alias("direction"), F.explode(parts).alias("p")).select("conn", "direction", "p.*", F.lit(False).alias("cut"))
    m = chunks.decode(c, ["k"])
    return m.select("conn", "body_total", F.when(F.col("body_total") <= 8192, F.col("body").cast("string")).alias("body"), "complete")


# ---------------------------------------------------------------- records, ingest, delivery

@query("record_decode", "SELECT chunk_id, pid, ssl_ptr, direction, split_part(comm, chr(0), 1) AS comm, flags FROM (SELECT DISTINCT * FROM chunks) WHERE abi_version = 2")
def record_decode(spark, d):
    """Captured records in their binary layout, written from the chunks and read again; the chunk's number is the payload."""
    def packed(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([frames.CHUNK.pack(0, r.pid, 0, r.ssl_ptr, 8, r.direction, 4, r.comm.encode()[:16], 0, 0, 0, 0, b"", b"", b"", b"", r.abi_version, r.flags, 8, 8, 0, 0, 0, 0, 0, 0, 0) + int(r.chunk_id).to_bytes(8, "big") for r in rows.itertuples()])

    c = table(spark, d, "chunks").distinct().select("chunk_id", "pid", "ssl_ptr", "direction", "comm", "abi_version", "flags")
    record = F.pandas_udf(lambda s: packed(s), "binary")(F.struct("chunk_id", "pid", "ssl_ptr", "direction", "comm", "abi_version", "flags"))
    r = chunks.read_records(c.select(record.alias("record")))
    return r.select(F.conv(F.hex("payload"), 16, 10).cast("long").alias("chunk_id"), "pid", "ssl_ptr", "direction", "comm", "flags")


def _content(n: int) -> bytes:
    good = b'{"MsgHeader":{}}'
    return (good, gzip.compress(good), gzip.compress(good)[:-12], b"\x1f\x8bxx", b"", b"[1]")[n % 6]


@query("ingest_bodies", "SELECT delivery_id, CASE delivery_id % 6 WHEN 2 THEN 'truncated gzip' WHEN 3 THEN 'invalid gzip' WHEN 4 THEN 'empty body' WHEN 5 THEN 'envelope must be an object' ELSE 'MsgHeader missing Version' END AS reason FROM wire_messages")
def ingest_bodies(spark, d):
    """Bodies as they reach the receiver, plain or compressed, whole or cut, and why each is refused."""
    content = F.pandas_udf(lambda s: s.map(_content), "binary")
    return ingest.bodies(table(spark, d, "wire_messages").select("delivery_id", content("delivery_id").alias("content"))).select("delivery_id", "reason")


def _receiver(_: str, data: bytes, headers: dict) -> tuple:
    """Takes a third of the envelopes, is out of service for a third and refuses a third."""
    body = gzip.decompress(data) if headers.get("content-encoding") == "gzip" else data
    return ((200, "", None), (503, "later", 0.0), (400, "token=abc refused", None))[int(body.split(b'"Sequence":')[1].split(b",")[0]) % 3]


@query("delivery_report", "SELECT delivery_id, delivery_id % 3 = 0 AS delivered, CAST(CASE WHEN delivery_id % 3 = 1 THEN 3 ELSE 1 END AS INT) AS attempts, CASE delivery_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'later' ELSE 'token=abc refused' END AS error FROM (SELECT DISTINCT delivery_id FROM transactions)")
def delivery_report(spark, d):
    """Envelopes encoded and posted from the executors: delivered, sent again while the receiver is out of service, or refused."""
    t = table(spark, d, "transactions").select("delivery_id", "txn_id", "req_method", epoch_ms(F.col("ts_ns")).alias("ms"))
    e = wire.envelopes(t, "delivery_id", F.lit("tenant"), F.lit("p1"), F.col("ms"))
    return sinks.deliver(e, "delivery_id", "https://receiver.invalid", _receiver).withColumnRenamed("id", "delivery_id")


@query("l7_counts", "SELECT CASE lower(protocol) WHEN 'http/2' THEN 'HTTP2' WHEN 'http/3' THEN 'HTTP3' WHEN 'grpc' THEN 'GRPC' WHEN 'websocket' THEN 'WebSocket' WHEN 'quic' THEN 'QUIC' WHEN 'mcp' THEN 'MCP' ELSE 'HTTP11' END AS l7, CAST(count(*) AS BIGINT) AS n FROM transactions GROUP BY 1")
def l7_counts(spark, d):
    t = table(spark, d, "transactions").select(labels.l7_name(F.col("protocol")).alias("l7"))
    return metrics.by_label(t, "l7")


@query("log_once", f"SELECT cgroup_id, min({MS}) AS first_ms FROM chunks WHERE cgroup_id IS NOT NULL AND cgroup_id NOT IN (SELECT cgroup_id FROM containers WHERE cgroup_id IS NOT NULL AND pod_namespace IS NOT NULL) GROUP BY cgroup_id ORDER BY first_ms, cgroup_id LIMIT 128")
def log_once(spark, d):
    """Cgroups without a namespace, one line each, the first 128 by time (a bounded report)."""
    c = table(spark, d, "chunks").where("cgroup_id is not null").groupBy("cgroup_id").agg(F.min(epoch_ms(F.col("ts_ns"))).alias("first_ms"))
    lost = c.join(table(spark, d, "containers").where("pod_namespace is not null").select("cgroup_id"), "cgroup_id", "left_anti")
    return order.newest(lost, [F.col("first_ms"), F.col("cgroup_id")], 128)


@query("library_discovery", "SELECT DISTINCT '08:0' || (pid % 3) AS dev, CAST(pid % 40 AS BIGINT) AS inode, '/usr/lib/lib' || (pid % 40) || '.so.' || (pid % 3) AS path FROM chunks WHERE pid % 5 <> 0 ORDER BY path, dev, inode LIMIT 512")
def library_discovery(spark, d):
    """Mapped libraries of all processes, once by file, the first 512 by path (a bounded report)."""
    pid = F.col("pid")
    text = F.concat(F.lit("7f00-7f9a "), F.when(pid % 5 == 0, "rw-p").otherwise("r-xp"), F.lit(" 00000000 08:0"), (pid % 3).cast("string"), F.lit(" "), (pid % 40).cast("string"), F.lit("                     /usr/lib/lib"), (pid % 40).cast("string"), F.lit(".so."), (pid % 3).cast("string"))
    lines = table(spark, d, "chunks").select(misc.mapped_file(text).alias("f")).where("f is not null").select("f.*")
    return order.newest(lines.dropDuplicates(["dev", "inode", "path"]), [F.col("path"), F.col("dev"), F.col("inode")], 512)


@query("event_streams", "SELECT o_orderkey, o_orderkey % 3 = 0 AS streams FROM orders")
def event_streams(spark, d):
    """Responses that are streams of events, by their content type."""
    kind = F.when(F.col("o_orderkey") % 3 == 0, "text/event-stream; charset=utf-8").when(F.col("o_orderkey") % 3 == 1, "text/html")
    return table(spark, d, "orders").select("o_orderkey", labels.is_event_stream(F.create_map(F.lit("content-type"), kind)).alias("streams"))


@query("ipv6_text", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '2001:db8::' || printf('%x', o_custkey) WHEN 1 THEN '::1' WHEN 2 THEN 'fe80::1:0:0:' || printf('%x', o_custkey) ELSE '1:2:3:4:5:6:7:' || printf('%x', o_custkey) END AS text FROM orders WHERE o_custkey BETWEEN 1 AND 65535")
def ipv6_text(spark, d):
    """Addresses of IPv6 as text."""
    k, c = F.col("o_orderkey") % 4, F.lpad(F.lower(F.hex("o_custkey")), 4, "0")
    head = F.when(k == 0, "20010db8" + "0" * 20).when(k == 1, "0" * 28).when(k == 2, "fe80" + "0" * 12 + "0001" + "0" * 8).otherwise("0001000200030004000500060007")
    digits = F.concat(head, F.when(k == 1, "0001").otherwise(c))
    return table(spark, d, "orders").where("o_custkey between 1 and 65535").select("o_orderkey", misc.ipv6(digits).alias("text"))
