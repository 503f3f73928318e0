"""HTTP/2 messages of a connection are paired by stream, through decoding in batch and as a stream."""

import pytest

from pyspark.sql import functions as F

from spanforge.operators import transactions as T
from spanforge.sources import chunks as C
from spanforge.sources.decode import fields, frames
from spanforge.streaming.decode import messages_stream
from spanforge.streaming.replay import replayed


def _request(stream, path):
    return frames.h2_frame(frames.HEADERS, 5, stream, fields.hpack_encode([(":method", "GET"), (":path", path)]))


def _response(stream, status):
    return frames.h2_frame(frames.HEADERS, 5, stream, fields.hpack_encode([(":status", str(status))]))


def _reset(stream):
    return frames.h2_frame(frames.RST, 0, stream, b"\0\0\0\x08")


def _goaway(last):
    return frames.h2_frame(frames.GOAWAY, 0, 0, last.to_bytes(4, "big") + b"\0\0\0\0")


#: (conn, direction, time, bytes): answers out of order, a reset request, a reset behind its answer, streams above a goaway, and an HTTP/1 connection
CHUNKS = [
    ("c", 0, 1, frames.PREFACE + _request(1, "/a")), ("c", 0, 2, _request(3, "/b")), ("c", 0, 3, _request(5, "/reset")), ("c", 0, 4, _request(7, "/c")), ("c", 0, 5, _reset(5)),
    ("c", 1, 6, frames.h2_frame(frames.SETTINGS, 0, 0, b"") + _response(7, 207)), ("c", 1, 7, _response(3, 203)), ("c", 1, 8, _response(1, 201)), ("c", 0, 9, _reset(1)),
    ("c", 0, 10, _request(9, "/d")), ("c", 0, 11, _request(11, "/dropped")), ("c", 1, 12, _goaway(9)), ("c", 1, 13, _response(9, 209)), ("c", 0, 14, _request(13, "/late")),
    ("h", 0, 1, b"GET /1 HTTP/1.1\r\n\r\nGET /2 HTTP/1.1\r\n\r\n"), ("h", 1, 2, b"HTTP/1.1 200 OK\r\nContent-Length: 0\r\n\r\nHTTP/1.1 404 X\r\nContent-Length: 0\r\n\r\n"),
]
WANT = {"/a": 201, "/b": 203, "/c": 207, "/d": 209, "/late": None, "/1": 200, "/2": 404}
BASE = 1_740_960_000_000


def _batch(df):
    # a chunk of the fixture is one message at most but for HTTP/1, so the k-th chunk's time is the k-th message's
    m = C.decode(df, ["ms"])
    times = {(c, d): [t for x, y, t, b in CHUNKS if (x, y) == (c, d)] for c, d, _, _ in CHUNKS}
    when = F.create_map(*(x for (c, d), ts in times.items() for k in range(9) for x in (F.lit(f"{c}{d}{k}"), F.lit(BASE + ts[min(k, len(ts) - 1)]))))
    return m.withColumn("ms", when[F.concat("conn", F.col("direction").cast("string"), F.col("n").cast("string"))]).withColumn("seq", F.col("n"))


def _streamed(df):
    return replayed(df, "ms", messages_stream, slices=3).withColumn("seq", F.monotonically_increasing_id())


@pytest.mark.parametrize("decode", (_batch, _streamed))
def test_pairs_by_stream(spark, decode):
    df = spark.createDataFrame([(c, d, k, BASE + t, b, False) for k, (c, d, t, b) in enumerate((c, d, t, b) for c, d, t, b in CHUNKS)], "conn string, direction byte, seq long, ms long, payload binary, cut boolean")
    if decode is _streamed:  # sequences run by direction
        df = df.selectExpr("conn", "direction", "row_number() OVER (PARTITION BY conn, direction ORDER BY seq) AS seq", "ms", "payload", "cut").withColumn("seq", F.col("seq").cast("long"))
    m = decode(df).withColumns({"cgroup_id": F.lit(1).cast("long"), "source_ip": F.lit("a"), "dest_ip": F.lit("b"), "source_port": F.lit(1), "dest_port": F.lit(2), "comm": F.lit("x")})
    rows = T.paired(m).collect()
    assert {r.q_target: r.r_status for r in rows} == WANT and len(rows) == len(WANT)
