"""Messages out of captured chunks.

Chunks of a connection and direction are brought together and sorted, and a
decoder walks through each partition: it holds the unconsumed bytes of one
connection at a time, whatever the number of its chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.sources.decode import frames
from spanforge.sources.decode.auto import AutoStream
from spanforge.sources.decode.fields import Malformed

MESSAGES = "conn string, direction byte, n int, method string, target string, status int, headers map<string,string>, body binary, body_total long, complete boolean, stream int, event string, problem string"

SCHEMA = pa.schema([
    ("conn", pa.string()), ("direction", pa.int8()), ("n", pa.int32()), ("method", pa.string()), ("target", pa.string()), ("status", pa.int32()), ("headers", pa.map_(pa.string(), pa.string())),
    ("body", pa.binary()), ("body_total", pa.int64()), ("complete", pa.bool_()), ("stream", pa.int32()), ("event", pa.string()), ("problem", pa.string()),
])


def _maps(dicts: tuple) -> pa.MapArray:
    starts, names, values = [], [], []
    for h in dicts:
        starts.append(None if h is None else len(names))
        if h:
            names += h
            values += h.values()
    starts.append(len(names))
    return pa.MapArray.from_arrays(pa.array(starts, pa.int32()), pa.array(names, pa.string()), pa.array(values, pa.string()))


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, stream, n = None, None, 0

    def row(m, problem=None) -> tuple:
        nonlocal n
        n += 1
        if m is None:
            return (*key, n - 1, None, None, None, None, None, None, False, None, None, problem)
        return (*key, n - 1, m.method, m.target, m.status, m.headers, m.body, m.body_total, m.complete, m.stream, m.event, problem)

    def frame(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [()] * len(SCHEMA)
        return pa.RecordBatch.from_arrays([_maps(c) if pa.types.is_map(f.type) else pa.array(c, f.type) for c, f in zip(columns, SCHEMA)], schema=SCHEMA)

    for b in batches:
        rows = []
        for conn, direction, payload, cut, quic in zip(*(c.to_numpy(zero_copy_only=False).tolist() for c in b.columns)):
            if key != (conn, direction):
                rows += [row(m) for m in stream.end()] if stream else []
                key, stream, n = (conn, direction), AutoStream(bool(quic)), 0
            try:
                rows += [row(m) for m in stream.feed(payload or b"")]
            except Malformed as e:
                rows += [row(m) for m in e.messages] + [row(None, str(e))]
                stream.resync()
            if cut:
                rows += [row(m, "gap") for m in stream.end()]
                stream.resync()
        yield frame(rows)
    if stream:
        yield frame([row(m) for m in stream.end()])


def decode(chunks: DataFrame, order: list[str]) -> DataFrame:
    """Messages of any HTTP version, WebSocket frames, resets and goaways of (conn, direction, payload, cut) chunks in ``order``.

    A chunk that is ``cut`` ends what is being read. A column ``quic`` tells
    chunks of QUIC providers, the only ones in which HTTP/3 is looked for.
    """
    rows = chunks if "quic" in chunks.columns else chunks.withColumn("quic", F.lit(False))
    return rows.repartition("conn", "direction").sortWithinPartitions("conn", "direction", *order).select("conn", "direction", "payload", "cut", "quic").mapInArrow(_decode, MESSAGES)


def stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Captured records, parquet files with a column ``record``, as they arrive in a folder, decoded."""
    raw = spark.readStream.schema("record binary").option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return read_records(raw)


def _records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [r for r in map(frames.chunk_record, b["record"]) if r]
        if rows:
            yield pd.DataFrame({c: [r[c] for r in rows] for c in ("ts_ns", "pid", "ssl_ptr", "direction", "comm", "flags", "copied_len", "payload")})


def read_records(records: DataFrame) -> DataFrame:
    """Captured records in their binary layout as rows; those of another version are left out."""
    return records.select("record").mapInPandas(_records, "ts_ns long, pid long, ssl_ptr long, direction byte, comm string, flags int, copied_len long, payload binary")


GRPC = "array<struct<number:int,kind:int,value:string>>"


def grpc(message: str):
    return F.pandas_udf(lambda s: s.map(lambda b: [{"number": n, "kind": k, "value": v} for n, k, v in frames.grpc_fields(b or b"")]), GRPC)(message)


def websocket(frame: str):
    """fin, opcode, length, payload and total of a frame; null if its head is cut."""
    def one(b):
        f = frames.ws_frame(b or b"")
        return [f] if f else []

    return F.get(F.pandas_udf(lambda s: s.map(one), "array<struct<fin:boolean,opcode:string,length:long,payload:binary,total:long>>")(frame), 0)


def http2(data: str):
    """(stream, path, method, body_total) of the complete messages of a direction given whole."""
    def one(b):
        return [{"stream": m.stream, "method": m.headers.get(":method"), "path": m.headers.get(":path"), "status": m.headers.get(":status"), "body_total": m.body_total} for k, m in frames.H2Direction(bytes(b or b"").startswith(b"PRI")).feed(b or b"") if k == "message"]

    return F.pandas_udf(lambda s: s.map(one), "array<struct<stream:int,method:string,path:string,status:string,body_total:long>>")(data)


def http3(data: str):
    return F.pandas_udf(lambda s: s.map(lambda b: frames.h3_headers(b or b"")), "map<string,string>")(data)
