"""Stored rows as a stream in a given order."""

from __future__ import annotations

import math
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.session import discard, scratch

#: State of many keys is kept on disk; a session's own choice holds.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: Stored bytes of a micro-batch, and the fewest micro-batches.
SLICE_BYTES, LEAST_SLICES = 8 << 30, 3


#: The clock of a query runs a thousandth as fast as its data and begins so early that no instant lies before its zero, where the
#: first watermark stands: each instant within 10^14 ms of 1970 then is one that Python's timestamps have.
SHIFT_MS, SLOWER = 10**14, 1000


def clock(ms: Column) -> Column:
    return F.timestamp_micros(ms + SHIFT_MS)


def clock_delay(ms: int) -> str:
    return f"{max(1, ms // SLOWER)} milliseconds"


def tick(ms: int) -> int:
    """The clock's milliseconds at an instant, rounded up."""
    return -(-(int(ms) + SHIFT_MS) // SLOWER)


def instant(ticks: int) -> int:
    return ticks * SLOWER - SHIFT_MS


def replayed(rows: DataFrame, order: str, build: Callable[[DataFrame], DataFrame], last: Callable[[DataFrame], DataFrame] | None = None, slices: int | None = None, partition_by: list[str] | None = None) -> DataFrame:
    """What the streaming query ``build`` writes when ``rows`` come in micro-batches ascending by ``order``.

    The rows are written once in slices between quantiles of ``order``, as many
    as their bytes ask for. The slices then arrive one by one: each is moved
    into the folder of the file source and the query runs over it to its end,
    on from its checkpoint. So the order does not depend on times of files or
    on what a file system does with them. ``last`` makes of the stored rows
    the control rows that come with the last slice, such as a marker that moves
    the watermark past every open timer; a batch without rows then ends them. Only what the query wrote stays; the rest is removed.
    """
    spark = rows.sparkSession
    base = scratch(spark, "replay")
    rows.write.parquet(f"{base}/rows")
    kept = spark.read.schema(rows.schema).parquet(f"{base}/rows")
    n = slices or max(LEAST_SLICES, math.ceil(_bytes(spark, f"{base}/rows") / SLICE_BYTES))
    edges = sorted(set(kept.approxQuantile(order, [k / n for k in range(1, n)], 0.25 / n)))  # a number a slice
    place = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col(order))) if edges else F.lit(0)
    kept.withColumn("_slice", place).write.partitionBy("_slice").parquet(f"{base}/slices")
    _fs(spark, f"{base}/in")[1].mkdirs(_fs(spark, f"{base}/in")[0])
    out = build(spark.readStream.schema(rows.schema).parquet(f"{base}/in"))
    for k in range(len(edges) + 1):
        end = k == len(edges)
        moved = _move(spark, f"{base}/slices/_slice={k}", f"{base}/in", f"{k:06}-")
        if end and last is not None:
            last(kept).coalesce(1).write.mode("append").parquet(f"{base}/in")
        if end or moved:  # timers that only the watermark can end run after the last slice, in a batch without rows
            _run(out, base, partition_by, {"spark.sql.streaming.noDataMicroBatches.enabled": str(end).lower()})
    discard(f"{base}/rows", f"{base}/slices", f"{base}/in", f"{base}/checkpoint")
    return spark.read.schema(out.schema).parquet(f"{base}/out")


def _run(stream: DataFrame, base: str, partition_by: list[str] | None, conf: dict[str, str]) -> None:
    spark = stream.sparkSession
    w = stream.writeStream.format("parquet").option("checkpointLocation", f"{base}/checkpoint").outputMode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    own = {} if spark.sparkContext.getConf().contains(next(iter(STORE))) else STORE
    with _conf(spark, own | conf):
        w.trigger(availableNow=True).start(f"{base}/out").awaitTermination()


@contextmanager
def _conf(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _bytes(spark: SparkSession, path: str) -> int:
    p, fs = _fs(spark, path)
    return fs.getContentSummary(p).getLength()


def _move(spark: SparkSession, source: str, target: str, prefix: str) -> int:
    """Move the data files of a folder and give their number."""
    p, fs = _fs(spark, source)
    if not fs.exists(p):
        return 0
    files = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName().endswith(".parquet")]
    for f in files:
        fs.rename(f, _fs(spark, f"{target}/{prefix}{f.getName()}")[0])
    return len(files)
