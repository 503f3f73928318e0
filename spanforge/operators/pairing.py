"""Requests and their responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TTL_MS = 300_000


def fifo(messages: DataFrame, conn: list[str], order: list[str], request: Column) -> DataFrame:
    """Messages with ``_rank``: the k-th live request and the k-th answering response of a connection get the same one.

    The running balance of requests and responses shows which responses came
    while nothing waited: those whose balance falls below every balance before,
    and below zero. They are dropped (``_unpaired``) and shift no later pair.
    """
    w = Window.partitionBy(*conn).orderBy(*order)
    all_before = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    m = messages.withColumn("_s", F.when(request, 1).otherwise(-1)).withColumn("_d", F.sum("_s").over(all_before))
    m = m.withColumn("_unpaired", (F.col("_s") == -1) & (F.col("_d") < F.least(F.coalesce(F.min("_d").over(earlier), F.lit(0)), F.lit(0))))
    return m.withColumn("_rank", F.row_number().over(Window.partitionBy(*conn, "_s", "_unpaired").orderBy(*order)))


def pairs(ranked: DataFrame, conn: list[str], ident: str, ms: str) -> DataFrame:
    """conn, request_id, response_id, latency_ms; requests without answer have nulls."""
    q = ranked.where("_s = 1").select(*conn, "_rank", F.col(ident).alias("request_id"), F.col(ms).alias("_t"))
    r = ranked.where("_s = -1 and not _unpaired").select(*conn, "_rank", F.col(ident).alias("response_id"), F.col(ms).alias("_u"))
    latency = F.greatest(F.lit(0).cast("long"), F.col("_u") - F.col("_t")).alias("latency_ms")
    return q.join(r, [*conn, "_rank"], "left").select(*conn, "request_id", "response_id", F.when(F.col("_u").isNotNull(), latency).alias("latency_ms"), F.col("_t").alias("request_ms"))


def outcome(response: Column, request_ms: Column, now_ms: Column, closed: Column, ttl_ms: int = TTL_MS) -> Column:
    """Why a request has no answer; null if it has one."""
    return F.when(response.isNotNull(), None).when(closed, "connection_closed").when(now_ms - request_ms >= ttl_ms, "no_response_observed").otherwise("sensor_shutdown")


def keyed(requests: DataFrame, responses: DataFrame, on: list[str]) -> DataFrame:
    """1:1 by key; of repeated keys the last one given by ``_at`` replaces the others."""
    def latest(df: DataFrame, name: str) -> DataFrame:
        cols = [c for c in df.columns if c not in (*on, "_at")]
        return df.groupBy(*on).agg(F.max_by(F.struct(*cols), F.col("_at")).alias(name))

    return latest(requests, "_q").join(latest(responses, "_r"), on, "left").select(*on, "_q.*", *(F.col(f"_r.{c}").alias(c) for c in responses.columns if c not in (*on, "_at")))


def close_matches(closes: DataFrame, connections: DataFrame) -> DataFrame:
    """Closes with the connection they end: the exact incarnation, or (pid, ssl_ptr) where the identity is zero."""
    c, k = closes.alias("c"), connections.alias("k")
    exact = (F.col("c.proc_start_ns") == F.col("k.proc_start_ns")) & (F.col("c.generation") == F.col("k.conn_generation"))
    unknown = (F.col("c.proc_start_ns") == 0) & (F.col("c.generation") == 0)
    return c.join(k, (F.col("c.pid") == F.col("k.pid")) & (F.col("c.ssl_ptr") == F.col("k.ssl_ptr")) & (exact | unknown))
