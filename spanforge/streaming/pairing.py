"""Requests and responses of connections as a stream.

Per connection the state holds the requests that wait, oldest first. Messages
are taken in order of time and sequence: a response answers the oldest live
request, and is unpaired if none waits; a request older than the time to live
leaves as ``no_response_observed``; a close ends its connection's requests as
``connection_closed``; more than ``MOST`` waiting push the oldest out as
``evicted``. Timers on the watermark expire requests without further traffic,
and what is left when a bounded replay ends leaves as ``sensor_shutdown``.

Defined results: messages of unknown kind or without connection are left out;
ties in time go by sequence; an empty stream gives nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spanforge.streaming.replay import clock, clock_delay, instant, replayed, tick

TTL_MS, MOST = 300_000, 100
OUT = "conn string, request_id long, response_id long, latency_ms long, outcome string"
STATE = "ids array<long>, times array<long>"


def pair_queue(waiting: list[tuple[int, int]], messages: Iterator[tuple[int, str, int]], ttl_ms: int = TTL_MS, most: int = MOST) -> tuple[list[tuple[int, int]], list[tuple]]:
    """(still waiting, results) after (time, kind, id) messages in order."""
    out: list[tuple] = []
    for t, kind, ident in messages:
        while waiting and t - waiting[0][1] >= ttl_ms:
            out.append((waiting.pop(0)[0], None, None, "no_response_observed"))
        if kind == "request":
            waiting.append((ident, t))
            if len(waiting) > most:
                out.append((waiting.pop(0)[0], None, None, "evicted"))
        elif kind == "response":
            if waiting:
                q, at = waiting.pop(0)
                out.append((q, ident, max(0, t - at), None))
            else:
                out.append((None, ident, None, "unpaired"))
        elif kind == "close":
            out += [(q, None, None, "connection_closed") for q, _ in waiting]
            waiting = []
    return waiting, out


def _step(ttl_ms: int, most: int, end_ms: int | None):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting = list(zip(*state.get)) if state.exists else []
        out: list[tuple] = []
        ticks = state.getCurrentWatermarkMs()
        now = instant(ticks)
        if not state.hasTimedOut:
            rows = pd.concat([b[["ms", "seq", "kind", "id"]] for b in batches]).sort_values(["ms", "seq"], kind="stable")
            rows = rows[rows["kind"] != "end"]
            waiting, out = pair_queue(waiting, zip(rows["ms"], rows["kind"], rows["id"]), ttl_ms, most)
        over = [w for w in waiting if w[1] + ttl_ms <= now]
        waiting = waiting[len(over) :]
        out += [(q, None, None, "no_response_observed" if end_ms is None or t + ttl_ms <= end_ms else "sensor_shutdown") for q, t in over]
        if waiting:
            state.update(([int(q) for q, _ in waiting], [int(t) for _, t in waiting]))
            state.setTimeoutTimestamp(max(ticks + 1, tick(waiting[0][1] + ttl_ms)))
        elif state.exists:
            state.remove()
        if out:
            q, r, latency, why = zip(*out)
            yield pd.DataFrame({"conn": key[0], **{c: pd.array(v, "Int64") for c, v in (("request_id", q), ("response_id", r), ("latency_ms", latency))}, "outcome": pd.array(why, "string")})

    return step


def pairs_stream(messages: DataFrame, ttl_ms: int = TTL_MS, most: int = MOST, delay_ms: int = 60_000, end_ms: int | None = None) -> DataFrame:
    """Pairs and incomplete requests of a streaming (conn, ms, seq, kind, id); ``end`` rows only move the watermark on."""
    return (
        messages.withColumn("at", clock(F.col("ms"))).withWatermark("at", clock_delay(delay_ms))
        .groupBy("conn").applyInPandasWithState(_step(ttl_ms, most, end_ms), OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )


def pair_stored(messages: DataFrame, ttl_ms: int = TTL_MS, most: int = MOST, slices: int | None = None) -> DataFrame:
    """The same over a stored table, replayed in order of time to its end."""
    m = messages.where(F.col("conn").isNotNull() & F.col("ms").isNotNull() & F.col("kind").isin("request", "response", "close"))
    end = m.agg(F.max("ms")).first()[0]
    if end is None:
        return messages.sparkSession.createDataFrame([], OUT)

    def marker(rows: DataFrame) -> DataFrame:
        return rows.agg((F.max("ms") + 2 * ttl_ms + 120_000).alias("ms")).select(F.lit("").alias("conn"), "ms", F.lit(0).cast("long").alias("seq"), F.lit("end").alias("kind"), F.lit(0).cast("long").alias("id"))

    rows = m.select("conn", F.col("ms").cast("long").alias("ms"), F.col("seq").cast("long").alias("seq"), "kind", F.col("id").cast("long").alias("id"))
    return replayed(rows, "ms", lambda s: pairs_stream(s, ttl_ms, most, end_ms=end), marker, slices)
