"""HTTP/1 and HTTP/2 messages out of a stream of chunks, the decoder's state kept between micro-batches.

The state of a connection's direction is the decoder itself: its unconsumed
bytes and the message it is building, both bounded. Chunks are taken in order
of sequence; a chunk whose number is not the next, or that was cut, ends what
is being read, and reading goes on at the next start of a message. A direction
that is idle for the time to live gives up what it holds.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spanforge.sources.decode.auto import AutoStream
from spanforge.sources.decode.fields import Malformed
from spanforge.sources.decode.http1 import METHODS
from spanforge.streaming.replay import clock, clock_delay, tick

TTL_MS = 300_000
OUT = "conn string, direction byte, ms long, method string, target string, status int, headers map<string,string>, body binary, body_total long, complete boolean, stream int, event string, problem string"
STATE = "decoder binary, last long, seen long, skipping boolean"
START = re.compile(rb"HTTP/1\.[01] |(?:" + b"|".join(sorted(METHODS)) + rb") ")
COLUMNS = [c.strip().split(" ")[0] for c in re.sub(r"<[^>]*>", "", OUT).split(",")]


def _row(key, ms, m, problem=None) -> tuple:
    return (*key, ms, m.method, m.target, m.status, m.headers, m.body, m.body_total, m.complete, m.stream, m.event, problem) if m else (*key, ms, None, None, None, None, None, None, False, None, None, problem)


def walk(key: tuple, decoder: AutoStream, last: int | None, skipping: bool, chunks: Iterator[tuple[int, int, bytes, bool]]) -> tuple[int | None, bool, list[tuple]]:
    """(last sequence, waiting for a start, rows) after (sequence, time, payload, cut) chunks."""
    out: list[tuple] = []
    for seq, ms, data, cut in chunks:
        if last is not None and seq <= last:
            continue  # repeated
        if last is not None and seq != last + 1 and not skipping:
            out += [_row(key, ms, m, "gap") for m in decoder.end()]
            decoder.resync()
            skipping = True
        last = seq
        if skipping and not (decoder.resumable and START.match(data)):
            continue
        skipping = False
        try:
            out += [_row(key, ms, m) for m in decoder.feed(data)]
        except Malformed as e:
            out += [_row(key, ms, m) for m in e.messages] + [_row(key, ms, None, str(e))]
            decoder.resync()
            skipping = True
        if cut:
            out += [_row(key, ms, m, "gap") for m in decoder.end()]
            decoder.resync()
            skipping = True
    return last, skipping, out


def _step(ttl_ms: int):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        decoder, last, seen, skipping = (pickle.loads(state.get[0]), *state.get[1:]) if state.exists else (AutoStream(), None, 0, False)
        last = None if last is None or last < 0 else last
        now = state.getCurrentWatermarkMs()
        if state.hasTimedOut:
            out = [_row(key, seen, m, "idle") for m in decoder.end()]
            state.remove()
        else:
            rows = pd.concat([b[["seq", "ms", "payload", "cut"]] for b in batches]).sort_values("seq", kind="stable")
            seen = max(int(seen), int(rows["ms"].max()))
            last, skipping, out = walk(key, decoder, last, bool(skipping), zip(rows["seq"], rows["ms"], rows["payload"], rows["cut"]))
            state.update((pickle.dumps(decoder), -1 if last is None else int(last), seen, bool(skipping)))
            state.setTimeoutTimestamp(max(now + 1, tick(seen + ttl_ms)))
        if out:
            df = pd.DataFrame(out, columns=COLUMNS)
            yield df.astype({"status": "Int32", "body_total": "Int64", "stream": "Int32", "method": "string", "target": "string", "event": "string", "problem": "string"})

    return step


def messages_stream(chunks: DataFrame, ttl_ms: int = TTL_MS, delay_ms: int = 60_000) -> DataFrame:
    """Messages of a streaming (conn, direction, seq, ms, payload, cut)."""
    return (
        chunks.withColumn("at", clock(F.col("ms"))).withWatermark("at", clock_delay(delay_ms))
        .groupBy("conn", "direction").applyInPandasWithState(_step(ttl_ms), OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )


def once(events: DataFrame, ident: str, at: str, delay: str = "1 hour") -> DataFrame:
    """One row per id within the delay: repeats of a resent batch drop."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark([ident])
