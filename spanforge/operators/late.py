"""Counts by period of event time, corrected as late records arrive, with a cut-off.

Records stream in order of arrival. Each belongs to the period of its event
time; it counts if it arrives no later than ``lateness_ms`` after the period's
end, else it is diverted to the side output with its id. Each (key, period) has
a state of its own with a timer of its own: the count so far and its revision.
A micro-batch that adds to it emits the new value as an upsert of (key,
period); when the watermark of arrivals passes the period's cut-off, the timer
emits the final value and removes the state. Of the upserts of a (key, period)
the one with the highest revision holds.

Before the state the records of a micro-batch are combined where they are read,
so a hot key sends a few partial counts, not its records. Late records travel
as lists of ``BLOCK`` ids to a state of their own, which counts and diverts
them; where a (key, period) has several blocks they spread over ``PARTS`` such
states.

Defined results: a record without event time or arrival can be neither placed
nor judged and is diverted as ``unplaced``; a null key is a group of its own;
of repeated rows of an id the earliest arrival counts; any key and id can
occur, as the row that ends a replay is marked by a column of its own; empty
tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spanforge.streaming.replay import clock, clock_delay, replayed, tick

HOUR_MS = 3_600_000
LATENESS_MS = 1_200_000
#: Ids in a list of late records, and states over which the lists of a (key, period) are spread.
BLOCK, PARTS = 1000, 16
PARTIAL = "control boolean, no_key boolean, key long, period_ms long, part int, n long, ids array<long>, clock_ms long"
ROWS = (("control", pa.bool_()), ("no_key", pa.bool_()), ("key", pa.int64()), ("period_ms", pa.int64()), ("part", pa.int32()), ("size", pa.int64()), ("ids", pa.list_(pa.int64())), ("max", pa.int64()))
PARTIAL_NAMES = [c.strip().split()[0] for c in PARTIAL.split(",")]
OUT = "kind string, no_key boolean, key long, period_ms long, n long, revision long, id long"
STATE = "n long, revision long"


def arrivals(records: DataFrame, key: Column, event_ms: Column, arrival_ms: Column, ident: Column) -> DataFrame:
    """One row per id: key, event time and earliest arrival."""
    r = records.select(ident.cast("long").alias("id"), key.cast("long").alias("key"), event_ms.alias("event_ms"), arrival_ms.alias("arrival_ms"))
    first = F.min(F.struct(F.col("arrival_ms").isNull().alias("no"), "arrival_ms", "event_ms", "key")).alias("f")
    return r.where("id is not null").groupBy("id").agg(first).select("id", "f.key", "f.event_ms", "f.arrival_ms")


def _combine(period_ms: int, lateness_ms: int):
    """Arrow batches of (control, id, key, event_ms, arrival_ms) to partial counts and lists of late records."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            control = b.column(0).to_numpy(zero_copy_only=False)
            key = b.column(2)
            no_key = key.is_null().to_numpy(zero_copy_only=False)
            ident, event, arrival = (b.column(k).to_numpy(zero_copy_only=False) for k in (1, 3, 4))
            period = event - event % period_ms
            late = ~control & (arrival > period + period_ms + lateness_ms)
            r = pd.DataFrame({"control": control, "no_key": no_key, "key": key.fill_null(0).to_numpy(zero_copy_only=False), "period_ms": period, "clock_ms": arrival, "id": ident})
            by = ["control", "no_key", "key", "period_ms"]
            n = r[~late].groupby(by, sort=False)["clock_ms"].agg(["size", "max"]).reset_index()
            n["part"], n["ids"] = 0, None
            one = r[late].assign(block=r[late].groupby(by, sort=False).cumcount() // BLOCK)
            lists = one.groupby([*by, "block"], sort=False).agg(size=("id", "size"), max=("clock_ms", "max"), ids=("id", list)).reset_index()
            lists["part"] = 1 + lists.pop("block") % PARTS
            both = [pa.concat_arrays([pa.array(x[c].to_list() if c == "ids" else x[c].to_numpy(), k) for x in (n, lists)]) for c, k in ROWS]
            yield pa.RecordBatch.from_arrays(both, names=PARTIAL_NAMES)

    return run


def _count(period_ms: int, lateness_ms: int):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (control, no_key), (value, period, part) = key[:2], map(int, key[2:])
        n, revision = state.get if state.exists else (0, 0)

        def rows(kind: str, n, revision: int, ident=0) -> pd.DataFrame:
            return pd.DataFrame({"kind": kind, "no_key": no_key, "key": value, "period_ms": period, "n": n, "revision": revision, "id": np.atleast_1d(ident)})

        if state.hasTimedOut:
            state.remove()
            if part == 0:
                yield rows("final", int(n), int(revision) + 1)
            return
        added = 0
        for b in batches:
            added += int(b["n"].sum())
            if part:
                yield rows("late", 1, 0, np.concatenate(b["ids"].to_list()).astype(np.int64))
        if control:
            return
        state.update((int(n) + added, int(revision) + 1))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, tick(period + period_ms + lateness_ms) + 1))
        if part == 0:
            yield rows("update", int(n) + added, int(revision) + 1)

    return step


def late_stream(records: DataFrame, period_ms: int = HOUR_MS, lateness_ms: int = LATENESS_MS, delay_ms: int = 60_000) -> DataFrame:
    """Upserts, finals and late records of a streaming (control, id, key, event_ms, arrival_ms), of which the key alone may be null.

    ``delay_ms`` is how far out of order arrivals may come.
    """
    partial = records.select("control", "id", "key", "event_ms", "arrival_ms").mapInArrow(_combine(period_ms, lateness_ms), PARTIAL)
    return (
        partial.withColumn("at", clock(F.col("clock_ms")))
        .withWatermark("at", clock_delay(delay_ms))
        .groupBy("control", "no_key", "key", "period_ms", "part")
        .applyInPandasWithState(_count(period_ms, lateness_ms), OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )


def corrected_counts(records: DataFrame, key: Column, event_ms: Column, arrival_ms: Column, ident: Column, period_ms: int = HOUR_MS, lateness_ms: int = LATENESS_MS, slices: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(counts: key, period_ms, n, revisions) and (diverted: id, key, period_ms, reason) of stored records, replayed in order of arrival."""
    rows = arrivals(records, key, event_ms, arrival_ms, ident)
    placed = rows.where("event_ms is not null and arrival_ms is not null").select(F.lit(False).alias("control"), "id", "key", "event_ms", "arrival_ms")

    def build(stream: DataFrame) -> DataFrame:
        return late_stream(stream, period_ms, lateness_ms)

    def marker(kept: DataFrame) -> DataFrame:
        """A control row behind the last arrival and the last cut-off."""
        end = F.coalesce(F.max(F.greatest("arrival_ms", F.col("event_ms") + period_ms + lateness_ms)), F.lit(0).cast("long")) + period_ms + 120_000
        zero = F.lit(0).cast("long")
        return kept.agg(end.alias("arrival_ms")).select(F.lit(True).alias("control"), zero.alias("id"), zero.alias("key"), zero.alias("event_ms"), "arrival_ms")

    out = replayed(placed, "arrival_ms", build, marker, slices, ["kind"])
    real = F.when(~F.col("no_key"), F.col("key")).alias("key")
    counts = out.where("kind <> 'late'").groupBy("no_key", "key", "period_ms").agg(F.max_by("n", "revision").alias("n"), F.max("revision").alias("revisions")).select(real, "period_ms", "n", "revisions")
    diverted = out.where("kind = 'late'").select("id", real, "period_ms", F.lit("late").alias("reason"))
    unplaced = rows.where("event_ms is null or arrival_ms is null").select("id", "key", F.lit(None).cast("long").alias("period_ms"), F.lit("unplaced").alias("reason"))
    return counts, diverted.unionByName(unplaced)
