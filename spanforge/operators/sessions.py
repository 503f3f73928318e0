"""Sessions of activity: keyed state with inactivity timers.

Events become *fragments* first: all events of an actor within one cell of a
grid as wide as the gap belong together whatever else happens, so minimum,
maximum and count per (actor, cell) are enough. They are combined before and
after the shuffle, so an actor with a third of all rows is a few rows a cell.

The fragments stream in order through the state of their actor, one row of the
state store for each open session: a fragment that begins before the session's
timeout extends it and moves the timeout to the fragment's end plus the gap;
when the watermark passes a timeout, that session leaves the state with its
final start, end and count. State and timers are those of the streaming session
window, whose width is given row by row, so all of it runs in the JVM and a key
holds its own open session only.

Defined results: events without an actor or an instant are in no session;
events without an id extend a session but are not counted; repeated rows of
one id count once; any actor and any instant can occur, as the row that ends a
replay is marked by a column of its own; an empty table gives no session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.streaming.replay import SHIFT_MS, replayed

GAP_MS = 1_800_000


def fragments(df: DataFrame, actor: Column, ms: Column, event: Column, gap_ms: int = GAP_MS) -> DataFrame:
    """(actor, start_ms, end_ms, n_events) per actor and cell of ``gap_ms``."""
    rows = df.select(actor.alias("actor"), ms.alias("ms"), event.alias("event")).where("actor is not null and ms is not null")
    once = rows.groupBy("actor", "ms", "event").agg(F.lit(1).alias("one"))  # spreads a hot actor over its instants
    cell = (F.col("ms") - F.pmod(F.col("ms"), F.lit(gap_ms).cast("long"))).alias("cell")
    return (
        once.groupBy("actor", cell)
        .agg(F.min("ms").alias("start_ms"), F.max("ms").alias("end_ms"), F.count("event").alias("n_events"))
        .select("actor", "start_ms", "end_ms", "n_events")
    )


def session_stream(frags: DataFrame, gap_ms: int = GAP_MS, delay_ms: int = GAP_MS) -> DataFrame:
    """Final sessions of a streaming (control, actor, start_ms, end_ms, n_events); a single event is a fragment of length 0.

    ``delay_ms`` is how far out of order fragments may come. A fragment that
    begins exactly at the timeout still extends the session.
    Control rows only move the watermark on; their own timeout is never passed.
    (A filter on them here would be pushed below the watermark.)
    """
    held = F.concat((F.col("end_ms") - F.col("start_ms") + gap_ms).cast("string"), F.lit(" milliseconds"))
    return (
        frags.withColumn("at", F.timestamp_millis(F.col("start_ms") + SHIFT_MS))
        .withWatermark("at", f"{delay_ms} milliseconds")
        .groupBy("control", "actor", F.session_window("at", held))
        .agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.sum("n_events").alias("n_events"))
        .select("actor", "start_ms", "end_ms", "n_events")
    )


def sessionize(df: DataFrame, actor: Column, ms: Column, event: Column, gap_ms: int = GAP_MS, slices: int | None = None) -> DataFrame:
    """Sessions of a stored table: its fragments replayed in order of time, then a marker behind the last timeout."""
    frags = fragments(df, actor, ms, event, gap_ms).select(F.lit(False).alias("control"), "*")

    def build(stream: DataFrame) -> DataFrame:
        return session_stream(stream, gap_ms)

    return replayed(frags, "start_ms", build, lambda rows: _marker(rows, gap_ms), slices).withColumn("duration_ms", F.col("end_ms") - F.col("start_ms"))


def _marker(rows: DataFrame, gap_ms: int) -> DataFrame:
    """A control row later than every timeout."""
    end = (F.coalesce(F.max("end_ms"), F.lit(0).cast("long")) + 4 * gap_ms + 60_000).alias("start_ms")
    return rows.agg(end).select(F.lit(True).alias("control"), F.lit("").alias("actor"), "start_ms", F.col("start_ms").alias("end_ms"), F.lit(0).cast("long").alias("n_events"))
