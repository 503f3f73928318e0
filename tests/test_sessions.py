import random

import pytest
from pyspark.sql import functions as F

from spanforge.functions import normal as N
from spanforge.operators import sessions

SCHEMA = "user_id string, session_id string, ts_ns long, txn_id long, actor string, ms string"
GAP = sessions.GAP_MS


def run(df):
    return sessions.sessionize(df, N.actor(F.col("user_id"), F.col("session_id")), N.epoch_ms(F.col("ts_ns")), F.col("txn_id"), slices=2)


def brute(rows):
    by = {}
    for user, sid, ts, txn in {r[:4] for r in rows}:
        u, s = (user or "").strip().lower(), (sid or "").strip().lower()
        who = u if u not in ("", "unknown") else s if s not in ("", "sid-0") else None
        if who is None or ts is None:
            continue
        ms = ts // 10**6 if ts >= 10**17 else ts // 10**3 if ts >= 10**14 else ts
        by.setdefault(who, []).append((ms, txn))
    out = set()
    for who, events in by.items():
        events.sort(key=lambda e: (e[0], e[1] or 0))
        run_ = [events[0]]
        for e in events[1:] + [(10**18, None)]:
            if e[0] - run_[-1][0] > GAP:
                out.add((who, run_[0][0], run_[-1][0], len({t for _, t in run_ if t is not None})))
                run_ = []
            run_.append(e)
    return out


def test_random_against_brute_force(spark):
    r = random.Random(3)
    rows = []
    for k in range(600):
        user = r.choice(["A ", "a", "b", "hot", "hot", "hot", "unknown", None, " UNKNOWN", ""])
        ms = 1_740_960_000_000 + r.randrange(0, 40 * GAP)
        unit = r.choice([10**6, 10**6, 10**3, 1])
        row = (user, r.choice(["S1", "sid-0", None, "s1 "]), ms * unit, k, "clash", "clash")
        rows += [row] * r.choice([1, 1, 2])
    rows += [("b", None, None, 9001, "", ""), ("b", None, 1_740_960_000_000, None, "", "")]
    got = {(x.actor, x.start_ms, x.end_ms, x.n_events) for x in run(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def test_gap_exactly_at_the_limit(spark):
    t = 1_740_960_000_001
    rows = [("a", None, t, 1, "", ""), ("a", None, t + GAP, 2, "", ""), ("a", None, t + 2 * GAP + 1, 3, "", "")]
    got = sorted((x.start_ms, x.end_ms, x.n_events, x.duration_ms) for x in run(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(t, t + GAP, 2, GAP), (t + 2 * GAP + 1, t + 2 * GAP + 1, 1, 0)]


def test_any_instant_and_actor_has_its_session(spark):
    """Instants far behind today, before 1970 and beyond the year 3000, and actors that look like a marker."""
    far = [4_200_000_000_000, 32_600_000_000_000, -5_000, 0]
    rows = [(a, None, t + d, k * 100 + j, "", "") for k, t in enumerate(far) for a in ("\x00end", "end") for j, d in enumerate((0, GAP))]
    got = {(x.actor, x.start_ms, x.end_ms, x.n_events) for x in run(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(a, t, t + GAP, 2) for t in far[:3] for a in ("\x00end", "end")} - {(a, -5000, -5000 + GAP, 2) for a in ("\x00end", "end")} | {(a, -5000, GAP, 4) for a in ("\x00end", "end")}


def test_an_event_inside_a_longer_fragment(spark):
    """A session grows by its last end, not by its last begun fragment."""
    t = 1_740_960_000_000 - 1_740_960_000_000 % GAP
    rows = [("a", None, t + d, k, "", "") for k, d in enumerate((0, GAP - 1, GAP, 2 * GAP - 1, 3 * GAP - 1, 4 * GAP))]
    got = sorted((x.start_ms - t, x.end_ms - t, x.n_events) for x in run(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(0, 3 * GAP - 1, 5), (4 * GAP, 4 * GAP, 1)]


def test_empty(spark):
    assert run(spark.createDataFrame([], SCHEMA)).count() == 0


def test_fragments_bound_a_hot_actor(spark):
    df = spark.range(20_000).select(F.lit("hot").alias("user_id"), F.lit(None).cast("string").alias("session_id"), (F.lit(1_740_960_000_000) + F.col("id") % 3600_000).alias("ts_ns"), F.col("id").alias("txn_id"))
    assert sessions.fragments(df, F.col("user_id"), F.col("ts_ns"), F.col("txn_id")).count() <= 3


@pytest.mark.parametrize("spelling,want", [(1740961572979543171, 1740961572979), (1740961572979543, 1740961572979), (1740961572979, 1740961572979), (-1, -1), (None, None)])
def test_units_of_instants(spark, spelling, want):
    assert spark.createDataFrame([(spelling,)], "t long").select(N.epoch_ms(F.col("t")).alias("m")).first().m == want


def test_times_of_messages(spark):
    rows = [("2025-03-03 00:26:14.935",), ("2025-03-03T00:26:14.935Z",), (" 2025-03-03T02:26:14.935+02:00 ",), ("2025-03-02T19:26:14.935-05:00",), ("1740961574935",), ("never",), (None,)]
    got = [r.m for r in spark.createDataFrame(rows, "t string").select(N.message_ms(F.col("t")).alias("m")).collect()]
    assert got == [1740961574935] * 5 + [None, None]
