import random

from pyspark.sql import functions as F

from spanforge.operators import pairing
from spanforge.streaming import pairing as S
from spanforge.streaming.replay import replayed


def messages(seed, n=300, conns=4):
    r = random.Random(seed)
    return [(f"c{r.randrange(conns)}", 1_740_960_000_000 + r.randrange(0, 3_000_000), k, r.choice(["request", "request", "response", "response", "close"]), k) for k in range(n)]


SCHEMA = "conn string, ms long, seq long, kind string, id long"


def test_set_based_pairing_equals_a_queue(spark):
    rows = [m for m in messages(1) if m[3] != "close"]
    df = spark.createDataFrame(rows, SCHEMA)
    ranked = pairing.fifo(df, ["conn"], ["ms", "seq"], F.col("kind") == "request")
    got = {(r.conn, r.request_id, r.response_id, r.latency_ms) for r in pairing.pairs(ranked, ["conn"], "id", "ms").collect()}
    want, unpaired = set(), set()
    for c in {m[0] for m in rows}:
        queue = []
        for _, t, _, kind, i in sorted((m for m in rows if m[0] == c), key=lambda m: (m[1], m[2])):
            if kind == "request":
                queue.append((i, t))
            elif queue:
                q, at = queue.pop(0)
                want.add((c, q, i, t - at))
            else:
                unpaired.add(i)
        want |= {(c, q, None, None) for q, _ in queue}
    assert got == want
    assert {r.id for r in ranked.where("_unpaired").collect()} == unpaired


def test_stream_equals_a_queue_with_time_to_live(spark):
    rows = messages(2)
    df = spark.createDataFrame([*rows, (None, 1, 1, "request", 999), ("c0", 1, 1, "other", 998)], SCHEMA)
    got = sorted(map(str, ((r.conn, r.request_id, r.response_id, r.latency_ms, r.outcome) for r in S.pair_stored(df, ttl_ms=400_000, slices=3).collect())))
    end, want = max(m[1] for m in rows), []
    for c in {m[0] for m in rows}:
        mine = [(m[1], m[3], m[4]) for m in sorted(rows, key=lambda m: (m[1], m[2])) if m[0] == c]
        waiting, out = S.pair_queue([], iter(mine), 400_000)
        out += [(q, None, None, "no_response_observed" if t + 400_000 <= end else "sensor_shutdown") for q, t in waiting]
        want += [(c, *o) for o in out]
    assert got == sorted(map(str, want))


def test_empty_stream(spark):
    assert S.pair_stored(spark.createDataFrame([], SCHEMA)).count() == 0


def test_queue_rules():
    w, out = S.pair_queue([], iter([(0, "request", 1), (10, "close", 0), (20, "response", 2)]), 100)
    assert w == [] and out == [(1, None, None, "connection_closed"), (None, 2, None, "unpaired")]
    w, out = S.pair_queue([], iter([(0, "request", k) for k in range(4)]), 100, most=3)
    assert out == [(0, None, None, "evicted")] and len(w) == 3
    _, out = S.pair_queue([], iter([(0, "request", 1), (100, "request", 2), (101, "response", 3)]), 100)
    assert out == [(1, None, None, "no_response_observed"), (2, 3, 1, None)]


def test_keyed_pairing_replaces_repeats(spark):
    q = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "k int, q string, _at int")
    r = spark.createDataFrame([(1, "x", 1)], "k int, r string, _at int")
    assert {tuple(x) for x in pairing.keyed(q, r, ["k"]).collect()} == {(1, "b", "x"), (2, "c", None)}


def test_replay_keeps_the_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("t"))
    out = replayed(df, "t", lambda s: s.select("t", F.current_timestamp().alias("at")), slices=3)
    seen = sorted((r.at, r.t) for r in out.collect())
    assert len(seen) == 1000 and len({at for at, _ in seen}) == 3
    assert [t for _, t in seen] == list(range(1000))


def test_replay_of_equal_and_of_no_rows(spark):
    df = spark.createDataFrame([(5,)] * 9, "t long")
    assert replayed(df, "t", lambda s: s, slices=3).count() == 9
    assert replayed(df.limit(0), "t", lambda s: s, slices=3).count() == 0
