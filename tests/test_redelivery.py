import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from spanforge.operators import redelivery as R

SCHEMA = "d long, t string, s long, m long, at timestamp, n string, delivery string"
C = F.col


def ident():
    return [C("t"), C("s"), C("m")]


T0 = datetime(2025, 3, 3)


def make(seed=2, n=500):
    r = random.Random(seed)
    out = []
    for d in range(n):
        key = ("hot", 1, 1) if r.random() < 0.35 else (r.choice(["a", None]), r.choice([r.randrange(40), None]), r.choice([1, 2]))
        out += [(d, *key, r.choice([None, T0 + timedelta(seconds=r.randrange(20))]), "", "")] * r.choice([1, 1, 2])
    return out


def brute(rows):
    best = {}
    for d, t, s, m, at, *_ in rows:
        rank = (at is None, at or T0, d)
        if (t, s, m) not in best or rank < best[t, s, m]:
            best[t, s, m] = rank
    return {x[2] for x in best.values()}


def test_one_copy_against_brute_force(spark):
    rows = make()
    df = spark.createDataFrame(rows, SCHEMA)
    kept = brute(rows)
    got = [r.delivery for r in R.survivors(df, ident(), C("at"), C("d")).collect()]
    assert sorted(got) == sorted(kept)
    more = [r.delivery for r in R.superfluous(df, ident(), C("at"), C("d")).collect()]
    assert sorted(more) == sorted({x[0] for x in rows} - kept)


def test_new_messages_against_stored_ones(spark):
    rows = make()
    old, new = rows[:300], rows[300:]
    o, n = spark.createDataFrame(old, SCHEMA), spark.createDataFrame(new, SCHEMA)
    kept = brute(old)
    seen = o.where(C("d").isin(*kept)).dropDuplicates(["d"])
    keys = {x[1:4] for x in old}
    want = brute([x for x in new if x[1:4] not in keys])
    assert sorted(r.delivery for r in R.admit(n, seen, ident(), C("at"), C("d")).collect()) == sorted(want)


def test_both_ways_of_the_marks_and_no_rank_for_singletons(spark):
    rows = make(5, 300)
    df = spark.createDataFrame(rows, SCHEMA)
    kept = brute(rows)
    for most in (0, 10**6):
        assert sorted(r.delivery for r in R.survivors(df, ident(), C("at"), C("d"), most).collect()) == sorted(kept)
        assert sorted(r.delivery for r in R.superfluous(df, ident(), C("at"), C("d"), most).collect()) == sorted({x[0] for x in rows} - kept)
    held, names = R._rows(df, ident(), C("at"), C("d"))
    marked = held.join(R.marks(held), "h", "left_semi")
    n = {}
    for d, t, s, m, *_ in rows:
        n[t, s, m] = n.get((t, s, m), 0) + 1
    assert {(r.k0, r.k1, r.k2) for r in marked.collect()} == {k for k, c in n.items() if c > 1}


def test_empty_and_missing_delivery(spark):
    e = spark.createDataFrame([], SCHEMA)
    assert R.survivors(e, ident(), C("at"), C("d")).count() == 0 and R.superfluous(e, ident(), C("at"), C("d")).count() == 0
    assert R.survivors(spark.createDataFrame([(None, "a", 1, 1, T0, "", "")], SCHEMA), ident(), C("at"), C("d")).count() == 0
