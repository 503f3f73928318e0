import random

from pyspark.sql import functions as F

from spanforge.operators import late

SCHEMA = "id long, key long, ev long, arr long, period_ms string"
C = F.col


def run(df, slices=3):
    counts, diverted = late.corrected_counts(df, C("key"), C("ev"), C("arr"), C("id"), slices=slices)
    return {(r.key, r.period_ms): r.n for r in counts.collect()}, {(r.id, r.reason) for r in diverted.collect()}


def test_random_against_brute_force(spark):
    r = random.Random(5)
    base = 1_740_960_000_000
    rows = []
    for k in range(500):
        ev = base + r.randrange(0, 12 * late.HOUR_MS)
        arr = ev + r.choice([0, 1000, late.HOUR_MS, 2 * late.HOUR_MS, -5000])
        rows += [(k, r.choice([1, 1, 1, 2, None]), ev, arr, "x")] * r.choice([1, 2])
    p = base - base % late.HOUR_MS
    edge = p + late.HOUR_MS + late.LATENESS_MS
    rows += [(9001, 1, p, edge, ""), (9002, 1, p, edge + 1, ""), (9003, 1, None, base, ""), (9004, 1, base, None, ""), (None, 1, base, base, "")]
    counts, diverted = run(spark.createDataFrame(rows, SCHEMA))
    want, late_ids = {}, set()
    for i, key, ev, arr, _ in sorted({x for x in rows if x[0] is not None}, key=str):
        if ev is None or arr is None:
            late_ids.add((i, "unplaced"))
            continue
        period = ev - ev % late.HOUR_MS
        if arr > period + late.HOUR_MS + late.LATENESS_MS:
            late_ids.add((i, "late"))
        else:
            want[key, period] = want.get((key, period), 0) + 1
    assert counts == want
    assert diverted == late_ids


def test_the_earliest_arrival_of_an_id_counts(spark):
    base = 1_740_960_000_000 - 1_740_960_000_000 % late.HOUR_MS
    df = spark.createDataFrame([(1, 7, base, base + 5 * late.HOUR_MS, ""), (1, 7, base, base + 10, "")], SCHEMA)
    assert run(df) == ({(7, base): 1}, set())


def test_any_key_id_and_instant_counts(spark):
    """Negative ids, the least key, arrivals beyond the year 2100."""
    base = 4_200_000_000_000 - 4_200_000_000_000 % late.HOUR_MS
    least = -(2**63)
    df = spark.createDataFrame([(-5, least, base, base + 1, ""), (-6, None, base, base + 1, ""), (-1, 0, 20 * base, 20 * base + 1, ""), (-7, 3, base, base + 9 * late.HOUR_MS, "")], SCHEMA)
    assert run(df) == ({(least, base): 1, (None, base): 1, (0, 20 * base - 20 * base % late.HOUR_MS): 1}, {(-7, "late")})


def test_a_late_record_corrects_its_count_and_each_revision_is_an_upsert(spark):
    base = 1_740_960_000_000 - 1_740_960_000_000 % late.HOUR_MS
    rows = [(k, 7, base, base + k * 600_000, "") for k in range(8)]
    counts, _ = late.corrected_counts(spark.createDataFrame(rows, SCHEMA), C("key"), C("ev"), C("arr"), C("id"), slices=8)
    got = counts.collect()
    assert [(r.key, r.n) for r in got] == [(7, 8)] and 3 <= got[0].revisions <= 9


def test_a_hot_key_is_a_few_rows_before_the_state(spark):
    rows = spark.range(0, 100_000, 1, 4).select(F.lit(False).alias("control"), "id", F.lit(1).cast("long").alias("key"), (F.lit(1_740_960_000_000) + F.col("id") % 3_600_000).alias("event_ms"), (F.lit(1_740_960_000_000) + F.col("id") % 3_600_000).alias("arrival_ms"))
    assert rows.mapInArrow(late._combine(late.HOUR_MS, late.LATENESS_MS), late.PARTIAL).count() <= 4 * 4


def test_empty(spark):
    assert run(spark.createDataFrame([], SCHEMA)) == ({}, set())
