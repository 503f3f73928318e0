import random

from pyspark.sql import functions as F

from spanforge.llm import truncation as T

TX = "txn_id long, capture_source string, direction string, req_headers map<string,string>, req_body string, words string, a string"
CH = "txn_id long, direction byte, flags int, actual_len long, copied_len long"
SENTENCES = ["Parcel {} left the hub.", "Quote {} expired before checkout.", "Slot {} is blocked for cleaning.", "Rack {} needs a new sensor."]


def corpus():
    r = random.Random(9)
    rows = []
    for k in range(900):
        body = " ".join(r.choice(SENTENCES).format(r.randrange(9999)) for _ in range(r.randrange(2, 7)))
        rows.append((k, r.choice(["x", "y"]), "incoming", {"content-type": "text/plain"}, body, "", ""))
    return rows


def judge(spark, rows, chunks=()):
    return {r.txn_id: r for r in T.judged(spark.createDataFrame(rows, TX), spark.createDataFrame(list(chunks), CH)).collect()}


def row(k, body, headers=None, direction="incoming"):
    return (k, "x", direction, {"content-type": "text/plain"} if headers is None else headers, body, "", "")


def test_endings_that_are_only_found_inside_are_cut(spark):
    cut = ["Rack 17 needs a new", "Slot 5 is blocked for clea", "Quote 3 expired before checkout. Parc", "Parcel 12 left the hub. Slot 9 is block…"]
    whole = ["Rack 17 needs a new sensor.", "Slot 5 is blocked for cleaning."]
    got = judge(spark, corpus() + [row(10_000 + k, b) for k, b in enumerate(cut)] + [row(20_000 + k, b) for k, b in enumerate(whole)])
    assert all(got[10_000 + k].by_text and got[10_000 + k].cut for k in range(len(cut)))
    assert not any(got[20_000 + k].cut for k in range(len(whole)))
    assert sum(r.cut for k, r in got.items() if k < 10_000) == 0


def test_headers_syntax_and_chunks(spark):
    j, x = {"content-type": "application/json; charset=utf-8"}, {"content-type": "application/xml"}
    rows = [
        row(1, "abc", {"content-length": "9"}), row(2, "é", {"content-length": "2"}), row(3, "abc", {"content-length": "wrong"}), row(4, '{"a":{"b":1}', j), row(5, '{"a":1,"a":2}', j), row(6, "[1,2", j), row(7, "[1,2]", j),
        row(8, "<r><a>x</a></r>", x), row(9, "<r><a>x</a>", x), row(10, "<r/>", x), row(11, None), row(12, ""), row(13, "ok"), row(14, "ok", None, "outgoing"), row(15, "ok", {}), (None, "x", "incoming", {}, "ok", "", ""), row(16, "ok"), row(16, "ok"), (17, None, None, None, "ok", "", ""),
    ]
    chunks = [(13, 0, 1, 5, 5), (14, 0, 1, 5, 5), (15, 0, 0, 9, 5), (16, 0, 2, 9, 0), (12, 0, None, 9, None), (None, 0, 1, 1, 1), (11, 0, 1, 9, 1), (77, 0, 1, 9, 1)]
    got = judge(spark, rows, chunks)
    assert {k for k, r in got.items() if r.cut} == {1, 4, 6, 9, 13, 15}
    assert 11 not in got and 77 not in got and None not in got and got[1].by_header and got[13].by_chunk and got[4].by_syntax


def test_a_met_length_overrules_the_text(spark):
    got = judge(spark, corpus() + [row(10_000, "Rack 17 needs a new", {"content-type": "text/plain", "content-length": "19"})])
    assert not got[10_000].cut


def test_rates_and_empty(spark):
    r = T.rates(T.judged(spark.createDataFrame([row(1, "abc", {"content-length": "9"}), row(2, "abc", {})], TX), spark.createDataFrame([], CH))).first()
    assert (r.bodies, r.n_cut, r.rate) == (2, 1, 0.5)
    assert judge(spark, []) == {}
    assert T.plain(F.lit("a+b%2"), F.lit(True)) is not None


def test_very_long_and_form_texts(spark):
    form = {"content-type": "application/x-www-form-urlencoded"}
    rows = corpus() + [row(10_000, "word " * 50_000), row(10_001, "memo=Parcel+1+left+the+hub.&q=%C3", form), row(10_002, "%", form), row(10_003, "memo=Slot+9+is+blocked+for+clea", form)]
    got = judge(spark, rows)
    assert {10_000, 10_001, 10_002, 10_003} <= set(got) and got[10_003].by_text


def test_words_are_cut_to_the_lengths_of_ends_only(spark):
    """A run of letters costs its own length, not its square."""
    run = "x" * 50_000
    counts = spark.createDataFrame([("a", "b", run, 9, 0), ("a", "b", "xxx", 0, 1), ("a", "b", "xy", 0, 2), ("c", "d", run, 5, 0)], "a string, b string, c string, inside long, terminal long")
    got = {(r.a, r.b, r.c): (r.inside, r.terminal) for r in T.endings(counts).collect()}
    assert got == {("a", "b", "xxx"): (9, 1), ("a", "b", "xy"): (0, 2)}


def test_the_bound_tends_to_the_share(spark):
    df = spark.createDataFrame([(1, 50), (1, 150), (20, 1000), (20_000, 1_000_000), (80_000, 1_000_000)], "hits long, n long")
    got = [r[0] for r in df.select(T.upper_share(F.col("hits"), F.col("n"))).collect()]
    assert got[0] > 0.05 > got[1] > 0.02 and got[2] < 0.04 and abs(got[3] - 0.02) < 0.001 and got[4] > 0.05
