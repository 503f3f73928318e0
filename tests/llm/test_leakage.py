import random

from spanforge.llm import leakage
from spanforge.llm.words import words

DOCS, ITEMS = "doc_id long, text string, id long, template string", "item_id long, item_text string, slots string"


def fixture():
    r = random.Random(8)
    names = ["rathe", "quorl", "skelm", "nandor", "vantrel", "tisk"]
    items = [(k, f"Task {1000 + k}: the sensor named {r.choice(names)} sees {r.randrange(9999)} calls on port {r.randrange(9999)} but probe {r.choice(names)} keeps only {r.randrange(9999)} of them before ledger {r.choice(names)} is closed again", "") for k in range(30)]
    filler = "we looked at the dashboard and found nothing unusual in the logs of that day".split()
    docs = []
    for k in range(120):
        body = " ".join(r.choice(filler) for _ in range(40))
        w = r.choice(items)[1].split()
        if k % 3 == 0:
            a = r.randrange(0, len(w) - 14)
            part = " ".join(w[a : a + r.choice([8, 11, 12, 13, 30])])
            body = f"{body} {part.upper() if k % 2 else part.replace(' ', ' ​- ')} {body}"
        docs.append((k, body, 1, "x"))
    docs += [(900, None, 1, ""), (901, "", 1, ""), (902, items[0][1], 1, ""), (902, items[0][1], 1, ""), (903, items[0][1].replace("s", "s­"), 1, ""), (904, "x " * 20_000 + items[1][1], 1, "")]
    return docs, [*items, (50, None, ""), (51, "", ""), (52, "too short", "")]


def brute(docs, items):
    index = {}
    for i, t, *_ in items:
        w = words(t) if t else []
        for k in range(len(w) - 11):
            index.setdefault(tuple(w[k : k + 12]), set()).add(i)
    return {(d, i) for d, t, *_ in docs if t for w in [words(t)] for k in range(len(w) - 11) for i in index.get(tuple(w[k : k + 12]), ())}


def matcher(d, i, *more):
    return leakage.Matcher(d, "doc_id", "text", i, "item_id", "item_text", *more)


def test_all_ways_equal_brute_force(spark):
    docs, items = fixture()
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    want = brute(docs, items)
    assert len(want) > 20
    for ways in ((leakage.BROADCAST_BYTES, leakage.MOST_NAMES), (0, leakage.MOST_NAMES), (leakage.BROADCAST_BYTES, 0)):
        m = matcher(d, i, *ways)
        rows = [(r.doc_id, r.item_id) for r in m.leaked().collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want
        classes, members = m.leaked_classes().collect(), m.window_members().collect()
        assert {(c.doc_id, x.item_id) for c in classes for x in members if c.class_id == x.class_id} == want


def test_names_joined_or_sent_are_the_same(spark):
    docs, items = fixture()
    i = spark.createDataFrame(items, ITEMS)
    names = leakage.slot_names(i, "item_text")
    assert names.count() > 3
    both = [sorted(map(tuple, leakage.windows(i, "item_id", "item_text", names, values=True, most_names=most).collect())) for most in (leakage.MOST_NAMES, 0)]
    assert both[0] == both[1] and len(both[0]) > 400


def test_recall_and_precision_of_planted_variants(spark):
    r = random.Random(5)
    kinds = (
        "A queue of {0} slots drains at {1} per second and is polled by {2} workers so that each of the {2} workers sees at most {0} entries in a full turn of the wheel",
        "Node {0} forwards {1} packets to node {2} while node {2} drops {1} of them and returns an error to node {0} before the next round of the test begins",
        "If a buffer holds {0} bytes and a reader takes {1} bytes every {2} ticks how long until the buffer with {0} bytes is empty and the reader may stop",
    )
    items = [(k, kinds[k % 3].format(*r.sample(range(100, 9000), 3)), "") for k in range(30)]
    docs, want = [], set()
    filler = "nothing was out of the ordinary in the night report of the second shift".split()
    for k in range(60):
        text = kinds[k % 3]
        body = " ".join(r.choice(filler) for _ in range(30))
        if k < 30:  # other values, consistently: a variant of all items of its kind
            docs.append((k, f"{body} {text.format(*r.sample(range(10_000, 90_000), 3))} {body}", 1, ""))
            want |= {(k, i) for i, *_ in items if i % 3 == k % 3}
        elif k < 45:  # the second mention of a value differs: not the same question
            broken = text.replace("{2}", "{2}", 1)
            parts = broken.rsplit("{2}" if k % 3 != 2 else "{0}", 1)
            a, b, c, x = r.sample(range(10_000, 90_000), 4)
            docs.append((k, f"{body} {str(x).join(parts).format(a, b, c)} {body}", 1, ""))
        else:  # word for word: a leak of that item and a variant of the others of its kind
            docs.append((k, f"{body} {items[k - 45][1]} {body}", 1, ""))
            want |= {(k, i) for i, *_ in items if i % 3 == (k - 45) % 3 and i != k - 45}
    m = matcher(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    got = {(x.doc_id, x.item_id) for x in m.variants().collect()}
    assert got == want, (len(got - want), len(want - got))
    assert {x.doc_id for x in m.leaked().collect()} == set(range(45, 60))
    classes, members = m.variant_classes().collect(), m.item_classes().collect()
    assert len({x.class_id for x in members}) == 3 and len(members) == 30
    assert {(c.doc_id, x.item_id) for c in classes for x in members if c.class_id == x.class_id} >= want


def test_words():
    assert words("Ａb­c-d_e ½ ﬁn​e 3rd") == ["abc", "d", "e", "1", "2", "fine", "3rd"]


def test_empty(spark):
    docs, items = fixture()
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    for m in (matcher(d.limit(0), i), matcher(d, i.limit(0))):
        assert m.leaked().count() == 0 and m.variants().count() == 0 and m.variant_classes().count() == 0
