import pytest
import regex

from spanforge.llm import pii, pii_train

SCHEMA = "txn_id long, req_body string, req_path string, req_query map<string,string>, req_headers map<string,string>, id string, field string"

CASES = [
    ("Please send it to Jane.Roe+x@mail.example.org.", {"email"}), ("to=jane%2Broe%40mail.example.org&x=1", {"email"}), ("jane [at] example.org", {"email"}), ("build kit@1.2.30 pinned", set()), ("Ping @ops now", set()),
    ("Call back on (415) 555-0178 after lunch.", {"phone"}), ("phone=%2B1%20%28415%29%20555-0156", {"phone"}), ("tel\x1f+14155550100", {"phone"}), ("Ring 0049-30-23125-926 please", {"phone"}), ("window 2025-03-04 10:21 closed", set()), ("Tracking 123-45-040 is internal.", set()),
    ("SSN on file: 478-13-5337.", {"national_id"}), ("ssn=081%2034%202072", {"national_id"}), ("KYC document ABCPE1234F accepted.", {"national_id"}), ("part 123-45-678", set()),
    ("Leave it at 12b Fernhollow Lane.", {"street_address"}), ("street\x1fPlaza%20Saltmarsh%2C%20200", {"street_address"}), ('{"a":"Lieferung an Millracestra\\u00dfe 11, Hinterhof."}', {"street_address"}), ("96, rue de Larkmoor", {"street_address"}), ("Gate 33 Street View tile missing.", set()), ("Lane 5 closure, detour 29.", set()),
    ("Dear Oksana M. Kelenko, your parcel is on the way.", {"person_name"}), ("customer=Nils+Selado-Oraga&qty=2", {"person_name"}), ("/lookup/Ulf%20Marridge", {"person_name"}), ("Regards, K. Ostdahl", {"person_name"}), ("Jordan Valley depot, dock 49.", set()), ("Grace Period ends soon.", set()), ("Pallet 1 waits at gate B. Invoice line 2 shows a gap.", set()), ("Summer Sale, week 31.", set()),
    ("", set()), ("%zz %", set()),
]


@pytest.mark.parametrize("text,want", CASES)
def test_kinds(text, want):
    assert {k for _, _, k in pii.find(text)} == want


def test_check_digit_decides():
    from spanforge.llm.pii_train import Maker

    m = Maker(3)
    assert {k for _, _, k in pii.find(f"id no. {m.aadhaar(True)} is")} == {"national_id"}
    assert {k for _, _, k in pii.find(f"order no. {m.aadhaar(False)} is")} == set()


def test_redaction_keeps_all_else():
    assert pii.redact("Spoke with Hiro Glassen about the delay; mail jane@example.org.") == "Spoke with [PERSON_NAME] about the delay; mail [EMAIL]."
    assert pii.redact("addr=Plaza%20Saltmarsh%2C%20200&q=%C3%A9") == "addr=[STREET_ADDRESS]&q=%C3%A9"
    assert pii.redact("Moved to 136, rue de Larkmoor last month. At 110 Windle Road. Next") == "Moved to [STREET_ADDRESS] last month. At [STREET_ADDRESS]. Next"
    assert pii.redact(None) is None and pii.redact("") == ""
    long = "Parcel 12 left the hub. " * 20_000
    assert pii.redact(long) == long


def test_decoding_remembers_places():
    for raw in ("a%20b", "x\\u00e9y", "&amp;&#64;z", "%25C3%25A9", "%2525252540", "&amp;amp;amp;lt;x", "a%252525", "\\ud83d\\ude00!", "a+b", "+49", "plain"):
        text, at = pii.decode(raw)
        if at is not None:
            assert len(at) == len(text) + 1 and at[0] == 0 and at[-1] == len(raw) and all(a <= b for a, b in zip(at, at[1:]))
    assert pii.decode("%" + "25" * 2000 + "40z")[0] == "@z" and pii.decode("&" + "amp;" * 2000 + "lt;")[0] == "<"
    assert pii.decode("R%25C3%25BCck")[0] == "Rück" and pii.decode("a+b")[0] == "a b" and pii.decode("x=+49")[0] == "x=+49" and pii.decode("j+r@e.org")[0] == "j+r@e.org"


def test_every_candidate_passes_the_first_pattern():
    """Texts of the training maker, raw and encoded: what Python finds the JVM pattern lets through."""
    from urllib.parse import quote

    p, hint = regex.compile(pii.CANDIDATE), regex.compile(pii.HINT)
    m = pii_train.Maker(11)
    for _ in range(800):
        t, _ = m.sentence()
        for raw in (t, quote(t), quote(t).replace("%20", "+"), quote(quote(t))):
            if pii.find(raw):
                assert p.search(raw) and hint.search(raw), raw


def test_best_segmentation_is_the_best_of_all():
    spans = [(0, 5, "a", ["a:x"]), (3, 8, "b", ["b:x"]), (5, 9, "a", ["a:y"]), (8, 12, "b", ["b:y"]), (0, 12, "c", ["c:x"])]
    w = {"a:x": 1.0, "b:x": 2.5, "a:y": 1.0, "b:y": 1.0, "c:x": 3.0}

    def best(k, free):
        if k == len(spans):
            return 0.0
        skip = best(k + 1, free)
        a, b, _, f = spans[k]
        if all(b <= x or y <= a for x, y in free):
            return max(skip, w[f[0]] + best(k + 1, [*free, (a, b)]))
        return skip

    assert sum(w[s[3][0]] for s in spans if s[:3] in pii.viterbi(spans, w)) == best(0, []) == 3.5
    z, p, _ = pii.marginals(spans[:2], {"a:x": 0.0, "b:x": 0.0})
    assert abs(z - 1.0986) < 1e-3 and all(abs(x - 1 / 3) < 1e-9 for x in p)


def test_neighbours_score_as_a_pair():
    """Sums and the best segmentation against all segmentations, with scores between types."""
    import math
    import random
    from itertools import combinations

    r = random.Random(4)
    for _ in range(60):
        spans = []
        for _ in range(5):
            a = r.randrange(24)
            spans.append((a, a + r.randint(1, 6), r.choice("ab"), [r.choice("ab") + ":x"]))
        spans = [(a, b, k, [f"{k}:x"]) for a, b, k, _ in dict.fromkeys((a, b, k, 0) for a, b, k, _ in spans)]
        w = {"a:x": r.uniform(-1, 2), "b:x": r.uniform(-1, 2)} | {pii.link(x, y): r.uniform(-2, 2) for x in "ab" for y in "ab"}
        ways = []
        for n in range(len(spans) + 1):
            for some in combinations(range(len(spans)), n):
                s = sorted((spans[i] for i in some), key=lambda x: (x[1], x[0]))
                if all(x[1] <= y[0] for x, y in zip(s, s[1:])):
                    ways.append((sum(w[x[3][0]] for x in s) + sum(w[pii.link(x[2], y[2])] for x, y in zip(s, s[1:]) if y[0] - x[1] <= pii.CLOSE), some))
        z, p, _ = pii.marginals(spans, w)
        assert abs(z - math.log(sum(math.exp(v) for v, _ in ways))) < 1e-9
        for i in range(len(spans)):
            assert abs(p[i] - sum(math.exp(v - z) for v, some in ways if i in some)) < 1e-9
        best = pii.viterbi(spans, w)
        got = sum(w[f"{k}:x"] for _, _, k in best) + sum(w[pii.link(x[2], y[2])] for x, y in zip(best, best[1:]) if y[0] - x[1] <= pii.CLOSE)
        assert abs(got - max(v for v, _ in ways)) < 1e-9


def test_held_out_accuracy_and_training_again():
    from spanforge.llm.pii_weights import WEIGHTS

    for k, (precision, recall) in pii_train.evaluate(WEIGHTS, pii_train.Maker(123, 1), 800).items():
        assert precision > 0.85 and recall > 0.85, k
    again, _ = pii_train.train(2500, 4)
    assert all(r > 0.8 for _, r in pii_train.evaluate(again, pii_train.Maker(5, 1), 400).values())


def test_tables(spark):
    rows = [(1, "Dear Ulf Marridge, hi", "/lookup/x@example.org?y=1", {"tel": "+14155550100", "Ulf Marridge": "v"}, {"host": "h", "from": "a@example.org"}, "", ""), (2, None, None, None, None, "", ""), (3, "", "/", {}, {"x": None}, "", ""), (None, "a@example.org", "/", {}, {}, "", "")]
    df = spark.createDataFrame([*rows, rows[0]], SCHEMA)
    got = [(r.txn_id, r.field, r.pii_type) for r in pii.found(df).collect()]
    want = {(1, "body", "person_name"), (1, "path", "email"), (1, "query", "phone"), (1, "query", "person_name"), (1, "headers", "email")}
    assert len(got) == len(set(got)) and set(got) == want
    red = {r.id: r for r in pii.redacted(df).collect()}
    assert red[1].req_body == "Dear [PERSON_NAME], hi" and red[1].req_path == "/lookup/[EMAIL]?y=1" and red[1].req_query == {"tel": "[PHONE]", "[PERSON_NAME]": "v"} and red[1].req_headers == {"host": "h", "from": "[EMAIL]"}
    assert red[2].req_body is None and red[2].req_query is None and red[3].req_headers == {"x": None} and pii.redacted(df).count() == 5
    assert pii.found(df.limit(0)).count() == 0 and pii.redacted(df.limit(0)).count() == 0
