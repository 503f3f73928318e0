import random
import re

import pytest

from spanforge.llm import splitting

TOKEN = re.compile(r"\w+|[^\w\s]+")
UNIT = re.compile(r"(?:^\s+)?(?:\w+|[^\w\s]+)\s*")
SCHEMA = "id long, text string, n long, no int, start string, _units string"


def texts():
    r = random.Random(6)
    words = ["alpha", "b2_x", "naïve", "日本", "don't", "x.", "end!\n\n", "line\r\n", "clause,", "...", "—", "ﬁ", "½"]
    out = [" ".join(r.choice(words) for _ in range(r.choice([3, 40, 200, 900]))) for _ in range(25)]
    return [*out, "", " \n ", None, "x" * 20_000, "a" * 3 + "." * 9000, "\n\n".join(["word " * 30] * 60), "  lead " + "w " * 700 + "  trail  ", "a\u0085b\x1cc " * 300]


def pieces(spark, rows, **kw):
    df = spark.createDataFrame([(k, t, None, 1, "s", "u") for k, t in enumerate(rows)], SCHEMA)
    out = {}
    for r in splitting.split(df, "text", "n", **kw).collect():
        out.setdefault(r.id, []).append(r.piece)
    return {k: sorted(v, key=lambda p: p.no) for k, v in out.items()}


@pytest.mark.parametrize("limit,overlap", [(512, 32), (50, 7), (10, 0), (3, 2)])
def test_pieces_cover_the_text_within_the_limit(spark, limit, overlap):
    rows = texts()
    got = pieces(spark, rows, limit=limit, overlap=overlap)
    assert set(got) == {k for k, t in enumerate(rows) if t is not None}
    for k, ps in got.items():
        tokens = TOKEN.findall(rows[k])
        assert ps[0].start == 0 and ps[-1].end == len(tokens)
        joined = ps[0].text
        for p in ps:
            assert p.n_tokens <= limit and TOKEN.findall(p.text) == tokens[p.start : p.end]
        for a, b in zip(ps, ps[1:]):
            assert a.end - b.start == overlap and b.no == a.no + 1
            joined += "".join(UNIT.findall(b.text)[overlap:])
        assert joined == rows[k]


def test_natural_boundaries_come_first(spark):
    text = ("One two three. " * 50).strip() + "\n\n" + "Four five six, " * 100
    first = pieces(spark, [text], limit=300, overlap=10)[0][0]
    assert first.text.endswith("\n\n")
    sentence = pieces(spark, ["One two three four. " * 200], limit=103, overlap=3)[0]
    assert all(p.text.rstrip().endswith(".") for p in sentence)


def test_counts_and_empty_table(spark):
    rows = [t for t in texts() if t is not None]
    df = spark.createDataFrame([(t,) for t in rows], "text string")
    assert [r[0] for r in df.select(splitting.token_count(df.text)).collect()] == [len(TOKEN.findall(t)) for t in rows]
    assert splitting.split(spark.createDataFrame([], SCHEMA), "text", "n").count() == 0
    with pytest.raises(ValueError):
        splitting.split(df, "text", limit=5, overlap=5)
