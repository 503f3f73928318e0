"""Candidates the JVM pattern must let through, and digit runs of any length."""

import random
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from spanforge.llm import pii

NAMES = ("José García", "Jürgen Müller signed", "Zoë Branvik", "René Halvik", "J\\u00fcrgen Branvik", "name=%20K.Ostdahl", "%C3%9Cmit%20Branvik", "Call\\n4155550178", "at%3Dcalle%20Mayor, 3", "12bis rue de Larkmoor")
PIECES = (
    "José García", "Łukasz Świst", "K. Ostdahl", "K.Ostdahl", "Roe, Jane", "Ünal,Ö.", "O’Neil Roe", "Anna-Maria Roe", "JANE ROE", "12bis rue de Larkmoor", "5 ALLÉE DE X", "7b, Main street", "TRAVESÍA Mayor 5", "calle Mayor, 3",
    "praça Xa 1", "Millracestraße 11", "Xstr. 5", "415) 555 0178", "(1)) (2)-(3) 4567", "078-05-1120", "1/2/3/4/5/6/7", "ABCPE1234F", "abcpe 1234 f", "a@b.c", "a [at] b.c", "a\n(at)\tb.c", "٣٤٥٦٧٨٩", "12ſ Main street",
    "Ludwig van Beethoven", "MARIA DE LA CRUZ", "Maria de la Cruz", "Иван Петров", "Γιώργος Παππάς", "J. R. Roe", "J.R.Roe", "Roe, J.", "山田太郎", "김민준", "محمد علي", "Unter den Linden 7", "am Markt 5", "Im Alten Hof 3", "Berliner Allee 12", "Lange gracht 3",
    "350 5th Ave", "9 THE Mall", "100 Broadway", "7/9 Elm Close", "ul. Długa 5/7", "УЛИЦА Пушкина, 5", "улица Пушкина, дом 5", "Via Roma 8", "STORGATAN 3", "Vägen 4 ", "Storvägen 4", "8, quai Branly", "Anna\xa0Roe", "O'Neil Roe",
)
GLUE = ("", "x", " ", "_", "=", "&a=", "\n", "/", '"', "-", "7", "é", ",", "; ", "%", "\\", "&", "\xa0", "+")


def _json(c):
    b = c.encode("utf-16-be")
    return "".join(f"\\u{b[i]:02x}{b[i + 1]:02x}" for i in range(0, len(b), 2))


def _encoded(r, t):
    return r.choice((
        lambda: quote(t, safe=""), lambda: quote(t).replace("%20", "+"), lambda: t.replace("\\", "\\\\").replace("/", "\\/").replace("\n", "\\n").replace('"', '\\"'),
        lambda: "".join(_json(c) if not c.isascii() or r.random() < 0.15 else c for c in t), lambda: "".join(f"&#{ord(c)};" if not c.isascii() or r.random() < 0.15 else c for c in t),
        lambda: t.replace("&", "&amp;").replace("'", "&apos;").replace("ß", "&szlig;").replace("@", "&commat;"), lambda: "".join(f"%{ord(c):02x}" if c.isascii() and r.random() < 0.4 else c for c in t),
    ))()


def test_spark_lets_every_candidate_through(spark):
    r, texts = random.Random(7), list(NAMES)
    for _ in range(9000):
        t = r.choice(GLUE) + r.choice(PIECES) + r.choice(GLUE)
        for _ in range(r.randrange(4)):
            t = _encoded(r, t)
        texts.append(t)
    texts = [t for t in texts if pii.candidates(pii.decode(t)[0])]
    assert len(texts) > 4000 and set(NAMES) <= set(texts)
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [x.t for x in df.where(~F.coalesce(pii.hinted(F.col("t")), F.lit(False))).collect()] == []


@pytest.mark.parametrize("text,want", [("10 20 30 40 50 60 70 078-05-1120", ("078-05-1120", "national_id")), ("12 34 56 78 90 11 22 33 415 555 0123", ("415 555 0123", "phone")), ("12-" * 30 + "078-05-1120/7", ("078-05-1120", "national_id"))])
def test_numbers_behind_long_runs_are_candidates(text, want):
    assert want in [(text[a:b], k) for a, b, k, _ in pii.candidates(text)]


def test_long_runs_are_found_in_whole():
    assert pii.redact("10 20 30 40 50 60 70 078-05-1120") == "10 20 30 40 50 60 70 [NATIONAL_ID]"
    assert len(pii.candidates("12 " * 3000 + "x")) < 3000 * 8 * 2
