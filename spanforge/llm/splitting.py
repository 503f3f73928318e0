"""Splitting oversized texts at natural boundaries, in SQL functions only.

A text becomes units, a token of the public wordpunct tokenizer with the blanks
behind it, and a string with one letter a unit for the boundary behind it:
P paragraph, L line, S sentence, C clause, W blank, x none. One regular
expression with bounded quantifiers then consumes that string piece by piece:
its alternatives stand in order of strength, each greedy up to the limit, with
a plain character count as the last resort. Offsets looking back into the piece
before supply the overlap. Everything is linear in the text and stays in the
JVM; a row needs memory for its own units only.

Defined results: a null text has no pieces; a text of at most ``limit`` tokens
is one piece (an empty one a piece of 0 tokens); a size that is not given is
counted; the pieces without their overlaps concatenate to the text, blanks
included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = r"[ \t-\r\x1c-\x1f\x85\p{Z}]"
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_ \t-\r\x1c-\x1f\x85\p{Z}]+"
UNIT = rf"(?:^{BLANK}+)?(?:{TOKEN}){BLANK}*"


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN)).cast("long")


def cut_pattern(limit: int, overlap: int) -> str:
    """Alternatives for the first piece (up to ``limit`` units) and for later ones (``overlap`` fewer)."""

    def ways(most: int, least: int) -> list[str]:
        half = max(least, most // 2)
        strong = [rf".{{{half - 1},{most - 1}}}{b}" for b in "PLS"]
        return [rf".{{1,{most}}}$", *strong, rf".{{{least - 1},{most - 1}}}[PLS]", rf".{{{least - 1},{most - 1}}}C", rf".{{{least - 1},{most - 1}}}W", rf".{{1,{most}}}"]

    first = [f"^(?:{w})" for w in ways(limit, overlap + 1)]
    return "|".join(first + ways(limit - overlap, 1))


def boundary(unit: Column) -> Column:
    """The letter of the boundary behind a unit."""
    core = F.rtrim(unit)
    end = F.right(core, F.lit(1))
    return (
        F.when(unit.contains("\n") | unit.contains("\r"), F.when(unit.rlike(r"(\r\n|\n|\r)[^\S\r\n]*(\r\n|\n|\r)\s*$"), "P").otherwise("L"))
        .when(core == unit, F.when(unit.rlike(rf"{BLANK}$"), "W").otherwise("x"))
        .when(end.isin(".", "!", "?", "…", "。"), "S")
        .when(core.rlike(r"[.!?…][\"')\]»”’]+$"), "S")
        .when(end.isin(",", ";", ":"), "C")
        .otherwise("W")
    )


def split(df: DataFrame, text: str, size: str | None = None, limit: int = 512, overlap: int = 32) -> DataFrame:
    """Each row once a piece: all columns of ``df`` and the struct ``piece``(no, start, end, n_tokens, text).

    ``start`` and ``end`` count tokens from 0; a clash of names is impossible
    but for ``piece``, which replaces a column of that name.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    t = F.col(f"`{text}`")
    n = F.coalesce(F.col(f"`{size}`").cast("long"), token_count(t)) if size else token_count(t)
    whole = F.array(F.struct(F.lit(0).alias("no"), F.lit(0).alias("start"), n.cast("int").alias("end"), n.cast("int").alias("n_tokens"), t.alias("text")))
    small = df.where(t.isNotNull() & (n <= limit)).withColumn("piece", F.explode(whole))
    units, taken, ends = (_free(df, x) for x in ("_units", "_taken", "_ends"))
    big = df.where(t.isNotNull() & (n > limit)).withColumn(units, F.regexp_extract_all(t, F.lit(UNIT), 0))
    big = big.withColumn(taken, F.transform(F.regexp_extract_all(F.array_join(F.transform(units, boundary), ""), F.lit(cut_pattern(limit, overlap)), 0), F.length))
    big = big.withColumn(ends, F.aggregate(taken, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))))

    def piece(_: Column, no: Column) -> Column:
        start = F.greatest(F.lit(0), F.get(F.col(ends), no) - F.when(no > 0, overlap).otherwise(0))
        end = F.get(F.col(ends), no + 1)
        return F.struct(no.alias("no"), start.alias("start"), end.alias("end"), (end - start).alias("n_tokens"), F.array_join(F.slice(units, start + 1, end - start), "").alias("text"))

    big = big.withColumn("piece", F.explode(F.transform(taken, piece))).drop(units, taken, ends)
    return small.unionByName(big)


def _free(df: DataFrame, name: str) -> str:
    """A name no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name
