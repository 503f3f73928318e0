"""Columns that bring the several spellings of one value to a single one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\r\n\x0b\x0c\xa0"


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def folded(c: Column) -> Column:
    """Trimmed and in lower case; null stays null."""
    return F.lower(trimmed(c))


def _floor_div(c: Column, d: int) -> Column:
    return F.floor((c - F.pmod(c, F.lit(d).cast("long"))) / d).cast("long") if d == 1 else F.call_function("div", c - F.pmod(c, F.lit(d).cast("long")), F.lit(d).cast("long"))


def epoch_ms(ts: Column) -> Column:
    """Whole epoch milliseconds, rounded down, of an instant in ns, µs or ms; the magnitude tells the unit."""
    ts = ts.cast("long")
    size = F.abs(ts)
    return F.when(size >= 10**17, _floor_div(ts, 10**6)).when(size >= 10**14, _floor_div(ts, 10**3)).otherwise(ts)


def message_ms(c: Column) -> Column:
    """Epoch milliseconds of a time spelled with or without zone (then UTC), or as digits; null if it cannot be read."""
    t = trimmed(c)
    zoned = F.when(t.rlike(r"(Z|z|[+-]\d{2}:?\d{2})$"), t).otherwise(F.concat(t, F.lit("Z")))
    return F.when(t.rlike(r"^\d{10,19}$"), epoch_ms(t.try_cast("long"))).otherwise(F.unix_millis(zoned.try_cast("timestamp")))


def actor(user: Column, session: Column) -> Column:
    """The user, else the device's session; null where both are missing or placeholders."""
    u, s = folded(user), folded(session)
    return F.coalesce(F.when(~u.isin("", "unknown"), u), F.when(~s.isin("", "sid-0"), s))


def host(c: Column) -> Column:
    """Host in lower case without port and trailing dot; null stays null."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r":\d*$", ""), r"\.$", "")


def path_only(c: Column) -> Column:
    """The target up to the first question mark."""
    return F.substring_index(c, "?", 1)
