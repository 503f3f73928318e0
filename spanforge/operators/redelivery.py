"""Exactly one copy of messages delivered at least once.

Identifiers are counted first, by a 64-bit hash that is combined before the
shuffle, and those that occur more than once are stored: the *marks*. A
delivery without a mark is the only one of its message and passes directly;
only marked ones are ranked, by the least (received, delivery) of each exact
identifier, which is an aggregate and so never brings a group together in one
task; both are united. Two identifiers of one hash are both marked and ranked
apart, so a collision costs a rank and changes nothing.

Up to ``MOST_SENT`` marks go to every executor and split the deliveries where
they are read; beyond it the marks meet them in a shuffled join, of which the
planner splits a hot key. Both ways give the same rows. New messages are
deduplicated against stored ones by the same rule, with the stored survivor
ahead of any new delivery.

Defined results: parts of an identifier may be null and null equals null;
physically repeated rows of one delivery are one delivery; a null time of
receipt ranks last; rows without delivery id are left out; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.session import stored

#: Marks that are broadcast at most, 8 bytes each.
MOST_SENT = 1_000_000


def _rows(messages: DataFrame, ident: list[Column], received: Column, delivery: Column) -> tuple[DataFrame, list[str]]:
    keys = [c.alias(f"k{i}") for i, c in enumerate(ident)]
    rows = messages.where(delivery.isNotNull()).select(F.xxhash64(*ident).alias("h"), *keys, received.alias("received"), delivery.alias("delivery"))
    return rows, [f"k{i}" for i in range(len(ident))]


def marks(rows: DataFrame, most_sent: int = MOST_SENT) -> DataFrame:
    """Hashes of the identifiers that occur more than once, each once."""
    repeated = stored(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "marks")
    return F.broadcast(repeated) if repeated.limit(most_sent + 1).count() <= most_sent else repeated


def _ranked(again: DataFrame, names: list[str]) -> DataFrame:
    """The first delivery by rank of each repeated identifier."""
    rank = F.struct(F.col("received").isNull().alias("late"), F.col("received"), F.col("delivery"))
    return again.groupBy(*names).agg(F.min(rank).alias("first")).select(*names, F.col("first.delivery").alias("delivery"))


def _kept(messages: DataFrame, ident: list[Column], received: Column, delivery: Column, most_sent: int) -> tuple[DataFrame, list[str]]:
    rows, names = _rows(messages, ident, received, delivery)
    m = marks(rows, most_sent)
    single = rows.join(m, "h", "left_anti").select(*names, "delivery")
    return single.unionByName(_ranked(rows.join(m, "h", "left_semi"), names)), names


def survivors(messages: DataFrame, ident: list[Column], received: Column, delivery: Column, most_sent: int = MOST_SENT) -> DataFrame:
    """The one delivery of each identifier that is kept: singletons as they are, of repeated ones the first by rank."""
    return _kept(messages, ident, received, delivery, most_sent)[0].select("delivery")


def superfluous(messages: DataFrame, ident: list[Column], received: Column, delivery: Column, most_sent: int = MOST_SENT) -> DataFrame:
    """All deliveries but the survivors, once each: of the repeated identifiers those not ranked first.

    The difference is taken on the delivery id, which is unique, so it has no
    skew even if one message makes up a third of all deliveries.
    """
    rows, names = _rows(messages, ident, received, delivery)
    again = rows.join(marks(rows, most_sent), "h", "left_semi")
    return again.select("delivery").distinct().join(_ranked(again, names).select("delivery"), "delivery", "left_anti")


def admit(new: DataFrame, kept: DataFrame, ident: list[Column], received: Column, delivery: Column, most_sent: int = MOST_SENT) -> DataFrame:
    """Deliveries of ``new`` to keep, given the survivors ``kept`` so far (same columns): the first of each identifier not kept yet."""
    fresh, names = _kept(new, ident, received, delivery, most_sent)
    seen = kept.select(*(c.alias(n) for c, n in zip(ident, names)), F.lit(0).alias("turn"), F.lit(None).cast("long").alias("delivery"))
    both = seen.unionByName(fresh.select(*names, F.lit(1).alias("turn"), "delivery"))
    return both.groupBy(*names).agg(F.min(F.struct("turn", "delivery")).alias("first")).where("first.turn = 1").select("first.delivery")
