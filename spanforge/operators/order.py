"""Sequence numbers, incarnations, frozen roles, eviction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.session import stored


def sequence_numbers(rows: DataFrame, by: list[str], order: list[str], name: str = "seq") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def gaps(rows: DataFrame, by: list[str], seq: str) -> DataFrame:
    """Rows behind a gap in the sequence, with the number of missing ones."""
    w = Window.partitionBy(*by).orderBy(seq)
    return rows.withColumn("missing", F.col(seq) - F.lag(seq).over(w) - 1).where("missing > 0")


def incarnations(rows: DataFrame, by: list[str], order: list[str], close: Column) -> DataFrame:
    """Number of closes before each row, and first sight of each incarnation."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    g = rows.withColumn("generation", F.coalesce(F.sum(close.cast("long")).over(w), F.lit(0)))
    return g.withColumn("born", F.min(order[0]).over(Window.partitionBy(*by, "generation")))


def frozen_role(rows: DataFrame, by: list[str], order: list[str], role: Column) -> DataFrame:
    """The first confident role so far; rows before it stay null."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("role", F.first(role, ignorenulls=True).over(w))


def newest(rows: DataFrame, order: list[Column], keep: int) -> DataFrame:
    """The newest ``keep`` rows; the sort keeps the top of each partition only."""
    return rows.orderBy(*order).limit(keep)


def streaks(rows: DataFrame, by: list[str], order: list[str], failed: Column) -> DataFrame:
    """Runs of consecutive failures: by, length, first and last place.

    The rows are stored in ranges of (by, order), so a group of any size lies in
    many tasks. Each range numbers its own rows and successes; what came before
    it in its group is a running sum over the ranges, one row each. A run is the
    failures behind the same number of successes, and so is merged across the
    borders of ranges by an ordinary aggregate.
    """
    r = rows.select(*by, *(c for c in order if c not in by), failed.cast("long").alias("_f"))
    r = stored(r.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = r.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_rows"), F.sum(1 - F.col("_f")).alias("_good"))
    sizes = sizes.select(*(F.col(c).alias(f"_by_{c}") for c in by), F.col("_range").alias("_at"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_good").over(before), F.lit(0)).alias("_g0"))
    inside = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = r.withColumn("_n", F.count(F.lit(1)).over(inside)).withColumn("_g", F.sum(1 - F.col("_f")).over(inside)).where("_f = 1")
    on = F.col("_range") == F.col("_at")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    own = own.join(sizes, on).withColumns({"_n": F.col("_n") + F.col("_n0"), "_g": F.col("_g") + F.col("_g0")})
    return own.groupBy(*by, "_g").agg(F.count(F.lit(1)).alias("length"), F.min("_n").cast("int").alias("first"), F.max("_n").cast("int").alias("last")).drop("_g")
