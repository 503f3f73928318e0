"""Counters, rates and their exposition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counters(rows: DataFrame, named: dict[str, Column]) -> DataFrame:
    """One pass: a row (metric, value) per named condition."""
    one = rows.agg(*(F.count_if(c).alias(n) for n, c in named.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(f"`{n}`").alias("value")) for n in named))).alias("m")).select("m.*")


def by_label(rows: DataFrame, label: str) -> DataFrame:
    return rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def drop_rate_bps(dropped: Column, captured: Column) -> Column:
    return F.when(captured > 0, F.call_function("div", dropped * 10000, captured)).otherwise(F.lit(0).cast("long"))


def exposition(metrics: DataFrame, prefix: str = "engine_") -> DataFrame:
    """Lines of the text format for scraping."""
    return metrics.select(F.concat(F.lit(prefix), "metric", F.lit(" "), F.col("value").cast("string")).alias("line"))
