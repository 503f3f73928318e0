"""Per-key results by multi-level tree aggregation.

A chunk is an input partition of the stored rows, of the fixed size in which
they are read, and is combined where it is read, before any shuffle; each round
merges the states of ``fan_in`` neighbouring chunks, until one state per key is
left: log_fan_in(chunks) rounds. No reducer receives more than ``fan_in``
partial states of a key, however many rows the key has, and a round's output is
combined again where it lies, before the next shuffle.

The state holds counts, sum, extremes and a histogram of latency in
logarithmic bins (relative width about 9 %), all mergeable exactly, so any
tree gives the same result.

Defined results: of repeated rows of an id one counts; rows without id are
left out; rows whose key has a null part have no key of their own but count in
the total (``key_null``); a null latency counts as a request without latency;
an empty table gives no keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.session import stored

#: Bins of latency: bin b > 0 holds values in [2^((b-1)/8), 2^(b/8)); bin 0 holds values below 1.
BINS_PER_DOUBLING = 8
SUMS = ("n", "errors", "timed", "latency_sum")


def rounds(chunks: int, fan_in: int) -> int:
    """Rounds of merging until one chunk is left, at least one."""
    n = 1
    while chunks > fan_in:
        chunks, n = -(-chunks // fan_in), n + 1
    return n


def tree_aggregate(df: DataFrame, keys: list[str], ident: str, error: Column, latency: Column, fan_in: int = 8) -> DataFrame:
    """keys, n, errors, timed, latency_sum/min/max, hist(bin, n) per combination of keys."""
    value = latency.cast("long")
    once = stored(
        df.where(F.col(ident).isNotNull())
        .groupBy(ident)
        .agg(F.min(F.struct(*keys, error.cast("int").alias("_error"), value.alias("_latency"))).alias("r"))
        .select("r.*"),
        "tree",
    )
    last = once.select(F.spark_partition_id().alias("p")).agg(F.max("p")).first()[0]  # one number
    chunks = 1 + (last or 0)
    lat = F.col("_latency")
    bin_ = F.when(lat < 1, 0).otherwise(F.floor(F.log2(lat) * BINS_PER_DOUBLING).cast("int") + 1)
    level = once.select(
        *keys, F.spark_partition_id().alias("_chunk"), F.when(lat.isNotNull(), bin_).alias("_bin"),
        F.lit(1).cast("long").alias("n"), F.coalesce("_error", F.lit(0)).cast("long").alias("errors"), F.when(lat.isNotNull(), 1).otherwise(0).cast("long").alias("timed"),
        F.coalesce(lat, F.lit(0)).alias("latency_sum"), lat.alias("latency_min"), lat.alias("latency_max"),
    )
    for _ in range(rounds(chunks, fan_in)):
        level = level.withColumn("_chunk", F.call_function("div", F.col("_chunk"), F.lit(fan_in)))
        level = level.groupBy(*keys, "_chunk", "_bin").agg(*(F.sum(c).alias(c) for c in SUMS), F.min("latency_min").alias("latency_min"), F.max("latency_max").alias("latency_max"))
    return level.groupBy(*keys).agg(
        *(F.sum(c).alias(c) for c in SUMS), F.min("latency_min").alias("latency_min"), F.max("latency_max").alias("latency_max"),
        F.sort_array(F.collect_list(F.when(F.col("_bin").isNotNull(), F.struct("_bin", "timed")))).alias("hist"),  # at most some 500 bins a key
    )


def quantile(hist: Column, timed: Column, q: float) -> Column:
    """Upper end of the bin that holds the q-quantile; null without latencies."""
    need = F.ceil(timed * q)
    found = F.aggregate(
        hist, F.struct(F.lit(0).cast("long").alias("seen"), F.lit(-1).alias("bin")),
        lambda a, x: F.struct((a["seen"] + x["timed"]).alias("seen"), F.when((a["bin"] < 0) & (a["seen"] + x["timed"] >= need), x["_bin"]).otherwise(a["bin"]).alias("bin")),
        lambda a: a["bin"],
    )
    return F.when(timed > 0, F.when(found <= 0, F.lit(1.0)).otherwise(F.pow(F.lit(2.0), found / BINS_PER_DOUBLING)))


def heavy_keys(states: DataFrame, keys: list[str], per_cent: float = 1.0) -> DataFrame:
    """Keys with at least ``per_cent`` of all rows, rows without key included in the total."""
    states = stored(states, "states")
    total = states.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()["total"]  # one number
    return states.where(" and ".join(f"`{k}` is not null" for k in keys)).where(F.col("n") * 100 >= F.lit(per_cent) * total)
