"""Scope and enrichment by dimension tables.

A dimension is broadcast only if its rows are at most ``BROADCAST_ROWS`` and
their bytes at most ``BROADCAST_BYTES``, which are counted; above either the
planner chooses a shuffle join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20


def small(dimension: DataFrame, most: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    size = F.octet_length(F.to_json(F.struct(*dimension.columns)))
    held = dimension.limit(most + 1).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()  # two numbers
    return F.broadcast(dimension) if held["rows"] <= most and held["bytes"] <= most_bytes else dimension


def one_per_key(dimension: DataFrame, key: str, best: list[Column]) -> DataFrame:
    """The first entry of each key by ``best``, so that a second entry cannot multiply rows."""
    cols = [c for c in dimension.columns if c != key]
    picked = F.min_by(F.struct(*cols), F.struct(*best)).alias("_v")
    return dimension.where(F.col(key).isNotNull()).groupBy(key).agg(picked).select(key, "_v.*")


def containers(dimension: DataFrame) -> DataFrame:
    """One container a cgroup: a resolved one before others, then by id, pod and node."""
    return one_per_key(dimension, "cgroup_id", [F.col("pod_namespace").isNull(), *(F.coalesce(c, F.lit("")) for c in ("container_id", "pod_name", "node_name"))])


def names(dns: DataFrame) -> DataFrame:
    """The latest resolved name of each address."""
    d = dns.where("ip is not null and hostname is not null")
    return d.groupBy("ip").agg(F.max_by("hostname", F.struct("resolved_at", "hostname")).alias("hostname"))


def in_scope(rows: DataFrame, dimension: DataFrame, allowed: list[str]) -> DataFrame:
    """Rows whose resolved namespace is allowed; unresolved rows drop (fail closed)."""
    keep = containers(dimension).where(F.col("pod_namespace").isin(*allowed)).select("cgroup_id")
    return rows.join(small(keep), "cgroup_id", "left_semi")


def with_container(rows: DataFrame, dimension: DataFrame) -> DataFrame:
    return rows.join(small(containers(dimension)), "cgroup_id", "left")


def with_names(rows: DataFrame, dns: DataFrame, source: str = "source_ip", dest: str = "dest_ip") -> DataFrame:
    """source_hostname and dest_hostname, null where nothing is resolved."""
    n = small(names(dns))
    s, d = (n.select(F.col("ip").alias(c), F.col("hostname").alias(o)) for c, o in ((source, "source_hostname"), (dest, "dest_hostname")))
    return rows.join(s, source, "left").join(d, dest, "left")


def blocked(rows: DataFrame, address: Column, rules: list[tuple[str, int]]) -> Column:
    """Whether an address lies in one of a few (network, prefix length) rules."""
    from spanforge.functions.misc import ipv4_number

    out, n = F.lit(False), ipv4_number(address)
    for net, bits in rules:
        base = sum(int(x) << (24 - 8 * k) for k, x in enumerate(net.split(".")))
        mask = (0xFFFFFFFF << (32 - bits)) & 0xFFFFFFFF
        out = out | (n.bitwiseAND(F.lit(mask)) == (base & mask))
    return F.coalesce(out, F.lit(False))


def attributed(rows: DataFrame, exact: DataFrame, thread: DataFrame, on_exact: list[str], on_thread: list[str], value: str) -> DataFrame:
    """``value`` from the exact map, else from the thread's with low confidence (attribution 1, 2, else 0)."""
    e = exact.select(*on_exact, F.col(value).alias("_e")).dropDuplicates(on_exact)
    t = thread.select(*on_thread, F.col(value).alias("_t")).dropDuplicates(on_thread)
    j = rows.join(e, on_exact, "left").join(t, on_thread, "left")
    return j.withColumn(value, F.coalesce("_e", "_t")).withColumn("attribution", F.when(F.col("_e").isNotNull(), 1).when(F.col("_t").isNotNull(), 2).otherwise(0)).drop("_e", "_t")
