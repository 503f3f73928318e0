"""Queries of the general data-processing problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions import normal as N
from spanforge.operators import late, redelivery, sessions, sketch, tree
from spanforge.plans.registry import Registry
from spanforge.session import stored
from spanforge.sources.tables import table

registry = Registry()
query = registry.query

MS_SQL = "CASE WHEN abs(ts_ns) >= 100000000000000000 THEN ts_ns // 1000000 WHEN abs(ts_ns) >= 100000000000000 THEN ts_ns // 1000 ELSE ts_ns END"
MSG_MS_SQL = """CASE WHEN regexp_full_match(trim(message_time), '[0-9]{13}') THEN CAST(trim(message_time) AS BIGINT)
  WHEN regexp_matches(trim(message_time), '(Z|[+-][0-9]{2}:?[0-9]{2})$') THEN epoch_ms(CAST(trim(message_time) AS TIMESTAMPTZ))
  ELSE epoch_ms(CAST(trim(message_time) || 'Z' AS TIMESTAMPTZ)) END"""

SESSIONS_SQL = f"""
WITH e AS (
  SELECT DISTINCT txn_id, {MS_SQL} AS ms,
    coalesce(CASE WHEN lower(trim(user_id)) NOT IN ('', 'unknown') THEN lower(trim(user_id)) END,
             CASE WHEN lower(trim(session_id)) NOT IN ('', 'sid-0') THEN lower(trim(session_id)) END) AS actor
  FROM transactions),
g AS (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY actor ORDER BY ms) <= 1800000 THEN 0 ELSE 1 END AS head FROM e WHERE actor IS NOT NULL AND ms IS NOT NULL),
s AS (SELECT *, sum(head) OVER (PARTITION BY actor ORDER BY ms ROWS UNBOUNDED PRECEDING) AS k FROM g)
"""


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "transactions")
    return sessions.sessionize(t, N.actor(F.col("user_id"), F.col("session_id")), N.epoch_ms(F.col("ts_ns")), F.col("txn_id"))


@query("p1_found", SESSIONS_SQL + "SELECT actor, min(ms) AS start_ms, max(ms) AS end_ms FROM s GROUP BY actor, k")
def p1_found(spark, d):
    return _sessions(spark, d).select("actor", "start_ms", "end_ms")


@query("p1_sessions", SESSIONS_SQL + "SELECT actor, min(ms) AS start_ms, max(ms) AS end_ms, CAST(count(DISTINCT txn_id) AS BIGINT) AS n_events, max(ms) - min(ms) AS duration_ms FROM s GROUP BY actor, k")
def p1_sessions(spark, d):
    return _sessions(spark, d)


ARRIVALS_SQL = f"""
WITH m AS (SELECT delivery_id, {MSG_MS_SQL} AS arrival FROM wire_messages),
r AS (SELECT t.txn_id, min(t.account_id) AS account_id, min({MS_SQL}) AS ms, min(m.arrival) AS arrival
      FROM transactions t LEFT JOIN m USING (delivery_id) GROUP BY t.txn_id),
w AS (SELECT *, ms - ms % 3600000 AS period_ms FROM r)
"""


def _late(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = table(spark, d, "transactions").select("txn_id", "delivery_id", "account_id", N.epoch_ms(F.col("ts_ns")).alias("event_ms"))
    m = table(spark, d, "wire_messages").select("delivery_id", N.message_ms(F.col("message_time")).alias("arrival_ms"))
    return late.corrected_counts(t.join(m, "delivery_id", "left"), F.col("account_id"), F.col("event_ms"), F.col("arrival_ms"), F.col("txn_id"))


@query("p3_found", ARRIVALS_SQL + "SELECT txn_id FROM w WHERE arrival > period_ms + 3600000 + 1200000")
def p3_found(spark, d):
    return _late(spark, d)[1].where("reason = 'late'").select(F.col("id").alias("txn_id"))


@query("p3_counts", ARRIVALS_SQL + "SELECT account_id, period_ms, CAST(count(*) AS BIGINT) AS n FROM w WHERE arrival <= period_ms + 3600000 + 1200000 GROUP BY ALL")
def p3_counts(spark, d):
    return _late(spark, d)[0].select(F.col("key").alias("account_id"), "period_ms", "n")


def identifiers() -> dict:
    user, session = N.folded(F.col("user_id")), N.folded(F.col("session_id"))
    return {"user_id": F.when(~user.isin("", "unknown"), user), "session_id": F.when(~session.isin("", "sid-0"), session), "req_host": N.host(F.col("req_host"))}


def _sketches(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "transactions").select("account_id", "capture_source", "user_id", "session_id", "req_host", F.timestamp_millis(N.epoch_ms(F.col("ts_ns"))).cast("date").alias("day"))
    return sketch.bit_rows(t, ["account_id", "capture_source", "day"], identifiers())


def _grains(sketches: DataFrame, what) -> DataFrame:
    """The estimates of each grain, the coarser ones from merged partial sketches."""
    grains = {"day": ["day"], "account": ["account_id"], "account_source_day": ["account_id", "capture_source", "day"]}
    kinds = {"account_id": "long", "capture_source": "string", "day": "date"}
    parts = []
    for name, by in grains.items():
        part = what(sketches if len(by) == 3 else sketch.merge(sketches, by), by)
        parts.append(part.select(F.lit(name).alias("grain"), *(F.col(c) if c in by else F.lit(None).cast(kinds[c]).alias(c) for c in kinds), *(c for c in part.columns if c not in by)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("p4_distinct")
def p4_distinct(spark, d):
    """Estimates with bounds per day, per account and per account, source and day."""
    return _grains(stored(_sketches(spark, d), "sketches"), sketch.estimate)


@query("p4_sketches")
def p4_sketches(spark, d):
    """The mergeable partial results themselves: touched rows of the bit matrices per account, source and day."""
    return _sketches(spark, d)


EXACT_SQL = f"""
WITH b AS (SELECT account_id, capture_source, CAST(epoch_ms({MS_SQL}) AS DATE) AS day,
    CASE WHEN lower(trim(user_id)) NOT IN ('', 'unknown') THEN lower(trim(user_id)) END AS u,
    CASE WHEN lower(trim(session_id)) NOT IN ('', 'sid-0') THEN lower(trim(session_id)) END AS s,
    regexp_replace(regexp_replace(lower(req_host), ':[0-9]*$', ''), '\\.$', '') AS h FROM transactions),
l AS (SELECT account_id, capture_source, day, 'user_id' AS dimension, u AS v FROM b UNION ALL SELECT account_id, capture_source, day, 'session_id', s FROM b UNION ALL SELECT account_id, capture_source, day, 'req_host', h FROM b)
SELECT 'day' AS grain, NULL::BIGINT AS account_id, NULL AS capture_source, day, dimension, CAST(count(DISTINCT v) AS BIGINT) AS exact, true AS within FROM l WHERE v IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'account', account_id, NULL, NULL::DATE, dimension, CAST(count(DISTINCT v) AS BIGINT), true FROM l WHERE v IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'account_source_day', account_id, capture_source, day, dimension, CAST(count(DISTINCT v) AS BIGINT), true FROM l WHERE v IS NOT NULL GROUP BY ALL
"""


@query("p4_within_bounds", EXACT_SQL)
def p4_within_bounds(spark, d):
    """Exact counts beside the estimates: whether each lies within five standard errors."""
    return p4_checked(spark, d, 5.0, 1.0)


def p4_checked(spark: SparkSession, d: str, errors: float, round_off: float) -> DataFrame:
    est = p4_distinct(spark, d)
    t = table(spark, d, "transactions")
    ids = identifiers()
    base = t.select("account_id", "capture_source", F.timestamp_millis(N.epoch_ms(F.col("ts_ns"))).cast("date").alias("day"), F.explode(F.array(*(F.struct(F.lit(n).alias("dimension"), c.alias("v")) for n, c in ids.items()))).alias("x"))
    base = base.select("account_id", "capture_source", "day", "x.dimension", "x.v").where("v is not null").distinct()
    parts = []
    for name, by in {"day": ["day"], "account": ["account_id"], "account_source_day": ["account_id", "capture_source", "day"]}.items():
        n = base.groupBy(*by, "dimension").agg(F.count_distinct("v").alias("exact"))
        e = est.where(F.col("grain") == name).select(*by, "dimension", "estimate", "std_error")
        on = [n[c].eqNullSafe(e[c]) for c in [*by, "dimension"]]
        within = F.abs(e["estimate"] - n["exact"]) <= errors * e["std_error"] + round_off
        parts.append(n.join(e, on, "left").select(F.lit(name).alias("grain"), *(n[c] if c in by else F.lit(None).cast(k).alias(c) for c, k in (("account_id", "long"), ("capture_source", "string"), ("day", "date"))), n["dimension"], n["exact"], F.coalesce(within, F.lit(False)).alias("within")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("p4_share", "SELECT grain, dimension, CAST(count(*) AS BIGINT) AS n_groups, true AS within FROM (" + EXACT_SQL + ") GROUP BY grain, dimension")
def p4_share(spark, d):
    """The groups of each grain and dimension, and whether at least nine in ten estimates lie within the stated two standard errors of the exact count (19 in 20 are expected; half a unit for rounding)."""
    e = p4_checked(spark, d, 2.0, 0.5)
    return e.groupBy("grain", "dimension").agg(F.count(F.lit(1)).alias("n_groups"), (F.count_if("within") >= 0.9 * F.count(F.lit(1))).alias("within"))


KEYS_SQL = """
WITH t AS (SELECT DISTINCT txn_id, regexp_replace(regexp_replace(lower(req_host), ':[0-9]*$', ''), '\\.$', '') AS host, split_part(req_path, '?', 1) AS path, resp_status, resp_latency_ms FROM transactions WHERE txn_id IS NOT NULL),
k AS (SELECT host, path, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN resp_status = 0 OR resp_status >= 400 THEN 1 ELSE 0 END) AS BIGINT) AS errors, CAST(count(resp_latency_ms) AS BIGINT) AS timed, CAST(coalesce(sum(resp_latency_ms), 0) AS BIGINT) AS latency_sum, min(resp_latency_ms) AS latency_min, max(resp_latency_ms) AS latency_max FROM t GROUP BY host, path)
"""


def _keys(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "transactions").select("txn_id", N.host(F.col("req_host")).alias("host"), N.path_only(F.col("req_path")).alias("path"), "resp_status", "resp_latency_ms")
    error = (F.col("resp_status") == 0) | (F.col("resp_status") >= 400)
    return tree.tree_aggregate(t, ["host", "path"], "txn_id", error, F.col("resp_latency_ms"))


@query("p5_found", KEYS_SQL + "SELECT host, path FROM k WHERE host IS NOT NULL AND path IS NOT NULL AND n * 100 >= (SELECT count(*) FROM t)")
def p5_found(spark, d):
    return tree.heavy_keys(_keys(spark, d), ["host", "path"]).select("host", "path")


@query("p5_keys", KEYS_SQL + "SELECT * FROM k WHERE host IS NOT NULL AND path IS NOT NULL")
def p5_keys(spark, d):
    return _keys(spark, d).where("host is not null and path is not null").drop("hist")


@query("p5_latency")
def p5_latency(spark, d):
    """Median and 99th percentile of latency per key, within a bin (9 %) of the exact value."""
    return p5_latency_states(spark, d).drop("timed")


def p5_latency_states(spark: SparkSession, d: str) -> DataFrame:
    k = _keys(spark, d).where("host is not null and path is not null")
    return k.select("host", "path", "n", "errors", "timed", tree.quantile(F.col("hist"), F.col("timed"), 0.5).alias("p50_ms"), tree.quantile(F.col("hist"), F.col("timed"), 0.99).alias("p99_ms"))


@query("p5_quantiles", KEYS_SQL + "SELECT host, path, timed, true AS within FROM k WHERE host IS NOT NULL AND path IS NOT NULL AND timed > 0")
def p5_quantiles(spark, d):
    """Whether the median and the 99th percentile of each key lie within a bin (9 %) above the exact ones."""
    k = p5_latency_states(spark, d)
    t = table(spark, d, "transactions").where("txn_id is not null").select("txn_id", N.host(F.col("req_host")).alias("h"), N.path_only(F.col("req_path")).alias("p"), "resp_latency_ms").dropDuplicates(["txn_id"])
    exact = t.where("resp_latency_ms is not null").groupBy("h", "p").agg(*(F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY resp_latency_ms)").alias(n) for n, q in (("e50", 0.5), ("e99", 0.99))))
    j = k.join(exact, (k["host"] == exact["h"]) & (k["path"] == exact["p"]))
    within = lambda est, x: (F.col(est) >= F.col(x)) & (F.col(est) <= F.greatest(F.lit(1.0), F.col(x) * 1.0906))
    return j.select("host", "path", "timed", (within("p50_ms", "e50") & within("p99_ms", "e99")).alias("within"))


def _message_id() -> list:
    return [N.folded(F.col("tenant_id")), F.col("msg_sequence"), N.message_ms(F.col("message_time"))]


KEPT_SQL = f"""
WITH r AS (SELECT delivery_id, row_number() OVER (PARTITION BY lower(trim(tenant_id)), msg_sequence, {MSG_MS_SQL} ORDER BY received_at, delivery_id) AS k FROM wire_messages)
"""


@query("p7_found", KEPT_SQL + "SELECT delivery_id FROM r WHERE k > 1")
def p7_found(spark, d):
    m = table(spark, d, "wire_messages")
    return redelivery.superfluous(m, _message_id(), F.col("received_at"), F.col("delivery_id")).select(F.col("delivery").alias("delivery_id"))


@query("p7_kept", KEPT_SQL + "SELECT delivery_id FROM r WHERE k = 1")
def p7_kept(spark, d):
    m = table(spark, d, "wire_messages")
    return redelivery.survivors(m, _message_id(), F.col("received_at"), F.col("delivery_id")).select(F.col("delivery").alias("delivery_id"))


@query("p7_transactions", KEPT_SQL + "SELECT txn_id, min(delivery_id) AS delivery_id FROM transactions WHERE delivery_id IN (SELECT delivery_id FROM r WHERE k = 1) GROUP BY txn_id")
def p7_transactions(spark, d):
    """One copy of each transaction that came with a kept delivery."""
    kept = p7_kept(spark, d)
    t = table(spark, d, "transactions").select("txn_id", "delivery_id").where("txn_id is not null")
    return t.join(kept, "delivery_id", "left_semi").groupBy("txn_id").agg(F.min("delivery_id").alias("delivery_id"))


@query("p7_incremental", KEPT_SQL + "SELECT delivery_id FROM r WHERE k = 1")
def p7_incremental(spark, d):
    """The same survivors in two steps: what the earlier half of the times of receipt kept, then the later messages, and those without time, admitted against it."""
    m = table(spark, d, "wire_messages")
    span = m.agg(F.min("received_at").alias("a"), F.max("received_at").alias("b")).first()  # two instants
    cut = F.lit(span.a + (span.b - span.a) / 2 if span.a is not None else None).cast("timestamp_ntz")
    old, new = m.where(F.col("received_at") < cut), m.where(F.coalesce(F.col("received_at") >= cut, F.lit(True)))
    kept = redelivery.survivors(old, _message_id(), F.col("received_at"), F.col("delivery_id"))
    seen = m.join(kept, m["delivery_id"] == kept["delivery"], "left_semi")
    return redelivery.admit(new, seen, _message_id(), F.col("received_at"), F.col("delivery_id")).unionByName(kept).select(F.col("delivery").alias("delivery_id"))
