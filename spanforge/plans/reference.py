"""Queries of the engine's own operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions import detect, http, identity, labels, misc, redact, tokens
from spanforge.functions.normal import epoch_ms
from spanforge.operators import enrich, metrics, order, pairing, wire
from spanforge.plans.registry import Registry
from spanforge.sources.tables import table

registry = Registry()
query = registry.query
KEY = tokens.TEST_KEY
CONN = ["pid", "ssl_ptr", "proc_start_ns", "conn_generation"]
MS = "CASE WHEN abs(ts_ns) >= 100000000000000000 THEN ts_ns // 1000000 WHEN abs(ts_ns) >= 100000000000000 THEN ts_ns // 1000 ELSE ts_ns END"


def q_in(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def any_sql(text: str, words) -> str:
    lit = lambda w: "'" + w.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return "(" + " OR ".join(f"contains(lower({text}), {lit(w)})" for w in words) + ")"


# ---------------------------------------------------------------- pairing

FIFO_SQL = """
WITH e AS (SELECT event_id, user_id, ts, CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE -1 END AS s FROM events WHERE event_type IN ('view', 'click', 'purchase', 'error')),
d AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS d FROM e),
m AS (SELECT *, min(d) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM d),
u AS (SELECT *, s = -1 AND d < least(coalesce(pm, 0), 0) AS unpaired FROM m),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id, s, unpaired ORDER BY ts, event_id) AS rn FROM u),
p AS (SELECT q.user_id, q.event_id AS request_id, r.event_id AS response_id, (epoch_us(q.ts) // 1000) AS request_ms, CASE WHEN r.ts IS NOT NULL THEN greatest(0, (epoch_us(r.ts) // 1000) - (epoch_us(q.ts) // 1000)) END AS latency_ms
      FROM k q LEFT JOIN k r ON q.user_id = r.user_id AND q.rn = r.rn AND r.s = -1 AND NOT r.unpaired WHERE q.s = 1)
"""


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_type in ('view', 'click', 'purchase', 'error')")
    e = e.select("event_id", "user_id", "ts", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), F.col("event_type").isin("view", "click").alias("q"))
    return pairing.fifo(e, ["user_id"], ["ts", "event_id"], F.col("q"))


@query("fifo_pairing", FIFO_SQL + "SELECT user_id, request_id, response_id, CAST(latency_ms AS BIGINT) AS latency_ms FROM p WHERE response_id IS NOT NULL")
def fifo_pairing(spark, d):
    return pairing.pairs(_ranked(spark, d), ["user_id"], "event_id", "ms").where("response_id is not null").drop("request_ms")


@query("unpaired_responses", FIFO_SQL + "SELECT user_id, event_id FROM u WHERE unpaired")
def unpaired_responses(spark, d):
    return _ranked(spark, d).where("_unpaired").select("user_id", "event_id")


@query("incomplete_outcomes", FIFO_SQL + "SELECT request_id, CASE WHEN (SELECT max((epoch_us(ts) // 1000)) FROM e) - request_ms >= 300000 THEN 'no_response_observed' ELSE 'sensor_shutdown' END AS outcome FROM p WHERE response_id IS NULL")
def incomplete_outcomes(spark, d):
    ranked = _ranked(spark, d)
    now = ranked.agg(F.max("ms").alias("m")).first()["m"]
    p = pairing.pairs(ranked, ["user_id"], "event_id", "ms").where("response_id is null")
    return p.select("request_id", pairing.outcome(F.col("response_id"), F.col("request_ms"), F.lit(now), F.lit(False)).alias("outcome"))


@query("keyed_pairing", """
WITH l AS (SELECT l_orderkey, max_by(l_linenumber, l_linenumber) AS l_linenumber, max_by(l_shipdate, (l_linenumber, l_shipdate)) AS l_shipdate FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey AS stream, o_custkey AS request_id, CAST(l_linenumber AS INT) AS response_id, CAST(CASE WHEN l_shipdate IS NOT NULL THEN greatest(0, (epoch_us(l_shipdate) // 1000) - (epoch_us(o_orderdate) // 1000)) END AS BIGINT) AS latency_ms FROM orders LEFT JOIN l ON o_orderkey = l_orderkey""")
def keyed_pairing(spark, d):
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    q = table(spark, d, "orders").select(F.col("o_orderkey").alias("stream"), F.col("o_custkey").alias("request_id"), ms("o_orderdate").alias("t"), F.lit(0).alias("_at"))
    r = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("stream"), F.col("l_linenumber").alias("response_id"), ms("l_shipdate").alias("u"), F.struct("l_linenumber", "l_shipdate").alias("_at"))
    return pairing.keyed(q, r, ["stream"]).select("stream", "request_id", "response_id", F.when(F.col("u").isNotNull(), F.greatest(F.lit(0).cast("long"), F.col("u") - F.col("t"))).alias("latency_ms"))


@query("close_connections", """
WITH k AS (SELECT DISTINCT pid, ssl_ptr, proc_start_ns, conn_generation FROM chunks), c AS (SELECT DISTINCT pid, ssl_ptr, proc_start_ns, generation FROM closes)
SELECT k.* FROM c JOIN k ON c.pid = k.pid AND c.ssl_ptr = k.ssl_ptr AND ((c.proc_start_ns = k.proc_start_ns AND c.generation = k.conn_generation) OR (c.proc_start_ns = 0 AND c.generation = 0))""")
def close_connections(spark, d):
    k = table(spark, d, "chunks").select(*CONN).distinct()
    c = table(spark, d, "closes").select("pid", "ssl_ptr", "proc_start_ns", "generation").distinct()
    return pairing.close_matches(c, k).select(*(F.col(f"k.{x}") for x in CONN))


@query("missing_closes", """
SELECT k.* FROM (SELECT DISTINCT pid, ssl_ptr, proc_start_ns, conn_generation FROM chunks) k
WHERE NOT EXISTS (SELECT 1 FROM closes c WHERE c.pid = k.pid AND c.ssl_ptr = k.ssl_ptr AND c.proc_start_ns = k.proc_start_ns AND c.generation = k.conn_generation)""")
def missing_closes(spark, d):
    k = table(spark, d, "chunks").select(*CONN).distinct()
    return k.join(table(spark, d, "closes").withColumnRenamed("generation", "conn_generation"), CONN, "left_anti")


@query("ttl_sessions", """
WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 300000000 THEN 0 ELSE 1 END AS head FROM events),
s AS (SELECT *, sum(head) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, (epoch_us(min(ts)) // 1000) AS start_ms, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, k""")
def ttl_sessions(spark, d):
    e = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("at", "300 seconds").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.unix_millis("w.start").alias("start_ms"), "n")


# ---------------------------------------------------------------- order

@query("sequence_numbers", f"SELECT chunk_id, CAST(row_number() OVER (PARTITION BY pid, ssl_ptr, conn_generation, direction ORDER BY dir_seq, chunk_id) - 1 AS INT) AS seq FROM (SELECT DISTINCT * FROM chunks)")
def sequence_numbers(spark, d):
    c = table(spark, d, "chunks").distinct()
    return order.sequence_numbers(c, ["pid", "ssl_ptr", "conn_generation", "direction"], ["dir_seq", "chunk_id"]).select("chunk_id", "seq")


@query("sequence_gaps", """
WITH c AS (SELECT DISTINCT pid, ssl_ptr, proc_start_ns, conn_generation, direction, dir_seq FROM chunks), g AS (SELECT *, dir_seq - lag(dir_seq) OVER (PARTITION BY pid, ssl_ptr, proc_start_ns, conn_generation, direction ORDER BY dir_seq) - 1 AS missing FROM c)
SELECT pid, ssl_ptr, proc_start_ns, conn_generation, direction, dir_seq, missing FROM g WHERE missing > 0""")
def sequence_gaps(spark, d):
    c = table(spark, d, "chunks").select(*CONN, "direction", "dir_seq").distinct()
    return order.gaps(c, [*CONN, "direction"], "dir_seq")


@query("connection_incarnation", f"""
WITH r AS (SELECT DISTINCT pid, ssl_ptr, {MS} AS ms, 0 AS is_close, conn_generation AS g FROM chunks UNION ALL SELECT DISTINCT pid, ssl_ptr, {MS}, 1, generation FROM closes),
n AS (SELECT *, coalesce(sum(is_close) OVER (PARTITION BY pid, ssl_ptr ORDER BY ms, is_close, g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS generation FROM r)
SELECT pid, ssl_ptr, CAST(generation AS BIGINT) AS generation, min(ms) AS born, CAST(count(*) AS BIGINT) AS n FROM n GROUP BY pid, ssl_ptr, generation""")
def connection_incarnation(spark, d):
    c = table(spark, d, "chunks").select("pid", "ssl_ptr", epoch_ms(F.col("ts_ns")).alias("ms"), F.lit(0).alias("is_close"), F.col("conn_generation").alias("g")).distinct()
    e = table(spark, d, "closes").select("pid", "ssl_ptr", epoch_ms(F.col("ts_ns")).alias("ms"), F.lit(1).alias("is_close"), F.col("generation").alias("g")).distinct()
    r = order.incarnations(c.unionByName(e), ["pid", "ssl_ptr"], ["ms", "is_close", "g"], F.col("is_close"))
    return r.groupBy("pid", "ssl_ptr", "generation").agg(F.min("born").alias("born"), F.count(F.lit(1)).alias("n"))


@query("role_freeze", f"""
SELECT chunk_id, CAST(first_value(CASE WHEN role_hint IN (1, 2) THEN role_hint END IGNORE NULLS) OVER (PARTITION BY pid, ssl_ptr, proc_start_ns, conn_generation ORDER BY {MS}, chunk_id ROWS UNBOUNDED PRECEDING) AS TINYINT) AS role FROM (SELECT DISTINCT * FROM chunks)""")
def role_freeze(spark, d):
    c = table(spark, d, "chunks").distinct().withColumn("ms", epoch_ms(F.col("ts_ns")))
    return order.frozen_role(c, CONN, ["ms", "chunk_id"], F.when(F.col("role_hint").isin(1, 2), F.col("role_hint"))).select("chunk_id", "role")


@query("oldest_eviction", f"""
WITH l AS (SELECT pid, ssl_ptr, proc_start_ns, conn_generation, max({MS}) AS last_seen FROM chunks GROUP BY ALL)
SELECT * FROM l ORDER BY last_seen DESC, pid, ssl_ptr, proc_start_ns, conn_generation LIMIT 1000""")
def oldest_eviction(spark, d):
    """The 1,000 connections seen last, which stay when older ones are evicted (a top-k report)."""
    last = table(spark, d, "chunks").groupBy(*CONN).agg(F.max(epoch_ms(F.col("ts_ns"))).alias("last_seen"))
    return order.newest(last, [F.desc("last_seen"), *(F.col(c) for c in CONN)], 1000)


@query("bounded_store", "SELECT delivery_id, received_at FROM wire_messages ORDER BY received_at DESC, delivery_id DESC LIMIT 500")
def bounded_store(spark, d):
    """The newest 500 deliveries (a top-k report)."""
    return order.newest(table(spark, d, "wire_messages").select("delivery_id", "received_at"), [F.desc("received_at"), F.desc("delivery_id")], 500)


@query("failure_streaks", """
WITH t AS (SELECT capture_source, CASE WHEN resp_status = 0 OR resp_status >= 500 THEN 1 ELSE 0 END AS f, row_number() OVER (PARTITION BY capture_source ORDER BY observed_at, txn_id, delivery_id) AS n FROM transactions),
g AS (SELECT *, sum(1 - f) OVER (PARTITION BY capture_source ORDER BY n ROWS UNBOUNDED PRECEDING) AS g FROM t)
SELECT capture_source, CAST(count(*) AS BIGINT) AS length, CAST(min(n) AS INT) AS first, CAST(max(n) AS INT) AS last FROM g WHERE f = 1 GROUP BY capture_source, g.g""")
def failure_streaks(spark, d):
    t = table(spark, d, "transactions").select("capture_source", "observed_at", "txn_id", "delivery_id", "resp_status")
    return order.streaks(t, ["capture_source"], ["observed_at", "txn_id", "delivery_id"], F.coalesce((F.col("resp_status") == 0) | (F.col("resp_status") >= 500), F.lit(False)))


# ---------------------------------------------------------------- aggregation

@query("protocol_counts", "SELECT protocol, CAST(count(*) AS BIGINT) AS n FROM transactions GROUP BY protocol")
def protocol_counts(spark, d):
    return metrics.by_label(table(spark, d, "transactions"), "protocol")


@query("counters", """
SELECT 'captured' AS metric, CAST(count(*) AS BIGINT) AS value FROM chunks UNION ALL SELECT 'truncated', CAST(count(*) FILTER (WHERE flags & 1 <> 0 OR actual_len > copied_len) AS BIGINT) FROM chunks
UNION ALL SELECT 'role_ambiguous', CAST(count(*) FILTER (WHERE role_hint NOT IN (1, 2)) AS BIGINT) FROM chunks UNION ALL SELECT 'abi_mismatch', CAST(count(*) FILTER (WHERE abi_version <> 2) AS BIGINT) FROM chunks
UNION ALL SELECT 'undecoded', CAST(count(*) FILTER (WHERE txn_id IS NULL) AS BIGINT) FROM chunks""")
def counters(spark, d):
    c = F.col
    return metrics.counters(table(spark, d, "chunks"), {
        "captured": F.lit(True), "truncated": labels.truncated(c("flags"), c("actual_len"), c("copied_len")), "role_ambiguous": ~c("role_hint").isin(1, 2), "abi_mismatch": c("abi_version") != 2, "undecoded": c("txn_id").isNull()})


@query("metric_lines", "SELECT 'engine_' || metric || ' ' || CAST(value AS VARCHAR) AS line FROM (SELECT 'transactions' AS metric, count(*) AS value FROM transactions UNION ALL SELECT 'incomplete', count(*) FILTER (WHERE outcome IS NOT NULL) FROM transactions)")
def metric_lines(spark, d):
    return metrics.exposition(metrics.counters(table(spark, d, "transactions"), {"transactions": F.lit(True), "incomplete": F.col("outcome").isNotNull()}))


@query("percpu_sum", "SELECT tid % 16 AS cpu, CAST(count(*) AS BIGINT) AS events, CAST(sum(data_len) AS BIGINT) AS bytes FROM chunks GROUP BY 1")
def percpu_sum(spark, d):
    return table(spark, d, "chunks").groupBy((F.col("tid") % 16).alias("cpu")).agg(F.count(F.lit(1)).alias("events"), F.sum("data_len").alias("bytes"))


@query("drop_rate", "SELECT provider_id, CAST(count(*) AS BIGINT) AS captured, CAST(count(*) FILTER (WHERE txn_id IS NULL) AS BIGINT) AS dropped, CAST(count(*) FILTER (WHERE txn_id IS NULL) * 10000 // count(*) AS BIGINT) AS bps FROM chunks GROUP BY provider_id")
def drop_rate(spark, d):
    g = table(spark, d, "chunks").groupBy("provider_id").agg(F.count(F.lit(1)).alias("captured"), F.count_if(F.col("txn_id").isNull()).alias("dropped"))
    return g.withColumn("bps", metrics.drop_rate_bps(F.col("dropped"), F.col("captured")))


@query("gauges", f"SELECT provider_id, CAST(count(DISTINCT (pid, ssl_ptr, proc_start_ns, conn_generation)) AS BIGINT) AS connections, max({MS}) AS heartbeat, CAST(sum(copied_len) * 100 // 134217728 AS BIGINT) AS buffer_pct FROM chunks GROUP BY provider_id")
def gauges(spark, d):
    return table(spark, d, "chunks").groupBy("provider_id").agg(F.count_distinct(F.struct(*CONN)).alias("connections"), F.max(epoch_ms(F.col("ts_ns"))).alias("heartbeat"), F.call_function("div", F.sum("copied_len") * 100, F.lit(134217728)).alias("buffer_pct"))


SIZE_SQL = " + ".join(f"coalesce(strlen({c}), 0)" for c in ("protocol", "req_method", "req_path", "req_scheme", "req_host", "req_body", "source_ip", "dest_ip", "user_id", "user_role", "session_id", "auth_session_id", "outcome")) + " + " + " + ".join(
    f"coalesce(list_sum(list_transform(map_entries({m}), lambda e: strlen(e.key) + coalesce(strlen(e.value), 0) + 48)), 0)" for m in ("req_headers", "req_query"))


@query("event_sizes", f"SELECT txn_id, delivery_id, CAST({SIZE_SQL} AS BIGINT) AS bytes FROM transactions")
def event_sizes(spark, d):
    return table(spark, d, "transactions").select("txn_id", "delivery_id", wire.size_estimate().alias("bytes"))


@query("ingest_summary", """
SELECT lower(trim(tenant_id)) AS tenant, CAST(count(*) AS BIGINT) AS batches, CAST(sum(n_events) AS BIGINT) AS events, CAST(count(*) FILTER (WHERE policy_version IS NULL) AS BIGINT) AS rejected, max(CASE WHEN policy_version IS NULL THEN received_at END) AS last_rejection FROM wire_messages GROUP BY 1""")
def ingest_summary(spark, d):
    bad = F.col("policy_version").isNull()
    return table(spark, d, "wire_messages").groupBy(F.lower(F.trim("tenant_id")).alias("tenant")).agg(F.count(F.lit(1)).alias("batches"), F.sum("n_events").cast("long").alias("events"), F.count_if(bad).alias("rejected"), F.max(F.when(bad, F.col("received_at"))).alias("last_rejection"))


# ---------------------------------------------------------------- scope and enrichment

CONTAINER_SQL = "(SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY cgroup_id ORDER BY pod_namespace IS NULL, coalesce(container_id, ''), coalesce(pod_name, ''), coalesce(node_name, '')) AS rn FROM containers WHERE cgroup_id IS NOT NULL) WHERE rn = 1)"
NAMES_SQL = "(SELECT ip, hostname FROM (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY resolved_at DESC, hostname DESC) AS rn FROM dns WHERE hostname IS NOT NULL AND ip IS NOT NULL) WHERE rn = 1)"


@query("scope_semi_join", f"SELECT txn_id, delivery_id FROM transactions JOIN {CONTAINER_SQL} c USING (cgroup_id) WHERE c.pod_namespace IN ('identity', 'shop')")
def scope_semi_join(spark, d):
    return enrich.in_scope(table(spark, d, "transactions").select("txn_id", "delivery_id", "cgroup_id"), table(spark, d, "containers"), ["identity", "shop"]).select("txn_id", "delivery_id")


@query("scope_counts", f"SELECT CASE WHEN c.pod_namespace IS NULL THEN 'unresolved' WHEN c.pod_namespace IN ('identity', 'shop') THEN 'in_scope' ELSE 'out_of_scope' END AS scope, CAST(count(*) AS BIGINT) AS n FROM transactions LEFT JOIN {CONTAINER_SQL} c USING (cgroup_id) GROUP BY 1")
def scope_counts(spark, d):
    j = enrich.with_container(table(spark, d, "transactions").select("cgroup_id"), table(spark, d, "containers"))
    return j.groupBy(F.when(F.col("pod_namespace").isNull(), "unresolved").when(F.col("pod_namespace").isin("identity", "shop"), "in_scope").otherwise("out_of_scope").alias("scope")).agg(F.count(F.lit(1)).alias("n"))


@query("container_enrichment", f"SELECT txn_id, delivery_id, c.container_id, c.pod_name, c.pod_namespace, c.service_name, c.node_name FROM transactions LEFT JOIN {CONTAINER_SQL} c USING (cgroup_id)")
def container_enrichment(spark, d):
    return enrich.with_container(table(spark, d, "transactions").select("txn_id", "delivery_id", "cgroup_id"), table(spark, d, "containers")).select("txn_id", "delivery_id", "container_id", "pod_name", "pod_namespace", "service_name", "node_name")


@query("hostname_enrichment", f"SELECT txn_id, delivery_id, s.hostname AS source_hostname, e.hostname AS dest_hostname FROM transactions t LEFT JOIN {NAMES_SQL} s ON t.source_ip = s.ip LEFT JOIN {NAMES_SQL} e ON t.dest_ip = e.ip")
def hostname_enrichment(spark, d):
    return enrich.with_names(table(spark, d, "transactions").select("txn_id", "delivery_id", "source_ip", "dest_ip"), table(spark, d, "dns")).select("txn_id", "delivery_id", "source_hostname", "dest_hostname")


RULES = [("10.60.0.0", 19), ("10.60.81.0", 24)]
IP_SQL = "(CAST(split_part({0}, '.', 1) AS BIGINT) * 16777216 + CAST(split_part({0}, '.', 2) AS BIGINT) * 65536 + CAST(split_part({0}, '.', 3) AS BIGINT) * 256 + CAST(split_part({0}, '.', 4) AS BIGINT))"


@query("cidr_block", "SELECT txn_id, delivery_id FROM transactions WHERE regexp_full_match(dest_ip, '[0-9]+(\\.[0-9]+){3}') AND (" + " OR ".join(f"({IP_SQL.format('dest_ip')} & {(0xFFFFFFFF << (32 - b)) & 0xFFFFFFFF}) = {sum(int(x) << (24 - 8 * k) for k, x in enumerate(n.split('.')))}" for n, b in RULES) + ")")
def cidr_block(spark, d):
    t = table(spark, d, "transactions").select("txn_id", "delivery_id", "dest_ip")
    return t.where(enrich.blocked(t, F.col("dest_ip"), RULES)).select("txn_id", "delivery_id")


@query("tuple_attribution", """
WITH e AS (SELECT pid, ssl_ptr, min(src_ip4) AS v FROM chunks WHERE src_ip4 IS NOT NULL AND attribution = 1 GROUP BY ALL), t AS (SELECT pid, tid, min(src_ip4) AS v FROM chunks WHERE src_ip4 IS NOT NULL GROUP BY ALL)
SELECT c.chunk_id, coalesce(e.v, t.v) AS src_ip4, CASE WHEN e.v IS NOT NULL THEN 1 WHEN t.v IS NOT NULL THEN 2 ELSE 0 END AS attribution FROM (SELECT DISTINCT chunk_id, pid, tid, ssl_ptr FROM chunks) c LEFT JOIN e ON c.pid = e.pid AND c.ssl_ptr = e.ssl_ptr LEFT JOIN t ON c.pid = t.pid AND c.tid = t.tid""")
def tuple_attribution(spark, d):
    c = table(spark, d, "chunks")
    known = c.where("src_ip4 is not null")
    exact = known.where("attribution = 1").groupBy("pid", "ssl_ptr").agg(F.min("src_ip4").alias("src_ip4"))
    thread = known.groupBy("pid", "tid").agg(F.min("src_ip4").alias("src_ip4"))
    return enrich.attributed(c.select("chunk_id", "pid", "tid", "ssl_ptr").distinct(), exact, thread, ["pid", "ssl_ptr"], ["pid", "tid"], "src_ip4").select("chunk_id", "src_ip4", "attribution")


@query("owner_lookup", "WITH o AS (SELECT ssl_ptr, min(pid) AS owner FROM chunks GROUP BY ssl_ptr) SELECT c.ssl_ptr, c.generation, c.ts_ns, o.owner FROM (SELECT DISTINCT ssl_ptr, generation, ts_ns FROM closes) c LEFT JOIN o USING (ssl_ptr)")
def owner_lookup(spark, d):
    owner = table(spark, d, "chunks").groupBy("ssl_ptr").agg(F.min("pid").alias("owner"))
    return table(spark, d, "closes").select("ssl_ptr", "generation", "ts_ns").distinct().join(owner, "ssl_ptr", "left")


# ---------------------------------------------------------------- sets

@query("union_sources", f"SELECT 'chunk' AS source, pid, ssl_ptr, ts_ns FROM chunks UNION ALL SELECT 'close', pid, ssl_ptr, ts_ns FROM closes")
def union_sources(spark, d):
    c, e = (table(spark, d, t).select(F.lit(n).alias("source"), "pid", "ssl_ptr", "ts_ns") for t, n in (("chunks", "chunk"), ("closes", "close")))
    return c.unionByName(e)


@query("dedup_first_seen", "SELECT min(doc_id) AS doc_id, md5(text) AS identity FROM documents GROUP BY md5(text)")
def dedup_first_seen(spark, d):
    """One row per identity, the first seen."""
    return table(spark, d, "documents").groupBy(F.md5(F.encode("text", "UTF-8")).alias("identity")).agg(F.min("doc_id").alias("doc_id"))


@query("new_since_last", "SELECT DISTINCT src_ip4 AS ip FROM chunks WHERE src_ip4 IS NOT NULL AND src_ip4 NOT IN (SELECT ip FROM dns WHERE hostname IS NOT NULL)")
def new_since_last(spark, d):
    """Addresses without a name yet, each once."""
    t = table(spark, d, "chunks").select(F.col("src_ip4").alias("ip")).where("ip is not null").distinct()
    return t.join(table(spark, d, "dns").where("hostname is not null").select("ip"), "ip", "left_anti")


@query("pending_lookups", "SELECT DISTINCT cgroup_id FROM chunks WHERE cgroup_id IS NOT NULL AND cgroup_id NOT IN (SELECT cgroup_id FROM containers WHERE cgroup_id IS NOT NULL AND pod_namespace IS NOT NULL)")
def pending_lookups(spark, d):
    c = table(spark, d, "chunks").select("cgroup_id").where("cgroup_id is not null").distinct()
    return c.join(table(spark, d, "containers").where("pod_namespace is not null").select("cgroup_id"), "cgroup_id", "left_anti")


@query("distinct_chunks", "SELECT DISTINCT * FROM chunks")
def distinct_chunks(spark, d):
    return table(spark, d, "chunks").dropDuplicates()


# ---------------------------------------------------------------- HTTP columns

@query("url_split", """
SELECT txn_id, delivery_id, split_part(req_path, '?', 1) AS path, CASE WHEN strpos(req_path, '?') > 0 THEN substr(req_path, strpos(req_path, '?') + 1) ELSE '' END AS query FROM transactions""")
def url_split(spark, d):
    return table(spark, d, "transactions").select("txn_id", "delivery_id", http.path_of(F.col("req_path")).alias("path"), http.query_of(F.col("req_path")).alias("query"))


@query("query_parameters", """
WITH t AS (SELECT DISTINCT req_path FROM transactions WHERE strpos(req_path, '?') > 0), p AS (SELECT req_path, unnest(string_split(substr(req_path, strpos(req_path, '?') + 1), '&')) AS kv, generate_subscripts(string_split(substr(req_path, strpos(req_path, '?') + 1), '&'), 1) AS i FROM t),
k AS (SELECT req_path, split_part(kv, '=', 1) AS key, CASE WHEN strpos(kv, '=') > 0 THEN substr(kv, strpos(kv, '=') + 1) ELSE '' END AS value, i FROM p WHERE kv <> '')
SELECT req_path AS target, key, max_by(value, i) AS value FROM k GROUP BY req_path, key""")
def query_parameters(spark, d):
    t = table(spark, d, "transactions").select(F.col("req_path").alias("target")).where("instr(target, '?') > 0").distinct()
    return t.select("target", F.explode(http.query_map(F.col("target"))))


@query("wire_query", """
SELECT txn_id, delivery_id, CASE WHEN strpos(req_path, '?') > 0 AND substr(req_path, strpos(req_path, '?') + 1) <> '' THEN substr(req_path, strpos(req_path, '?') + 1)
  ELSE coalesce(array_to_string(list_transform(list_sort(map_entries(req_query)), lambda e: CASE WHEN e.value = '' THEN e.key ELSE e.key || '=' || e.value END), '&'), '') END AS query FROM transactions""")
def wire_query(spark, d):
    return table(spark, d, "transactions").select("txn_id", "delivery_id", http.wire_query(F.col("req_path"), F.col("req_query")).alias("query"))


@query("api_id", """
WITH t AS (SELECT DISTINCT req_method, req_path, coalesce(req_method, '') || ':' || coalesce(req_path, '') AS x FROM transactions)
SELECT req_method, req_path, CAST(greatest(1, list_reduce(list_transform(range(1, CAST(len(hex(encode(x))) // 2 + 1 AS BIGINT)), lambda k: CAST(('0x' || substr(hex(encode(x)), 2 * k - 1, 2)) AS BIGINT)), lambda a, b: (a * 33 + b) & 4294967295, 5381::BIGINT) & 2147483647) AS BIGINT) AS api_id FROM t""")
def api_id(spark, d):
    return table(spark, d, "transactions").select("req_method", "req_path").distinct().withColumn("api_id", http.api_id(F.col("req_method"), F.col("req_path")))


@query("named_headers", """
SELECT txn_id, delivery_id, coalesce(req_headers['user-agent'], '') AS user_agent, coalesce(TRY_CAST(req_headers['content-length'] AS BIGINT), 0) AS content_length, coalesce(req_headers['content-type'], '') AS content_type, coalesce(req_headers['x-request-id'], '') AS request_id FROM transactions""")
def named_headers(spark, d):
    h = F.col("req_headers")
    return table(spark, d, "transactions").select("txn_id", "delivery_id", F.coalesce(h["user-agent"], F.lit("")).alias("user_agent"), http.content_length(h).alias("content_length"), F.coalesce(h["content-type"], F.lit("")).alias("content_type"), F.coalesce(h["x-request-id"], F.lit("")).alias("request_id"))


@query("extra_headers", f"""
SELECT txn_id, delivery_id, CAST(coalesce(len(list_filter(map_keys(req_headers), lambda k: k NOT IN ({q_in(http.REQUEST_HEADERS)}))), 0) AS INT) AS n, coalesce(array_to_string(list_sort(list_filter(map_keys(req_headers), lambda k: k NOT IN ({q_in(http.REQUEST_HEADERS)}))), ','), '') AS names FROM transactions""")
def extra_headers(spark, d):
    keys = F.array_sort(F.json_object_keys(http.extra_headers(F.col("req_headers"))))
    return table(spark, d, "transactions").select("txn_id", "delivery_id", F.size(keys).alias("n"), F.array_join(keys, ",").alias("names"))


@query("body_base64", "SELECT txn_id, delivery_id, CASE WHEN length(req_body) > 0 THEN base64(encode(req_body)) END AS body, CAST(coalesce(strlen(req_body), 0) AS INT) AS body_length FROM transactions")
def body_base64(spark, d):
    return table(spark, d, "transactions").select("txn_id", "delivery_id", http.base64_text(F.col("req_body")).alias("body"), F.coalesce(F.octet_length("req_body"), F.lit(0)).alias("body_length"))


PREVIEW_SQL = """
WITH h AS (SELECT doc_id, text, strlen(text) AS n, CASE WHEN strlen(text) > 8192 THEN substr(hex(encode(text)), 1, 16384) END AS h FROM documents),
c AS (SELECT *, regexp_replace(h, '^((?:..)*?)(?:C[2-9A-F]|D[0-9A-F]|E[0-9A-F](?:[89AB][0-9A-F])?|F[0-4](?:[89AB][0-9A-F]){0,2})$', '\\1') AS whole FROM h),
p AS (SELECT doc_id, CASE WHEN n <= 8192 THEN text ELSE decode(from_hex(whole)) || CASE WHEN whole <> h THEN chr(65533) ELSE '' END END AS p FROM c)
SELECT doc_id, CAST(coalesce(length(p), 0) AS INT) AS n, CASE WHEN p <> '' THEN p END AS preview FROM p
"""


@query("body_preview", PREVIEW_SQL)
def body_preview(spark, d):
    """The first 8,192 bytes of every text, a character cut at the border replaced; null for empty and null texts."""
    p = http.preview(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.length(p), F.lit(0)).alias("n"), F.when(p != "", p).alias("preview"))


HEAD_SQL = "req_method || ' ' || req_path || ' HTTP/1.1' || chr(13) || chr(10) || 'Host: ' || coalesce(req_host, 'none') || chr(13) || chr(10) || 'X-Tag: a' || chr(13) || chr(10) || 'x-tag:  b ' || chr(13) || chr(10) || 'Content-Length: ' || coalesce(strlen(req_body), 0) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(req_body, '')"


def _heads(spark, d):
    t = table(spark, d, "transactions")
    head = F.concat(F.col("req_method"), F.lit(" "), F.col("req_path"), F.lit(" HTTP/1.1\r\nHost: "), F.coalesce("req_host", F.lit("none")), F.lit("\r\nX-Tag: a\r\nx-tag:  b \r\nContent-Length: "), F.coalesce(F.octet_length("req_body"), F.lit(0)).cast("string"), F.lit("\r\n\r\n"), F.coalesce("req_body", F.lit("")))
    return t.select("txn_id", "delivery_id", head.alias("head"))


@query("header_parse", "SELECT txn_id, delivery_id, coalesce(req_host, 'none') AS host, 'a, b' AS tag, CAST(coalesce(strlen(req_body), 0) AS VARCHAR) AS content_length, 3 AS n FROM transactions")
def header_parse(spark, d):
    h = http.parse_headers(F.col("head"))
    t = _heads(spark, d).select("txn_id", "delivery_id", h.alias("h"))
    return t.select("txn_id", "delivery_id", F.col("h")["host"].alias("host"), F.col("h")["x-tag"].alias("tag"), F.col("h")["content-length"].alias("content_length"), F.size("h").alias("n"))


@query("head_parse", f"SELECT txn_id, delivery_id, CASE WHEN req_method IN ({q_in(http.METHODS)}) AND req_path NOT LIKE '% %' THEN 'request' END AS kind, CASE WHEN req_method IN ({q_in(http.METHODS)}) AND req_path NOT LIKE '% %' THEN req_path END AS target FROM transactions")
def head_parse(spark, d):
    return _heads(spark, d).select("txn_id", "delivery_id", http.parse_head(F.col("head")).alias("p")).select("txn_id", "delivery_id", "p.kind", "p.target")


@query("body_framing", """
SELECT txn_id, delivery_id, CASE WHEN req_headers['transfer-encoding'] IS NOT NULL AND req_headers['content-length'] IS NOT NULL THEN 'error'
 WHEN req_headers['transfer-encoding'] IS NOT NULL THEN CASE WHEN trim(list_extract(string_split(lower(req_headers['transfer-encoding']), ','), -1)) = 'chunked' THEN 'chunked' ELSE 'error' END
 WHEN req_headers['content-length'] IS NOT NULL THEN CASE WHEN regexp_full_match(trim(req_headers['content-length']), '[0-9]{1,18}') THEN 'length:' || CAST(CAST(trim(req_headers['content-length']) AS BIGINT) AS VARCHAR) ELSE 'error' END ELSE 'none' END AS framing FROM transactions""")
def body_framing(spark, d):
    return table(spark, d, "transactions").select("txn_id", "delivery_id", http.body_framing(F.col("req_headers"), F.lit(False)).alias("framing"))


# ---------------------------------------------------------------- labels and predicates

@query("usable_requests", f"SELECT txn_id, delivery_id FROM transactions WHERE req_method IN ({q_in(http.METHODS)}) AND length(req_path) > 0")
def usable_requests(spark, d):
    t = table(spark, d, "transactions")
    return t.where(http.usable_request(t["req_method"], t["req_path"])).select("txn_id", "delivery_id")


@query("final_responses", "SELECT txn_id, delivery_id, resp_status FROM transactions WHERE NOT coalesce(resp_status BETWEEN 100 AND 199 AND resp_status <> 101, false)")
def final_responses(spark, d):
    t = table(spark, d, "transactions")
    return t.where(~http.interim(t["resp_status"])).select("txn_id", "delivery_id", "resp_status")


@query("request_direction", """
WITH p AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'GET /x HTTP/1.1' WHEN 1 THEN 'HTTP/1.1 200 OK' WHEN 2 THEN 'PRI * HTTP/2.0' ELSE 'binary' END AS prefix, CAST(o_custkey % 2 AS TINYINT) AS direction, CAST(o_custkey % 3 AS TINYINT) AS role FROM orders)
SELECT o_orderkey, CAST(CASE WHEN prefix LIKE 'PRI%' THEN direction WHEN prefix LIKE 'HTTP/1.%' THEN 1 - direction WHEN prefix LIKE 'GET %' THEN direction WHEN role = 1 THEN 0 WHEN role = 2 THEN 1 END AS TINYINT) AS request_direction, (prefix LIKE 'GET %' OR prefix LIKE 'HTTP/1.%') AS starts FROM p""")
def request_direction(spark, d):
    k = F.col("o_orderkey") % 5
    prefix = F.when(k == 0, "GET /x HTTP/1.1").when(k == 1, "HTTP/1.1 200 OK").when(k == 2, "PRI * HTTP/2.0").otherwise("binary")
    o = table(spark, d, "orders").select("o_orderkey", prefix.alias("prefix"), (F.col("o_custkey") % 2).cast("byte").alias("direction"), (F.col("o_custkey") % 3).cast("byte").alias("role"))
    return o.select("o_orderkey", labels.request_direction(F.col("prefix"), F.col("direction"), F.col("role")).alias("request_direction"), http.starts_message(F.col("prefix")).alias("starts"))


@query("l7_labels", """
SELECT txn_id, delivery_id, CASE lower(protocol) WHEN 'http/2' THEN 'HTTP2' WHEN 'http/3' THEN 'HTTP3' WHEN 'grpc' THEN 'GRPC' WHEN 'websocket' THEN 'WebSocket' WHEN 'quic' THEN 'QUIC' WHEN 'mcp' THEN 'MCP' ELSE 'HTTP11' END AS l7,
 CASE WHEN protocol ILIKE 'grpc%' THEN 'grpc' WHEN protocol ILIKE 'websocket' THEN 'websocket' WHEN protocol IN ('QUIC', 'HTTP/3') THEN 'quic' ELSE 'rest' END AS proto FROM transactions""")
def l7_labels(spark, d):
    p = F.col("protocol")
    return table(spark, d, "transactions").select("txn_id", "delivery_id", labels.l7_name(p).alias("l7"), labels.proto_name(p).alias("proto"))


@query("protocol_label", """
SELECT txn_id, delivery_id, CASE WHEN dest_port = 8443 AND req_headers['content-type'] LIKE 'application/grpc%' THEN 'gRPC' WHEN dest_port = 8443 THEN 'HTTP/2' WHEN req_body LIKE '%"jsonrpc"%' THEN 'MCP' WHEN resp_status = 101 THEN 'WebSocket' ELSE 'HTTP/1.1' END AS label FROM transactions""")
def protocol_label(spark, d):
    """The label rule with conditions that the stored columns can express."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    t = table(spark, d, "transactions")
    return t.select("txn_id", "delivery_id", labels.protocol_label(yes(t["dest_port"] == 8443), yes(t["req_body"].contains('"jsonrpc"')), yes(t["resp_status"] == 101), yes(t["req_headers"]["content-type"].startswith("application/grpc")), F.lit(False)).alias("label"))


@query("lookup_exclusion", "SELECT DISTINCT ip FROM (SELECT source_ip AS ip FROM transactions UNION ALL SELECT dest_ip FROM transactions) WHERE ip IS NOT NULL AND NOT (ip LIKE '127.%' OR ip LIKE '169.254.%' OR ip IN ('::1', '0.0.0.0', '::') OR lower(ip) LIKE 'fe80:%')")
def lookup_exclusion(spark, d):
    t = table(spark, d, "transactions")
    ips = t.select(F.explode(F.array("source_ip", "dest_ip")).alias("ip")).where("ip is not null")
    return ips.where(~labels.not_looked_up(F.col("ip"))).distinct()


@query("orientation", "SELECT chunk_id, CASE WHEN role_hint = 1 THEN dst_ip4 ELSE src_ip4 END AS client_ip, CASE WHEN role_hint = 1 THEN src_ip4 ELSE dst_ip4 END AS server_ip, CASE role_hint WHEN 1 THEN 'incoming' WHEN 2 THEN 'outgoing' END AS direction FROM (SELECT DISTINCT * FROM chunks)")
def orientation(spark, d):
    """The source is always the client: a server's own address is the destination."""
    server = F.col("role_hint") == 1
    return table(spark, d, "chunks").distinct().select("chunk_id", F.when(server, F.col("dst_ip4")).otherwise(F.col("src_ip4")).alias("client_ip"), F.when(server, F.col("src_ip4")).otherwise(F.col("dst_ip4")).alias("server_ip"), F.when(server, "incoming").when(F.col("role_hint") == 2, "outgoing").alias("direction"))


@query("abi_filter", "SELECT chunk_id, least(CASE WHEN copied_len > 0 THEN copied_len ELSE data_len END, 32767) AS payload_len, coalesce(flags & 1 <> 0 OR actual_len > copied_len, false) AS truncated FROM chunks WHERE abi_version = 2")
def abi_filter(spark, d):
    c = F.col
    return table(spark, d, "chunks").where("abi_version = 2").select("chunk_id", labels.payload_length(c("copied_len"), c("data_len"), F.lit(32767).cast("long")).alias("payload_len"), labels.truncated(c("flags"), c("actual_len"), c("copied_len")).alias("truncated"))


_TEXTS = ("capture_source", "protocol", "direction", "source_ip", "dest_ip", "req_method", "req_path", "req_host", "req_scheme", "req_body", "outcome", "user_id", "user_role", "session_id", "auth_session_id")


@query("request_id_filter", "SELECT txn_id, delivery_id FROM transactions WHERE contains(concat_ws(' ', " + ", ".join(_TEXTS) + ", " + ", ".join(f"array_to_string({f}({m}), ' ')" for m in ("req_headers", "req_query") for f in ("map_keys", "map_values")) + "), 'r1f')")
def request_id_filter(spark, d):
    """Events whose serialised row holds a part of a request id, wherever it stands."""
    t = table(spark, d, "transactions")
    return t.where(F.to_json(F.struct(*t.columns)).contains("r1f")).select("txn_id", "delivery_id")


PARTS_SQL = "concat_ws('|', req_method, req_path, source_ip, CAST(source_port AS VARCHAR), CAST(txn_id AS VARCHAR))"


@query("sampling_keep", f"""
SELECT txn_id, delivery_id FROM transactions WHERE ({' OR '.join(f"starts_with(req_path, '{p}')" for p in labels.ALWAYS_KEEP)}) OR CAST('0x' || substr(md5({PARTS_SQL}), 1, 8) AS BIGINT) % 100 < CASE WHEN ({' OR '.join(f"starts_with(req_path, '{p}')" for p in labels.HEALTH)}) THEN 5 ELSE 30 END""")
def sampling_keep(spark, d):
    """Deterministic sampling of transactions: 30 %, health paths 5 %, some paths always (a sampling operator)."""
    t = table(spark, d, "transactions")
    return t.where(labels.sampled([t[c] for c in ("req_method", "req_path", "source_ip", "source_port", "txn_id")], t["req_path"], 30, 5)).select("txn_id", "delivery_id")


# ---------------------------------------------------------------- security columns

@query("path_features", f"""
SELECT req_path, length(req_path) - length(replace(req_path, '/', '')) AS path_depth, contains(req_path, '%') AS has_encoded_chars, {any_sql('req_path', detect.SQLI)} AS sqli, {any_sql('req_path', detect.XSS)} AS xss, (contains(req_path, '../') OR contains(req_path, '..\\')) AS traversal FROM (SELECT DISTINCT req_path FROM transactions)""")
def path_features(spark, d):
    t = table(spark, d, "transactions").select("req_path").distinct()
    f = detect.anomaly_features(F.col("req_path"), F.lit(None).cast("map<string,string>"), F.lit(0))
    return t.select("req_path", f.alias("f")).select("req_path", F.col("f.path_depth").cast("long").alias("path_depth"), "f.has_encoded_chars", F.col("f.has_sqli_pattern").alias("sqli"), F.col("f.has_xss_pattern").alias("xss"), F.col("f.has_path_traversal").alias("traversal"))


@query("size_bucket", "SELECT txn_id, delivery_id, CAST(CASE WHEN strlen(req_body) > 0 THEN floor(log2(strlen(req_body))) ELSE 0 END AS INT) AS bucket, CAST(coalesce(cardinality(req_query), 0) AS INT) AS n_params FROM transactions")
def size_bucket(spark, d):
    t = table(spark, d, "transactions")
    f = detect.anomaly_features(t["req_path"], t["req_query"], F.coalesce(F.octet_length("req_body"), F.lit(0)))
    return t.select("txn_id", "delivery_id", f["request_size_bucket"].cast("int").alias("bucket"), f["query_param_count"].cast("int").alias("n_params"))


@query("path_entropy", """
WITH p AS (SELECT DISTINCT req_path, hex(encode(req_path)) AS h FROM transactions WHERE req_path <> ''), b AS (SELECT req_path, len(h) // 2 AS n, substr(h, 2 * CAST(k AS BIGINT) - 1, 2) AS b FROM p, unnest(range(1, CAST(len(h) // 2 + 1 AS BIGINT))) AS u(k)), c AS (SELECT req_path, n, b, count(*) AS c FROM b GROUP BY ALL)
SELECT req_path, round(-sum((c / n) * log2(c / n)), 4) AS entropy FROM c GROUP BY req_path""")
def path_entropy(spark, d):
    return table(spark, d, "transactions").select("req_path").where("req_path <> ''").distinct().select("req_path", F.round(detect.entropy(F.col("req_path")), 4).alias("entropy"))


@query("injection_flags", f"""
SELECT doc_id, {any_sql('text', detect.INJECTION)} AS injection, array_to_string(list_filter([{', '.join(f"CASE WHEN contains(lower(text), '{w}') THEN '{w}' END" for w in detect.PERMISSION)}], lambda x: x IS NOT NULL), ',') AS permissions FROM documents""")
def injection_flags(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", detect.any_of(t, detect.INJECTION).alias("injection"), F.array_join(detect.all_of(t, detect.PERMISSION), ",").alias("permissions"))


@query("rpc_calls", """
SELECT DISTINCT txn_id, json_extract_string(req_body, '$.method') AS method, json_extract_string(req_body, '$.params.name') AS tool FROM transactions WHERE json_valid(req_body) AND json_extract_string(req_body, '$.jsonrpc') = '2.0' AND json_extract_string(req_body, '$.method') IS NOT NULL""")
def rpc_calls(spark, d):
    t = table(spark, d, "transactions").where("req_body like '%jsonrpc%'").select("txn_id", F.explode(misc.rpc_calls(F.col("req_body"))).alias("c"))
    return t.select("txn_id", misc.rpc_call(F.col("c")).alias("r")).select("txn_id", "r.method", "r.tool").distinct()


@query("sse_events", "SELECT event_id, 1 AS n, json_extract_string(props, '$.k') AS k FROM events")
def sse_events(spark, d):
    body = F.concat(F.lit(": note\ndata: "), F.col("props"), F.lit("\n\ndata: [DONE]\ndata: {bad\n"))
    e = table(spark, d, "events").select("event_id", misc.sse_data(body).alias("s"))
    return e.select("event_id", F.size("s").alias("n"), F.get_json_object(F.get("s", 0), "$.k").alias("k"))


HMAC_SQL = "sha256(from_hex('{o}') || from_hex(sha256(from_hex('{i}') || encode({x}))))"


def hmac_sql(x: str) -> str:
    i, o = tokens.pads(KEY)
    return HMAC_SQL.format(i=i, o=o, x=x)


@query("name_tokens", f"SELECT c_custkey, 'PII_EMAIL_' || substr({hmac_sql('c_name')}, 1, 32) AS token, 'sid-' || substr({hmac_sql('c_name')}, 1, 16) AS session FROM customer")
def name_tokens(spark, d):
    n = F.col("c_name")
    return table(spark, d, "customer").select("c_custkey", tokens.token("EMAIL", n, KEY).alias("token"), F.concat(F.lit("sid-"), tokens.fingerprint(n, KEY)).alias("session"))


@query("email_tokens", f"""
WITH m AS (SELECT DISTINCT txn_id, unnest(regexp_extract_all(req_body, '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}\\b')) AS m FROM transactions WHERE req_body IS NOT NULL)
SELECT txn_id, m AS email, 'PII_EMAIL_' || substr({hmac_sql('m')}, 1, 32) AS token FROM m""")
def email_tokens(spark, d):
    t = table(spark, d, "transactions").select("txn_id", F.explode(tokens.matches(F.col("req_body"), "EMAIL")).alias("email")).distinct()
    return t.withColumn("token", tokens.token("EMAIL", F.col("email"), KEY))


@query("ssn_redaction", """
SELECT DISTINCT txn_id, CAST(len(regexp_extract_all(req_body, '\\b[0-9]{3}-[0-9]{2}-[0-9]{4}\\b')) AS INT) AS n FROM transactions WHERE regexp_matches(req_body, '\\b[0-9]{3}-[0-9]{2}-[0-9]{4}\\b')""")
def ssn_redaction(spark, d):
    """Bodies with numbers of a social security shape, and how many tokens replaced them."""
    t = table(spark, d, "transactions").select("txn_id", "req_body").where(F.col("req_body").rlike(dict(tokens.SHAPES)["SSN"])).distinct()
    return t.select("txn_id", F.regexp_count(tokens.redact_shapes(F.col("req_body"), KEY, ("SSN",)), F.lit("PII_SSN_")).alias("n"))


@query("redacted_bodies")
def redacted_bodies(spark, d):
    t = table(spark, d, "transactions").select("txn_id", "delivery_id", "req_body", "req_path")
    return t.select("txn_id", "delivery_id", redact.redact_text(F.col("req_body"), KEY).alias("body"), redact.redact_text(F.col("req_path"), KEY).alias("path"))


@query("redacted_headers")
def redacted_headers(spark, d):
    t = table(spark, d, "transactions").select("txn_id", "delivery_id", "req_headers")
    return t.select("txn_id", "delivery_id", redact.redact_headers(F.col("req_headers"), KEY).alias("headers"))


#: Shapes of which every match in these texts is a token afterwards, and the texts have none left.
_COUNTED = ("EMAIL", "SSN", "PAN", "IFSC", "CARD")


def _shape_sql(kind: str) -> str:
    found = "regexp_extract_all(req_body, '" + dict(tokens.SHAPES)[kind].replace("'", "''") + "')"
    if kind == "CARD":
        luhn = "list_sum(list_transform(range(1, len(m) + 1), lambda k: CASE WHEN (len(m) - k) % 2 = 1 THEN (2 * CAST(substr(m, k, 1) AS INT)) // 10 + (2 * CAST(substr(m, k, 1) AS INT)) % 10 ELSE CAST(substr(m, k, 1) AS INT) END)) % 10 = 0"
        found = f"list_filter({found}, lambda m: {luhn})"
    return f"CAST(coalesce(len({found}), 0) AS INT) AS {kind.lower()}"


@query("redacted_shapes", "SELECT txn_id, delivery_id, " + ", ".join(map(_shape_sql, _COUNTED)) + ", CAST(0 AS INT) AS missed FROM transactions WHERE req_body IS NOT NULL AND NOT regexp_matches(req_body, '(?i)token|secret|passw|session|cookie|auth|sid|ssn|pin|key|otp|cvv|cvc|pwd|credential|signature|[cx]srf|://[^/\\s:@?#]+:')")
def redacted_shapes(spark, d):
    """Tokens of five shapes in the redacted bodies, and matches of these shapes that are left, of all bodies without a word that names a secret."""
    named = r"(?i)token|secret|passw|session|cookie|auth|sid|ssn|pin|key|otp|cvv|cvc|pwd|credential|signature|[cx]srf|://[^/\s:@?#]+:"
    t = table(spark, d, "transactions").select("txn_id", "delivery_id", "req_body").where(F.col("req_body").isNotNull() & ~F.col("req_body").rlike(named))
    t = t.select("txn_id", "delivery_id", redact.redact_text(F.col("req_body"), KEY).alias("b"))
    left = sum((F.regexp_count("b", F.lit(dict(tokens.SHAPES)[k])) for k in _COUNTED if k != "CARD"), F.lit(0))
    return t.select("txn_id", "delivery_id", *(F.regexp_count("b", F.lit(f"PII_{k}_[0-9a-f]{{32}}")).alias(k.lower()) for k in _COUNTED), left.cast("int").alias("missed"))


def _header_sql(name: str) -> str:
    return f"CASE WHEN trim(req_headers['{name}']) <> '' THEN 'PII_SECRET_' || substr({hmac_sql(f"trim(req_headers['{name}'])")}, 1, 32) ELSE req_headers['{name}'] END"


@query("redacted_secrets", f"SELECT txn_id, delivery_id, {_header_sql('x-api-key')} AS api_key, CASE WHEN strpos(trim(req_headers['authorization']), ' ') > 0 THEN split_part(trim(req_headers['authorization']), ' ', 1) || ' PII_SECRET_' || substr({hmac_sql("trim(substr(trim(req_headers['authorization']), strpos(trim(req_headers['authorization']), ' ') + 1))")}, 1, 32) WHEN trim(req_headers['authorization']) <> '' THEN {_header_sql('authorization')} ELSE req_headers['authorization'] END AS authorization, CAST(cardinality(req_headers) AS INT) AS n FROM transactions")
def redacted_secrets(spark, d):
    """Headers that carry a secret by their name, redacted, and the number of headers, which stays."""
    t = table(spark, d, "transactions").select("txn_id", "delivery_id", redact.redact_headers(F.col("req_headers"), KEY).alias("h"))
    return t.select("txn_id", "delivery_id", F.col("h")["x-api-key"].alias("api_key"), F.col("h")["authorization"].alias("authorization"), F.size("h").alias("n"))


NAMED_SQL = f"""
WITH b AS (SELECT c_custkey, 'T' || c_custkey AS s FROM customer)
SELECT c_custkey, '{{"password":"PII_SECRET_' || substr({hmac_sql('s')}, 1, 32) || '","note":"' || s || '"}}' AS json, 'a=' || s || '&api_key=PII_SECRET_' || substr({hmac_sql('s')}, 1, 32) || '&b=2' AS form,
 '<x><secret>PII_SECRET_' || substr({hmac_sql('s')}, 1, 32) || '</secret><y>' || s || '</y></x>' AS xml, 'https://u:PII_SECRET_' || substr({hmac_sql('s')}, 1, 32) || '@h/' AS url, 'PII_PRIVATE_KEY_REDACTED' AS pem FROM b
"""


@query("named_secrets", NAMED_SQL)
def named_secrets(spark, d):
    """Secrets under names in JSON, forms, XML, URLs and key blocks."""
    s = F.concat(F.lit("T"), F.col("c_custkey").cast("string"))
    made = {
        "json": F.concat(F.lit('{"pass\\u0077ord":"'), s, F.lit('","note":"'), s, F.lit('"}')), "form": F.concat(F.lit("a="), s, F.lit("&api_key="), s, F.lit("&b=2")), "xml": F.concat(F.lit("<x><secret>"), s, F.lit("</secret><y>"), s, F.lit("</y></x>")),
        "url": F.concat(F.lit("https://u:"), s, F.lit("@h/")), "pem": F.concat(F.lit("-----BEGIN PRIVATE KEY-----\n"), s, F.lit("\n-----END PRIVATE KEY-----")),
    }
    out = table(spark, d, "customer").select("c_custkey", *(redact.redact_text(c, KEY).alias(n) for n, c in made.items()))
    return out.withColumn("json", F.replace("json", F.lit("pass\\u0077ord"), F.lit("password")))


@query("cookie_redaction", f"""
WITH c AS (SELECT DISTINCT req_headers['cookie'] AS cookie FROM transactions WHERE req_headers['cookie'] IS NOT NULL)
SELECT cookie, array_to_string(list_transform(string_split(cookie, ';'), lambda p: CASE WHEN strpos(p, '=') > 0 AND trim(substr(p, strpos(p, '=') + 1)) <> '' THEN split_part(p, '=', 1) || '=PII_SECRET_' || substr({hmac_sql("trim(substr(p, strpos(p, '=') + 1))")}, 1, 32) ELSE p END), ';') AS redacted FROM c""")
def cookie_redaction(spark, d):
    c = table(spark, d, "transactions").select(F.col("req_headers")["cookie"].alias("cookie")).where("cookie is not null").distinct()
    return c.withColumn("redacted", tokens.redact_cookie(F.col("cookie"), KEY))


@query("secret_names", f"""
WITH k AS (SELECT DISTINCT unnest(map_keys(req_headers) || coalesce(map_keys(req_query), [])) AS name FROM transactions), n AS (SELECT name, lower(replace(replace(replace(replace(replace(name, '-', ''), '_', ''), '.', ''), '[', ''), ']', '')) AS p FROM k)
SELECT name FROM n WHERE p IN ({q_in(tokens.SECRET_EXACT)}) OR {any_sql('p', tokens.SECRET_PARTS)}""")
def secret_names(spark, d):
    t = table(spark, d, "transactions").select(F.explode(F.concat(F.coalesce(F.map_keys("req_headers"), F.array().cast("array<string>")), F.coalesce(F.map_keys("req_query"), F.array().cast("array<string>")))).alias("name")).distinct()
    return t.where(tokens.secret_name(F.col("name")))


LUHN_SQL = "list_sum(list_transform(range(1, 17), lambda k: CASE WHEN k % 2 = 1 THEN (2 * CAST(substr(n, k, 1) AS INT)) // 10 + (2 * CAST(substr(n, k, 1) AS INT)) % 10 ELSE CAST(substr(n, k, 1) AS INT) END)) % 10 = 0"


@query("luhn_check", f"SELECT o_orderkey, {LUHN_SQL} AS valid FROM (SELECT o_orderkey, '4' || lpad(CAST(o_orderkey * 7919 + o_custkey AS VARCHAR), 15, '0') AS n FROM orders)")
def luhn_check(spark, d):
    n = F.concat(F.lit("4"), F.lpad((F.col("o_orderkey") * 7919 + F.col("o_custkey")).cast("string"), 15, "0"))
    return table(spark, d, "orders").select("o_orderkey", tokens.luhn(n).alias("valid"))


def _verhoeff_sql(n: str) -> str:
    mul, perm = tokens.MUL, tokens.PERM
    return f"list_reduce(list_transform(range(0, 12), lambda k: {perm}[CAST(k % 8 * 10 + CAST(substr({n}, CAST(12 - k AS BIGINT), 1) AS INT) + 1 AS BIGINT)]), lambda c, x: {mul}[c * 10 + x + 1], 0) = 0"


@query("verhoeff_check", f"SELECT o_orderkey, {_verhoeff_sql('n')} AS valid FROM (SELECT o_orderkey, '2' || lpad(CAST(o_orderkey * 104729 + o_custkey AS VARCHAR), 11, '0') AS n FROM orders)")
def verhoeff_check(spark, d):
    n = F.concat(F.lit("2"), F.lpad((F.col("o_orderkey") * 104729 + F.col("o_custkey")).cast("string"), 11, "0"))
    return table(spark, d, "orders").select("o_orderkey", tokens.verhoeff(n).alias("valid"))


@query("identity_ladder", f"""
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN 'h-' || c_custkey WHEN 2 THEN 'unknown' ELSE c_name END AS user_id, CASE c_custkey % 4 WHEN 0 THEN 'a,b' WHEN 3 THEN 'buyer' ELSE 'unknown' END AS user_role,
 CASE WHEN c_custkey % 4 = 2 THEN 'sid-' || substr({hmac_sql("'s' || CAST(c_custkey AS VARCHAR)")}, 1, 16) ELSE 'sid-0' END AS session_id, CASE c_custkey % 4 WHEN 0 THEN 'j' || c_custkey ELSE '0' END AS auth_session_id FROM customer""")
def identity_ladder(spark, d):
    k = F.col("c_custkey")
    claims = F.when(k % 4 == 0, F.to_json(F.struct(F.col("c_name").alias("sub"), F.array(F.lit("a"), F.lit("b")).alias("roles"), F.concat(F.lit("j"), k.cast("string")).alias("jti")))).otherwise(F.to_json(F.struct(F.col("c_name").alias("email"), F.lit("buyer").alias("role"))))
    jwt = F.concat(F.lit("Bearer e30."), F.translate(F.regexp_replace(F.base64(F.encode(claims, "UTF-8")), "[\r\n=]", ""), "+/", "-_"), F.lit(".sig"))
    h = F.when(k % 4 == 1, F.create_map(F.lit("x-user-id"), F.concat(F.lit("h-"), k.cast("string")))).when(k % 4 == 2, F.create_map(F.lit("cookie"), F.concat(F.lit("a=b; SID=s"), k.cast("string")))).otherwise(F.create_map(F.lit("authorization"), jwt))
    return table(spark, d, "customer").select(k, identity.identity(h, KEY).alias("i")).select("c_custkey", "i.*")


# ---------------------------------------------------------------- times, addresses, ids

@query("time_formats", f"""
SELECT txn_id, delivery_id, strftime(epoch_ms({MS}), '%Y-%m-%d %H:%M:%S.%g') AS message_time, strftime(epoch_ms({MS}), '%Y-%m-%dT%H:%M:%S.%g') || '000000Z' AS start_time FROM transactions""")
def time_formats(spark, d):
    ms = epoch_ms(F.col("ts_ns"))
    return table(spark, d, "transactions").select("txn_id", "delivery_id", misc.message_time(ms).alias("message_time"), misc.start_time(ms).alias("start_time"))


@query("wall_clock", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey * 1000 + 1700000000000 ELSE 1700000000000 + o_orderkey END AS wall_ms FROM orders")
def wall_clock(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k, misc.wall_ms(F.when(k % 2 == 0, k * 1000).otherwise(k + 1_700_000_000_000), F.lit(1_700_000_000_000)).alias("wall_ms"))


@query("event_ids", f"""
SELECT txn_id, delivery_id, printf('%016x', 7::BIGINT) || '-' || printf('%012x', {MS}) || '-' || printf('%010x', txn_id) AS id, printf('%016x', xor({MS}, delivery_id << 16)) AS opc FROM transactions""")
def event_ids(spark, d):
    ms = epoch_ms(F.col("ts_ns"))
    return table(spark, d, "transactions").select("txn_id", "delivery_id", misc.event_id(F.lit(7).cast("long"), ms, F.col("txn_id")).alias("id"), misc.opc_id(ms, F.col("delivery_id")).alias("opc"))


@query("ipv4_text", "SELECT ip, ((n >> 24) & 255) || '.' || ((n >> 16) & 255) || '.' || ((n >> 8) & 255) || '.' || (n & 255) AS text FROM (SELECT ip, " + IP_SQL.format("ip") + " AS n FROM dns WHERE regexp_full_match(ip, '[0-9]+(\\.[0-9]+){3}'))")
def ipv4_text(spark, d):
    t = table(spark, d, "dns").select("ip").where(misc.ipv4_number(F.col("ip")).isNotNull())
    return t.select("ip", misc.ipv4(misc.ipv4_number(F.col("ip"))).alias("text"))


@query("process_names", "SELECT comm, split_part(comm || chr(0) || 'x', chr(0), 1) AS name, CAST(count(*) AS BIGINT) AS n FROM chunks GROUP BY comm")
def process_names(spark, d):
    return table(spark, d, "chunks").groupBy("comm").agg(F.count(F.lit(1)).alias("n")).withColumn("name", misc.process_name(F.concat(F.col("comm"), F.lit("\0x"))))


@query("cgroup_paths", "SELECT cgroup_id, container_id, substr(container_id, 1, 12) AS short_id, '0123abcd-0123-4567-89ab-0123456789ab' AS pod_uid FROM containers WHERE regexp_full_match(container_id, '[0-9A-Fa-f]{32,}')")
def cgroup_paths(spark, d):
    kinds = ("cri-containerd-", "cri-o-", "crio-", "docker-", "libpod-", "containerd-", "")
    kind = F.get(F.array(*map(F.lit, kinds)), F.pmod(F.col("cgroup_id"), F.lit(len(kinds))).cast("int"))
    under = F.when(F.col("cgroup_id") % 2 == 0, "/kubepods.slice/kubepods-burstable.slice/kubepods-burstable-pod0123abcd_0123_4567_89ab_0123456789ab.slice/").otherwise("/kubepods/besteffort/pod0123abcd-0123-4567-89ab-0123456789ab/")
    path = F.concat(under, kind, F.col("container_id"), F.when(F.col("cgroup_id") % 2 == 0, ".scope").otherwise(""))
    t = table(spark, d, "containers").select("cgroup_id", path.alias("path"))
    return t.select("cgroup_id", misc.container_id(F.col("path")).alias("container_id"), misc.pod_uid(F.col("path")).alias("pod_uid")).where("container_id is not null").withColumn("short_id", F.substring("container_id", 1, 12))


@query("backoff", "SELECT p_partkey, CAST(least(1000 * power(2, p_size % 12), 60000) AS BIGINT) AS wait_ms FROM part")
def backoff(spark, d):
    return table(spark, d, "part").select("p_partkey", misc.backoff_ms(F.col("p_size") % 12).alias("wait_ms"))


@query("health_verdicts", """
SELECT s_suppkey, CASE WHEN s_suppkey % 7 * 40 < 120 THEN 'ok' ELSE 'stalled' END AS status, CASE WHEN s_nationkey % 5 < 3 THEN 'ok' ELSE 'failing' END AS delivery, CAST(CASE WHEN s_suppkey % 3 > 0 THEN s_nationkey * 100 // (s_suppkey % 3 * 100) ELSE 0 END AS BIGINT) AS drop_pct, (s_nationkey % 5 < 3 AND (s_suppkey % 3 > 0 OR s_suppkey % 60 < 30)) AS ready FROM supplier""")
def health_verdicts(spark, d):
    k, n = F.col("s_suppkey"), F.col("s_nationkey").cast("long")
    return table(spark, d, "supplier").select(k, misc.health(k % 3 * 100, n, n % 5, k % 7 * 40, k % 60).alias("h")).select("s_suppkey", "h.*")


# ---------------------------------------------------------------- wire

@query("wire_rows", f"""
SELECT txn_id, coalesce(source_ip, '') AS source_ip, CASE lower(protocol) WHEN 'http/2' THEN 'HTTP2' WHEN 'http/3' THEN 'HTTP3' WHEN 'grpc' THEN 'GRPC' WHEN 'websocket' THEN 'WebSocket' WHEN 'quic' THEN 'QUIC' WHEN 'mcp' THEN 'MCP' ELSE 'HTTP11' END AS l7, split_part(req_path, '?', 1) AS uri,
 CAST(coalesce(strlen(req_body), 0) AS INT) AS body_length, coalesce(resp_status, 0) AS status, coalesce(user_id, 'unknown') AS user_id, printf('%016x', 0::BIGINT) || '-' || printf('%012x', {MS}) || '-' || printf('%010x', txn_id) AS id, coalesce(req_headers['user-agent'], '') AS user_agent FROM transactions""")
def wire_rows(spark, d):
    w = wire.wire_rows(table(spark, d, "transactions"))
    names = {"`DownstreamL3L4.SourceIP`": "source_ip", "L7Protocol": "l7", "`HTTPReq.Uri`": "uri", "`HTTPReq.BodyLength`": "body_length", "`HTTPResp.ResponseCode`": "status", "user_id": "user_id", "Id": "id", "`Req.Header.user-agent`": "user_agent"}
    return w.select("txn_id", *(F.col(c).alias(n) for c, n in names.items()))


PACK_SQL = """
WITH RECURSIVE r AS (SELECT source, doc_id // 1000 AS flush, doc_id, n_chars, row_number() OVER (PARTITION BY source, doc_id // 1000 ORDER BY doc_id) AS i FROM documents WHERE n_chars <= 20000),
f AS (SELECT source, flush, i, doc_id, 0 AS batch, 1 AS n, n_chars AS total, (1 >= 5 OR n_chars >= 20000) AS full_ FROM r WHERE i = 1
 UNION ALL SELECT r.source, r.flush, r.i, r.doc_id, CASE WHEN f.full_ OR f.total + r.n_chars > 20000 THEN f.batch + 1 ELSE f.batch END, CASE WHEN f.full_ OR f.total + r.n_chars > 20000 THEN 1 ELSE f.n + 1 END,
  CASE WHEN f.full_ OR f.total + r.n_chars > 20000 THEN r.n_chars ELSE f.total + r.n_chars END,
  CASE WHEN f.full_ OR f.total + r.n_chars > 20000 THEN (1 >= 5 OR r.n_chars >= 20000) ELSE (f.n + 1 >= 5 OR f.total + r.n_chars >= 20000) END FROM f JOIN r ON r.source = f.source AND r.flush = f.flush AND r.i = f.i + 1)
SELECT doc_id, flush, CAST(batch AS BIGINT) AS batch FROM f UNION ALL SELECT doc_id, doc_id // 1000, NULL FROM documents WHERE n_chars > 20000"""


@query("batch_packing", PACK_SQL)
def batch_packing(spark, d):
    """Batches of a source within each interval of a flush, here of a thousand ids."""
    t = table(spark, d, "documents").select("source", "doc_id", "n_chars", F.call_function("div", F.col("doc_id"), F.lit(1000)).alias("flush"))
    return wire.pack(t, ["source", "flush"], ["doc_id"], "n_chars", 5, 20_000).select("doc_id", "flush", "batch")


QUEUE_SQL = """
WITH RECURSIVE r AS (SELECT source, doc_id // 1000 AS flush, doc_id, n_chars, row_number() OVER (PARTITION BY source, doc_id // 1000 ORDER BY doc_id) AS i FROM documents),
f AS (SELECT source, flush, i, doc_id, n_chars <= 30000 AS accepted, CASE WHEN n_chars <= 30000 THEN n_chars ELSE 0 END AS held FROM r WHERE i = 1
 UNION ALL SELECT r.source, r.flush, r.i, r.doc_id, f.held + r.n_chars <= 30000, CASE WHEN f.held + r.n_chars <= 30000 THEN f.held + r.n_chars ELSE f.held END FROM f JOIN r ON r.source = f.source AND r.flush = f.flush AND r.i = f.i + 1)
SELECT doc_id, accepted FROM f"""


@query("bounded_queue", QUEUE_SQL)
def bounded_queue(spark, d):
    """Which events a queue of bounded bytes takes between two flushes, and which it refuses."""
    t = table(spark, d, "documents").select("source", "doc_id", "n_chars", F.call_function("div", F.col("doc_id"), F.lit(1000)).alias("flush"))
    return wire.queued(t, ["source", "flush"], ["doc_id"], "n_chars", 30_000).select("doc_id", "accepted")


@query("envelopes", "SELECT delivery_id, '2.0' AS version, delivery_id AS sequence, CAST(count(*) AS INT) AS n FROM transactions GROUP BY delivery_id")
def envelopes(spark, d):
    t = table(spark, d, "transactions").select("delivery_id", "txn_id", "req_method", epoch_ms(F.col("ts_ns")).alias("ms"))
    e = wire.envelopes(t, "delivery_id", F.lit("tenant"), F.lit("p1"), F.col("ms"))
    v = F.col("envelope")
    return e.select("delivery_id", F.get_json_object(v, "$.MsgHeader.Version").alias("version"), F.get_json_object(v, "$.MsgHeader.Sequence").cast("long").alias("sequence"), F.json_array_length(F.get_json_object(v, "$.Batch")).alias("n"))


@query("schema_validation", """
SELECT delivery_id, CASE delivery_id % 6 WHEN 0 THEN 'Batch is empty' WHEN 1 THEN 'missing MsgHeader' WHEN 2 THEN 'legacy schema' WHEN 3 THEN 'MsgHeader.Sequence must be int' WHEN 4 THEN 'invalid JSON' ELSE 'missing SrcInfo.Source' END AS reason FROM wire_messages""")
def schema_validation(spark, d):
    """Ingest bodies with one defect each, by the delivery's number."""
    head = lambda seq: F.struct(F.lit("2.0").alias("Version"), F.col("message_time").alias("MessageTime"), F.coalesce("tenant_id", F.lit("")).alias("TenantId"), seq.alias("Sequence"), F.coalesce("internal_opc_id", F.lit("")).alias("InternalOPCID"), F.coalesce("policy_version", F.lit("")).alias("PolicyVersion"))
    seq, k = F.coalesce("msg_sequence", F.lit(0).cast("long")), F.col("delivery_id") % 6
    none = F.lit("[]")
    wrap = lambda h, batch: F.concat(F.lit('{"MsgHeader":'), F.to_json(h), F.lit(',"Batch":'), batch, F.lit("}"))
    body = F.when(k == 0, wrap(head(seq), none)).when(k == 1, F.lit('{"Batch":[]}')).when(k == 2, F.lit('{"events":[]}')).when(k == 3, wrap(head(F.lit("x")), none)).when(k == 4, F.lit('{"MsgHeader":')).otherwise(wrap(head(seq), F.lit("[{}]")))
    return wire.rejected(table(spark, d, "wire_messages").select("delivery_id", body.alias("body")), F.col("body")).select("delivery_id", "reason")


# ---------------------------------------------------------------- decoders and streams

def _chunked(spark, d):
    """Each transaction as a connection of two chunks, cut at a place its number tells."""
    h = _heads(spark, d).where("head is not null").withColumn("b", F.encode("head", "UTF-8"))
    cut = (F.col("txn_id") % F.octet_length("b")).cast("int")
    parts = F.array(F.struct(F.lit(0).alias("k"), F.substring("b", F.lit(1), cut).alias("payload")), F.struct(F.lit(1).alias("k"), F.substring("b", cut + 1, F.octet_length("b")).alias("payload")))
    return h.select(F.concat_ws("-", "txn_id", "delivery_id").alias("conn"), F.lit(0).cast("byte").alias("direction"), F.explode(parts).alias("p")).select("conn", "direction", "p.*", F.lit(False).alias("cut"))


@query("http1_decode", "SELECT txn_id || '-' || delivery_id AS conn, req_method AS method, req_path AS target, coalesce(strlen(req_body), 0) AS body_total, 'a, b' AS tag, true AS complete FROM transactions")
def http1_decode(spark, d):
    from spanforge.sources.chunks import decode

    m = decode(_chunked(spark, d), ["k"])
    return m.select("conn", "method", "target", "body_total", F.col("headers")["x-tag"].alias("tag"), "complete")


def _bytes(spark, d, make, cols):
    """Bytes made of each transaction by a plain function of columns."""
    import pandas as pd

    t = table(spark, d, "transactions").select("txn_id", "delivery_id", *cols)
    run = F.pandas_udf(lambda *s: pd.Series([make(*x) for x in zip(*s)]), "binary")
    return t.withColumn("bytes", run(*cols))


def _h2_bytes(path, body):
    from spanforge.sources.decode import fields, frames

    block = fields.hpack_encode([(":method", "POST"), (":path", path or "/"), ("x-a", "1")], index=True)
    data = (body or "").encode()
    return frames.PREFACE + frames.h2_frame(frames.SETTINGS, 0, 0, b"") + frames.h2_frame(frames.HEADERS, 0, 1, block[:5]) + frames.h2_frame(frames.CONTINUATION, 4, 1, block[5:]) + frames.h2_frame(frames.DATA, 1, 1, data)


@query("http2_decode", "SELECT txn_id, delivery_id, 1 AS stream, 'POST' AS method, req_path AS path, CAST(coalesce(strlen(req_body), 0) AS BIGINT) AS body_total FROM transactions")
def http2_decode(spark, d):
    from spanforge.sources.chunks import http2

    t = _bytes(spark, d, _h2_bytes, ["req_path", "req_body"])
    return t.select("txn_id", "delivery_id", F.explode(http2("bytes")).alias("m")).select("txn_id", "delivery_id", "m.stream", "m.method", "m.path", "m.body_total")


def _grpc_bytes(txn, path):
    def number(v):
        out = b""
        while v > 127:
            out, v = out + bytes([v & 127 | 128]), v >> 7
        return out + bytes([v])

    raw = (path or "").encode()
    body = b"\x08" + number(txn) + b"\x12" + number(len(raw)) + raw + b"\x1d\x01\x00\x00\x00"
    return b"\0" + len(body).to_bytes(4, "big") + body


@query("grpc_fields", """SELECT txn_id, delivery_id, 1 AS number, 0 AS kind, CAST(txn_id AS VARCHAR) AS value FROM transactions UNION ALL SELECT txn_id, delivery_id, 2, 2, '"' || substr(req_path, 1, 128) || '"' FROM transactions UNION ALL SELECT txn_id, delivery_id, 3, 5, '0x00000001' FROM transactions""")
def grpc_fields(spark, d):
    from spanforge.sources.chunks import grpc

    t = table(spark, d, "transactions").select("txn_id", "delivery_id", "req_path")
    import pandas as pd

    made = F.pandas_udf(lambda a, b: pd.Series([_grpc_bytes(x, y) for x, y in zip(a, b)]), "binary")
    return t.select("txn_id", "delivery_id", F.explode(grpc(made("txn_id", "req_path"))).alias("f")).select("txn_id", "delivery_id", "f.*")


def _ws_bytes(path):
    raw, mask = (path or "").encode(), b"\x01\x02\x03\x04"
    n = bytes([128 | len(raw)]) if len(raw) < 126 else bytes([128 | 126]) + len(raw).to_bytes(2, "big")
    return b"\x81" + n + mask + bytes(b ^ mask[k & 3] for k, b in enumerate(raw))


@query("websocket_frames", "SELECT txn_id, delivery_id, true AS fin, 'text' AS opcode, CAST(strlen(req_path) AS BIGINT) AS length, req_path AS text FROM transactions")
def websocket_frames(spark, d):
    from spanforge.sources.chunks import websocket

    t = _bytes(spark, d, _ws_bytes, ["req_path"])
    return t.select("txn_id", "delivery_id", websocket("bytes").alias("f")).select("txn_id", "delivery_id", "f.fin", "f.opcode", "f.length", F.col("f.payload").cast("string").alias("text"))


def _quic_varint(n):
    return n.to_bytes(1, "big") if n < 1 << 6 else (n | 1 << 14).to_bytes(2, "big") if n < 1 << 14 else (n | 1 << 31).to_bytes(4, "big")


def _h3_bytes(path):
    """Settings and one block of fields with the whole path, its length a prefix integer of seven bits (RFC 9204 section 4.1)."""
    raw = (path or "/").encode()
    size, rest = bytes([min(len(raw), 127)]), len(raw) - 127
    if rest >= 0:
        while rest > 127:
            size, rest = size + bytes([rest & 127 | 128]), rest >> 7
        size += bytes([rest])
    block = b"\0\0" + bytes([0xC0 | 20, 0xC0 | 23, 0x50 | 1]) + size + raw
    return b"\x04\0\x01" + _quic_varint(len(block)) + block


@query("http3_headers", "SELECT txn_id, delivery_id, 'POST' AS method, 'https' AS scheme, CASE WHEN req_path <> '' THEN req_path ELSE '/' END AS path FROM transactions")
def http3_headers(spark, d):
    """Fields of every row with the whole path; a row without path has ``/``."""
    from spanforge.sources.chunks import http3

    t = _bytes(spark, d, _h3_bytes, ["req_path"])
    return t.select("txn_id", "delivery_id", http3("bytes").alias("h")).select("txn_id", "delivery_id", F.col("h")[":method"].alias("method"), F.col("h")[":scheme"].alias("scheme"), F.col("h")[":path"].alias("path"))


@query("stream_pairing")
def stream_pairing(spark, d):
    """Views and clicks paired with purchases and errors per user, with time to live, as a stream; sign-ups close."""
    from spanforge.streaming.pairing import pair_stored

    kind = F.when(F.col("event_type").isin("view", "click"), "request").when(F.col("event_type").isin("purchase", "error"), "response").otherwise("close")
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("conn"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), F.col("event_id").alias("seq"), kind.alias("kind"), F.col("event_id").alias("id"))
    return pair_stored(e, ttl_ms=6 * 3_600_000)
