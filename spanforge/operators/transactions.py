"""From decoded messages to the transaction rows of the data model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions import http, identity, labels, misc, redact
from spanforge.operators import enrich, pairing

#: Columns of the connection that a transaction keeps.
NET = ("cgroup_id", "source_ip", "dest_ip", "source_port", "dest_port", "comm")


def paired(messages: DataFrame) -> DataFrame:
    """Requests with their responses: messages are (conn, ms, seq, method, target, status, headers, body, body_total, stream, event) with the columns of NET.

    Messages with a stream are paired by (conn, stream), those without in order
    of the connection. Requests that are not usable are left out before pairing
    and interim responses before as well; a request without answer stays, with
    an outcome, but for one whose stream is reset, or above a goaway's last one,
    before its answer: it waits for none and is left out.

    The messages are read once and sorted by connection once: a running count
    gives those without a stream the key that pairs them, and all are brought
    together by their key.
    """
    usable = http.usable_request(F.col("method"), F.col("target")) | (F.col("status").isNotNull() & ~http.interim(F.col("status")))
    what = F.when(usable, F.when(F.col("method").isNotNull(), "request").otherwise("response")).when(F.col("event").isin("reset", "goaway"), F.col("event"))
    m = messages.withColumn("_what", what).where("_what = 'request' or _what is not null and conn is not null")
    m = _keyed(m.withColumns({"_s": F.when(F.col("stream").isNull(), F.when(F.col("_what") == "request", 1).when(F.col("_what") == "response", -1)), "_at": F.struct("ms", "seq")}))
    at = {k: F.when(F.col("_what") == k, F.col("_at")) for k in ("request", "response", "reset", "goaway")}
    latest = lambda k, c, name: F.max_by(c, at[k]).alias(name)
    p = m.groupBy("conn", "stream", "_rank").agg(
        *(latest("request", c, f"q_{c}") for c in ("ms", "method", "target", "headers", "body")), *(latest("request", c, c) for c in NET), *(latest("response", c, f"r_{c}") for c in ("ms", "status", "headers", "body")),
        F.max(at["request"]).alias("q_at"), F.max(at["response"]).alias("r_at"), F.min(at["reset"]).alias("_reset"), F.max(F.when(F.col("_what") == "goaway", F.struct(F.col("stream").alias("last"), F.col("_at").alias("at")))).alias("_goaway"),
    )
    unanswered = lambda when: F.col("r_at").isNull() | (when < F.col("r_at"))
    ended = F.exists(F.collect_list("_goaway").over(Window.partitionBy("conn")), lambda g: (F.col("stream") > g["last"]) & (g["at"] >= F.col("q_at")) & unanswered(g["at"]))
    p = p.withColumn("_ended", ended).where("q_at is not null").where(~F.coalesce(unanswered(F.col("_reset")) & F.col("_reset").isNotNull(), F.lit(False)) & ~F.coalesce(F.col("_ended"), F.lit(False)))
    return p.drop("stream", "_rank", "q_at", "r_at", "_reset", "_goaway", "_ended")


def _keyed(m: DataFrame) -> DataFrame:
    """With ``_rank``: as ``pairing.fifo`` gives it to messages without a stream (``_s`` is 1 or -1; unpaired responses are left out), 0 for those of a stream, and its own below 0 for each goaway."""
    w = Window.partitionBy("conn").orderBy("ms", "seq")
    until, earlier = w.rowsBetween(Window.unboundedPreceding, Window.currentRow), w.rowsBetween(Window.unboundedPreceding, -1)
    m = m.withColumn("_d", F.sum("_s").over(until))
    m = m.withColumn("_unpaired", (F.col("_s") == -1) & (F.col("_d") < F.least(F.coalesce(F.min("_d").over(earlier), F.lit(0)), F.lit(0))))
    nth = lambda c: F.sum(F.when(c, 1).otherwise(0)).over(until)
    request, response, goaway = F.col("_s") == 1, (F.col("_s") == -1) & ~F.col("_unpaired"), F.col("_what") == "goaway"
    rank = F.when(request, nth(request)).when(response, nth(response)).when(goaway, -nth(goaway)).otherwise(0)
    return m.withColumn("_rank", rank).where("not coalesce(_unpaired, false)").drop("_s", "_d", "_unpaired")


def transactions(pairs: DataFrame, key_hex: str, now_ms: int, closed: DataFrame | None = None, account_id: int = 0, source: str = "openssl") -> DataFrame:
    """One row a pair, values redacted: protocol, direction, features, identity and, without an answer, status 0 and its outcome."""
    p = pairs if closed is None else pairs.join(closed.select("conn", F.lit(True).alias("_closed")).distinct(), "conn", "left")
    is_closed = F.coalesce(F.col("_closed"), F.lit(False)) if closed is not None else F.lit(False)
    answered = F.col("r_ms")
    who = identity.identity(F.col("q_headers"), key_hex)
    text: Column = http.preview(F.col("q_body").cast("string"))
    rpc = F.size(F.coalesce(misc.rpc_calls(text), F.array().cast("array<string>"))) > 0
    protocol = labels.protocol_label(F.lit(False), rpc | labels.is_event_stream(F.coalesce(F.col("r_headers"), F.create_map().cast("map<string,string>"))), F.coalesce(F.col("r_status") == 101, F.lit(False)), F.lit(False), F.lit(False))
    t = p.withColumns({"_who": who, "_query": http.query_map(F.col("q_target"))})
    return t.select(
        "conn", F.lit("v1").alias("version"), F.lit("api_traffic").alias("event_type"), F.lit(account_id).cast("long").alias("account_id"), F.lit(source).alias("capture_source"), protocol.alias("protocol"),
        F.coalesce(answered, F.col("q_ms")).alias("observed_at"), F.col("q_method").alias("req_method"), redact.redact_text(F.col("q_target"), key_hex).alias("req_path"), F.col("q_headers")["host"].alias("req_host"), F.lit("https").alias("req_scheme"),
        redact.redact_headers(F.col("q_headers"), key_hex).alias("req_headers"), F.col("_query").alias("req_query"), redact.redact_text(text, key_hex).alias("req_body"),
        F.coalesce(F.col("r_status"), F.lit(0)).alias("resp_status"), redact.redact_headers(F.col("r_headers"), key_hex).alias("resp_headers"), redact.redact_text(http.preview(F.col("r_body").cast("string")), key_hex).alias("resp_body"),
        F.when(answered.isNotNull(), F.greatest(F.lit(0).cast("long"), answered - F.col("q_ms"))).alias("resp_latency_ms"),
        pairing.outcome(answered, F.col("q_ms"), F.lit(now_ms), is_closed).alias("outcome"), "_who.*", *(c for c in NET if c != "comm"), misc.process_name(F.col("comm")).alias("process_name"),
    )


def enriched(rows: DataFrame, containers: DataFrame, dns: DataFrame, namespaces: list[str] | None = None) -> DataFrame:
    """Scope, container and host names."""
    kept = enrich.in_scope(rows, containers, namespaces) if namespaces is not None else rows
    return enrich.with_names(enrich.with_container(kept, containers), dns)
