"""Wire rows, envelopes, batches and their validation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions import detect, http, labels, misc
from spanforge.functions.normal import epoch_ms


def size_estimate(t: DataFrame | None = None) -> Column:
    """Bytes of an event as budgets count them: its texts, and 48 more for every map entry."""
    text = lambda c: F.coalesce(F.octet_length(F.col(c)), F.lit(0)).cast("long")
    entries = lambda c: F.coalesce(F.aggregate(F.map_entries(F.col(c)), F.lit(0).cast("long"), lambda a, e: a + F.octet_length(e["key"]) + F.coalesce(F.octet_length(e["value"]), F.lit(0)) + 48), F.lit(0).cast("long"))
    total = F.lit(0).cast("long")
    for c in ("protocol", "req_method", "req_path", "req_scheme", "req_host", "req_body", "source_ip", "dest_ip", "user_id", "user_role", "session_id", "auth_session_id", "outcome"):
        total = total + text(c)
    return total + entries("req_headers") + entries("req_query")


def wire_rows(t: DataFrame, ident: str = "txn_id") -> DataFrame:
    """Flat rows with dotted keys of transactions."""
    ms = epoch_ms(F.col("ts_ns"))
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    header = lambda n: F.coalesce(F.col("req_headers")[n], F.lit(""))
    target, query = F.col("req_path"), F.col("req_query")
    f = detect.anomaly_features(target, query, F.octet_length("req_body"))
    cols = {
        "SrcInfo.Source": F.lit(2), "SrcInfo.RemoteAddress": blank("source_ip"), "LogVersion": F.lit("v4"), "Id": misc.event_id(F.lit(0).cast("long"), ms, F.col(ident)),
        "SessionStats.StartTime": misc.start_time(ms), "SessionStats.TimeToLastDownstreamTxByte": F.coalesce(F.col("resp_latency_ms"), F.lit(0).cast("long")),
        "DownstreamL3L4.SourceIP": blank("source_ip"), "DownstreamL3L4.DestIP": blank("dest_ip"), "DownstreamL3L4.L4Protocol": F.lit("L4Proto_TCP"),
        "DownstreamL3L4.SourcePort": F.coalesce("source_port", F.lit(0)), "DownstreamL3L4.DestPort": F.coalesce("dest_port", F.lit(0)),
        "UpstreamL3L4.SourceIP": F.lit(""), "UpstreamL3L4.DestIP": blank("dest_ip"), "UpstreamL3L4.L4Protocol": F.lit("L4Proto_Unknown"), "UpstreamL3L4.SourcePort": F.lit(0), "UpstreamL3L4.DestPort": F.coalesce("dest_port", F.lit(0)),
        "L7Protocol": labels.l7_name(F.col("protocol")), "HTTPReq.Method": blank("req_method"), "HTTPReq.Uri": http.path_of(target), "HTTPReq.Query": http.wire_query(target, query),
        "HTTPReq.BodyLength": F.coalesce(F.octet_length("req_body"), F.lit(0)), "HTTPReq.Body": http.base64_text(F.col("req_body")), "HTTPReq.PathParams": F.lit("{}"),
        **{f"Req.Header.{n}": header(n) for n in http.REQUEST_HEADERS if n not in ("content-length", "host")}, "Req.Header.content-length": http.content_length(F.col("req_headers")), "Req.Header.host": blank("req_host"),
        "Req.Header.extra": http.extra_headers(F.col("req_headers")), "HTTPResp.ResponseCode": F.coalesce("resp_status", F.lit(0)), "HTTPResp.ResponseCodeDetails": F.lit(""), "HTTPResp.BodyLength": F.lit(0), "HTTPResp.Body": F.lit(None).cast("string"),
        "session_id": F.coalesce("session_id", F.lit("sid-0")), "auth_session_id": F.coalesce("auth_session_id", F.lit("0")), "user_id": F.coalesce("user_id", F.lit("unknown")), "user_role": F.coalesce("user_role", F.lit("unknown")),
        "APIInfo.Name": F.lit(""), "APIInfo.Id": F.lit(0), "OnPremAction.FinalActionLog": F.lit(True), "OnPremAction.ModuleActionBlock": F.lit(False), "MetaDataOnly": F.lit(False),
        "APIID": http.api_id(F.col("req_method"), target), "Proto": labels.proto_name(F.col("protocol")),
        "MetaDataMap": F.struct(F.when(F.col("protocol").isin("HTTP/3", "QUIC"), "udp").otherwise("tcp").alias("transport"), F.col("outcome").alias("transaction_outcome"), F.col("direction").alias("direction"), F.col("_f.path_depth").alias("path_depth"), F.col("_f.shannon_entropy").alias("shannon_entropy")),
        "error_flags": F.filter(F.array(F.when(F.col("_f.has_sqli_pattern"), "sqli"), F.when(F.col("_f.has_xss_pattern"), "xss"), F.when(F.col("_f.has_path_traversal"), "path_traversal")), lambda x: x.isNotNull()),
    }
    return t.withColumn("_f", f).select(F.col(ident), *(c.alias(n) for n, c in cols.items()))


def envelopes(rows: DataFrame, batch: str, tenant: Column, policy: Column, now_ms: Column) -> DataFrame:
    """One JSON envelope a batch: header and the batch's rows, which the packer has bounded."""
    body = [c for c in rows.columns if c not in (batch, "_tenant", "_policy", "_now")]
    r = rows.withColumns({"_tenant": tenant, "_policy": policy, "_now": now_ms})
    g = r.groupBy(batch).agg(F.collect_list(F.struct(*(F.col(f"`{c}`") for c in body))).alias("_rows"), F.min("_tenant").alias("t"), F.min("_policy").alias("p"), F.max("_now").alias("n"))
    head = F.struct(F.lit("2.0").alias("Version"), misc.message_time(F.col("n")).alias("MessageTime"), F.col("t").alias("TenantId"), F.col(batch).cast("long").alias("Sequence"), misc.opc_id(F.col("n"), F.col(batch)).alias("InternalOPCID"), F.col("p").alias("PolicyVersion"))
    return g.select(batch, F.to_json(F.struct(head.alias("MsgHeader"), F.col("_rows").alias("Batch"))).alias("envelope"))


def pack(rows: DataFrame, by: list[str], order: list[str], size: str, most_events: int = 200, most_bytes: int = 4 << 20) -> DataFrame:
    """Rows with their ``batch`` within ``by``: flushed before an overflow and when either budget is reached; larger rows than the budget are dropped (batch null).

    ``by`` names the sender and the interval of the timed flush, which ends a
    batch as well: a task walks one interval, not all rows of a sender.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", batch long"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, batch, n, total = object(), 0, 0, 0
        for p in parts:
            out = []
            for *k, s in zip(*(p[c].tolist() for c in by), p[size].tolist()):
                if k != key:
                    key, batch, n, total = k, 0, 0, 0
                if s > most_bytes:
                    out.append(None)
                    continue
                if n and total + s > most_bytes:
                    batch, n, total = batch + 1, 0, 0
                out.append(batch)
                n, total = n + 1, total + s
                if n >= most_events or total >= most_bytes:
                    batch, n, total = batch + 1, 0, 0
            yield p.assign(batch=pd.array(out, dtype="Int64"))

    # rows of a key stand together and in order; nothing but counters is held
    return rows.repartition(*by).sortWithinPartitions(*by, *order).mapInPandas(run, schema)


def queued(rows: DataFrame, by: list[str], order: list[str], size: str, capacity: int) -> DataFrame:
    """Rows with ``accepted``: a queue of ``capacity`` bytes, emptied at the end of each ``by``, refuses a row that does not fit and takes later ones that do."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", accepted boolean"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, 0
        for p in parts:
            out = []
            for *k, s in zip(*(p[c].tolist() for c in by), p[size].tolist()):
                if k != key:
                    key, held = k, 0
                out.append(held + s <= capacity)
                held += s if out[-1] else 0
            yield p.assign(accepted=out)

    return rows.repartition(*by).sortWithinPartitions(*by, *order).mapInPandas(run, schema)


# Required keys and their types.
HEADER_FIELDS = {"Version": "str", "MessageTime": "str", "TenantId": "str", "Sequence": "int", "InternalOPCID": "str", "PolicyVersion": "str"}
EVENT_FIELDS = {
    "SrcInfo.Source": "int", "LogVersion": "str", "Id": "str", "SessionStats.StartTime": "str", "L7Protocol": "str", "HTTPReq.Method": "str", "HTTPReq.Uri": "str", "HTTPReq.Query": "str", "HTTPReq.BodyLength": "int",
    "HTTPResp.ResponseCode": "int", "DownstreamL3L4.SourceIP": "str", "DownstreamL3L4.DestIP": "str", "DownstreamL3L4.SourcePort": "int", "DownstreamL3L4.DestPort": "int", "Proto": "str", "APIID": "int", "MetaDataMap": "dict",
}
L7_NAMES = ("HTTP11", "HTTP2", "HTTP3", "GRPC", "WebSocket", "QUIC", "MCP")


def _kind(v: Column) -> Column:
    """str, int, dict, list or other of a variant."""
    s = F.schema_of_variant(v)
    return F.when(v.isNull(), None).when(s == "STRING", "str").when(s == "BIGINT", "int").when(s.startswith("OBJECT"), "dict").when(s.startswith("ARRAY"), "list").otherwise(s)


def _get(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$['{name}']", "variant")


def rejected(rows: DataFrame, body: Column, name: str = "reason") -> DataFrame:
    """The rows with why their ingest body is refused, the first reason that holds; null if it is accepted.

    The body is parsed once and its parts and their kinds are taken once, each
    in a projection of its own, before any of them is compared.
    """
    keep = [c for c in rows.columns if c != name]
    parsed = rows.withColumn("_v", F.try_parse_json(body))
    parts = parsed.select(*keep, "_v", _get(F.col("_v"), "MsgHeader").alias("_head"), _get(F.col("_v"), "Batch").alias("_batch"))
    kinds = parts.select(
        *keep, _kind(F.col("_v")).alias("_is"), _kind(F.col("_head")).alias("_head_is"), _kind(F.col("_batch")).alias("_batch_is"), _get(F.col("_v"), "events").isNotNull().alias("_legacy"),
        F.struct(*(_kind(_get(F.col("_head"), n)).alias(n) for n in HEADER_FIELDS)).alias("_fields"),
        F.transform(F.try_variant_get("_v", "$.Batch", "array<variant>"), lambda e: F.struct(
            _kind(e).alias("_is"), F.try_variant_get(e, "$['L7Protocol']", "string").alias("_l7"), *(_kind(_get(e, n)).alias(n.replace(".", "_")) for n in EVENT_FIELDS))).alias("_events"),
    )
    v = F.col
    reason = F.when(v("_is").isNull(), "invalid JSON").when(v("_is") != "dict", "envelope must be an object").when(v("_legacy") & v("_batch_is").isNull(), "legacy schema").when(v("_head_is").isNull(), "missing MsgHeader").when(v("_head_is") != "dict", "MsgHeader must be an object")
    for n, k in HEADER_FIELDS.items():
        reason = reason.when(v(f"_fields.{n}").isNull(), f"MsgHeader missing {n}").when(v(f"_fields.{n}") != k, f"MsgHeader.{n} must be {k}")
    reason = reason.when(v("_batch_is").isNull(), "missing Batch").when(v("_batch_is") != "list", "Batch must be a list").when(F.size("_events") == 0, "Batch is empty")

    def first_error(e: Column) -> Column:
        out = F.when(e["_is"] != "dict", "event must be an object")
        for n, k in EVENT_FIELDS.items():
            is_ = e[n.replace(".", "_")]
            out = out.when(is_.isNull(), f"missing {n}").when(is_ != k, f"{n} must be {k}")
        return out.when(~e["_l7"].isin(*L7_NAMES), "unknown L7Protocol")

    return kinds.select(*keep, reason.otherwise(F.get(F.filter(F.transform("_events", first_error), lambda x: x.isNotNull()), 0)).alias(name))
