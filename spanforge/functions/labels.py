"""Labels and predicates of captured traffic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanforge.functions.http import METHODS

#: Paths that sampling never drops, and health paths.
ALWAYS_KEEP = ("/auth", "/login", "/token", "/oauth", "/admin", "/mcp")
HEALTH = ("/health", "/readyz", "/livez", "/metrics")


def truncated(flags: Column, actual: Column, copied: Column) -> Column:
    return F.coalesce((flags.bitwiseAND(1) != 0) | (actual > copied), F.lit(False))


def payload_length(copied: Column, data: Column, present: Column) -> Column:
    """The copied length if known, else the data length, no more than is there."""
    return F.least(F.when(copied > 0, copied).otherwise(data), present)


def request_direction(prefix: Column, direction: Column, role: Column) -> Column:
    """The direction requests travel in: this chunk's or the other; null if nothing tells."""
    other = (1 - direction).cast("byte")
    return (
        F.when(prefix.startswith("PRI * HTTP/2.0"), direction).when(prefix.startswith("HTTP/1."), other).when(prefix.rlike("^(" + "|".join(METHODS) + ") "), direction)
        .when(role == 1, F.lit(0).cast("byte")).when(role == 2, F.lit(1).cast("byte"))
    )


def begins_with(path: Column, prefixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | path.startswith(p)
    return F.coalesce(out, F.lit(False))


def protocol_label(http2: Column, mcp: Column, websocket: Column, grpc: Column, http3: Column) -> Column:
    return F.when(http3, "HTTP/3").when(http2, F.when(grpc, "gRPC").otherwise("HTTP/2")).when(mcp, "MCP").when(websocket, "WebSocket").otherwise("HTTP/1.1")


def l7_name(protocol: Column) -> Column:
    p = F.lower(protocol)
    return F.when(p.isin("http/2", "http2"), "HTTP2").when(p.isin("http/3", "http3"), "HTTP3").when(p == "grpc", "GRPC").when(p == "websocket", "WebSocket").when(p == "quic", "QUIC").when(protocol == "MCP", "MCP").otherwise("HTTP11")


def proto_name(protocol: Column) -> Column:
    return F.when(protocol.startswith("gRPC") | protocol.startswith("grpc"), "grpc").when(protocol.isin("WebSocket", "websocket"), "websocket").when(protocol.isin("QUIC", "HTTP/3"), "quic").otherwise("rest")


def not_looked_up(ip: Column) -> Column:
    """Loopback and link-local addresses have no name to look up."""
    return F.coalesce(ip.startswith("127.") | ip.startswith("169.254.") | ip.isin("::1", "0.0.0.0", "::") | F.lower(ip).startswith("fe80:"), F.lit(False))


def is_event_stream(headers: Column) -> Column:
    return F.coalesce(headers["content-type"].contains("text/event-stream"), F.lit(False))


def sampled(parts: list[Column], path: Column, rate: int = 100, health_rate: int = 100) -> Column:
    """Deterministic keep decision per transaction: same parts, same answer, on any engine."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *(p.cast("string") for p in parts))), 1, 8), 16, 10).cast("long")
    chosen = F.when(begins_with(path, HEALTH), F.lit(health_rate)).otherwise(F.lit(rate))
    return begins_with(path, ALWAYS_KEEP) | (F.pmod(h, F.lit(100)) < chosen)
