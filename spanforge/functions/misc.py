"""Times, addresses, cgroups, JSON-RPC and other small columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanforge.functions.detect import INJECTION, PERMISSION, all_of, any_of


def message_time(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm:ss.SSS")


def start_time(ms: Column) -> Column:
    return F.concat(F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("000000Z"))


def wall_ms(ms: Column, offset_ms: Column) -> Column:
    """Values too small for an epoch are times since boot."""
    return F.when(ms < 1_000_000_000_000, ms + offset_ms).otherwise(ms)


def event_id(nonce: Column, ms: Column, counter: Column) -> Column:
    hexed = lambda c, n: F.lpad(F.lower(F.hex(c)), n, "0")
    return F.concat_ws("-", hexed(nonce, 16), hexed(ms.bitwiseAND(F.lit(0xFFFFFFFFFFFF)), 12), hexed(counter.bitwiseAND(F.lit(0xFFFFFFFFFF)), 10))


def opc_id(now_ms: Column, sequence: Column) -> Column:
    return F.lpad(F.lower(F.hex(now_ms.bitwiseXOR(F.shiftleft(sequence.cast("long"), 16)))), 16, "0")


def backoff_ms(attempt: Column, base: int = 1000, most: int = 60_000) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt), F.lit(float(most))).cast("long")


def health(captured: Column, dropped: Column, failures: Column, last_poll_age_s: Column, uptime_s: Column) -> Column:
    """Liveness, readiness and delivery verdicts."""
    alive = (last_poll_age_s < 120) | (last_poll_age_s.isNull() & (uptime_s < 180))
    delivery = failures < 3
    return F.struct(
        F.when(alive, "ok").otherwise("stalled").alias("status"), F.when(delivery, "ok").otherwise("failing").alias("delivery"),
        F.when(captured > 0, F.call_function("div", dropped * 100, captured)).otherwise(F.lit(0).cast("long")).alias("drop_pct"), (delivery & ((captured > 0) | (uptime_s < 30))).alias("ready"),
    )


def ipv4(n: Column) -> Column:
    """Dotted form of a number in network order."""
    return F.concat_ws(".", *(F.shiftright(n, s).bitwiseAND(F.lit(255).cast("long")).cast("string") for s in (24, 16, 8, 0)))


def ipv4_number(ip: Column) -> Column:
    """Number of a dotted address; null if it is none."""
    p = F.split(ip, r"\.")
    n = sum((F.get(p, k).try_cast("long") * (1 << (24 - 8 * k)) for k in range(1, 4)), F.get(p, 0).try_cast("long") * (1 << 24))
    return F.when(ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), n)


def process_name(comm: Column) -> Column:
    return F.substring_index(comm, "\0", 1)


def container_id(path: Column) -> Column:
    """The last segment of a cgroup path that is a container id."""
    bare = F.transform(F.split(path, "/"), lambda s: F.regexp_replace(F.regexp_replace(s, r"\.scope$", ""), r"^(cri-containerd-|cri-o-|crio-|docker-|libpod-|containerd-)", ""))
    return F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.filter(bare, lambda s: s.rlike(r"^[0-9A-Fa-f]{32,}$"))), -1)


def pod_uid(path: Column) -> Column:
    """The last segment that names a pod by a UUID, underscores as hyphens."""
    uid = F.transform(F.split(path, "/"), lambda s: F.replace(F.regexp_extract(F.regexp_replace(s, r"\.slice$", ""), r"(?:^|-)pod([^/]*)$", 1), F.lit("_"), F.lit("-")))
    return F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.filter(uid, lambda s: s.rlike(r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"))), -1)


def mapped_file(line: Column) -> Column:
    """(dev, inode, path) of a line of a process's memory map that maps a library's code; null for any other."""
    p = r"^[0-9a-f]+-[0-9a-f]+ ..x. [0-9a-f]+ ([0-9a-f]+:[0-9a-f]+) ([0-9]+)\s+(/.*\.so(?:\.[0-9.]+)?)$"
    found = F.struct(F.regexp_extract(line, p, 1).alias("dev"), F.regexp_extract(line, p, 2).try_cast("long").alias("inode"), F.regexp_extract(line, p, 3).alias("path"))
    return F.when(line.rlike(p), found)


def sse_data(body: Column) -> Column:
    """JSON texts of ``data:`` lines, in order, without [DONE] and texts that are no JSON."""
    lines = F.filter(F.split(body, r"\r?\n"), lambda x: x.startswith("data: "))
    data = F.transform(lines, lambda x: F.btrim(F.substring(x, 7, 2**30)))
    return F.filter(data, lambda x: ~x.isin("", "[DONE]") & F.try_parse_json(x).isNotNull())


def rpc_calls(body: Column) -> Column:
    """JSON-RPC 2.0 calls of a request: one object or a list of them, those with a method."""
    items = F.when(body.rlike(r"^\s*\["), F.from_json(body, "array<string>")).when(F.json_object_keys(body).isNotNull(), F.array(body))
    return F.filter(items, lambda x: (F.get_json_object(x, "$.jsonrpc") == "2.0") & F.get_json_object(x, "$.method").isNotNull())


def rpc_call(text: Column) -> Column:
    """method, tool, injection and permission flags of one call."""
    return F.struct(
        F.get_json_object(text, "$.method").alias("method"), F.get_json_object(text, "$.params.name").alias("tool"), any_of(text, INJECTION).alias("has_injection"), all_of(text, PERMISSION).alias("permission_flags"),
    )


def service_name(labels_: Column) -> Column:
    """The service a container's labels name."""
    return F.coalesce(labels_["app.kubernetes.io/name"], labels_["app"])


def ipv6(hex_text: Column) -> Column:
    """The shortest form of 32 hex digits: the longest run of two or more zero groups becomes ``::``."""
    groups = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.regexp_replace(F.lower(F.substring(hex_text, k * 4 + 1, F.lit(4))), "^0{1,3}", ""))
    full = F.array_join(groups, ":")
    out = full
    for n in range(8, 1, -1):
        run = rf"(?<![0-9a-f])0(:0){{{n - 1}}}(?![0-9a-f])"
        longer = F.lit(False) if n == 8 else full.rlike(rf"(?<![0-9a-f])0(:0){{{n},}}(?![0-9a-f])")
        short = F.regexp_replace(F.regexp_replace(F.regexp_replace(full, rf"^(.*?):?{run}:?(.*)$", "$1::$3"), "^:::", "::"), ":::", "::")
        out = F.when(full.rlike(run) & ~longer, short).otherwise(out)
    return F.when(hex_text.rlike("^[0-9A-Fa-f]{32}$"), out)
