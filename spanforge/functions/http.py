"""HTTP targets, heads, headers and wire values as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of HTTP.
METHODS = ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS", "CONNECT", "TRACE")
#: Headers with a wire key of their own (fixed values of the format).
REQUEST_HEADERS = ("user-agent", "content-length", "content-type", "content-encoding", "cookie", "x-user-id", "authentication", "authorization", "x-request-id", "x-forwarded-for", "x-forwarded-proto", "host")
RESPONSE_HEADERS = ("content-length", "content-type", "content-encoding")


def path_of(target: Column) -> Column:
    return F.substring_index(target, "?", 1)


def query_of(target: Column) -> Column:
    """Text behind the first question mark, '' without one."""
    return F.when(F.instr(target, "?") > 0, F.substring(target, F.instr(target, "?") + 1, F.length(target))).otherwise("")


def pairs(query: Column) -> Column:
    """``a=1&b`` as an array of (key, value); a missing value is ''."""
    parts = F.filter(F.split(query, "&", -1), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.when(F.instr(p, "=") > 0, F.substring(p, F.instr(p, "=") + 1, F.length(p))).otherwise("").alias("value")))


def last_wins(entries: Column) -> Column:
    """A map of (key, value) entries in which the last of equal keys stays."""
    keep = F.filter(F.transform(F.sequence(F.lit(1), F.size(entries)), lambda k: F.struct(F.element_at(entries, k).alias("e"), k.alias("k"))), lambda x: ~F.exists(F.slice(entries, x["k"] + 1, F.size(entries)), lambda y: y["key"] == x["e"]["key"]))
    return F.when(F.size(entries) > 0, F.map_from_entries(F.transform(keep, lambda x: x["e"]))).otherwise(F.create_map().cast("map<string,string>"))


def query_map(target: Column) -> Column:
    return last_wins(pairs(query_of(target)))


def wire_query(target: Column, query: Column) -> Column:
    """The query in the target, else the parsed parameters in order of key and value."""
    listed = F.array_sort(F.transform(F.map_entries(query), lambda e: F.struct(e["key"], e["value"])))
    text = F.array_join(F.transform(listed, lambda e: F.when(F.coalesce(e["value"], F.lit("")) == "", e["key"]).otherwise(F.concat(e["key"], F.lit("="), e["value"]))), "&")
    own = query_of(target)
    return F.when(own != "", own).otherwise(F.coalesce(text, F.lit("")))


def bytes_of(text: Column) -> Column:
    """The UTF-8 bytes of a text as an array of numbers."""
    h = F.hex(F.encode(text, "UTF-8"))
    n = F.octet_length(text)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.conv(F.substring(h, k * 2 + 1, F.lit(2)), 16, 10).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def api_id(method: Column, path: Column) -> Column:
    """31-bit DJB2 hash of ``method:path`` over bytes, at least 1."""
    text = F.concat(F.coalesce(method, F.lit("")), F.lit(":"), F.coalesce(path, F.lit("")))
    h = F.aggregate(bytes_of(text), F.lit(5381).cast("long"), lambda a, b: (a * 33 + b).bitwiseAND(F.lit(4294967295)))
    return F.greatest(F.lit(1).cast("long"), h.bitwiseAND(F.lit(2147483647)))


def joined_headers(lines: Column, cookie: str = ", ") -> Column:
    """Header lines as a map: lower-case trimmed names, repeats joined by ', ', ``set-cookie`` by newline."""
    entries = F.transform(F.filter(lines, lambda x: F.instr(x, ":") > 0), lambda x: F.struct(F.lower(F.btrim(F.substring_index(x, ":", 1))).alias("key"), F.btrim(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("value")))
    names = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    between = lambda k: F.when(k == "set-cookie", "\n").when(k == "cookie", cookie).otherwise(", ")
    return F.map_from_entries(F.transform(names, lambda k: F.struct(k, F.aggregate(F.filter(entries, lambda e: e["key"] == k), F.lit(None).cast("string"), lambda a, e: F.when(a.isNull(), e["value"]).otherwise(F.concat(a, between(k), e["value"]))))))


def head_lines(head: Column) -> Column:
    """Header lines of a message head up to the first empty line."""
    return F.split(F.regexp_extract(head, r"(?s)^[^\r\n]*\r?\n(.*?)(?:\r?\n\r?\n.*)?$", 1), r"\r?\n")


def parse_headers(head: Column) -> Column:
    return joined_headers(head_lines(head))


def parse_head(head: Column) -> Column:
    """kind, method, target, version, status of the first line; kind is null if it is neither."""
    line = F.regexp_extract(head, r"^([^\r\n]*)", 1)
    method = F.regexp_extract(line, r"^([A-Z]+) (\S+) (HTTP/1\.[01])$", 1)
    status = F.regexp_extract(line, r"^(HTTP/1\.[01]) ([1-9]\d\d)(?: .*)?$", 2)
    kind = F.when(method.isin(*METHODS), "request").when(status != "", "response")
    return F.struct(
        kind.alias("kind"), F.when(kind == "request", method).alias("method"), F.when(kind == "request", F.regexp_extract(line, r"^[A-Z]+ (\S+) ", 1)).alias("target"),
        F.when(kind.isNotNull(), F.regexp_extract(line, r"(HTTP/1\.[01])", 1)).alias("version"), F.when(kind == "response", F.when(status != "", status.try_cast("int"))).alias("status"),
    )


def body_framing(headers: Column, response: Column) -> Column:
    """'error', 'chunked', 'length:n', 'none' or 'until_close' by the rules of RFC 9112 section 6."""
    te, cl = headers["transfer-encoding"], headers["content-length"]
    codings = F.transform(F.split(F.lower(te), ","), lambda x: F.btrim(x))
    lengths = F.array_distinct(F.transform(F.split(cl, ","), lambda x: F.btrim(x)))
    return (
        F.when(te.isNotNull() & cl.isNotNull(), "error")
        .when(te.isNotNull(), F.when(F.element_at(codings, -1) == "chunked", "chunked").when(response, "until_close").otherwise("error"))
        .when(cl.isNotNull(), F.when((F.size(lengths) == 1) & F.element_at(lengths, 1).rlike(r"^\d{1,18}$"), F.concat(F.lit("length:"), F.element_at(lengths, 1).try_cast("long").cast("string"))).otherwise("error"))
        .otherwise(F.when(response, "until_close").otherwise("none"))
    )


def content_length(headers: Column) -> Column:
    return F.coalesce(headers["content-length"].try_cast("long"), F.lit(0).cast("long"))


def extra_headers(headers: Column, named: tuple[str, ...] = REQUEST_HEADERS) -> Column:
    """Headers without a wire key of their own as JSON text, names in order."""
    rest = F.map_from_entries(F.array_sort(F.map_entries(F.map_filter(headers, lambda k, v: ~k.isin(*named)))))
    return F.coalesce(F.to_json(rest), F.lit("{}"))


def base64_text(text: Column) -> Column:
    """Base64 without line breaks; null for null and empty texts."""
    return F.when(F.length(text) > 0, F.regexp_replace(F.base64(F.encode(text, "UTF-8")), r"[\r\n]", ""))


def preview(body: Column, limit: int = 8192) -> Column:
    """The first ``limit`` bytes as text, invalid sequences replaced, empty as null."""
    return F.nullif(F.make_valid_utf8(F.substring(F.encode(body, "UTF-8"), 1, limit).cast("string")), F.lit(""))


def usable_request(method: Column, path: Column) -> Column:
    return F.coalesce(method.isin(*METHODS) & (F.length(path) > 0), F.lit(False))


def starts_message(prefix: Column) -> Column:
    """An HTTP/1 message begins here."""
    return F.coalesce(prefix.startswith("HTTP/1.") | prefix.rlike("^(" + "|".join(METHODS) + ") "), F.lit(False))


def interim(status: Column) -> Column:
    """1xx but for 101: never the final answer."""
    return F.coalesce((status >= 100) & (status < 200) & (status != 101), F.lit(False))
