"""Anomaly features and keyword flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanforge.functions.http import bytes_of

# Substrings, compared in lower case.
SQLI = ("union select", "' or ", "1=1", "drop table", "insert into", "delete from", "update set", "--", "/*", "*/", "xp_", "exec(", "char(", "concat(", "benchmark(", "sleep(")
XSS = ("<script", "javascript:", "onerror=", "onload=", "onfocus=", "onmouseover=", "<img", "<svg", "<iframe", "alert(", "document.cookie")
INJECTION = ("ignore previous instructions", "ignore all previous", "you are now", "disregard the above", "system prompt", "jailbreak", "act as", "\n\nhuman:", "\n\nassistant:", "<|im_start|>", "[inst]")
PERMISSION = ("execute", "admin", "root", "sudo", "chmod", "write", "delete", "drop", "truncate", "shell", "cmd", "bash", "system", "eval", "exec", "spawn")


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    low = F.lower(text)
    out = F.lit(False)
    for w in words:
        out = out | F.contains(low, F.lit(w))
    return F.coalesce(out, F.lit(False))


def all_of(text: Column, words: tuple[str, ...]) -> Column:
    """The words that occur, in the order given."""
    low = F.lower(text)
    return F.filter(F.array(*(F.when(F.contains(low, F.lit(w)), w) for w in words)), lambda x: x.isNotNull())


def in_target(path: Column, query: Column, words: tuple[str, ...]) -> Column:
    return any_of(path, words) | F.coalesce(F.exists(F.map_values(query), lambda v: any_of(v, words)), F.lit(False))


def entropy(text: Column) -> Column:
    """Shannon entropy in bits per byte; 0 for null and empty texts.

    One byte value after the other is removed from the hex form, so the work
    is one pass for each of the distinct bytes of a text.
    """
    b = bytes_of(text)
    n = F.size(b).cast("double")
    total = F.aggregate(F.array_distinct(b), F.lit(0.0), lambda a, x: a - (lambda p: p * F.log2(p))(F.size(F.filter(b, lambda y: y == x)).cast("double") / n))
    return F.when(F.octet_length(text) > 0, total).otherwise(0.0)


def anomaly_features(target: Column, query: Column, body_length: Column) -> Column:
    return F.struct(
        F.least(F.lit(255), F.length(target) - F.length(F.replace(target, F.lit("/"), F.lit("")))).cast("short").alias("path_depth"),
        F.least(F.lit(255), F.coalesce(F.size(F.map_keys(query)), F.lit(0))).cast("short").alias("query_param_count"),
        target.contains("%").alias("has_encoded_chars"),
        F.when(body_length > 0, F.floor(F.log2(body_length))).otherwise(0).cast("short").alias("request_size_bucket"),
        entropy(target).cast("float").alias("shannon_entropy"),
        in_target(target, query, SQLI).alias("has_sqli_pattern"),
        in_target(target, query, XSS).alias("has_xss_pattern"),
        (target.contains("../") | target.contains("..\\")).alias("has_path_traversal"),
    )
