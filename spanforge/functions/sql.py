"""The plainest columns under SQL names, for queries written as text."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "target_path(t STRING) RETURNS STRING": "substring_index(t, '?', 1)",
    "target_query(t STRING) RETURNS STRING": "CASE WHEN instr(t, '?') > 0 THEN substr(t, instr(t, '?') + 1) ELSE '' END",
    "host_name(h STRING) RETURNS STRING": r"regexp_replace(regexp_replace(lower(h), ':[0-9]*$', ''), '[.]$', '')",
    "instant_ms(t BIGINT) RETURNS BIGINT": "CASE WHEN abs(t) >= 100000000000000000 THEN (t - pmod(t, 1000000)) DIV 1000000 WHEN abs(t) >= 100000000000000 THEN (t - pmod(t, 1000)) DIV 1000 ELSE t END",
    "is_truncated(flags INT, actual BIGINT, copied BIGINT) RETURNS BOOLEAN": "coalesce((flags & 1) <> 0 OR actual > copied, false)",
    "drop_rate_bps(dropped BIGINT, captured BIGINT) RETURNS BIGINT": "CASE WHEN captured > 0 THEN dropped * 10000 DIV captured ELSE 0 END",
    "is_interim(status INT) RETURNS BOOLEAN": "coalesce(status >= 100 AND status < 200 AND status <> 101, false)",
}


def register(spark: SparkSession) -> list[str]:
    """Create them as temporary functions of the session."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [h.split("(")[0] for h in FUNCTIONS]
