"""Ingest bodies: decompressed, checked, and kept or refused with a reason."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.operators.wire import rejected

MOST_BYTES = 128 << 20


def inflate(data: bytes | None, most: int = MOST_BYTES) -> tuple[str | None, str | None]:
    """(text, problem); compression is told by its magic bytes, whatever a header says, and a bomb stops at ``most``."""
    if not data:
        return None, "empty body"
    if data[:2] == b"\x1f\x8b":
        try:
            d = zlib.decompressobj(31)
            out = d.decompress(data, most + 1)
            if len(out) <= most and not d.eof:
                return None, "truncated gzip"
            data = out
        except zlib.error:
            return None, "invalid gzip"
    if len(data) > most:
        return None, "body too large"
    return data.decode("utf-8", "replace"), None


def bodies(files: DataFrame, content: str = "content", most: int = MOST_BYTES) -> DataFrame:
    """All columns but the content, with ``body`` and the first ``reason`` to refuse it, null if it is accepted."""
    rest = [f for f in files.schema if f.name not in (content, "body", "reason")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "body string", "reason string"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            both = [inflate(x, most) for x in b[content]]
            if len(b):
                yield b[[f.name for f in rest]].assign(body=[t for t, _ in both], reason=[p for _, p in both])

    checked = rejected(files.mapInPandas(run, schema).withColumnRenamed("reason", "_problem"), F.col("body"))
    return checked.withColumn("reason", F.coalesce("_problem", "reason")).drop("_problem")


def events(accepted: DataFrame) -> DataFrame:
    """The rows of accepted bodies, as variants."""
    return accepted.where("reason is null").select(F.explode(F.try_variant_get(F.try_parse_json("body"), "$.Batch", "array<variant>")).alias("event"))
