"""Delivery of micro-batches.

``deliver`` posts envelopes from executors, one request each, and returns what
became of every one; a replayed batch sends the same ids again, so a receiver
that keeps one copy per id sees each event once.
"""

from __future__ import annotations

import gzip
import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Bodies above this many bytes are compressed; so many attempts; waits between them.
GZIP_ABOVE, ATTEMPTS, FIRST_WAIT_S, MOST_WAIT_S, ERROR_BYTES = 4096, 3, 0.2, 10.0, 512


def encode(body: str) -> tuple[bytes, dict[str, str]]:
    raw = body.encode()
    head = {"content-type": "application/json"}
    return (gzip.compress(raw), head | {"content-encoding": "gzip"}) if len(raw) > GZIP_ABOVE else (raw, head)


def post(url: str, data: bytes, headers: dict[str, str], timeout: float = 30.0) -> tuple[int | None, str, float | None]:
    """(status or null if nothing connected, start of an error body, Retry-After)."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, data, headers), timeout=timeout) as r:
            return r.status, "", None
    except urllib.error.HTTPError as e:
        wait = e.headers.get("retry-after", "")
        return e.code, e.read(ERROR_BYTES).decode("utf-8", "replace"), float(wait) if wait.isdigit() else None
    except TimeoutError:
        return 0, "timeout", None
    except OSError as e:
        return None, str(e)[:ERROR_BYTES], None


def send(body: str, url: str, how: Callable = post, sleep: Callable = time.sleep) -> tuple[bool, int, str]:
    """(delivered, attempts, error): sent again only where the receiver cannot have taken it (no connection, 429, 503), never after a timeout."""
    data, head = encode(body)
    for k in range(1, ATTEMPTS + 1):
        status, error, wait = how(url, data, head)
        if status is not None and 200 <= status < 300:
            return True, k, ""
        if status not in (None, 429, 503) or k == ATTEMPTS:
            return False, k, error or f"status {status}"
        sleep(wait if wait is not None else random.uniform(0, min(MOST_WAIT_S, FIRST_WAIT_S * 2**k)))
    return False, ATTEMPTS, ""


def deliver(envelopes: DataFrame, ident: str, url: str, how: Callable = post) -> DataFrame:
    """(id, delivered, attempts, error) of rows with an ``envelope``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(i, *send(e, url, how)) for i, e in zip(b[ident], b["envelope"])], columns=["id", "delivered", "attempts", "error"])

    return envelopes.select(ident, "envelope").mapInPandas(run, "id long, delivered boolean, attempts int, error string")


def start(stream: DataFrame, to_envelopes: Callable[[DataFrame, int], DataFrame], url: str, report: str, checkpoint: str, interval: str = "1 second"):
    """Packs and posts each micro-batch and appends the outcomes to ``report``; the batch number is the sequence."""
    def each(df: DataFrame, batch: int) -> None:
        deliver(to_envelopes(df, batch), "batch", url).write.mode("append").parquet(report)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()
