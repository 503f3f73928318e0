"""Named queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from spanforge.session import ship

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            @wraps(f)
            def run(spark: SparkSession, folder: str) -> DataFrame:
                ship(spark)
                # stored times have no zone and are to be read as UTC
                spark.conf.set("spark.sql.session.timeZone", "UTC")
                return f(spark, folder)

            self.queries[name] = run
            if sql is not None:
                self.sql[name] = sql
            return f

        return add
