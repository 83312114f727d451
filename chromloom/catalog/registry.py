"""Named queries over the given tables, each with the SQL that states its result."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chromloom.catalog import fixtures
from chromloom.session import shared_dir


class Tables:
    """Lazy access to the given tables and to the views derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def stream(self, name: str, batches: int = 4) -> DataFrame:
        """A table as a stream of its files, one file or a folder of many, in about ``batches``
        micro-batches."""
        table = self(name)
        per = max(1, -(-len(table.inputFiles()) // batches))
        # a stream takes a single file only as a pattern
        pattern = f"{self.sf_dir}/{name}.parque[t]"
        return self.spark.readStream.schema(table.schema).option("maxFilesPerTrigger", per).parquet(pattern)

    def scratch(self, name: str) -> str:
        """A new path in the folder that all machines share."""
        return f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"

    def fx(self, name: str) -> DataFrame:
        return fixtures.VIEWS[name](self)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, fx: tuple[str, ...] = ()):
    """Register ``fn(tables)``; ``sql`` follows the common table expressions named in ``fx``.

    A body starting with a comma adds further expressions before its SELECT.
    """

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ctes = fixtures.with_clause(fx)
            body = sql.strip()
            if not ctes and body.startswith(","):
                body = "WITH " + body[1:]
            ORACLES[name] = f"{ctes} {body}".strip()
        return fn

    return register
