"""Where queries register themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..workers import ship, spread

#: Tables of texts, of which each row takes long.
TEXTS = ("documents", "pages", "conversations")
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, and the DuckDB SQL that it must equal."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:  # DuckDB's patterns ignore the case of all letters anyway, Java's only when told so
            ORACLES[f.__name__] = sql.replace("(?iu)", "(?i)").replace("(?ium)", "(?im)")
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in TEXTS else rows
