"""Registration of queries with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame; ``sql`` is None where SQL cannot say it."""

    def register(f):
        assert name not in QUERIES, name
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


#: Rows of a dimension that is broadcast; beyond it Spark chooses.
SMALL = 4096


def small(rows: DataFrame, most: int = SMALL) -> DataFrame:
    """``rows`` marked for broadcast, if a count shows that they are few."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
