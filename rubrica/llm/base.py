"""Registration of the queries of this subpackage and small helpers they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, folder)`` under ``name``, beside the DuckDB SQL for its rows."""

    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Hand texts to Python in small record batches, so that what a task holds does not follow the rows of a batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


def lower_ascii(text: Column | str) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def typed(df: DataFrame, **kinds: str) -> DataFrame:
    """Only the named columns, cast; a missing one is an error of Spark's own."""
    return df.select(*[F.col(f"`{name}`").cast(kind).alias(name) for name, kind in kinds.items()])
