"""Registration, table access and the stand-in views shared by query and SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rubrica.functions.numeric import hash_int, rounded

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Lazy handles on the parquet tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None, doubles: str = "", digits: int = 6):
    """Register a query; doubles are rounded alike on both sides."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return rounded(fn(Tables(spark, folder)), digits)

        QUERIES[name] = run
        if sql is not None:
            names = doubles.split()
            replace = (
                " REPLACE ("
                + ", ".join(f"CAST(round({c}, {digits}) AS DOUBLE) + CAST(0 AS DOUBLE) AS {c}" for c in names)
                + ")"
                if names
                else ""
            )
            ORACLES[name] = f"SELECT *{replace} FROM ({sql}) AS result"
        return fn

    return wrap


# ---------------------------------------------------------------------------
# Scored rows: parts with a half-step score, a fold and three predictions.
# ---------------------------------------------------------------------------


def fold_of(key: Column | str, folds: int = 5, salt: str = "fold") -> Column:
    return (hash_int(F.lit(salt), key) % folds).cast("bigint")


def sql_hash(*parts: str) -> str:
    text = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)"


def sql_fold(key: str, folds: int = 5, salt: str = "fold") -> str:
    return f"({sql_hash(repr(salt), key)} % {folds})"


def scored(t: Tables) -> DataFrame:
    x = (F.col("p_retailprice") - 900) / 20
    noise = (hash_int(F.lit("voice"), "p_partkey") % 1000) / 200.0
    return t.part.select(
        F.col("p_partkey").alias("key"),
        F.when(x < 0.75, 0.0).otherwise(F.floor(x * 2 + 0.5) / 2).cast("double").alias("label"),
        fold_of("p_partkey").alias("fold"),
        (x * 0.55 + (F.col("p_size") / 10.0) * 0.45).alias("text"),
        (x * 0.4 + noise * 0.6).alias("audio"),
        (x * 0.75 + noise * 0.3 - (F.col("p_size") / 10.0) * 0.05).alias("voice"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("kind"),
        F.col("p_size").cast("double").alias("size"),
        F.col("p_retailprice").alias("price"),
    )


SCORED = f"""scored AS (
  SELECT p_partkey AS key,
    CAST(CASE WHEN x < 0.75 THEN 0 ELSE floor(x * 2 + 0.5e0) / 2 END AS DOUBLE) AS label,
    {sql_fold("p_partkey")} AS fold,
    x * 0.55e0 + (p_size / 10e0) * 0.45e0 AS text,
    x * 0.4e0 + noise * 0.6e0 AS audio,
    x * 0.75e0 + noise * 0.3e0 - (p_size / 10e0) * 0.05e0 AS voice,
    p_brand AS brand, p_type AS kind, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price
  FROM (SELECT *, (p_retailprice - 900) / 20 AS x,
          ({sql_hash("'voice'", "p_partkey")} % 1000) / 200e0 AS noise FROM part))"""

RMSE = "sqrt(avg(({0} - {1}) * ({0} - {1})))"
PEARSON = "covar_pop({0}, {1}) / nullif(stddev_pop({0}) * stddev_pop({1}), 0)"


def sql_rmse(y: str, p: str) -> str:
    return RMSE.format(y, p)


def sql_pearson(x: str, y: str) -> str:
    return PEARSON.format(x, y)
