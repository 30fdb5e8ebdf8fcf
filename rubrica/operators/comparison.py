"""Paired comparison of two prediction columns and the decisions drawn from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import count_where, pearson, quotient, rmse, share
from .metrics import open_band


def paired_comparison(
    df: DataFrame, label: str = "label", old: str = "old", new: str = "new", fold: str = "fold"
) -> DataFrame:
    """Metrics of both columns and their differences: pooled, per fold, per band."""
    work = df.withColumn("band", open_band(label))
    grouped = work.groupingSets([[], [fold], ["band"]], fold, "band").agg(
        F.grouping(fold).alias("__gf"),
        F.grouping("band").alias("__gb"),
        F.count("*").alias("n"),
        rmse(label, old).alias("old_rmse"),
        rmse(label, new).alias("new_rmse"),
        pearson(label, old).alias("old_pearson"),
        pearson(label, new).alias("new_pearson"),
        F.avg(old).alias("mean_old"),
        F.avg(new).alias("mean_new"),
    )
    return grouped.select(
        F.when(F.col("__gf") == 0, "fold").when(F.col("__gb") == 0, "band").otherwise("pooled").alias("scope"),
        fold,
        "band",
        "n",
        "old_rmse",
        "new_rmse",
        "old_pearson",
        "new_pearson",
        "mean_old",
        "mean_new",
        (F.col("new_rmse") - F.col("old_rmse")).alias("rmse_delta"),
        (quotient(F.col("new_rmse") - F.col("old_rmse"), "old_rmse") * 100).alias("rmse_change_percent"),
        (F.col("new_pearson") - F.col("old_pearson")).alias("pearson_delta"),
    )


def improving_folds(comparison: DataFrame) -> DataFrame:
    """How many folds improve on each metric and on both."""
    lower, higher = F.col("rmse_delta") < 0, F.col("pearson_delta") > 0
    return comparison.where(F.col("scope") == "fold").agg(
        count_where(lower).alias("folds_improving_rmse"),
        count_where(higher).alias("folds_improving_pearson"),
        count_where(lower & higher).alias("folds_improving_both"),
    )


def win_rate(df: DataFrame, label: str, old: str, new: str) -> DataFrame:
    """Strict share of rows whose absolute error falls."""
    better = F.abs(F.col(label) - F.col(new)) < F.abs(F.col(label) - F.col(old))
    return df.agg(
        F.count("*").alias("n"),
        count_where(better).alias("wins"),
        share(better).alias("win_rate"),
    )


def paired_errors(df: DataFrame, label: str, old: str, new: str) -> DataFrame:
    """Residuals and absolute errors of both columns with the improvement."""
    y = F.col(label)
    return (
        df.withColumn("old_residual", y - F.col(old))
        .withColumn("new_residual", y - F.col(new))
        .withColumn("old_abs_error", F.abs("old_residual"))
        .withColumn("new_abs_error", F.abs("new_residual"))
        .withColumn("improvement", F.col("old_abs_error") - F.col("new_abs_error"))
    )


def error_extremes(errors: DataFrame, key: str, k: int = 20) -> DataFrame:
    """The k largest improvements and the k largest deteriorations."""
    best = errors.orderBy(F.desc("improvement"), key).limit(k).withColumn("kind", F.lit("improvement"))
    worst = errors.orderBy(F.asc("improvement"), key).limit(k).withColumn("kind", F.lit("deterioration"))
    return best.unionByName(worst)


def classify(rmse_value: Column, pearson_value: Column, ref_rmse: Column, ref_pearson: Column, tolerance: float = 1e-12) -> Column:
    """dominates, tradeoff or worse against a reference; undefined metrics give NULL."""
    lower = rmse_value < ref_rmse - tolerance
    higher = pearson_value > ref_pearson + tolerance
    return (
        F.when(lower.isNull() | higher.isNull(), F.lit(None))
        .when(lower & higher, "dominates")
        .when(lower | higher, "tradeoff")
        .otherwise("worse")
    )


def acceptance_gate(comparison: DataFrame, max_rmse: float, min_pearson: float, min_folds: int) -> DataFrame:
    """Pooled thresholds plus a minimum number of improving folds."""
    pooled = comparison.where(F.col("scope") == "pooled").select("new_rmse", "new_pearson")
    return pooled.crossJoin(F.broadcast(improving_folds(comparison))).select(
        "new_rmse",
        "new_pearson",
        "folds_improving_rmse",
        (
            (F.col("new_rmse") <= max_rmse)
            & (F.col("new_pearson") >= min_pearson)
            & (F.col("folds_improving_rmse") >= min_folds)
        ).alias("accepted"),
    )
