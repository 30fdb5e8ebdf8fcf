"""Regression metrics and error reports.

Reports over several levels (pooled, per fold, per band) come from one
aggregate with grouping sets; its partial sums are per group, so a fold or a
label that holds most rows costs nothing extra in the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import count_where, pearson, quotient, rmse, share, weighted_rmse
from .ranking import exact_quantiles

# ---- fixed values ----
OPEN_BANDS = (("low", None, 3.0), ("mid", 3.0, 4.0), ("high", 4.0, None))
CLOSED_BANDS = (("LOW", None, 2.0), ("MID", 2.5, 4.0), ("HIGH", 4.5, None))
SCORE_CUTS = (0.0, 2.25, 2.75, 3.25, 3.75, 4.25, 4.75, 5.0)
SCORE_CUT_NAMES = ("<=2", "2.5", "3", "3.5", "4", "4.5", "5")
# ----------------------


def regression_metrics(
    df: DataFrame, label: str = "label", prediction: str = "prediction", by: str | None = "fold"
) -> DataFrame:
    """RMSE and Pearson pooled and, with ``by``, per group; ``n`` counts the rows with both numbers."""
    measures = [
        F.count(F.col(label) - F.col(prediction)).alias("n"),
        rmse(label, prediction).alias("rmse"),
        pearson(label, prediction).alias("pearson"),
    ]
    if by is None:
        return df.agg(*measures)
    return (
        df.rollup(by)
        .agg(F.grouping(by).alias("__all"), *measures)
        .select(
            F.when(F.col("__all") == 1, "pooled").otherwise(by).alias("scope"),
            F.col(by),
            "n",
            "rmse",
            "pearson",
        )
    )


def weighted_error(
    df: DataFrame, label: str, prediction: str, weight: str, by: Sequence[str] = ()
) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), weighted_rmse(label, prediction, weight).alias("weighted_rmse")
    )


def fold_summary(df: DataFrame, label: str = "label", fold: str = "fold") -> DataFrame:
    """Size, centre and spread of the target per fold; the median is exact."""
    base = df.groupBy(fold).agg(
        F.count("*").alias("n"),
        F.avg(label).alias("mean"),
        F.stddev_pop(label).alias("std"),
        F.min(label).alias("min"),
        F.max(label).alias("max"),
    )
    return base.join(exact_quantiles(df, [fold], label, {"median": 0.5}), fold)


def score_diagnostics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Per exact label: prediction spread and signed, absolute and squared error."""
    error = F.col(prediction) - F.col(label)
    return df.groupBy(label).agg(
        F.count("*").alias("n"),
        F.avg(prediction).alias("prediction_mean"),
        F.stddev_pop(prediction).alias("prediction_std"),
        F.min(prediction).alias("prediction_min"),
        F.max(prediction).alias("prediction_max"),
        F.avg(error).alias("mean_signed_error"),
        F.avg(F.abs(error)).alias("mae"),
        rmse(label, prediction).alias("rmse"),
    )


def open_band(label: Column | str) -> Column:
    """low < 3 <= mid < 4 <= high."""
    label = F.col(label) if isinstance(label, str) else label
    return F.when(label < 3, "low").when(label < 4, "mid").when(label >= 4, "high")


def closed_band(label: Column | str) -> Column:
    """LOW <= 2, MID 2.5 to 4, HIGH >= 4.5; labels in the gaps belong to none."""
    label = F.col(label) if isinstance(label, str) else label
    return (
        F.when(label <= 2, "LOW")
        .when(label.between(2.5, 4), "MID")
        .when(label >= 4.5, "HIGH")
    )


def band_report(df: DataFrame, band: Column, names: Sequence[str], label: str, prediction: str) -> DataFrame:
    """Metrics per band; a band without rows keeps a row with n = 0."""
    measured = (
        df.withColumn("band", band)
        .where(F.col("band").isNotNull())
        .groupBy("band")
        .agg(
            F.count("*").alias("__n"),
            rmse(label, prediction).alias("rmse"),
            pearson(label, prediction).alias("pearson"),
            F.avg(F.abs(F.col(prediction) - F.col(label))).alias("mae"),
            F.avg(prediction).alias("mean_prediction"),
            F.avg(label).alias("mean_target"),
            F.avg(F.col(prediction) - F.col(label)).alias("mean_signed_error"),
        )
    )
    bands = df.sparkSession.createDataFrame([(n,) for n in names], "band string")
    return (
        bands.join(measured, "band", "left")
        .withColumn("n", F.coalesce("__n", F.lit(0)).cast("bigint"))
        .drop("__n")
    )


def cut_column(value: Column | str, cuts: Sequence[float], names: Sequence[str]) -> Column:
    """Right-closed bins; values outside every bin give NULL."""
    value = F.col(value) if isinstance(value, str) else value
    out = F.when((value > cuts[0]) & (value <= cuts[1]), names[0])
    for low, high, name in zip(cuts[1:-1], cuts[2:], names[1:]):
        out = out.when((value > low) & (value <= high), name)
    return out


def residual_by_cut(
    df: DataFrame, label: str, prediction: str, cuts=SCORE_CUTS, names=SCORE_CUT_NAMES
) -> DataFrame:
    return (
        df.withColumn("band", cut_column(label, cuts, names))
        .where(F.col("band").isNotNull())
        .groupBy("band")
        .agg(
            F.avg(F.col(prediction) - F.col(label)).alias("mean_residual"),
            F.count("*").alias("n"),
        )
    )


def subset_metrics(
    df: DataFrame, subsets: dict[str, Column], label: str, predictions: Sequence[str]
) -> DataFrame:
    """One row per named subset; a row may belong to several."""
    tagged = df.withColumn(
        "subset",
        F.explode(F.filter(
            F.array(*[F.when(condition, F.lit(name)) for name, condition in subsets.items()]),
            lambda s: s.isNotNull(),
        )),
    )
    last = predictions[-1]
    return tagged.groupBy("subset").agg(
        F.count("*").alias("n"),
        *[rmse(label, p).alias(f"rmse_{p}") for p in predictions],
        F.avg(F.col(last) - F.col(label)).alias("mean_error"),
    )


def prediction_distribution(df: DataFrame, prediction: str, low: float = 0.0, high: float = 5.0) -> DataFrame:
    p = F.col(prediction)
    return df.agg(
        F.count("*").alias("n"),
        F.min(p).alias("min"),
        F.max(p).alias("max"),
        F.avg(p).alias("mean"),
        F.stddev_pop(p).alias("std"),
        count_where(p < low).alias("below"),
        count_where(p > high).alias("above"),
        count_where((p < low) | (p > high)).alias("clipped"),
    )


def label_frequencies(df: DataFrame, label: str, low: float, high: float, bins: int) -> DataFrame:
    """Histogram count per value and equal-width bin index."""
    index = F.least(
        F.floor((F.col(label) - low) / ((high - low) / bins)), F.lit(bins - 1)
    ).cast("bigint")
    return (
        df.groupBy(label)
        .agg(F.count("*").alias("n"))
        .withColumn("bin", index)
    )


def describe(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles."""
    base = df.groupBy(*by).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    quartiles = exact_quantiles(df, by, value, {"p25": 0.25, "median": 0.5, "p75": 0.75})
    return base.join(quartiles, list(by)) if by else base.crossJoin(F.broadcast(quartiles))


def label_value_stats(df: DataFrame, label: str, value: str) -> DataFrame:
    """Another column's count, mean, exact median and sample deviation per label."""
    base = df.groupBy(label).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std")
    )
    return base.join(exact_quantiles(df, [label], value, {"median": 0.5}), label)


def label_subset_stats(df: DataFrame, label: str, value: str, subset: Column) -> DataFrame:
    """Per label: rows and mean of a column over all rows and over a subset, and the subset's share of its rows."""
    inside = F.coalesce(subset, F.lit(False))
    table = df.groupBy(label).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"),
        F.count(F.when(inside, 1)).alias("subset_n"), F.avg(F.when(inside, F.col(value))).alias("subset_mean"),
    )
    total = table.agg(F.sum("n").alias("__n"), F.sum("subset_n").alias("__s"))
    return table.crossJoin(F.broadcast(total)).select(
        label, "n", "mean", "subset_n", "subset_mean",
        quotient("n", "__n").alias("share"), quotient("subset_n", "__s").alias("subset_share"),
    )


def shared_keys(df: DataFrame, part: str, key: Sequence[str]) -> DataFrame:
    """Keys that occur in several parts: empty where the parts are disjoint."""
    return df.groupBy(*key).agg(F.count_distinct(part).alias("parts")).where("parts > 1")


def group_spread(df: DataFrame, group: str, value: str) -> DataFrame:
    """Mean within-group deviation of groups with several rows, next to the overall one."""
    per_group = df.groupBy(group).agg(
        F.count("*").alias("n"),
        F.stddev_pop(value).alias("sd"),
        F.sum(value).alias("s"),
        F.sum(F.col(value) * F.col(value)).alias("ss"),
    )
    total, s, ss = F.sum("n"), F.sum("s"), F.sum("ss")
    return per_group.agg(
        F.count("*").alias("groups"),
        count_where(F.col("n") > 1).alias("repeated_groups"),
        F.max("n").alias("largest_group"),
        F.avg(F.when(F.col("n") > 1, F.col("sd"))).alias("mean_within_std"),
        F.sqrt(F.greatest(quotient(ss, total) - F.pow(quotient(s, total), 2), F.lit(0.0))).alias(
            "overall_std"
        ),
    )


def pairwise_combinations(df: DataFrame, name: str) -> DataFrame:
    """All unordered pairs of the distinct names (a list of models, not of rows)."""
    names = df.select(name).distinct()
    left, right = names.withColumnRenamed(name, "first"), names.withColumnRenamed(name, "second")
    return left.join(right, F.col("first") < F.col("second"))


def seed_group_mean(runs: DataFrame, key: Sequence[str], group: str, prediction: str) -> DataFrame:
    """Average the runs of a group first, then the groups with equal weight."""
    per_group = runs.groupBy(*key, group).agg(F.avg(prediction).alias("__p"))
    return per_group.groupBy(*key).agg(F.avg("__p").alias("prediction"))


def best_epoch(history: DataFrame, group: str, epoch: str, metric: str) -> DataFrame:
    """First epoch that attains the smallest metric of its group."""
    return history.groupBy(group).agg(
        F.min_by(epoch, F.struct(metric, epoch)).alias("best_epoch"), F.min(metric).alias("best_metric")
    )


def complementarity(df: DataFrame, label: str, first: str, second: str, by: str = "fold") -> DataFrame:
    """Correlation of two models' predictions and of their residuals."""
    y = F.col(label)
    return (
        df.rollup(by)
        .agg(
            F.grouping(by).alias("__all"),
            F.count("*").alias("n"),
            pearson(first, second).alias("prediction_correlation"),
            pearson(y - F.col(first), y - F.col(second)).alias("residual_correlation"),
        )
        .select(
            F.when(F.col("__all") == 1, "pooled").otherwise(by).alias("scope"),
            by,
            "n",
            "prediction_correlation",
            "residual_correlation",
        )
    )


def pairwise_model_correlations(df: DataFrame, label: str, models: Sequence[str]) -> DataFrame:
    """Complementarity of every pair of prediction columns, in one pass over the rows."""
    pairs = [(a, b) for i, a in enumerate(models) for b in models[i + 1 :]]
    y = F.col(label)
    row = df.agg(
        *[
            F.struct(
                F.lit(a).alias("first"),
                F.lit(b).alias("second"),
                pearson(a, b).alias("prediction_correlation"),
                pearson(y - F.col(a), y - F.col(b)).alias("residual_correlation"),
            ).alias(f"{a}__{b}")
            for a, b in pairs
        ]
    )
    return row.select(F.explode(F.array(*[f"{a}__{b}" for a, b in pairs])).alias("p")).select("p.*")


def column_correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All-pairs Pearson matrix of prediction columns as tall rows."""
    row = df.agg(*[
        F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), pearson(a, b).alias("pearson")).alias(f"{a}__{b}")
        for a in columns for b in columns
    ])
    return row.select(
        F.explode(F.array(*[f"{a}__{b}" for a in columns for b in columns])).alias("p")
    ).select("p.*")


def run_report(df: DataFrame, label: str, columns: dict[str, str]) -> DataFrame:
    """Metrics of several prediction columns as one row each, in one pass."""
    row = df.agg(*[
        F.struct(
            F.lit(name).alias("model"),
            F.count("*").alias("n"),
            rmse(label, c).alias("rmse"),
            pearson(label, c).alias("pearson"),
        ).alias(name)
        for name, c in columns.items()
    ])
    return row.select(F.explode(F.array(*columns)).alias("m")).select("m.*")


def reference_deviation(metrics: DataFrame, reference: DataFrame, on: Sequence[str], tolerance: float) -> DataFrame:
    """Metric minus its stored reference with a flag above the tolerance; a metric without a reference is material."""
    joined = metrics.join(reference, list(on), "left")
    delta = F.col("value") - F.col("reference")
    return joined.withColumn("delta", delta).withColumn("material", F.coalesce(F.abs(delta) > tolerance, F.lit(True)))


def first_n_per_partition(df: DataFrame, part: str, order: Sequence[str], n: int) -> DataFrame:
    """First rows of each partition; the engine keeps only n per task before the shuffle."""
    from pyspark.sql import Window

    w = Window.partitionBy(part).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def topk_rows(df: DataFrame, score: Column, k: int, tie: Sequence[str], descending: bool = True) -> DataFrame:
    """Stable top-k report; ties go to the smaller key."""
    key = score.desc() if descending else score.asc()
    return df.orderBy(key, *tie).limit(k)


def mix_shares(df: DataFrame, split: str, properties: dict[str, Column]) -> DataFrame:
    """Share of rows per property and split."""
    return df.groupBy(split).agg(
        F.count("*").alias("n"), *[share(c).alias(name) for name, c in properties.items()]
    )
