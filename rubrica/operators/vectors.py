"""Pooling of vector columns.

A vector of known dimension is summed as that many scalar sums in one
aggregate: map-side partials keep one buffer per group and no row is exploded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import let, quotient


def entries(vector: str, dimension: int) -> list[Column]:
    return [F.get(F.col(vector), F.lit(i)).cast("double") for i in range(dimension)]


def squared_length(vector: Column | str) -> Column:
    return F.aggregate(
        F.col(vector) if isinstance(vector, str) else vector,
        F.lit(0.0),
        lambda acc, x: acc + x.cast("double") * x.cast("double"),
    )


def unit(vector: Column | str, floor: float = 0.0) -> Column:
    """Vector divided by its length; NULL for zero length unless a floor is given."""
    v = F.col(vector) if isinstance(vector, str) else vector
    length = F.sqrt(squared_length(v))
    length = F.greatest(length, F.lit(floor)) if floor else F.nullif(length, F.lit(0.0))
    return let(length, lambda size: F.transform(v, lambda x: x.cast("double") / size))


def weighted_vector_mean(df: DataFrame, key: Sequence[str], vector: str, weight: Column, dimension: int, name: str = "vector") -> DataFrame:
    """Mean of vectors weighted by a column; zeros where the weights sum to 0."""
    w = weight.cast("double")
    sums = df.withColumn("__w", w).groupBy(*key).agg(
        F.sum("__w").alias("__total"),
        *[F.sum(e * F.col("__w")).alias(f"__s{i}") for i, e in enumerate(entries(vector, dimension))],
    )
    return sums.select(
        *key,
        F.array(*[F.coalesce(quotient(f"__s{i}", "__total"), F.lit(0.0)) for i in range(dimension)]).alias(name),
    )


def masked_mean_pool(df: DataFrame, key: Sequence[str], vector: str, mask: Column, dimension: int) -> DataFrame:
    """Mean of the vectors where the mask holds, zero-safe."""
    return weighted_vector_mean(df, key, vector, F.when(mask, 1.0).otherwise(0.0), dimension)


def layer_stats(df: DataFrame, key: Sequence[str], vector: str, dimension: int) -> DataFrame:
    """Count, mean and population deviation per dimension from mergeable sums."""
    cells = entries(vector, dimension)
    sums = df.groupBy(*key).agg(
        F.count("*").alias("frames"),
        *[F.sum(e).alias(f"__s{i}") for i, e in enumerate(cells)],
        *[F.sum(e * e).alias(f"__q{i}") for i, e in enumerate(cells)],
    )

    def deviation(i: int) -> Column:
        mean = F.col(f"__s{i}") / F.col("frames")
        return F.sqrt(F.greatest(F.col(f"__q{i}") / F.col("frames") - mean * mean, F.lit(0.0)))

    return sums.select(
        *key,
        "frames",
        F.array(*[F.col(f"__s{i}") / F.col("frames") for i in range(dimension)]).alias("mean"),
        F.array(*[deviation(i) for i in range(dimension)]).alias("std"),
    )


def unit_mean(df: DataFrame, key: Sequence[str], vector: str, dimension: int) -> DataFrame:
    """Mean direction of unit vectors, renormalised; NULL when it has no length."""
    units = df.withColumn("__u", unit(vector, 1e-12))
    pooled = weighted_vector_mean(units, key, "__u", F.lit(1.0), dimension)
    return pooled.withColumn("vector", unit("vector"))


def centred_units(df: DataFrame, vector: str, reference: DataFrame, dimension: int) -> DataFrame:
    """Subtract the reference mean and normalise.  The mean is one row."""
    centre = weighted_vector_mean(reference, [], vector, F.lit(1.0), dimension, "__centre")
    shifted = df.crossJoin(F.broadcast(centre)).withColumn(
        "__shifted", F.zip_with(vector, "__centre", lambda x, c: x.cast("double") - c)
    )
    return shifted.withColumn("unit", unit("__shifted")).drop("__centre", "__shifted")


def view_average(views: DataFrame, key: Sequence[str], prediction: str = "prediction") -> DataFrame:
    """Mean prediction over feature views."""
    return views.groupBy(*key).agg(F.avg(prediction).alias("prediction"))
