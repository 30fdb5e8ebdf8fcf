"""Guarded arithmetic and error-metric column expressions.

Every function takes and returns ``Column`` objects, so the expressions stay in
whole-stage code generation and aggregate with map-side partials.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INFINITY = float("inf")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    An expression used inside a lambda is otherwise evaluated for every element
    of the array the lambda runs over.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Quotient that is 0 where the denominator is 0 (or the quotient undefined)."""
    return F.coalesce(F.try_divide(col(numerator).cast("double"), col(denominator).cast("double")), F.lit(0.0))


def quotient(numerator: Column | str, denominator: Column | str) -> Column:
    """Quotient that is NULL where the denominator is 0."""
    return F.try_divide(col(numerator).cast("double"), col(denominator).cast("double"))


def is_finite(value: Column | str) -> Column:
    value = col(value).cast("double")
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(INFINITY))


def share(condition: Column) -> Column:
    """Share of rows where the condition holds."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def count_where(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.lit(1)).otherwise(F.lit(0))), F.lit(0)).cast("bigint")


def rmse(label: Column | str, prediction: Column | str) -> Column:
    """Root mean squared error in one pass, safe for very large and very small errors.

    Squares of errors beyond about 1e154 overflow a double; the aggregate
    therefore keeps a scaled-down and a scaled-up sum next to the plain one and
    picks the one that fits the largest error.
    """
    e = col(label) - col(prediction)
    top = F.max(F.abs(e))
    down, up = e * F.lit(1e-200), e * F.lit(1e200)
    return (
        F.when(top == 0, F.lit(0.0))
        .when(top > 1e150, F.lit(1e200) * F.sqrt(F.avg(down * down)))
        .when(top < 1e-150, F.lit(1e-200) * F.sqrt(F.avg(up * up)))
        .otherwise(F.sqrt(F.avg(e * e)))
    )


def constant(value: Column) -> Column:
    """Aggregate: all values are one finite number.

    The engine's moments are no test of that: merging the means of partial
    aggregates rounds, so equal values can get a variance just above 0.
    """
    return (F.min(value) == F.max(value)) & is_finite(F.max(value))


def pearson(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation; NULL for fewer than two rows or a constant side."""
    x, y = col(x).cast("double"), col(y).cast("double")
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    varied = ~constant(x) & ~constant(y)
    return F.when(varied, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def weighted_rmse(label: Column | str, prediction: Column | str, weight: Column | str) -> Column:
    e = col(label) - col(prediction)
    return F.sqrt(F.try_divide(F.sum(col(weight) * e * e), F.sum(col(weight))))


def clip(value: Column | str, low: float | None, high: float | None) -> Column:
    value = col(value)
    if low is not None:
        value = F.greatest(value, F.lit(float(low)))
    if high is not None:
        value = F.least(value, F.lit(float(high)))
    return value


def report_number(value: Column | str) -> Column:
    """Text form for reports: NaN becomes NULL, infinities become words."""
    value = col(value).cast("double")
    return (
        F.when(value.isNull() | F.isnan(value), F.lit(None).cast("string"))
        .when(value == F.lit(INFINITY), F.lit("Infinity"))
        .when(value == F.lit(-INFINITY), F.lit("-Infinity"))
        .otherwise(value.cast("string"))
    )


def hash_int(*parts: Column | str) -> Column:
    """Engine-independent non-negative integer from the md5 of the joined parts."""
    text = F.concat_ws("|", *[col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (floats come out as rounded doubles)."""
    return df.select(
        *[
            F.round(F.col(f"`{f.name}`").cast("double"), digits).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )
