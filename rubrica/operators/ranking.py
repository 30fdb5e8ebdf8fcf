"""Exact order statistics without putting a whole group into one task.

A window ordered over a column needs the whole partition in one task, and the
built-in exact percentile keeps every distinct value of a group in one map.
Neither holds for a column of a 100 TB table.  Two plans take their place, at every size:

* **Running counts** (ranks, ECDF, KS) are a parallel prefix sum.  Equal values collapse to
  counts, which are dealt by ranges of (group, value); each range is ordered by itself, and
  the totals of the ranges before it are added.
* **Quantiles** are selected between brackets.  A mergeable quantile sketch of each group
  gives a lower and an upper bound of every wanted value; a second pass counts what lies
  outside the brackets and keeps single values only inside.  That the brackets hold the
  wanted ranks is checked, and a group where they do not is bracketed by its extremes, so
  results are exact whatever the sketch does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

ALL = "__all"
ACCURACY = 10_000  # of the sketch: ranks are off by at most one row in so many
BROADCAST_ROWS = 20_000


def value_counts(
    df: DataFrame, groups: Sequence[str], value: str, counts: dict[str, Column] | None = None
) -> DataFrame:
    """Distinct values of each group with their (possibly several) counts."""
    counts = counts or {"n": F.lit(1)}
    return df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(*[F.sum(c.cast("bigint")).alias(name) for name, c in counts.items()])


def _before(df: DataFrame, groups: Sequence[str], order: str, names: Sequence[str], suffix: str):
    span = Window.partitionBy(*groups).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.select(
        "*", *[F.coalesce(F.sum(n).over(span), F.lit(0)).alias(n + suffix) for n in names]
    )


def broadcast_small(df: DataFrame, limit: int) -> DataFrame:
    """Broadcast a derived table when it is seen to have at most ``limit`` rows."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema, verifySchema=False))


def cumulative(counted: DataFrame, groups: Sequence[str], value: str, names: Sequence[str] = ("n",)) -> DataFrame:
    """Add ``<name>_before``: the count of strictly smaller values in the group.

    ``counted`` has one row per (group, value), as ``value_counts`` returns it.  No task orders
    more than one range of it.
    """
    groups = list(groups)
    # A struct as key keeps groups whose columns are NULL together.
    key = F.struct(*groups) if groups else F.struct(F.lit(0).alias("all"))
    # Ranges are drawn by sampling, so they are stored before they are used twice.
    placed = stored(counted.withColumn("__key", key).repartitionByRange("__key", value).withColumn("__range", F.spark_partition_id()), "value-ranges")
    totals = placed.groupBy("__key", "__range").agg(*[F.sum(n).alias(n) for n in names])
    offsets = _before(totals, ["__key"], "__range", names, "_offset").select("__key", "__range", *[n + "_offset" for n in names])
    inside = _before(placed, ["__key", "__range"], value, names, "_inside")
    return inside.join(offsets, ["__key", "__range"]).select(
        *groups,
        value,
        *names,
        *[(F.col(n + "_inside") + F.col(n + "_offset")).alias(n + "_before") for n in names],
    )


def exact_quantiles(df: DataFrame, groups: Sequence[str], value: str, probabilities: dict[str, float], accuracy: int = ACCURACY) -> DataFrame:
    """Linearly interpolated quantiles per group, one column per named probability.  NaN is the largest value."""
    # Own names inside: groups and values may have any name.
    outer, groups = list(groups), [f"__g{i}" for i in range(len(groups))]
    key = F.struct(*[F.col(g).alias(own) for g, own in zip(outer, groups, strict=True)]) if groups else F.struct(F.lit(0).alias("all"))
    number = F.col(value).cast("double")
    base = stored(df.where(F.col(value).isNotNull()).select(key.alias("__k"), F.nanvl(number, F.lit(float("inf"))).alias("__v"), F.isnan(number).alias("__nan")), "quantile-values")
    wanted = sorted(set(probabilities.values()))
    slack = 3.0 / accuracy
    points = [max(p - slack, 0.0) for p in wanted] + [min(p + slack, 1.0) for p in wanted]
    sketch = base.groupBy("__k").agg(
        F.count("*").alias("__total"), F.sum(F.col("__nan").cast("bigint")).alias("__nans"), F.min("__v").alias("__min"), F.max("__v").alias("__max"),
        F.percentile_approx("__v", points, accuracy).alias("__q"),
    )
    at = lambda i: F.get("__q", F.lit(i))
    low = [F.when(F.lit(p <= 0), F.col("__min")).otherwise(at(i)) for i, p in enumerate(points[: len(wanted)])]
    high = [F.when(F.lit(p >= 1), F.col("__max")).otherwise(at(len(wanted) + i)) for i, p in enumerate(points[len(wanted) :])]
    brackets = stored(sketch.select("__k", "__total", "__nans", "__min", "__max", F.array(*low).alias("__lo"), F.array(*high).alias("__hi")), "quantile-brackets")
    ranks = {name: F.lit(float(p)) * (F.col("__total") - 1) for name, p in probabilities.items()}

    def pick(brackets: DataFrame) -> DataFrame:
        # What lies outside the brackets counts at the edge below it, behind the rows that are there.
        rows = base.join(brackets.select("__k", "__lo", "__hi"), "__k")
        lo, hi = ([F.get(f"__{side}", F.lit(i)) for i in range(len(wanted))] for side in ("lo", "hi"))
        inside, below = F.lit(False), [F.lit(float("-inf"))]
        for first, last in zip(lo, hi, strict=True):
            inside, below = inside | F.col("__v").between(first, last), [*below, F.when(last < F.col("__v"), last)]
        marked = rows.select("__k", F.when(inside, F.col("__v")).otherwise(F.greatest(*below)).alias("__v"), inside.cast("int").alias("__in"))
        counted = value_counts(marked, ["__k"], "__v", {"n": F.lit(1), "own": F.col("__in")})
        ordered = cumulative(counted, ["__k"], "__v", ("n", "own")).join(brackets.select("__k", "__total", "__nans"), "__k")
        picks, outputs = [], []
        for name, rank in ranks.items():
            for side, place in (("lo", F.floor(rank)), ("hi", F.ceil(rank))):
                # The last rows of a group with NaN are NaN; a place among rows at an edge finds nothing.
                real = F.when(place >= F.col("__total") - F.col("__nans"), float("nan")).otherwise(F.col("__v"))
                picks.append(F.max(F.when((F.col("n_before") <= place) & (place < F.col("n_before") + F.col("own")), real)).alias(f"__{name}_{side}"))
            picks.append(F.max(rank - F.floor(rank)).alias(f"__{name}_f"))
            first, last, part = (F.col(f"__{name}_{k}") for k in ("lo", "hi", "f"))
            outputs.append((first * (1 - part) + last * part).alias(name))
        return stored(ordered.groupBy("__k").agg(*picks).select("__k", *outputs), "quantiles")

    found = pick(brackets)
    lost = F.lit(False)
    for name in probabilities:
        lost = lost | F.col(name).isNull()
    missed = found.where(lost).select("__k")
    if not missed.isEmpty():
        ends = lambda side: F.array_repeat(f"__{side}", len(wanted))
        wide = brackets.join(missed, "__k", "left_semi").withColumns({"__lo": ends("min"), "__hi": ends("max")})
        found = found.where(~lost).unionByName(pick(wide))
    return found.select(*[F.col(f"__k.{own}").alias(g) for g, own in zip(outer, groups, strict=True)], *probabilities)


def hashed_positions(
    df: DataFrame, groups: Sequence[str], hashed: str, ties: Sequence[str], name: str = "position"
) -> DataFrame:
    """1-based position within a group in the order of a hex hash, then ``ties``.

    The first three hex digits split every group into 4,096 even cells, so no
    task orders more than a sliver of a group.
    """
    groups = list(groups) or [ALL]
    work = (df if ALL not in groups else df.withColumn(ALL, F.lit(0))).withColumn(
        "__cell", F.substring(hashed, 1, 3)
    )
    cells = _before(
        work.groupBy(*groups, "__cell").agg(F.count("*").alias("__n")), groups, "__cell", ["__n"], "_before"
    )
    inside = Window.partitionBy(*groups, "__cell").orderBy(hashed, *ties)
    return (
        work.withColumn("__row", F.row_number().over(inside))
        .join(cells.drop("__n"), [*groups, "__cell"])
        .withColumn(name, (F.col("__row") + F.col("__n_before")).cast("bigint"))
        .drop("__cell", "__row", "__n_before", ALL)
    )


def average_ranks(df: DataFrame, groups: Sequence[str], value: str, name: str) -> DataFrame:
    """One row per (group, value) with the average rank of its ties."""
    own = [f"__g{i}" for i in range(len(groups))]
    rows = df.select(*[F.col(g).alias(o) for g, o in zip(groups, own, strict=True)], F.col(value).alias("__v"))
    return _ranked(value_counts(rows, own, "__v"), groups, own, value, name)


def counted_ranks(counts: DataFrame, groups: Sequence[str], value: str, weight: str, name: str) -> DataFrame:
    """``average_ranks`` of rows that are given as counts."""
    own = [f"__g{i}" for i in range(len(groups))]
    rows = counts.select(*[F.col(g).alias(o) for g, o in zip(groups, own, strict=True)], F.col(value).alias("__v"), F.col(weight).alias("__w"))
    return _ranked(value_counts(rows, own, "__v", {"n": F.col("__w")}), groups, own, value, name)


def _ranked(counts: DataFrame, groups: Sequence[str], own: Sequence[str], value: str, name: str) -> DataFrame:
    ranked = cumulative(counts, own, "__v")
    return ranked.select(
        *[F.col(o).alias(g) for g, o in zip(groups, own, strict=True)],
        F.col("__v").alias(value),
        (F.col("n_before") + (F.col("n") + 1) / 2.0).alias(name),
    )
