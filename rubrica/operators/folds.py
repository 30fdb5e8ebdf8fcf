"""Fold assignment and the mean baseline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import quotient
from ..session import stored
from .ranking import BROADCAST_ROWS, broadcast_small, exact_quantiles, hashed_positions


def mean_baseline_params(df: DataFrame, label: str = "label", fold: str = "fold") -> DataFrame:
    """Mean of the other folds per fold, from one row of sums per fold; rows without a fold train nothing."""
    sums = df.where(F.col(fold).isNotNull()).groupBy(fold).agg(F.sum(label).alias("s"), F.count(label).alias("n"))
    totals = sums.agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    return sums.crossJoin(F.broadcast(totals)).select(
        fold, quotient(F.col("ts") - F.col("s"), F.col("tn") - F.col("n")).alias("prediction")
    )


def mean_baseline_oof(df: DataFrame, label: str = "label", fold: str = "fold") -> DataFrame:
    """Predict every row with the mean label of the other folds; NULL for a row without a fold."""
    return df.join(F.broadcast(mean_baseline_params(df, label, fold)), fold, "left")


def stratification_bins(
    df: DataFrame, label: str, n_bins: int = 5, n_splits: int = 5, name: str = "bin"
) -> DataFrame:
    """Right-closed quantile bins of the target.

    Repeated edges merge.  The bin count is lowered until every bin holds at
    least ``n_splits`` rows; one bin is the fallback.  Only edges and bin sizes
    (at most ``n_bins`` numbers) come to the driver.
    """
    rows = df.count()
    if rows < n_splits:
        raise ValueError("Fewer rows than folds")
    for count in range(min(n_bins, rows // n_splits), 1, -1):
        edges = bin_edges(df, label, count)
        inner = edges[1:-1]
        binned = df.withColumn(name, _bin_of(label, inner))
        sizes = [r["n"] for r in binned.groupBy(name).agg(F.count("*").alias("n")).collect()]
        if len(sizes) > 1 and min(sizes) >= n_splits or len(edges) == 2:
            return _contiguous(binned, name)
    return df.withColumn(name, F.lit(0).cast("bigint"))


def bin_edges(df: DataFrame, label: str, count: int) -> list[float]:
    """Distinct quantile edges, outer ones included."""
    probabilities = {f"q{i}": i / count for i in range(count + 1)}
    row = exact_quantiles(df, [], label, probabilities).first()
    return sorted({row[q] for q in probabilities})


def _bin_of(label: str, inner: Sequence[float]):
    """Number of inner edges strictly below the value."""
    total = F.lit(0)
    for edge in inner:
        total = total + F.when(F.col(label) > edge, 1).otherwise(0)
    return total.cast("bigint")


def _contiguous(df: DataFrame, name: str) -> DataFrame:
    """Renumber occupied bins 0, 1, 2, ... (empty ones vanish)."""
    used = sorted(r[0] for r in df.select(name).distinct().collect())
    if used == list(range(len(used))):
        return df
    out = F
    for position, bin_id in enumerate(used):
        out = out.when(F.col(name) == bin_id, position)
    return df.withColumn(name, out.cast("bigint"))


def stratified_folds(
    df: DataFrame, key: str, label: str, n_splits: int = 5, n_bins: int = 5, seed: int = 42
) -> DataFrame:
    """Deal the rows of each bin over the folds in the order of a seeded key hash.

    Dealing continues across bins, so fold sizes differ by at most one in total
    and inside every bin.  Positions come from hash cells, not from one ordered
    window per bin.
    """
    binned = stratification_bins(df, label, n_bins, n_splits).withColumn(
        "__h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    )
    sizes = binned.groupBy("bin").agg(F.count("*").alias("n"))
    before = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # at most n_bins rows
    offsets = sizes.withColumn("__offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    placed = hashed_positions(binned, ["bin"], "__h", [key], "__pos")
    return (
        placed.join(F.broadcast(offsets), "bin")
        .withColumn("fold", ((F.col("__pos") - 1 + F.col("__offset")) % n_splits).cast("bigint"))
        .drop("__h", "__pos", "__offset")
    )


def pack_sizes(counts: dict[int, int], n_splits: int) -> list[tuple[int, int, int, int]]:
    """``(size, fold, first, last)``: which places among the groups of a size go to which fold.

    Groups go to the lightest fold, largest first, the lower fold winning ties; all groups of
    one size are dealt at once, as the smallest of the totals that each fold would pass through.
    """
    totals, out = [0] * n_splits, []
    for size in sorted(counts, reverse=True):
        many = counts[size]
        passed = lambda level, size=size: sum((level - t) // size + 1 for t in totals if t <= level)
        low, high = min(totals) - 1, min(totals) + size * many
        while low < high:  # the highest level that is passed no more often than there are groups
            middle = (low + high + 1) // 2
            low, high = (middle, high) if passed(middle) <= many else (low, middle - 1)
        take = [(low - t) // size + 1 if t <= low else 0 for t in totals]
        for fold in [f for f in range(n_splits) if totals[f] + take[f] * size == low + 1][: many - sum(take)]:
            take[fold] += 1
        done = 0
        for fold, n in enumerate(take):
            if n:
                out.append((size, fold, done + 1, done + n))
                done += n
            totals[fold] += n * size
    return out


def group_folds(df: DataFrame, group: str, n_splits: int = 5) -> DataFrame:
    """Whole groups to folds, largest first, each to the fold with the fewest rows.

    Only counts of counts are packed (their number is at most the root of twice the rows, on
    the driver); which group of a size goes where follows from its place by hash, so no task
    sees all groups.
    """
    sizes = stored(df.groupBy(group).agg(F.count("*").alias("n")), "group-sizes")
    counts = {r["n"]: r["groups"] for r in sizes.groupBy("n").agg(F.count("*").alias("groups")).collect()}
    places = df.sparkSession.createDataFrame(pack_sizes(counts, n_splits), "__size bigint, fold bigint, __first bigint, __last bigint")
    hashed = sizes.withColumn("__h", F.md5(F.col(group).cast("string")))
    placed = hashed_positions(hashed, ["n"], "__h", [group], "__pos")
    own = (F.col("n") == F.col("__size")) & F.col("__pos").between(F.col("__first"), F.col("__last"))
    return placed.join(broadcast_small(places, BROADCAST_ROWS), own).select(group, F.col("n").alias("group_size"), "fold")


def unseen_group_mask(df: DataFrame, group: str, fold: str) -> DataFrame:
    """True where the row's group has no row in another fold."""
    spans = df.groupBy(group).agg((F.min(fold) == F.max(fold)).alias("unseen"))
    return df.join(spans, group)


def mean_baseline_report(df: DataFrame, label: str = "label", fold: str = "fold") -> DataFrame:
    """Per fold: the training mean used and the in-sample error it has there."""
    sums = df.groupBy(fold).agg(
        F.sum(label).alias("s"), F.count(label).alias("n"), F.sum(F.col(label) * F.col(label)).alias("q")
    )
    totals = sums.agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"), F.sum("q").alias("tq"))
    rest = lambda t, c: F.col(t) - F.col(c)
    mean = quotient(rest("ts", "s"), rest("tn", "n"))
    variance = quotient(rest("tq", "q"), rest("tn", "n")) - mean * mean
    return sums.crossJoin(F.broadcast(totals)).select(
        fold, rest("tn", "n").alias("train_n"), mean.alias("train_mean"), F.sqrt(F.greatest(variance, F.lit(0.0))).alias("train_rmse")
    )
