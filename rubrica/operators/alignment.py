"""Keyed alignment: one-to-one joins, reordering, reconciliation and unions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import count_where


def union_frames(frames: dict[str, DataFrame], tag: str = "split") -> DataFrame:
    """Stack frames by column name with a tag column."""
    tagged = [df.select(F.lit(name).alias(tag), "*") for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b), tagged)


def key_reconcile(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys on one side only: ``missing`` from the right, ``unexpected`` in it.

    Keys are reduced to distinct rows before the join, so repeats of one key
    collapse in the partial aggregate and never meet in one task.
    """
    key = list(key)
    a = left.select(*key).distinct().withColumn("__l", F.lit(1))
    b = right.select(*key).distinct().withColumn("__r", F.lit(1))
    joined = a.join(b, key, "full_outer")
    return joined.where("__l IS NULL OR __r IS NULL").select(
        *key, F.when(F.col("__r").isNull(), "missing").otherwise("unexpected").alias("rule")
    )


def aligned_join(
    labels: DataFrame, features: DataFrame, folds: DataFrame, key: Sequence[str], extra_allowed: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Inner join of three keyed tables plus the violations that would break it.

    Violations: repeated keys in any table, labelled keys without features or
    fold, and (unless allowed) feature or fold keys without a label.
    """
    from .quality import duplicate_keys

    key = list(key)
    joined = labels.join(features, key).join(folds, key)
    checks = [
        duplicate_keys(df, key).withColumn("table", F.lit(name))
        for name, df in (("labels", labels), ("features", features), ("folds", folds))
    ]
    shape = [F.to_json(F.struct(*key)).alias("key"), "rule", "table"]
    parts = [c.select(*shape) for c in checks]
    for name, df in (("features", features), ("folds", folds)):
        gaps = key_reconcile(labels, df, key).withColumn("table", F.lit(name))
        if extra_allowed:
            gaps = gaps.where(F.col("rule") == "missing")
        parts.append(gaps.select(*shape))
    return joined, reduce(lambda a, b: a.unionByName(b), parts)


def keyed_reorder(df: DataFrame, reference: DataFrame, key: Sequence[str], position: str) -> DataFrame:
    """Rows of ``df`` with the position of their key in the reference, in that order."""
    return df.join(reference.select(*key, position), list(key)).orderBy(position)


def oof_agreement(left: DataFrame, right: DataFrame, key: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """Count of disagreements between two out-of-fold tables by rule."""
    key = list(key)
    a = left.select(*key, F.col("label").alias("__la"), F.col("fold").alias("__fa"), F.lit(1).alias("__l"))
    b = right.select(*key, F.col("label").alias("__lb"), F.col("fold").alias("__fb"), F.lit(1).alias("__r"))
    joined = a.join(b, key, "full_outer")
    both = F.col("__l").isNotNull() & F.col("__r").isNotNull()
    return joined.agg(
        count_where(both).alias("matched"),
        count_where(F.col("__r").isNull()).alias("missing"),
        count_where(F.col("__l").isNull()).alias("unexpected"),
        count_where(both & (F.abs(F.col("__la") - F.col("__lb")) > tolerance)).alias("label_differs"),
        count_where(both & ~F.col("__fa").eqNullSafe(F.col("__fb"))).alias("fold_differs"),
    )


def oof_parity(rebuilt: DataFrame, stored: DataFrame, key: Sequence[str], tolerance: float) -> DataFrame:
    """Largest absolute difference of two prediction tables against a tolerance.

    ``unmatched`` counts keys on one side only and pairs without a number; any
    of them fails the tolerance.
    """
    key = list(key)
    a = rebuilt.select(*key, F.col("prediction").alias("__a"), F.lit(1).alias("__l"))
    b = stored.select(*key, F.col("prediction").alias("__b"), F.lit(1).alias("__r"))
    difference = F.abs(F.col("__a") - F.col("__b"))
    gap = F.max(difference)
    unmatched = count_where(difference.isNull() | F.isnan(difference))
    return a.join(b, key, "full_outer").agg(
        count_where(F.col("__l").isNotNull() & F.col("__r").isNotNull()).alias("n"),
        unmatched.alias("unmatched"),
        gap.alias("max_difference"),
        (F.coalesce(gap <= tolerance, F.lit(False)) & (unmatched == 0)).alias("within_tolerance"),
    )


def merge_indicator(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Full join with the side each row came from.  Other columns must not clash."""
    a = left.withColumn("__l", F.lit(1))
    b = right.withColumn("__r", F.lit(1))
    side = (
        F.when(F.col("__r").isNull(), "left_only").when(F.col("__l").isNull(), "right_only").otherwise("both")
    )
    return a.join(b, list(key), "full_outer").withColumn("merge", side).drop("__l", "__r")


def merge_coverage(merged: DataFrame) -> DataFrame:
    """Rows on the left only, on the right only and on both sides of ``merge_indicator``."""
    return merged.agg(
        F.count("*").alias("n"), *[count_where(F.col("merge") == side).alias(side) for side in ("both", "left_only", "right_only")]
    )


def set_overlap(sets: dict[str, DataFrame], key: str) -> DataFrame:
    """Sizes of the pairwise intersections and differences of several key sets.

    One shuffle: each key carries the names of the sets it belongs to.
    """
    tagged = reduce(
        lambda a, b: a.unionByName(b),
        [df.select(F.col(key).alias("__key"), F.lit(name).alias("__name")) for name, df in sets.items()],
    )
    member = tagged.groupBy("__key").agg(
        *[F.max(F.when(F.col("__name") == n, True).otherwise(False)).alias(n) for n in sets]
    )
    names = list(sets)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    row = member.agg(
        *[
            F.struct(
                F.lit(a).alias("first"),
                F.lit(b).alias("second"),
                count_where(F.col(a) & F.col(b)).alias("both"),
                count_where(F.col(a) & ~F.col(b)).alias("first_only"),
                count_where(~F.col(a) & F.col(b)).alias("second_only"),
            ).alias(f"{a}__{b}")
            for a, b in pairs
        ]
    )
    return row.select(F.explode(F.array(*[f"{a}__{b}" for a, b in pairs])).alias("p")).select("p.*")


def run_set(runs: DataFrame, names: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """One row per key with a prediction column per run and an agreement flag."""
    wide = runs.groupBy("key").agg(
        F.min("label").alias("label"),
        F.min("fold").alias("fold"),
        *[F.max(F.when(F.col("run") == n, F.col("prediction"))).alias(n) for n in names],
        (
            (F.max("label") - F.min("label") <= tolerance)
            & (F.max("fold") == F.min("fold"))
            & (F.count("prediction") == len(names))
            & (F.count_distinct("run") == len(names))
        ).alias("agrees"),
    )
    return wide


def assemble_texts(
    labels: DataFrame, folds: DataFrame, primary: DataFrame, alternative: DataFrame | None, key: str, keep: Column
) -> DataFrame:
    """Labelled, folded rows with a main text and, where given, a second one.

    A kept label without a fold or a main text is an error.
    """
    from .quality import enforce

    kept = labels.where(keep)
    for name, table in (("folds", folds), ("texts", primary)):
        gaps = kept.select(key).join(table.select(key), key, "left_anti").select(F.lit(f"missing_in_{name}").alias("rule"), key)
        enforce(gaps, f"text assembly ({name})")
    rows = kept.join(folds, key).join(primary, key)
    if alternative is not None:
        rows = rows.join(alternative, key, "left")
    return rows
