"""Flagship plan: evaluate and apply a blend as it will behave on unseen groups."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import pearson, rmse, share, weighted_rmse
from ..operators import blend as B
from ..operators import linear as L
from ..operators.alignment import key_reconcile
from ..operators.folds import group_folds
from ..operators.quality import duplicate_keys, enforce, fold_group_leak
from ..operators.similarity import has_partner, similarity_groups
from ..session import cut_lineage


@dataclass
class Channel:
    """A channel is the mean of ridge models over several feature views."""

    name: str
    views: Sequence[tuple[str, int]]
    alpha: float


@dataclass
class HonestBlend:
    oof: DataFrame
    predictions: DataFrame
    report: DataFrame
    choices: DataFrame


def run(
    train: DataFrame,
    target: DataFrame,
    key: str,
    label: str,
    speaker: tuple[str, int],
    threshold: float,
    runs: Sequence[str],
    channels: Sequence[Channel],
    short: str,
    folds: int = 5,
    fold: str | None = None,
) -> HonestBlend:
    """Group, fold by group, weight to the target mix, cross-fit, blend, calibrate.

    If similarity leaves one group, nothing is fitted across folds: cross-fitted and final
    predictions are NULL, and so are their metrics and parameters.

    ``runs`` are prediction columns present in both tables; their mean is the
    text channel.  With ``fold`` given, stored folds are used and must not split
    a group.
    """
    vector, dimension = speaker
    enforce(duplicate_keys(train, [key]), "training keys")
    everyone = train.select(key, vector).unionByName(target.select(key, vector))

    groups = cut_lineage(similarity_groups(train, key, vector, everyone, dimension, threshold))
    if fold is None:
        assigned = groups.join(group_folds(groups, "group", folds), "group").select(key, "group", "fold", "group_size")
    else:
        sizes = groups.groupBy("group").agg(F.count("*").alias("group_size"))
        assigned = groups.join(sizes, "group").join(train.select(key, F.col(fold).alias("fold")), key)
    rows = train.drop("fold").join(assigned, key)
    rows = rows.withColumn("partner", F.col("group_size") > 1)
    rows = rows.withColumn("cell", B.property_cells(rows, F.col(short), F.col("partner")))
    rows = cut_lineage(rows)
    enforce(key_reconcile(train, rows, [key]), "training rows after alignment")
    enforce(fold_group_leak(rows, "group", "fold"), "folds")

    target_groups = similarity_groups(target, key, vector, everyone, dimension, threshold)
    goal = target.join(has_partner(target_groups, key), key).withColumnRenamed("has_partner", "partner")
    goal = cut_lineage(goal.withColumn("cell", B.property_cells(goal, F.col(short), F.col("partner"))))
    rows, missing = B.cell_weights(rows, goal, "cell")
    uncovered = missing.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    # Where similarity joins all rows into one group no fit can leave a row's group out.
    crossed = len(rows.select("fold").where("fold IS NOT NULL").distinct().take(2)) > 1

    mean_of = lambda names: reduce(lambda a, b: a + b, [F.col(n) for n in names]) / float(len(names))
    rows, goal = rows.withColumn("text", mean_of(runs)), goal.withColumn("text", mean_of(runs))
    for channel in channels:
        oof_names, target_names = [], []
        for i, (view, size) in enumerate(channel.views):
            name = f"__{channel.name}{i}"
            m = L.collect_moments(rows, view, label, ["fold"], size)
            lines = L.fold_lines(m, channel.alpha) if crossed else {}
            rows = L.predict_by_fold(rows, lines, view, "fold", name)
            line = L.solve(m.pick(lambda c: True), m.centre, channel.alpha)
            goal = L.predict_with(goal, line, view, name)
            oof_names.append(name)
            target_names.append(name)
        rows = rows.withColumn(channel.name, mean_of(oof_names)).drop(*oof_names)
        goal = goal.withColumn(channel.name, mean_of(target_names)).drop(*target_names)
    names = ["text", *[c.name for c in channels]]
    keep = [key, label, "fold", "group", short, "partner", "weight", *names]
    rows = cut_lineage(rows.select(*keep))

    goal_channels = goal.select(key, *names)
    if crossed:
        nested, choices = B.nested_blend(rows, names, label, "fold", "weight")
        predictions, line, weights = B.final_blend(rows, goal_channels, names, label, "weight")
    else:
        none = F.lit(None).cast("double")
        nested, predictions, line, weights = rows.withColumn("prediction", none), goal_channels.withColumn("prediction", none), None, [None] * len(names)
        columns = ", ".join(f"{n} double" for n in names)
        choices = train.sparkSession.createDataFrame([], f"fold {dict(rows.dtypes)['fold']}, {columns}, intercept double, slope double")
    return HonestBlend(
        nested, predictions.select(key, "prediction"), report(nested, goal, label, short, names, weights, line, uncovered), choices
    )


def report(nested: DataFrame, goal: DataFrame, label: str, short: str, names: Sequence[str], weights: Sequence[float | None], line: L.Line | None, uncovered: int = 0) -> DataFrame:
    """Sizes, property shares, weighted and plain metrics, final parameters, as tall rows.

    Target rows whose cell has no training row are counted as ``target_uncovered`` if there are any.
    """
    spark = nested.sparkSession
    columns = {**{n: n for n in names}, "blend_nested": "prediction"}
    entry = lambda section, name, value: F.struct(
        F.lit(section).alias("section"), F.lit(name).alias("name"), value.cast("double").alias("value")
    )
    cells = [
        entry("size", "rows", F.count("*")),
        entry("share", "short_train", share(F.col(short))),
        entry("share", "partner_train", share(F.col("partner"))),
    ]
    for name, column in columns.items():
        cells += [
            entry("target_like_rmse", name, weighted_rmse(label, column, "weight")),
            entry("rmse", name, rmse(label, column)),
            entry("pearson", name, pearson(label, column)),
        ]
    # Groups never span folds, so counting per group first keeps the count exact and small.
    groups = nested.groupBy("group").agg(F.count("*").alias("n")).agg(F.array(entry("size", "groups", F.count("*"))).alias("c"))
    mix = goal.agg(
        F.array(entry("share", "short_target", share(F.col(short))), entry("share", "partner_target", share(F.col("partner")))).alias("c")
    )
    measured = nested.agg(F.array(*cells).alias("c")).unionByName(groups).unionByName(mix)
    fixed = [("final_weight", n, None if w is None else float(w)) for n, w in zip(names, weights)]
    fixed += [("calibration", "intercept", line and line.intercept), ("calibration", "slope", line and float(line.standardized[0]))]
    fixed += [("size", "target_uncovered", float(uncovered))] if uncovered else []
    return (
        measured.select(F.explode("c").alias("c"))
        .select("c.*")
        .unionByName(spark.createDataFrame(fixed, "section string, name string, value double"))
    )
