"""Composed studies: one frame of tall metrics each."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clip, pearson, rmse
from ..operators import blend as B
from ..operators import drift as D
from ..operators import linear as L
from ..operators import metrics as M
from ..operators.comparison import classify
from ..operators.folds import mean_baseline_oof
from ..operators.quality import enforce, finite_check, population_filter
from ..session import cut_lineage


def _tall(section: str, df: DataFrame, name: Column, values: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("value")) for v in values])
    return df.select(F.lit(section).alias("section"), name.alias("name"), F.explode(pairs).alias("m")).select(
        "section", "name", "m.metric", "m.value"
    )


def baseline_study(
    df: DataFrame, features: Sequence[str], label: str, reference: str, fold: str, split: str, alpha: float, weights: Sequence[float]
) -> DataFrame:
    """Cross-fit one baseline on the training split and report it against a reference column.

    Sections: out-of-fold metrics, training error, complementarity with the
    reference, drift of the features between the splits, and the blend grid.
    """
    bad = finite_check(df, [*features, label, reference]).where("nulls + nans + infinities > 0")
    enforce(bad, "baseline inputs")
    train = df.where(F.col(split) == "train")
    oof = cut_lineage(L.ridge_oof(train, features, label, fold, alpha).select(label, reference, fold, "prediction"))
    scope = F.coalesce(F.col(fold).cast("string"), F.lit("pooled"))
    grid = B.blend_grid_summary(B.blend_grid(oof, reference, "prediction", label, fold, weights))
    parts = [
        _tall("oof", M.regression_metrics(oof, label, "prediction", fold), scope, ["rmse", "pearson"]),
        _tall("training", L.training_rmse(train, features, label, fold, alpha), scope, ["training_rmse"]),
        _tall(
            "complementarity", M.complementarity(oof, label, reference, "prediction", fold), scope,
            ["prediction_correlation", "residual_correlation"],
        ),
        _tall("drift", D.smd_shift_audit(df, split, features), F.col("feature"), ["smd"]),
        _tall("blend", grid, F.format_number("weight", 2), ["rmse", "pearson"]),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def population_ablation(df: DataFrame, keep: Column, label: str, fold: str, key: str) -> DataFrame:
    """Mean baseline fitted on all rows and on the kept ones, compared on the kept rows."""
    kept, _ = population_filter(df, keep)
    old = mean_baseline_oof(df.select(key, label, fold), label, fold).select(key, F.col("prediction").alias("old"))
    new = mean_baseline_oof(kept.select(key, label, fold), label, fold).withColumnRenamed("prediction", "new")
    matched = new.join(old, key)
    return matched.rollup(fold).agg(
        F.grouping(fold).alias("pooled"),
        F.count("*").alias("n"),
        rmse(label, "old").alias("old_rmse"),
        rmse(label, "new").alias("new_rmse"),
    ).select(
        F.when(F.col("pooled") == 1, "pooled").otherwise("fold").alias("scope"), fold, "n", "old_rmse", "new_rmse",
        (F.col("new_rmse") - F.col("old_rmse")).alias("rmse_delta"),
    )


def candidate_study(
    df: DataFrame, label: str, fold: str, reference: str, others: Sequence[str], low: float = 0.0, high: float = 5.0, steps: int = 20
) -> DataFrame:
    """Raw, clipped, calibrated, fixed-weight and learned-blend candidates against a reference.

    Clipped and cross-fitted candidates are measured in one pass over the rows,
    fixed weights from moments; each is classified as dominating, trading off or worse.
    """
    work = B.crossfit_calibration(df, reference, label, fold, name="__calibrated")
    kinds = {f"{reference}": ("raw", F.col(reference))}
    for other in others:
        kinds[other] = ("raw", F.col(other))
    kinds[f"{reference}_clipped"] = ("clipping", clip(reference, low, high))
    kinds[f"{reference}_calibrated"] = ("crossfit", F.col("__calibrated"))
    kinds[f"{reference}_calibrated_clipped"] = ("crossfit", clip("__calibrated", low, high))
    for other in others:
        learned = f"__learned_{other}"
        work = L.ols_oof(work, [reference, other], label, fold, learned)
        kinds[f"{reference}_{other}_learned"] = ("crossfit", F.col(learned))
        kinds[f"{reference}_{other}_learned_clipped"] = ("crossfit", clip(learned, low, high))
    structs = [
        F.struct(
            F.lit(name).alias("candidate"), F.lit(kind).alias("kind"), rmse(label, c).alias("rmse"), pearson(label, c).alias("pearson")
        ).alias(f"c{i}")
        for i, (name, (kind, c)) in enumerate(kinds.items())
    ]
    row = work.agg(*structs)
    tall = row.select(F.explode(F.array(*[f"c{i}" for i in range(len(structs))])).alias("c")).select("c.*")
    # Fixed weights are linear in the channels: their metrics follow from moments.
    for other in others:
        grid = B.blend_grid(df, reference, other, label, fold, [k / steps for k in range(steps + 1)])
        tall = tall.unionByName(
            grid.where("scope = 'pooled'").select(
                F.concat(F.lit(f"{reference}_{other}_w"), F.format_number("weight", 2)).alias("candidate"),
                F.lit("fixed_grid").alias("kind"), "rmse", "pearson",
            )
        )
    base = row.select(F.col("c0.rmse").alias("__rmse"), F.col("c0.pearson").alias("__pearson"))
    verdict = classify(F.col("rmse"), F.col("pearson"), F.col("__rmse"), F.col("__pearson"), 1e-9)
    return tall.crossJoin(F.broadcast(base)).select("candidate", "kind", "rmse", "pearson", verdict.alias("verdict"))
