"""Seams for user-supplied models: batch scoring and fold-routed scoring."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import is_finite


def batch_score(
    df: DataFrame, key: Sequence[str], inputs: Sequence[str], score: Callable[[pd.DataFrame], pd.Series], name: str = "prediction"
) -> DataFrame:
    """Score a table in Arrow batches.

    Only the key and the input columns travel to Python.  A batch whose result
    has another length or holds a non-finite value fails the job.
    """
    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in key) + f", {name} double"

    def run(batches):
        import numpy as np

        for batch in batches:
            values = np.asarray(score(batch[list(inputs)]), dtype=float)
            if values.shape != (len(batch),):
                raise ValueError("The scorer must return one value per row")
            if not np.isfinite(values).all():
                raise ValueError("The scorer returned a non-finite value")
            out = batch[list(key)].copy()
            out[name] = values
            yield out

    return df.select(*key, *[c for c in inputs if c not in key]).mapInPandas(run, schema)


def score_violations(scored: DataFrame, source: DataFrame, key: Sequence[str], name: str = "prediction") -> DataFrame:
    """Keys lost or invented by scoring, and non-finite values."""
    from .alignment import key_reconcile

    gaps = key_reconcile(source, scored, key).select(F.to_json(F.struct(*key)).alias("key"), "rule")
    bad = scored.where(~F.coalesce(is_finite(name), F.lit(False))).select(
        F.to_json(F.struct(*key)).alias("key"), F.lit("not_finite").alias("rule")
    )
    return gaps.unionByName(bad)


def fold_routed_score(
    df: DataFrame, key: Sequence[str], fold: str, inputs: Sequence[str], models: dict[int, Callable[[pd.DataFrame], pd.Series]]
) -> DataFrame:
    """Each row is scored by the model of its own fold only.

    Rows stay where they are: every batch is split by fold inside the task, so
    a fold that holds most rows needs no shuffle.  ``model_fold`` records which
    model scored the row.
    """
    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in key) + f", {fold} {kinds[fold]}, model_fold bigint, prediction double"

    def run(batches):
        for batch in batches:
            for k, part in batch.groupby(fold, sort=True):
                if k not in models:
                    raise ValueError(f"No model for fold {k}")
                out = part[[*key, fold]].copy()
                out["model_fold"] = int(k)
                out["prediction"] = pd.Series(models[k](part[list(inputs)]), dtype=float).to_numpy()
                yield out

    return df.select(*key, fold, *inputs).mapInPandas(run, schema)


def leakage_violations(scored: DataFrame, fold: str) -> DataFrame:
    """Rows scored by a model of another fold than their own."""
    return scored.where(F.col(fold) != F.col("model_fold"))
