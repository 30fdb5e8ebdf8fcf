"""Ordinal score vocabulary: encode, decode and answer distributions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import col, let

# ---- fixed values ----
SCORE_VALUES = (0.0, 1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 4.5, 5.0)
ANSWER_SCORES = (1.0, 2.0, 3.0, 4.0, 5.0)
# ----------------------


def doubles(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def ordinal_targets(label: Column | str) -> Column:
    """One indicator per boundary: label above each score value but the last."""
    return F.transform(
        doubles(SCORE_VALUES[:-1]),
        lambda boundary: F.when(col(label) > boundary, 1).otherwise(0),
    )


def class_probabilities(cumulative: Column) -> Column:
    """Ten class probabilities from nine exceedance probabilities."""
    upper = F.concat(F.array(F.lit(1.0)), cumulative)
    lower = F.concat(cumulative, F.array(F.lit(0.0)))
    return F.zip_with(upper, lower, lambda a, b: a - b)


def expectation(probabilities: Column, values) -> Column:
    products = F.zip_with(probabilities, doubles(values), lambda p, v: p * v)
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def decreasing_within_unit(cumulative: Column) -> Column:
    """True where the probabilities lie in [0, 1] and never rise."""
    n = F.size(cumulative)
    steps = F.zip_with(
        F.slice(cumulative, F.lit(1), n - 1),
        F.slice(cumulative, F.lit(2), n - 1),
        lambda a, b: a >= b,
    )
    inside = F.forall(
        cumulative, lambda q: q.isNotNull() & ~F.isnan(q) & (q >= 0) & (q <= 1)
    )
    return (n == len(SCORE_VALUES) - 1) & inside & F.forall(steps, lambda ok: ok)


def softmax(logits: Column) -> Column:
    weights = let(F.array_max(logits), lambda top: F.transform(logits, lambda z: F.exp(z - top)))

    def normalised(w: Column) -> Column:
        return let(
            F.aggregate(w, F.lit(0.0), lambda acc, v: acc + v), lambda total: F.transform(w, lambda v: v / total)
        )

    return let(weights, normalised)


def answer_mean(logits: Column) -> Column:
    return expectation(softmax(logits), ANSWER_SCORES)


def answer_std(logits: Column) -> Column:
    def spread(p: Column) -> Column:
        return let(
            expectation(p, ANSWER_SCORES),
            lambda mean: F.aggregate(
                F.zip_with(p, doubles(ANSWER_SCORES), lambda q, v: q * (v - mean) * (v - mean)), F.lit(0.0), lambda acc, v: acc + v
            ),
        )

    return F.sqrt(let(softmax(logits), spread))


def logistic_loss(logit: Column, target: Column) -> Column:
    """Binary cross-entropy with logits, stable for large magnitudes."""
    return F.greatest(logit, F.lit(0.0)) - logit * target + F.log1p(F.exp(-F.abs(logit)))
