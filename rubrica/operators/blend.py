"""Blend weights, calibration lines and evaluation weights.

Every search works on channel moments per fold: a grid of weight vectors costs
arithmetic on c x c matrices, not a pass over the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clip, quotient, share
from .linear import Line, Moments, collect_moments, predict_by_fold, predict_with, squared_error

# ---- fixed values ----
WEIGHT_STEP = 0.05
SCORE_RANGE = (1.0, 5.0)
SECOND_CHANNEL_MAXIMUM = 0.70

# ----------------------


def simplex_weights(channels: int, step: float = WEIGHT_STEP) -> np.ndarray:
    """All non-negative weight vectors on the grid that sum to 1, in lexicographic order."""
    ticks = int(round(1 / step))

    def extend(prefix: tuple[int, ...], left: int, depth: int):
        if depth == 1:
            yield (*prefix, left)
            return
        for k in range(left + 1):
            yield from extend((*prefix, k), left - k, depth - 1)

    return np.array(list(extend((), ticks, channels)), dtype=float) / ticks


def simplex_grid(spark, channels: int, step: float = WEIGHT_STEP) -> DataFrame:
    """The same grid as a table ``(pos, w1, w2, ...)``, built from sequences."""
    ticks = int(round(1 / step))
    grid = spark.range(1).select(F.lit(ticks).alias("left"))
    for i in range(1, channels):
        grid = grid.select(
            *grid.columns, F.explode(F.sequence(F.lit(0), F.col("left"))).alias(f"k{i}")
        ).withColumn("left", F.col("left") - F.col(f"k{i}"))
    grid = grid.withColumnRenamed("left", f"k{channels}")
    order = F.lit(0).cast("bigint")
    for i in range(1, channels):
        order = order * (ticks + 1) + F.col(f"k{i}")
    return grid.select(
        order.alias("code"), *[(F.col(f"k{i}") / float(ticks)).alias(f"w{i}") for i in range(1, channels + 1)]
    )


def channel_moments(df: DataFrame, channels: Sequence[str], label: str, fold: str, weight: str | None = None) -> Moments:
    return collect_moments(df, list(channels), label, [fold], weight=F.col(weight) if weight else None)


def blend_errors(part, centre: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """Weighted RMSE of every weight vector."""
    return np.sqrt(
        [squared_error(part, centre, Line(0.0, g, g, len(g))) / part[0] for g in grid]
    )


def best_weights(part, centre: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """First grid vector with the smallest error.

    Errors that agree to nine digits count as ties, so float noise between
    equal candidates cannot decide.
    """
    return grid[int(np.argmin(np.round(blend_errors(part, centre, grid), 9)))]


def simplex_errors(df: DataFrame, channels: Sequence[str], label: str, weight: str | None = None, step: float = WEIGHT_STEP) -> DataFrame:
    """Weighted RMSE of every vector of the simplex grid."""
    m = channel_moments(df.withColumn("__one", F.lit(0)), channels, label, "__one", weight)
    vectors = simplex_weights(len(channels), step)
    errors = blend_errors(m.pick(lambda c: True), m.centre, vectors)
    ticks = int(round(1 / step))
    codes = [int(sum(round(w * ticks) * (ticks + 1) ** (len(v) - 2 - i) for i, w in enumerate(v[:-1]))) for v in vectors]
    measured = df.sparkSession.createDataFrame([(c, float(e)) for c, e in zip(codes, errors)], "code bigint, weighted_rmse double")
    return simplex_grid(df.sparkSession, len(channels), step).join(F.broadcast(measured), "code")


def best_weights_table(df: DataFrame, channels: Sequence[str], label: str, weight: str | None = None, step: float = WEIGHT_STEP) -> DataFrame:
    m = channel_moments(df.withColumn("__one", F.lit(0)), channels, label, "__one", weight)
    part, grid = m.pick(lambda c: True), simplex_weights(len(channels), step)
    chosen = best_weights(part, m.centre, grid)
    error = float(blend_errors(part, m.centre, chosen[None, :])[0])
    columns = ", ".join(f"{c} double" for c in channels)
    return df.sparkSession.createDataFrame([(*[float(w) for w in chosen], error)], f"{columns}, weighted_rmse double")


def two_channel_weight(part, centre: np.ndarray, step: float = WEIGHT_STEP, maximum: float = SECOND_CHANNEL_MAXIMUM) -> float:
    """Weight of the second channel on 0, step, ..., maximum."""
    weights = np.arange(0, int(round(maximum / step)) + 1) * step
    grid = np.column_stack([1 - weights, weights])
    return float(best_weights(part, centre, grid)[1])


def line_on_blend(part, centre: np.ndarray, weights: np.ndarray) -> Line:
    """Weighted calibration line on a blend, written back on the channels."""
    n, s, g = part
    c = len(weights)
    mean = s / n
    cov = g / n - np.outer(mean, mean)
    variance = weights @ cov[:c, :c] @ weights
    slope = (weights @ cov[:c, c]) / variance if variance > 0 else 0.0
    raw = mean + centre
    intercept = raw[c] - slope * (weights @ raw[:c])
    return Line(float(intercept), slope * weights, np.array([slope]), c)


def calibration_table(df: DataFrame, prediction: str, label: str, weight: str | None = None) -> DataFrame:
    """Intercept and slope of label on prediction, optionally weighted."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    x, y = F.col(prediction), F.col(label)
    n = F.sum(w)
    mx, my = F.sum(w * x) / n, F.sum(w * y) / n
    centre = df.agg(mx.alias("mx"), my.alias("my"))
    shifted = df.crossJoin(F.broadcast(centre))
    dx, dy = F.col(prediction) - F.col("mx"), F.col(label) - F.col("my")
    sums = shifted.groupBy("mx", "my").agg(quotient(F.sum(w * dx * dy), F.sum(w * dx * dx)).alias("slope"))
    return sums.select((F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"), "slope")


def apply_calibration(df: DataFrame, table: DataFrame, prediction: str, low: float | None, high: float | None, name: str = "calibrated") -> DataFrame:
    value = F.col("intercept") + F.col("slope") * F.col(prediction)
    return df.crossJoin(F.broadcast(table)).withColumn(name, clip(value, low, high)).drop("intercept", "slope")


def crossfit_calibration(
    df: DataFrame, prediction: str, label: str, fold: str, low: float | None = None, high: float | None = None, name: str = "calibrated"
) -> DataFrame:
    """Each fold gets the line of the other folds."""
    m = channel_moments(df, [prediction], label, fold)
    one = np.ones(1)
    lines = {c[0]: line_on_blend(m.pick(lambda d: d[0] != c[0]), m.centre, one) for c in m.cells}
    return predict_by_fold(df, lines, [prediction], fold, name).withColumn(name, clip(name, low, high))


def nested_lines(m: Moments, grid: np.ndarray) -> tuple[dict, dict]:
    """Per fold: weights and calibration line chosen on the other folds."""
    lines, chosen = {}, {}
    for cell in sorted(m.cells):
        part = m.pick(lambda c: c[0] != cell[0])
        chosen[cell[0]] = best_weights(part, m.centre, grid)
        lines[cell[0]] = line_on_blend(part, m.centre, chosen[cell[0]])
    return lines, chosen


def nested_blend(
    df: DataFrame, channels: Sequence[str], label: str, fold: str, weight: str | None = None, step: float = WEIGHT_STEP, clip_to=SCORE_RANGE
) -> tuple[DataFrame, DataFrame]:
    """Predictions whose weights and line never saw the row's fold, and the choices."""
    m = channel_moments(df, channels, label, fold, weight)
    lines, chosen = nested_lines(m, simplex_weights(len(channels), step))
    predicted = predict_by_fold(df, lines, list(channels), fold).withColumn("prediction", clip("prediction", *clip_to))
    rows = [
        (k, *[float(w) for w in chosen[k]], lines[k].intercept, float(lines[k].standardized[0])) for k in lines
    ]
    columns = ", ".join(f"{c} double" for c in channels)
    table = df.sparkSession.createDataFrame(rows, f"{fold} {dict(df.dtypes)[fold]}, {columns}, intercept double, slope double")
    return predicted, table


def nested_blend_masked(df: DataFrame, channels: Sequence[str], label: str, fold: str, mask: str, weight: str | None = None, step: float = WEIGHT_STEP) -> DataFrame:
    """Fit and predict masked rows only; the others keep a NULL prediction."""
    m = channel_moments(df.where(F.col(mask)), channels, label, fold, weight)
    lines, _ = nested_lines(m, simplex_weights(len(channels), step))
    out = predict_by_fold(df, lines, list(channels), fold)
    return out.withColumn("prediction", F.when(F.col(mask), clip("prediction", *SCORE_RANGE)))


def nested_two_channel(df: DataFrame, first: str, second: str, label: str, fold: str) -> DataFrame:
    """Two-channel nested blend with the second weight limited, no calibration."""
    m = channel_moments(df, [first, second], label, fold)
    lines = {}
    for cell in m.cells:
        w = two_channel_weight(m.pick(lambda c: c[0] != cell[0]), m.centre)
        lines[cell[0]] = Line(0.0, np.array([1 - w, w]), np.array([w]), 2)
    return predict_by_fold(df, lines, [first, second], fold)


def fixed_blend(left: DataFrame, right: DataFrame, key: Sequence[str], weight: float) -> DataFrame:
    """w x left + (1 - w) x right over aligned prediction tables; a key on one side only is an error."""
    from .alignment import key_reconcile
    from .quality import enforce

    enforce(key_reconcile(left, right, key), "blend")
    a = left.select(*key, F.col("prediction").alias("__a"))
    b = right.select(*key, F.col("prediction").alias("__b"))
    return a.join(b, list(key)).select(*key, (F.col("__a") * weight + F.col("__b") * (1 - weight)).alias("prediction"))


def blend_grid(df: DataFrame, first: str, second: str, label: str, fold: str, weights: Sequence[float]) -> DataFrame:
    """Metrics of w x first + (1 - w) x second, pooled and per fold, against the first alone.

    Everything follows from one pass of moments per fold.
    """
    m = channel_moments(df, [first, second], label, fold)

    def metrics(part, w: float):
        g = np.array([w, 1 - w])
        n, s, cross = part
        error = float(np.sqrt(squared_error(part, m.centre, Line(0.0, g, g, 2)) / n))
        mean = s / n
        cov = cross / n - np.outer(mean, mean)
        spread = (g @ cov[:2, :2] @ g) * cov[2, 2]
        return int(round(n)), error, float((g @ cov[:2, 2]) / np.sqrt(spread)) if spread > 0 else None

    scopes = [("pooled", None, m.pick(lambda c: True))] + [
        ("fold", cell[0], m.pick(lambda c: c == cell)) for cell in sorted(m.cells)
    ]
    rows = []
    for w in weights:
        for scope, k, part in scopes:
            n, error, r = metrics(part, w)
            _, error0, r0 = metrics(part, 1.0)
            rows.append((float(w), scope, k, n, error, r, error - error0, None if r is None or r0 is None else r - r0))
    return df.sparkSession.createDataFrame(
        rows,
        f"weight double, scope string, {fold} {dict(df.dtypes)[fold]}, n bigint, rmse double, pearson double, rmse_delta double, pearson_delta double",
    )


def blend_grid_summary(grid: DataFrame) -> DataFrame:
    """Per weight: pooled metrics, improving folds, worst fold, and the best flags.

    The grid has (folds + 1) rows per weight, so one window over it is small.
    """
    from pyspark.sql import Window

    pooled, fold = F.col("scope") == "pooled", F.col("scope") == "fold"
    rows = grid.groupBy("weight").agg(
        F.max(F.when(pooled, F.col("rmse"))).alias("rmse"),
        F.max(F.when(pooled, F.col("pearson"))).alias("pearson"),
        F.count(F.when(fold & (F.col("rmse_delta") < -1e-12), 1)).alias("folds_improving_rmse"),
        F.count(F.when(fold & (F.col("pearson_delta") > 1e-12), 1)).alias("folds_improving_pearson"),
        F.max(F.when(fold, F.col("rmse_delta"))).alias("worst_fold_rmse_delta"),
        F.min(F.when(fold, F.col("pearson_delta"))).alias("worst_fold_pearson_delta"),
    )
    everything = Window.partitionBy(F.lit(1))
    by_rmse = F.min(F.struct("rmse", "weight")).over(everything)["weight"]
    by_pearson = F.min(F.struct(-F.col("pearson"), F.col("weight"))).over(everything)["weight"]
    return rows.withColumn("best_by_rmse", F.col("weight") == by_rmse).withColumn(
        "best_by_pearson", F.col("weight") == by_pearson
    )


def importance_weights(df: DataFrame, flag: str, mask: str, target_share: float) -> DataFrame:
    """Weight so that masked rows show the target share of a boolean property."""
    inside = df.where(F.col(mask)).agg(share(F.col(flag)).alias("__share"))
    found = inside.first()["__share"]
    if found is None or not 0.0 < found < 1.0:
        raise ValueError("Masked rows must hold both values of the property")
    return df.withColumn(
        "weight",
        F.when(F.col(flag), F.lit(target_share / found)).otherwise(F.lit((1 - target_share) / (1 - found))),
    )


def property_cells(df: DataFrame, short: Column, partner: Column) -> Column:
    """2 x short + partner."""
    return (F.when(short, 2).otherwise(0) + F.when(partner, 1).otherwise(0)).cast("bigint")


def cell_weights(df: DataFrame, target: DataFrame, cell: str) -> tuple[DataFrame, DataFrame]:
    """Weight so each cell has its share in the target set, and target cells without rows.

    Those are returned with their number, since no weight can stand for them.  One row per
    cell on both sides; Spark broadcasts that table where it is small.  Rows with a NULL cell
    are a cell of their own.
    """
    have = df.groupBy(cell).agg(F.count("*").alias("h"))
    wanted = target.groupBy(cell).agg(F.count("*").alias("w")).withColumnRenamed(cell, "__want")
    same = F.col(cell).eqNullSafe(F.col("__want"))
    missing = wanted.join(have, same, "left_anti").select(
        F.lit("cell_without_rows").alias("rule"), F.col("__want").cast("string").alias("key"), F.col("w").alias("rows")
    )
    totals = have.agg(F.sum("h").alias("th")).crossJoin(wanted.agg(F.sum("w").alias("tw")))
    table = have.join(wanted, same, "left").crossJoin(F.broadcast(totals)).select(
        F.col(cell).alias("__cell"),
        ((F.coalesce("w", F.lit(0)) / F.col("tw")) / (F.col("h") / F.col("th"))).alias("weight"),
    )
    return df.join(table, F.col(cell).eqNullSafe(F.col("__cell"))).drop("__cell"), missing


def final_blend(df: DataFrame, target: DataFrame, channels: Sequence[str], label: str, weight: str | None = None) -> tuple[DataFrame, Line, np.ndarray]:
    """Weights and line from all rows, applied to a target table."""
    m = channel_moments(df.withColumn("__one", F.lit(0)), channels, label, "__one", weight)
    part = m.pick(lambda c: True)
    chosen = best_weights(part, m.centre, simplex_weights(len(channels)))
    line = line_on_blend(part, m.centre, chosen)
    out = predict_with(target, line, list(channels)).withColumn("prediction", clip("prediction", *SCORE_RANGE))
    return out, line, chosen
