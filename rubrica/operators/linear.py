"""Cross-fitted linear models from additive moments.

One pass collects n, sums and cross-products per fold (or per any cell).  What a
model needs for "all folds but k" is total minus fold k, so no fold, penalty,
feature block or inner split costs another scan.  The p x p solves run on the
driver; p is the number of features, never the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clip

TILE = 128  # features on a side of a block
FAN = 64  # partial blocks that one group of a round merges


@dataclass
class Moments:
    """Per cell: n, sums and cross-products of (features, label), all centred."""

    cells: list[tuple]
    n: np.ndarray
    s: np.ndarray
    g: np.ndarray
    centre: np.ndarray
    #: Rows left out because a feature, the label or the weight is NULL.
    skipped: int = 0

    def pick(self, keep: Callable[[tuple], bool]):
        """Added-up moments of the cells that pass."""
        mask = np.array([keep(c) for c in self.cells], dtype=bool)
        return self.n[mask].sum(), self.s[mask].sum(axis=0), self.g[mask].sum(axis=0)

    def columns(self, index: Sequence[int]) -> "Moments":
        """Moments of some features (the label stays last)."""
        i = [*index, len(self.centre) - 1]
        return Moments(self.cells, self.n, self.s[:, i], self.g[:, i][:, :, i], self.centre[i], self.skipped)


@dataclass
class Line:
    """A fitted linear model in raw units."""

    intercept: float
    coef: np.ndarray
    standardized: np.ndarray
    rank: int


def feature_array(features: Sequence[str] | str) -> Column:
    """Features as one array of doubles: named columns, or an array column."""
    if isinstance(features, str):
        return F.col(features).cast("array<double>")
    return F.array(*[F.col(f).cast("double") for f in features])


def collect_moments(
    df: DataFrame,
    features: Sequence[str] | str,
    label: str | Column,
    cells: Sequence[str],
    dimension: int | None = None,
    weight: Column | None = None,
) -> Moments:
    """Gather moments per cell.  ``features`` is a list of columns or an array column.

    One scan at any width: tasks keep count, mean and centred cross-products of each cell,
    batch by batch, and pass them on in packed triangles of square blocks, which are merged
    in rounds of ``FAN`` (by Chan's rule, so nothing needs to be centred before).  The driver
    receives one set of blocks a cell, for its solves.  A row with a NULL feature, label or
    weight is no observation: it counts in ``skipped`` and in nothing else.
    """
    p = dimension if isinstance(features, str) else len(features)
    y = F.col(label) if isinstance(label, str) else label
    w = weight.cast("double") if weight is not None else F.lit(1.0)
    rows = df.select(
        *cells, F.concat(feature_array(features), F.array(y.cast("double"))).alias("z"), w.alias("w")
    )
    width = p + 1
    whole = F.forall("z", lambda v: v.isNotNull()) & (F.size("z") == width) & F.col("w").isNotNull()
    rows = rows.withColumn("__whole", F.coalesce(whole, F.lit(False)))
    named = [f"__c{i}" for i in range(len(cells))]
    rows = rows.select(*[F.col(c).alias(n) for c, n in zip(cells, named, strict=True)], F.when(F.col("__whole"), F.col("z")).alias("z"), "w")
    kinds = dict(rows.dtypes)
    shape = "".join(f"{n} {kinds[n]}, " for n in named) + "__tile int, __part bigint, n double, a array<double>, b array<double>, m array<double>"
    blocks, parts = rows.mapInArrow(_partials(named, width), shape), rows.rdd.getNumPartitions()
    while True:
        parts = -(-parts // FAN)
        blocks = blocks.withColumn("__part", F.floor(F.col("__part") / FAN)).groupBy(*named, "__tile", "__part").applyInArrow(_merge(len(named)), shape)
        if parts <= 1:
            break
    return _assemble(blocks.toArrow(), len(named), width)


def tiles(width: int) -> list[tuple[slice, slice]]:
    """Blocks of the upper triangle."""
    cuts = [slice(i, min(i + TILE, width)) for i in range(0, width, TILE)]
    return [(a, b) for k, a in enumerate(cuts) for b in cuts[k:]]


def _packed(block: np.ndarray, diagonal: bool) -> np.ndarray:
    return block[np.triu_indices(len(block))] if diagonal else block.ravel()


def _partials(cells: Sequence[str], width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[int, list] = {}
        known: dict[tuple, int] = {}
        first, skipped, empty = [], 0, None
        for batch in batches:
            empty = batch.slice(0, 0)
            whole = batch.column(len(cells)).is_valid()
            skipped += batch.num_rows - (whole.true_count or 0)
            batch = batch.filter(whole)
            if not batch.num_rows:
                continue
            z = batch.column(len(cells)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            w = batch.column(len(cells) + 1).to_numpy(zero_copy_only=False)
            code = np.zeros(batch.num_rows, np.int64)
            for i in range(len(cells)):
                own = batch.column(i).dictionary_encode(null_encoding="encode")
                _, code = np.unique(code * (len(own.dictionary) + 1) + own.indices.to_numpy(zero_copy_only=False), return_inverse=True)
            order = np.argsort(code, kind="stable")
            bounds = np.flatnonzero(np.concatenate([[True], np.diff(code[order]) > 0, [True]]))
            for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                index = order[start:end]
                name = tuple(batch.column(i)[int(index[0])].as_py() for i in range(len(cells)))
                if name not in known:
                    known[name] = len(first)
                    first.append(batch.slice(int(index[0]), 1))
                part, weight = z[index], w[index]
                n = weight.sum()
                mean = weight @ part / n if n else np.zeros(width)
                part = part - mean
                new = [n, mean, (part * weight[:, None]).T @ part]
                held[known[name]] = _chan(held[known[name]], new) if known[name] in held else new
        number = TaskContext.get().partitionId()
        names = [*cells, "__tile", "__part", "n", "a", "b", "m"]
        lists = lambda v: pa.array([v], pa.list_(pa.float64()))

        def row(keys: list[pa.Array], tile: int, n: float, a, b, m) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*keys, pa.array([tile], pa.int32()), pa.array([number], pa.int64()), pa.array([float(n)]), lists(a), lists(b), lists(m)], names)

        if empty is not None and skipped:
            yield row([pa.nulls(1, empty.column(i).type) for i in range(len(cells))], -1, skipped, [], [], [])
        for k, (n, mean, product) in held.items():
            keys = [first[k].column(i) for i in range(len(cells))]
            for tile, (i, j) in enumerate(tiles(width)):
                yield row(keys, tile, n, mean[i], mean[j], _packed(product[i, j], i == j))

    return run


def _chan(x: list, y: list) -> list:
    n = x[0] + y[0]
    if not n:
        return x
    apart = y[1] - x[1]
    return [n, x[1] + apart * (y[0] / n), x[2] + y[2] + np.outer(apart, apart) * (x[0] * y[0] / n)]


def _merge(keys: int):
    def run(group: pa.Table) -> pa.Table:
        n = group.column("n").to_numpy()
        stacked = lambda c: group.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(n), -1)
        a, b, m = stacked("a"), stacked("b"), stacked("m")
        total = n.sum()
        mean_a, mean_b = (n @ x / total if total else x[0] for x in (a, b))
        da, db = a - mean_a, b - mean_b
        between = (da * n[:, None]).T @ db
        # Diagonal blocks hold their upper triangle only.
        m = m.sum(axis=0) + (_packed(between, True) if between.size != m.shape[1] else between.ravel())
        one = group.slice(0, 1)
        lists = lambda v: pa.array([v], pa.list_(pa.float64()))
        return pa.table([*one.columns[: keys + 2], pa.array([total]), lists(mean_a), lists(mean_b), lists(m)], names=group.column_names)

    return run


def _assemble(found: pa.Table, keys: int, width: int) -> Moments:
    cells: dict[tuple, int] = {}
    n, mean, g, skipped = [], [], [], 0
    blocks = tiles(width)
    for r in found.to_pylist():
        name, (tile, _, count, a, b, m) = tuple(r.values())[:keys], tuple(r.values())[keys:]
        if tile < 0:
            skipped += int(count)
            continue
        if name not in cells:
            cells[name] = len(n)
            n.append(count)
            mean.append(np.zeros(width))
            g.append(np.zeros((width, width)))
        k, (i, j) = cells[name], blocks[tile]
        if i == j:
            mean[k][i] = a
            square = np.zeros((len(a), len(a)))
            square[np.triu_indices(len(a))] = m
            g[k][i, j] = square + np.triu(square, 1).T
        else:
            g[k][i, j] = np.array(m).reshape(len(a), len(b))
            g[k][j, i] = g[k][i, j].T
    n = np.array(n, float)
    if not n.sum():
        raise ValueError("No rows to fit on")
    mean = np.array(mean)
    centre = n @ mean / n.sum()
    off = mean - centre
    return Moments(list(cells), n, n[:, None] * off, np.array(g) + n[:, None, None] * off[:, :, None] * off[:, None, :], centre, skipped)


def solve(
    moments, centre: np.ndarray, alpha: float, scale: bool = True, unscaled: Sequence[int] = ()
) -> Line:
    """Ridge with an unpenalised intercept; ``alpha = 0`` is least squares.

    Columns are standardised with the fitting rows' population deviation, a
    constant column is divided by 1, and ``unscaled`` columns are left alone.
    """
    n, s, g = moments
    if n <= 0:
        raise ValueError("No rows to fit on")
    mean = s / n
    cov = g - n * np.outer(mean, mean)
    p = len(mean) - 1
    spread = np.sqrt(np.maximum(np.diag(cov)[:p] / n, 0.0))
    constant = spread <= 1e-10 * np.maximum(1.0, np.sqrt(np.maximum(np.diag(g)[:p] / n, 0.0)))
    divide = np.where(constant, 1.0, spread) if scale else np.ones(p)
    divide[list(unscaled)] = 1.0
    a = cov[:p, :p] / np.outer(divide, divide)
    b = cov[:p, p] / divide
    a[constant, :] = a[:, constant] = b[constant] = 0.0
    rank = int(np.linalg.matrix_rank(a)) if p else 0
    if alpha > 0:
        lower = np.linalg.cholesky(a + alpha * np.eye(p))
        beta = np.linalg.solve(lower.T, np.linalg.solve(lower, b))
    else:
        beta = np.linalg.lstsq(a, b, rcond=None)[0]
    coef = beta / divide
    raw_mean = mean + centre
    return Line(float(raw_mean[p] - coef @ raw_mean[:p]), coef, beta, rank)


def squared_error(moments, centre: np.ndarray, line: Line) -> float:
    """Sum of squared errors of a line on the rows behind the moments."""
    n, s, g = moments
    p = len(line.coef)
    d = np.append(-line.coef, 1.0)
    shift = centre[p] - line.intercept - line.coef @ centre[:p]
    return float(max(d @ g @ d + 2 * shift * (d @ s) + n * shift * shift, 0.0))


def fold_lines(m: Moments, alpha: float, scale: bool = True, unscaled: Sequence[int] = ()) -> dict:
    """One line per fold, fitted on every other fold."""
    return {
        cell[0]: solve(m.pick(lambda c: c[0] != cell[0]), m.centre, alpha, scale, unscaled) for cell in sorted(m.cells)
    }


def line_table(spark, lines: dict, fold: str, kind: str = "bigint") -> DataFrame:
    """Lines as a small table (one row per fold)."""
    rows = [(k, l.intercept, [float(c) for c in l.coef]) for k, l in lines.items()]
    return spark.createDataFrame(rows, f"{fold} {kind}, __intercept double, __coef array<double>")


def _linear(features: Sequence[str] | str, dimension: int | None) -> Column:
    if isinstance(features, str):
        products = F.zip_with(F.col(features), F.col("__coef"), lambda x, c: x.cast("double") * c)
        return F.col("__intercept") + F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)
    total = F.col("__intercept")
    for i, f in enumerate(features):
        total = total + F.col(f).cast("double") * F.get("__coef", F.lit(i))
    return total


def predict_by_fold(
    df: DataFrame, lines: dict, features: Sequence[str] | str, fold: str, name: str = "prediction", dimension: int | None = None
) -> DataFrame:
    """Each row is predicted by the line of its own fold (fitted without it); NULL without a fold."""
    table = line_table(df.sparkSession, lines, fold, dict(df.dtypes)[fold])
    return (
        df.join(F.broadcast(table), fold, "left")
        .withColumn(name, _linear(features, dimension))
        .drop("__intercept", "__coef")
    )


def predict_with(df: DataFrame, line: Line, features: Sequence[str] | str, name: str = "prediction") -> DataFrame:
    """Every row is predicted by one line."""
    table = df.sparkSession.createDataFrame(
        [(line.intercept, [float(c) for c in line.coef])], "__intercept double, __coef array<double>"
    )
    return df.crossJoin(F.broadcast(table)).withColumn(name, _linear(features, None)).drop("__intercept", "__coef")


def ridge_oof(
    df: DataFrame, features, label: str, fold: str, alpha: float, scale: bool = True, dimension: int | None = None, name: str = "prediction"
) -> DataFrame:
    """Out-of-fold ridge predictions; scaler and ridge see the other folds only."""
    m = collect_moments(df, features, label, [fold], dimension)
    return predict_by_fold(df, fold_lines(m, alpha, scale), features, fold, name, dimension)


def ridge_fit(df: DataFrame, features, label: str, alpha: float, scale: bool = True, dimension: int | None = None) -> Line:
    m = collect_moments(df.withColumn("__one", F.lit(0)), features, label, ["__one"], dimension)
    return solve(m.pick(lambda c: True), m.centre, alpha, scale)


def ridge_fit_predict(train: DataFrame, target: DataFrame, features, label: str, alpha: float, dimension: int | None = None) -> DataFrame:
    """Fit on every training row, predict another table."""
    return predict_with(target, ridge_fit(train, features, label, alpha, True, dimension), features)


def coefficient_table(spark, line: Line, features: Sequence[str]) -> DataFrame:
    rows = [(f, float(b), float(c)) for f, b, c in zip(features, line.standardized, line.coef)]
    return spark.createDataFrame(rows, "feature string, standardized double, raw double")


def fold_models_predict(train: DataFrame, target: DataFrame, features, label: str, fold: str, alpha: float, dimension: int | None = None) -> DataFrame:
    """Mean prediction of the k fold models for every target row.

    The models are linear, so their mean is the model with mean parameters: the
    target rows are read once and not multiplied by k.
    """
    m = collect_moments(train, features, label, [fold], dimension)
    lines = list(fold_lines(m, alpha).values())
    mean = Line(
        float(np.mean([l.intercept for l in lines])), np.mean([l.coef for l in lines], axis=0),
        np.mean([l.standardized for l in lines], axis=0), min(l.rank for l in lines),
    )
    return predict_with(target, mean, features)


def ols_lines(df: DataFrame, features, label: str, fold: str, dimension: int | None = None) -> dict:
    return fold_lines(collect_moments(df, features, label, [fold], dimension), 0.0, scale=False)


def ols_oof(df: DataFrame, features, label: str, fold: str, name: str = "prediction") -> DataFrame:
    """Cross-fitted least squares with intercept."""
    return predict_by_fold(df, ols_lines(df, features, label, fold), features, fold, name)


def ols_parameters(df: DataFrame, features: Sequence[str], label: str, fold: str) -> DataFrame:
    """Intercept, slopes and rank per fold."""
    lines = ols_lines(df, features, label, fold)
    rows = [(k, l.intercept, *[float(c) for c in l.coef], l.rank) for k, l in lines.items()]
    columns = ", ".join(f"{f} double" for f in features)
    return df.sparkSession.createDataFrame(rows, f"{fold} {dict(df.dtypes)[fold]}, intercept double, {columns}, rank int")


def residual_correction_oof(df: DataFrame, features, label: str, base: str, fold: str, alpha: float) -> DataFrame:
    """Ridge on what the base prediction leaves over, added to it."""
    work = df.withColumn("__left", F.col(label) - F.col(base))
    fitted = ridge_oof(work, features, "__left", fold, alpha, name="__correction")
    return fitted.withColumn("prediction", F.col(base) + F.col("__correction")).drop("__left", "__correction")


def stack_oof(df: DataFrame, features: Sequence[str], label: str, base: str, fold: str, alpha: float) -> DataFrame:
    """Ridge on the base prediction, left unscaled, and the scaled features."""
    columns = [base, *features]
    m = collect_moments(df, columns, label, [fold])
    return predict_by_fold(df, fold_lines(m, alpha, True, unscaled=[0]), columns, fold)


def fusion_oof(df: DataFrame, blocks: dict[str, Sequence[str]], label: str, fold: str, alpha: float) -> DataFrame:
    """One ridge per feature block and one on all blocks together.

    All of them are solved from sub-matrices of the same moments.
    """
    every = [f for block in blocks.values() for f in block]
    m = collect_moments(df, every, label, [fold])
    out = df
    for name, block in {**blocks, "both": every}.items():
        lines = fold_lines(m.columns([every.index(f) for f in block]), alpha)
        out = predict_by_fold(out, lines, list(block), fold, f"prediction_{name}")
    return out


def inner_cv_search(
    df: DataFrame, features, label: str, fold: str, inner: str, alphas: Sequence[float], dimension: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Choose a penalty per outer fold by inner folds of the other rows, refit, predict.

    Moments per (outer, inner) cell serve every fit and every score: one scan.
    The first penalty with the smallest mean inner RMSE wins.
    """
    m = collect_moments(df, features, label, [fold, inner], dimension)
    lines, chosen = {}, []
    for k in sorted({c[0] for c in m.cells}):
        scores = []
        for alpha in alphas:
            errors = []
            for j in sorted({c[1] for c in m.cells}):
                line = solve(m.pick(lambda c: c[0] != k and c[1] != j), m.centre, alpha)
                held = m.pick(lambda c: c[0] != k and c[1] == j)
                errors.append(np.sqrt(squared_error(held, m.centre, line) / held[0]))
            scores.append(float(np.mean(errors)))
        best = int(np.argmin(scores))
        chosen.append((k, float(alphas[best]), scores[best]))
        lines[k] = solve(m.pick(lambda c: c[0] != k), m.centre, alphas[best])
    table = df.sparkSession.createDataFrame(chosen, f"{fold} {dict(df.dtypes)[fold]}, alpha double, inner_rmse double")
    return predict_by_fold(df, lines, features, fold, dimension=dimension), table


def training_rmse(df: DataFrame, features, label: str, fold: str, alpha: float, dimension: int | None = None) -> DataFrame:
    """RMSE over every fold's training rows, pooled (k - 1 entries per row), from moments."""
    m = collect_moments(df, features, label, [fold], dimension)
    total = count = 0.0
    rows = []
    for k, line in fold_lines(m, alpha).items():
        part = m.pick(lambda c: c[0] != k)
        error = squared_error(part, m.centre, line)
        rows.append(("fold", k, int(round(part[0])), float(np.sqrt(error / part[0]))))
        total, count = total + error, count + part[0]
    rows.append(("pooled", None, int(round(count)), float(np.sqrt(total / count))))
    return df.sparkSession.createDataFrame(rows, f"scope string, {fold} {dict(df.dtypes)[fold]}, n bigint, training_rmse double")


def clipped(df: DataFrame, column: str, low: float | None, high: float | None) -> DataFrame:
    return df.withColumn(column, clip(column, low, high))
