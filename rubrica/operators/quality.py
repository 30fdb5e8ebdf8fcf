"""Data-quality gates.

Each gate returns its violations as rows ``(rule, key, detail)``; ``enforce``
turns a non-empty result into an error.  Row rules are checked in one scan;
repeat checks count keys with map-side partials, so a key that holds a third of
the rows is one counter per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import count_where, is_finite

# ---- fixed value: characters and names that make a key unsafe as a file name ----
UNSAFE_NAME = r"[/\\]|^\.{1,2}$"
# ---------------------------------------------------------------------------------


class QualityError(ValueError):
    """Raised by ``enforce`` when a gate has violations."""


def enforce(violations: DataFrame, what: str = "table") -> None:
    """Raise with a few examples when there are violations."""
    examples = violations.limit(5).collect()
    if examples:
        shown = "; ".join(str(row.asDict()) for row in examples)
        raise QualityError(f"{what} breaks its contract: {shown}")


def row_violations(df: DataFrame, key: Column | str, rules: dict[str, Column], detail: Column | None = None) -> DataFrame:
    """One row per (row, broken rule).  A rule whose condition is NULL counts as kept."""
    key = F.col(key) if isinstance(key, str) else key
    broken = F.array_compact(
        F.array(*[F.when(condition, F.lit(rule)) for rule, condition in rules.items()])
    )
    any_rule = None
    for condition in rules.values():
        hit = F.coalesce(condition, F.lit(False))
        any_rule = hit if any_rule is None else any_rule | hit
    text = detail if detail is not None else F.lit(None)
    return df.where(any_rule).select(
        F.explode(broken).alias("rule"), key.cast("string").alias("key"), text.cast("string").alias("detail")
    )


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return (
        df.groupBy(*key)
        .agg(F.count("*").alias("copies"))
        .where(F.col("copies") > 1)
        .withColumn("rule", F.lit("duplicate"))
    )


def key_check(df: DataFrame, key: Sequence[str], safe_name: bool = False) -> DataFrame:
    """Present, non-blank, (optionally) safe as a file name, and unique together."""
    rules: dict[str, Column] = {}
    for name in key:
        text = F.col(name).cast("string")
        rules[f"missing:{name}"] = text.isNull()
        rules[f"blank:{name}"] = ~text.rlike(r"(?U)\S")
        if safe_name:
            rules[f"unsafe:{name}"] = text.rlike(UNSAFE_NAME)
    whole = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key])
    repeated = duplicate_keys(df.na.drop(subset=list(key)), key).select(
        "rule",
        F.concat_ws("|", *[F.col(k).cast("string") for k in key]).alias("key"),
        F.col("copies").cast("string").alias("detail"),
    )
    return row_violations(df, whole, rules).unionByName(repeated)


def range_check(df: DataFrame, key: str, value: str, low: float, high: float) -> DataFrame:
    """Null, not a number, or outside the closed range."""
    text, number = F.col(value).cast("string"), F.col(value).try_cast("double")
    rules = {
        "null": text.isNull(),
        "not_numeric": text.isNotNull() & (number.isNull() | F.isnan(number)),
        "out_of_range": is_finite(number) & ~number.between(low, high),
    }
    return row_violations(df, key, rules, text)


def vocabulary_check(df: DataFrame, key: str, value: str, allowed: Sequence) -> DataFrame:
    known = F.col(value).isin(list(allowed))
    return row_violations(df, key, {"unknown_value": ~F.coalesce(known, F.lit(False))}, F.col(value))


def schema_check(df: DataFrame, columns: Sequence[tuple[str, str]]) -> list[str]:
    """Differences between the frame's ordered (name, type) list and the contract."""
    wanted, found = [f"{n} {t}" for n, t in columns], [f"{n} {t}" for n, t in df.dtypes]
    problems = [f"missing or moved: {c}" for c in wanted if c not in found]
    problems += [f"unexpected: {c}" for c in found if c not in wanted]
    if not problems and wanted != found:
        problems.append("columns out of order")
    return problems


def finite_check(df: DataFrame, columns: Sequence[str], positive: Sequence[str] = ()) -> DataFrame:
    """Per column counts of null, NaN, infinite and (where asked) non-positive values."""
    inf = F.lit(float("inf"))
    row = df.agg(
        *[
            F.struct(
                F.lit(c).alias("column"),
                count_where(F.col(c).isNull()).alias("nulls"),
                count_where(F.isnan(F.col(c).cast("double"))).alias("nans"),
                count_where(F.abs(F.col(c).cast("double")) == inf).alias("infinities"),
                (count_where(F.col(c) <= 0) if c in positive else F.lit(0).cast("bigint")).alias("non_positive"),
            ).alias(c)
            for c in columns
        ]
    )
    return row.select(F.explode(F.array(*columns)).alias("r")).select("r.*")


def split_guard(df: DataFrame, key: str, split: str, allowed: str) -> DataFrame:
    """Rows of another split than the one a fit may use."""
    other = ~F.coalesce(F.col(split) == allowed, F.lit(False))
    return row_violations(df, key, {"wrong_split": other}, F.col(split))


def population_filter(df: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame]:
    """Kept rows and a one-row report of retained and removed counts."""
    kept = F.coalesce(keep, F.lit(False))
    report = df.agg(
        F.count("*").alias("total"),
        count_where(kept).alias("retained"),
        count_where(~kept).alias("removed"),
    )
    return df.where(kept), report


def residual_consistency(df: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Stored residual and absolute error against recomputed ones."""
    again = F.col("label") - F.col("prediction")
    return df.agg(
        F.count("*").alias("n"),
        count_where(F.abs(F.col("residual") - again) > tolerance).alias("residual_differs"),
        count_where(F.abs(F.col("abs_error") - F.abs(again)) > tolerance).alias("abs_error_differs"),
    )


def fold_check(df: DataFrame, fold: str, folds: int) -> DataFrame:
    """Fold ids are exactly 0..k-1 and sizes differ by at most one."""
    sizes = df.groupBy(fold).agg(F.count("*").alias("n"))
    inside = F.col(fold).between(0, folds - 1)
    return sizes.agg(
        count_where(F.coalesce(inside, F.lit(False))).alias("known_folds"),
        count_where(~F.coalesce(inside, F.lit(False))).alias("unknown_folds"),
        F.min("n").alias("smallest"),
        F.max("n").alias("largest"),
    ).withColumn(
        "valid",
        (F.col("known_folds") == folds) & (F.col("unknown_folds") == 0) & (F.col("largest") - F.col("smallest") <= 1),
    )


def fold_group_leak(df: DataFrame, group: str, fold: str) -> DataFrame:
    """Groups that span several folds.  Minimum and maximum decide it without a distinct."""
    return (
        df.groupBy(group)
        .agg(F.min(fold).alias("first_fold"), F.max(fold).alias("last_fold"), F.count("*").alias("n"))
        .where(F.col("first_fold") != F.col("last_fold"))
    )


def oof_coverage(expected: DataFrame, pieces: DataFrame, key: str) -> DataFrame:
    """Rows predicted never or more than once across the fold pieces."""
    counts = pieces.groupBy(key).agg(F.count("*").alias("predictions"))
    present = expected.select(key, F.lit(1).alias("__e"))
    joined = present.join(counts, key, "full_outer")
    rule = (
        F.when(F.col("__e").isNull(), "unexpected")
        .when(F.col("predictions").isNull(), "not_predicted")
        .when(F.col("predictions") > 1, "predicted_twice")
    )
    return joined.select(F.col(key), rule.alias("rule"), F.coalesce("predictions", F.lit(0)).cast("bigint").alias("predictions")).where(
        F.col("rule").isNotNull()
    )


def prediction_schema_check(
    predictions: DataFrame, reference: DataFrame, key: str, value: str, position: str | None = None
) -> DataFrame:
    """Columns, key set, uniqueness, finite values and row order of a prediction table, as counts.

    The columns must be the key and the value, in that order.  With ``position``,
    a row number that both tables carry, every key must stand where the
    reference has it.
    """
    from .alignment import key_reconcile

    gaps = key_reconcile(reference, predictions, [key]).groupBy("rule").agg(F.count("*").alias("n"))
    bad = predictions.agg(count_where(~F.coalesce(is_finite(value), F.lit(False))).alias("n")).select(
        F.lit("not_finite").alias("rule"), "n"
    )
    twice = duplicate_keys(predictions, [key]).groupBy("rule").agg(F.count("*").alias("n"))
    wanted = [key, value] if position is None else [key, value, position]
    spark = predictions.sparkSession
    names = spark.range(1).select(F.lit("columns").alias("rule"), F.lit(int(predictions.columns != wanted)).cast("bigint").alias("n"))
    found = gaps.unionByName(bad).unionByName(twice).unionByName(names)
    if position is not None:
        placed = predictions.select(key, F.col(position).alias("__at")).join(reference.select(key, F.col(position).alias("__want")), key)
        moved = placed.agg(count_where(~F.col("__at").eqNullSafe(F.col("__want"))).alias("n"))
        found = found.unionByName(moved.select(F.lit("order").alias("rule"), "n"))
    return found.where(F.col("n") > 0)


def integrity_report(df: DataFrame, split: str, key: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Rows, features, repeated keys, missing and non-finite cells per split.

    Keys are counted first, so repeats need no distinct over the whole table.
    """
    def cells(condition):
        total = F.lit(0)
        for c in features:
            total = total + F.when(condition(c), 1).otherwise(0)
        return F.sum(total).cast("bigint")

    per_key = df.groupBy(split, *key).agg(
        F.count("*").alias("__n"),
        cells(lambda c: F.col(c).isNull()).alias("__missing"),
        cells(lambda c: F.col(c).isNotNull() & ~is_finite(c)).alias("__bad"),
    )
    return per_key.groupBy(split).agg(
        F.sum("__n").alias("rows"),
        F.first(F.lit(len(features))).cast("bigint").alias("features"),
        F.sum(F.col("__n") - 1).alias("duplicates"),
        F.sum("__missing").alias("missing"),
        F.sum("__bad").alias("non_finite"),
    )
