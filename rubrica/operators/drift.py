"""Distribution summaries, drift between two splits and feature audits.

Features are compared in tall form (feature, value); equal values collapse to
counts before anything is ordered.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import INFINITY, constant, is_finite, pearson, quotient, share
from ..session import cut_lineage, stored
from .ranking import average_ranks, counted_ranks, cumulative, exact_quantiles, value_counts

# ---- fixed values ----
PERCENTILES = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
NEAR_ZERO_UNIQUE_SHARE = 0.1
NEAR_ZERO_FREQUENCY_RATIO = 19
MODERATE_SHIFT, LARGE_SHIFT = 0.5, 0.8
HIGH_CORRELATION = 0.95
AFFINE_TOLERANCE = 1e-10
# ----------------------


def melt(df: DataFrame, keep: Sequence[str], features: Sequence[str]) -> DataFrame:
    """One row per (row, feature)."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    return df.select(*keep, F.explode(pairs).alias("p")).select(*keep, "p.feature", "p.value")


def distribution_summary(df: DataFrame, features: Sequence[str], approximate: bool = False, accuracy: int = 10000) -> DataFrame:
    """Mean, sample deviation, extremes, percentiles and zero share per feature.

    Percentiles are exact; ``approximate`` trades that for one mergeable sketch.
    """
    tall = melt(df, [], features)
    base = tall.groupBy("feature").agg(
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        share(F.col("value") == 0).alias("zero_fraction"),
    )
    if approximate:
        sketch = tall.groupBy("feature").agg(
            F.percentile_approx("value", list(PERCENTILES.values()), accuracy).alias("q")
        )
        quantiles = sketch.select("feature", *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(PERCENTILES)])
    else:
        quantiles = exact_quantiles(tall, ["feature"], "value", PERCENTILES)
    return base.join(quantiles, "feature")


def variance_sparsity(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Constant, nearly constant and mostly zero features."""
    counts = value_counts(melt(df, [], features), ["feature"], "value")
    top = counts.groupBy("feature").agg(F.max(F.struct("n", "value")).alias("top"))
    rest = counts.join(F.broadcast(top), "feature")
    stats = rest.groupBy("feature").agg(
        F.count("*").alias("distinct_values"),
        F.sum("n").alias("rows"),
        F.max("top").alias("top"),
        F.max(F.when(F.col("value") != F.col("top.value"), F.col("n"))).alias("second_n"),
        F.sum(F.when(F.col("value") == 0, F.col("n")).otherwise(0)).alias("zeros"),
    )
    return stats.select("feature", *_sparsity())


def _sparsity() -> list[Column]:
    """Verdicts from a feature's number of values, its rows, its most and second most frequent value and its zeros."""
    zero_share = quotient("zeros", "rows")
    return [
        (F.col("distinct_values") <= 1).alias("zero_variance"),
        (
            (F.col("distinct_values") > 1)
            & (quotient("distinct_values", "rows") <= NEAR_ZERO_UNIQUE_SHARE)
            & (F.coalesce(quotient("top.n", "second_n"), F.lit(0.0)) >= NEAR_ZERO_FREQUENCY_RATIO)
        ).alias("near_zero_variance"),
        (zero_share > 0.95).alias("zero_over_95_percent"),
        (zero_share > 0.99).alias("zero_over_99_percent"),
    ]


def _pooled(a: Column, b: Column, variance) -> Column:
    """Aggregate: root of the mean of two variances; exactly 0 where both sides are constant."""
    return F.when(constant(a) & constant(b), F.lit(0.0)).otherwise(F.sqrt((variance(a) + variance(b)) / 2))


def _standardised(delta: Column, scale: Column) -> Column:
    """delta / scale; equal constants give 0, unequal ones a signed infinity."""
    return (
        F.when(scale > 0, F.try_divide(delta, scale))
        .when(delta == 0, F.lit(0.0))
        .when(delta > 0, F.lit(INFINITY))
        .when(delta < 0, F.lit(-INFINITY))
    )


def smd_sample(df: DataFrame, split: str, features: Sequence[str], first: str = "train", second: str = "test") -> DataFrame:
    """(first - second) over the pooled sample deviation."""
    a, b = F.when(F.col(split) == first, F.col("value")), F.when(F.col(split) == second, F.col("value"))
    stats = melt(df, [split], features).groupBy("feature").agg(
        (F.avg(a) - F.avg(b)).alias("delta"), _pooled(a, b, F.var_samp).alias("scale")
    )
    smd = _standardised(F.col("delta"), F.col("scale"))
    return stats.select("feature", smd.alias("smd"), F.abs(smd).alias("abs_smd"))


def smd_shift_audit(df: DataFrame, split: str, features: Sequence[str], first: str = "train", second: str = "test") -> DataFrame:
    """(second - first) over the pooled population deviation, with severity."""
    a, b = F.when(F.col(split) == first, F.col("value")), F.when(F.col(split) == second, F.col("value"))
    stats = melt(df, [split], features).groupBy("feature").agg(
        F.avg(a).alias("train_mean"), F.avg(b).alias("test_mean"),
        F.stddev_pop(a).alias("train_std"), F.stddev_pop(b).alias("test_std"),
        F.min(a).alias("train_min"), F.max(a).alias("train_max"),
        F.min(b).alias("test_min"), F.max(b).alias("test_max"),
        _pooled(a, b, F.var_pop).alias("scale"),
    )
    smd = _standardised(F.col("test_mean") - F.col("train_mean"), F.col("scale"))
    return stats.withColumn("smd", smd).withColumn(
        "shift",
        F.when(F.abs("smd") >= LARGE_SHIFT, "large").when(F.abs("smd") >= MODERATE_SHIFT, "moderate").otherwise("low"),
    ).drop("scale")


def ks_statistic(df: DataFrame, split: str, features: Sequence[str], first: str = "train", second: str = "test") -> DataFrame:
    """Largest distance between the two empirical distributions of each feature."""
    counted = value_counts(
        melt(df, [split], features),
        ["feature"],
        "value",
        {
            "a": F.when(F.col(split) == first, 1).otherwise(0),
            "b": F.when(F.col(split) == second, 1).otherwise(0),
        },
    )
    return _largest_gap(cumulative(counted, ["feature"], "value", ("a", "b")), counted)


def _largest_gap(ranked: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """``(feature, ks)`` from counts ``a`` and ``b`` of each value and the counts before it."""
    totals = (ranked if counted is None else counted).groupBy("feature").agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    gap = F.abs(
        quotient(F.col("a_before") + F.col("a"), "na") - quotient(F.col("b_before") + F.col("b"), "nb")
    )
    return ranked.join(F.broadcast(totals), "feature").groupBy("feature").agg(F.max(gap).alias("ks"))


def ecdf(df: DataFrame, group: str, value: str) -> DataFrame:
    """Share of rows at or below each distinct value of the group."""
    counted = value_counts(df, [group], value)
    totals = counted.groupBy(group).agg(F.sum("n").alias("total"))
    return cumulative(counted, [group], value).join(totals, group).select(
        group, value, "n", quotient(F.col("n_before") + F.col("n"), "total").alias("ecdf")
    )


def pair_correlations(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Pearson, slope and intercept of every pair, in one pass over the rows."""
    names = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    # A row a pair and one set of moments: moments of all pairs side by side are more code than the engine compiles well.
    cells = [F.struct(F.lit(i).alias("i"), *[F.col(n).cast("double").alias(c) for n, c in zip(pair, "xy", strict=True)]) for i, pair in enumerate(names)]
    slope = F.when(~constant(F.col("x")), F.try_divide(F.covar_pop("x", "y"), F.var_pop("x")))
    moments = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*").groupBy("i").agg(
        pearson("x", "y").alias("pearson"), slope.alias("affine_slope"), (F.avg("y") - slope * F.avg("x")).alias("affine_intercept"), F.max(F.abs("y")).alias("largest")
    )
    pairs = df.sparkSession.createDataFrame([(i, *pair) for i, pair in enumerate(names)], "i int, left string, right string")
    return pairs.join(moments, "i").drop("i")


def high_correlation_pairs(df: DataFrame, features: Sequence[str], threshold: float = HIGH_CORRELATION) -> DataFrame:
    """Pairs with |Pearson| at or above the threshold and how affine they are.

    The kept pairs (a function of the feature list, not of the rows) come to
    the driver and one more pass measures their largest residual.
    """
    kept = pair_correlations(df, features).where(F.abs("pearson") >= threshold).collect()
    schema = (
        "left string, right string, pearson double, abs_pearson double, affine_slope double, "
        "affine_intercept double, max_affine_residual double, near_exact_affine boolean"
    )
    if not kept:
        return df.sparkSession.createDataFrame([], schema)
    structs = []
    for i, p in enumerate(kept):
        x, y = F.col(p["left"]).cast("double"), F.col(p["right"]).cast("double")
        residual = F.max(F.abs(y - (x * p["affine_slope"] + p["affine_intercept"])))
        structs.append(
            F.struct(
                F.lit(p["left"]).alias("left"), F.lit(p["right"]).alias("right"), F.lit(p["pearson"]).alias("pearson"),
                F.lit(abs(p["pearson"])).alias("abs_pearson"), F.lit(p["affine_slope"]).alias("affine_slope"),
                F.lit(p["affine_intercept"]).alias("affine_intercept"), residual.alias("max_affine_residual"),
                (residual <= AFFINE_TOLERANCE * max(1.0, p["largest"])).alias("near_exact_affine"),
            ).alias(f"p{i}")
        )
    row = df.agg(*structs)
    return row.select(F.explode(F.array(*[f"p{i}" for i in range(len(kept))])).alias("p")).select("p.*")


def label_correlations(df: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    """Pearson and Spearman of each feature with the label; constants give NULL.

    Spearman is Pearson on average ranks.  Rows collapse to counted
    (feature, value, label) triples once; both correlations and the features'
    ranks follow from them, so a value shared by most rows joins once.
    """
    tall = melt(df, [label], features)
    triples = cut_lineage(tall.groupBy("feature", "value", label).agg(F.count("*").alias("w")))
    plain = counted_pearson(triples.where(F.col("value").isNotNull() & F.col(label).isNotNull()), "value", label, "pearson")
    plain = triples.select("feature").distinct().join(plain, "feature", "left")
    x = counted_ranks(triples, ["feature"], "value", "w", "rx")
    y = average_ranks(df, [], label, "ry")
    ranked = cut_lineage(triples.join(x, ["feature", "value"]).join(y, label).select("feature", "w", "rx", "ry"))
    return plain.join(counted_pearson(ranked, "rx", "ry", "spearman"), "feature", "left")


def counted_pearson(counted: DataFrame, x: str, y: str, name: str) -> DataFrame:
    """``(feature, name)``: Pearson correlation of pairs that stand ``w`` times; NULL for fewer than two rows or a constant side."""
    return counted_pearsons(counted, {name: (x, y)})


def counted_pearsons(counted: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """``counted_pearson`` of several pairs of columns in the same two passes.

    Sums are taken of what is left after subtracting the means: plain sums of squares of
    ranks pass 2^53 and leave a constant with a variance other than 0.
    """
    w, means, sums, values = F.col("w").cast("double"), [], [], []
    for name, (x, y) in pairs.items():
        a, b = F.col(x).cast("double"), F.col(y).cast("double")
        means += [
            F.try_divide(F.sum(w * a), F.sum(w)).alias(f"__{name}_a"), F.try_divide(F.sum(w * b), F.sum(w)).alias(f"__{name}_b"),
            (constant(a) | constant(b)).alias(f"__{name}_same"),
        ]
        da, db = a - F.col(f"__{name}_a"), b - F.col(f"__{name}_b")
        sums += [F.sum(w * p * q).alias(f"__{name}_{n}") for n, p, q in (("ab", da, db), ("aa", da, da), ("bb", db, db))]
        sums.append(F.max(f"__{name}_same").alias(f"__{name}_one"))
        value = F.try_divide(F.col(f"__{name}_ab"), F.sqrt(f"__{name}_aa") * F.sqrt(f"__{name}_bb"))
        values.append(F.when(~F.col(f"__{name}_one"), value).alias(name))
    own = counted.groupBy("feature").agg(*means)  # a row a feature
    return counted.join(F.broadcast(own), "feature").groupBy("feature").agg(*sums).select("feature", *values)


def family_correlations(correlations: DataFrame, families: dict[str, str]) -> DataFrame:
    """Median and maximum absolute correlation per feature family (a handful of rows)."""
    family = reduce(
        lambda acc, item: acc.when(F.col("feature") == item[0], item[1]), families.items(), F
    )
    return correlations.withColumn("family", family).groupBy("family").agg(
        F.count("*").alias("feature_count"),
        F.median(F.abs("pearson")).alias("median_absolute_pearson"),
        F.max(F.abs("pearson")).alias("max_absolute_pearson"),
        F.median(F.abs("spearman")).alias("median_absolute_spearman"),
        F.max(F.abs("spearman")).alias("max_absolute_spearman"),
    )


def residual_feature_correlations(df: DataFrame, residual: Column, features: Sequence[str], k: int = 10) -> DataFrame:
    """Correlation of each feature with a model's residual, the k largest first."""
    tall = melt(df.withColumn("__residual", residual), ["__residual"], features)
    scored = tall.groupBy("feature").agg(pearson("value", "__residual").alias("residual_correlation"))
    return scored.orderBy(F.desc_nulls_last(F.abs("residual_correlation")), "feature").limit(k)


def tall_metrics(df: DataFrame, section: str, split: str | None, name: Column, metrics: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return df.select(
        F.lit(section).alias("section"), F.lit(split).cast("string").alias("split"), name.alias("name"), F.explode(pairs).alias("m")
    ).select("section", "split", "name", "m.metric", "m.value")


def integrity(df: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
    """One row: rows, features, repeated keys beyond the first, missing and non-finite values."""
    cells = [F.col(f).cast("double") for f in features]
    total = lambda parts: reduce(lambda a, b: a + b, parts)
    missing = total([F.when(c.isNull() | F.isnan(c), 1).otherwise(0) for c in cells])
    odd = total([F.when(c.isNull() | F.isnan(c) | (F.abs(c) == INFINITY), 1).otherwise(0) for c in cells])
    keyed = df.groupBy(key).agg(F.count("*").alias("n"), F.sum(missing).alias("missing"), F.sum(odd).alias("odd"))
    sums = keyed.agg(F.sum("n").alias("n"), F.sum(F.col("n") - 1).alias("again"), F.sum("missing").alias("missing"), F.sum("odd").alias("odd"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return sums.select(
        zero("n").alias("row_count"), F.lit(len(features)).alias("feature_count"), zero("again").alias("duplicate_identities"),
        zero("missing").alias("missing_values"), zero("odd").alias("non_finite_values"),
    )


def counted_cells(df: DataFrame, split: str, label: str, features: Sequence[str], sides: tuple[str, str]) -> DataFrame:
    """``(feature, value, label, a, b)``: how many rows of the two splits hold a value, in one exchange.

    Rows of the first split keep their label.  The label's own values stand under the feature NULL.
    """
    first, y = F.col(split) == sides[0], F.col(label).cast("double")
    cell = lambda name, value, own: F.struct(name.cast("string").alias("feature"), value.cast("double").alias("value"), own.alias("label"))
    cells = [cell(F.lit(f), F.col(f), F.when(first, y)) for f in features] + [cell(F.lit(None), y, F.lit(None).cast("double"))]
    tall = df.where(F.col(split).isin(*sides)).select(first.alias("__first"), F.explode(F.array(*cells)).alias("c")).select("__first", "c.*")
    own = F.when(F.col("__first"), 1).otherwise(0).cast("bigint")
    return stored(tall.groupBy("feature", "value", "label").agg(F.sum(own).alias("a"), F.sum(1 - own).alias("b")), "audit-cells")


def side_statistics(ranked: DataFrame, rows: DataFrame, sides: tuple[str, str]) -> DataFrame:
    """One row per (side, feature) with values: what the audit says of one column of one split.

    ``ranked`` has the counts ``a`` and ``b`` of each (feature, value) and the counts before it,
    ``rows`` all rows of a feature, also those without a value.
    """
    counts = [F.struct(F.lit(s).alias("side"), F.col(c).alias("n"), F.col(f"{c}_before").alias("before")) for s, c in zip(sides, "ab", strict=True)]
    sided = ranked.select("feature", "value", F.explode(F.array(*counts)).alias("s")).select("feature", "value", "s.*").where("n > 0")
    n, v = F.col("n"), F.col("value")
    same = (F.col("min") == F.col("max")) & is_finite("max")
    own = cut_lineage(
        sided.groupBy("side", "feature")
        .agg(
            F.count("*").alias("distinct_values"), F.sum("n").alias("rows"), F.sum(n * v).alias("sum"), F.min("value").alias("min"),
            F.max("value").alias("max"), F.max(F.struct("n", "value")).alias("top"), F.sum(F.when(v == 0, n).otherwise(0)).alias("zeros"),
        )
        .withColumn("same", same)
        .withColumn("mean", F.when(F.col("same"), F.col("min")).otherwise(quotient("sum", "rows")))
    )  # a row a side and feature
    picks, percentiles = [], []
    for name, p in PERCENTILES.items():
        rank = F.lit(float(p)) * (F.col("rows") - 1)
        for edge, place in (("lo", F.floor(rank)), ("hi", F.ceil(rank))):
            picks.append(F.max(F.when((F.col("before") <= place) & (place < F.col("before") + n), v)).alias(f"__{name}_{edge}"))
        part = rank - F.floor(rank)
        percentiles.append((F.col(f"__{name}_lo") * (1 - part) + F.col(f"__{name}_hi") * part).alias(name))
    delta = v - F.col("mean")
    more = sided.join(F.broadcast(own.select("side", "feature", "rows", "mean", "top")), ["side", "feature"]).groupBy("side", "feature").agg(
        F.sum(n * delta * delta).alias("squares"), F.max(F.when(v != F.col("top.value"), n)).alias("second_n"), *picks
    )
    all_rows = F.when(F.col("side") == sides[0], F.col("a")).otherwise(F.col("b"))
    var = F.when(F.col("same") & (F.col("rows") > 1), F.lit(0.0)).otherwise(quotient("squares", F.col("rows") - 1))
    return cut_lineage(
        own.join(F.broadcast(more), ["side", "feature"]).join(F.broadcast(rows), "feature").select(
            "side", "feature", "mean", var.alias("var"), F.sqrt(var).alias("std"), "min", "max", "same", quotient("zeros", all_rows).alias("zero_fraction"),
            *percentiles, *_sparsity(),
        )
    )


def counted_label_correlations(cells: DataFrame, ranked: DataFrame, rows: DataFrame) -> DataFrame:
    """``label_correlations`` of the first split, from counted cells and the ranks of values and labels."""
    rank = F.col("a_before") + (F.col("a") + 1) / 2.0
    held = ranked.where("a > 0")
    x = held.where("feature IS NOT NULL").select("feature", "value", rank.alias("rx"))
    y = held.where("feature IS NULL").select(F.col("value").alias("label"), rank.alias("ry"))
    triples = cells.where("feature IS NOT NULL AND a > 0 AND value IS NOT NULL AND label IS NOT NULL").select("feature", "value", "label", F.col("a").alias("w"))
    joined = stored(triples.join(x, ["feature", "value"]).join(y, "label"), "audit-pairs")
    both = counted_pearsons(joined, {"pearson": ("value", "label"), "spearman": ("rx", "ry")})
    return rows.where("a > 0").select("feature").join(F.broadcast(both), "feature", "left")


def audit_report(df: DataFrame, split: str, key: str, label: str, features: Sequence[str], families: dict[str, str], sides: tuple[str, str] = ("train", "test")) -> DataFrame:
    """The feature audit as ``(section, split, name, metric, value)``.

    Sections: integrity, variance and sparsity, and distributions of both splits; shift between
    them; highly correlated pairs, label correlations and their summary by family on the first.
    Rows collapse to counts once, and the counts are ordered once; all but integrity and pairs
    follow from those two tables.
    """
    first = df.where(F.col(split) == sides[0])
    cells = counted_cells(df, split, label, features, sides)
    values = cells.where("value IS NOT NULL").groupBy("feature", "value").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    ranked = stored(cumulative(values, ["feature"], "value", ("a", "b")), "audit-ranks")
    named = ranked.where("feature IS NOT NULL")
    rows = cut_lineage(cells.where("feature IS NOT NULL").groupBy("feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b")))  # a row a feature
    stats = side_statistics(named, rows, sides)
    parts = []
    for side in sides:
        own = stats.where(F.col("side") == side)
        parts.append(tall_metrics(integrity(df.where(F.col(split) == side), key, features), "integrity", side, F.lit("all"), ["row_count", "feature_count", "duplicate_identities", "missing_values", "non_finite_values"]))
        parts.append(tall_metrics(own, "variance_sparsity", side, F.col("feature"), ["zero_variance", "near_zero_variance", "zero_over_95_percent", "zero_over_99_percent"]))
        parts.append(tall_metrics(own, "distribution", side, F.col("feature"), ["mean", "std", "min", "max", *PERCENTILES, "zero_fraction"]))
    halves = rows.select("feature")
    for side, c in zip(sides, "ab", strict=True):
        own = stats.where(F.col("side") == side).select("feature", *[F.col(name).alias(f"{name}_{c}") for name in ("mean", "var", "same")])
        halves = halves.join(F.broadcast(own), "feature", "left")
    scale = F.when(F.col("same_a") & F.col("same_b"), F.lit(0.0)).otherwise(F.sqrt((F.col("var_a") + F.col("var_b")) / 2))
    smd = _standardised(F.col("mean_a") - F.col("mean_b"), scale)
    parts.append(tall_metrics(halves.select("feature", smd.alias("smd"), F.abs(smd).alias("abs_smd")), "shift", None, F.col("feature"), ["smd", "abs_smd"]))
    parts.append(tall_metrics(_largest_gap(named), "shift", None, F.col("feature"), ["ks"]))
    pairs = high_correlation_pairs(first, features)
    parts.append(tall_metrics(pairs, "high_correlation", sides[0], F.concat_ws("|", "left", "right"), ["pearson", "affine_slope", "affine_intercept", "near_exact_affine"]))
    correlations = cut_lineage(counted_label_correlations(cells, ranked, rows))  # a row a feature
    parts.append(tall_metrics(correlations, "label_correlation", sides[0], F.col("feature"), ["pearson", "spearman"]))
    summary = [f"{stat}_absolute_{method}" for method in ("pearson", "spearman") for stat in ("median", "max")]
    parts.append(tall_metrics(family_correlations(correlations, families), "family_correlation", sides[0], F.col("family"), ["feature_count", *summary]))
    return reduce(lambda a, b: a.unionByName(b), parts)
