import math

import pytest
from pyspark.sql import functions as F

from rubrica.functions.numeric import pearson, report_number, rmse
from rubrica.operators import comparison as C
from rubrica.operators import metrics as M

from .conftest import one


def pairs(spark, rows):
    return spark.createDataFrame([(float(a), float(b)) for a, b in rows], "y double, p double")


@pytest.mark.parametrize(
    "rows, expected",
    [
        ([(1, 2), (2, 4), (3, 5)], math.sqrt(3)),
        ([(0, 1e200), (0, 1e200)], 1e200),
        ([(0, 1e-200), (0, 1e-200)], 1e-200),
        ([(1, 1)], 0.0),
    ],
)
def test_rmse(spark, rows, expected):
    assert one(pairs(spark, rows).agg(rmse("y", "p").alias("v")))["v"] == pytest.approx(expected, rel=1e-12)


@pytest.mark.parametrize("size", [49, 107, 161])
def test_pearson_of_a_constant_over_many_partitions(spark, size):
    # 2 / 49 * 49 is not 2: the means of merged partial aggregates differ in the last digit.
    rows = spark.range(0, 4 * size, 1, 4).select(F.col("id").cast("double").alias("x"))
    found = one(rows.agg(*[pearson("x", F.lit(c)).alias(f"c{i}") for i, c in enumerate((2.0, 3.0, 1.1, 903.7))]))
    assert set(found.values()) == {None}


def test_fold_scope_has_no_pearson_for_one_prediction_a_fold(spark):
    rows = spark.range(0, 4 * 98, 1, 4).select((F.col("id") % 2).alias("fold"), F.col("id").cast("double").alias("label"))
    rows = rows.withColumn("prediction", F.when(F.col("fold") == 0, 2.0).otherwise(4.0))
    found = {(r["scope"], r["fold"]): r["pearson"] for r in M.regression_metrics(rows).collect()}
    assert found["fold", 0] is None and found["fold", 1] is None and found["pooled", None] is not None


def test_pearson_defined_and_undefined(spark):
    assert one(pairs(spark, [(1, 2), (2, 4), (3, 6)]).agg(pearson("y", "p").alias("v")))["v"] == pytest.approx(1)
    assert one(pairs(spark, [(1, 2), (2, 2)]).agg(pearson("y", "p").alias("v")))["v"] is None
    assert one(pairs(spark, [(1, 2)]).agg(pearson("y", "p").alias("v")))["v"] is None


def test_weighted_rmse(spark):
    df = spark.createDataFrame([(0.0, 1.0, 3.0), (0.0, 3.0, 1.0)], "y double, p double, w double")
    assert one(M.weighted_error(df, "y", "p", "w"))["weighted_rmse"] == pytest.approx(math.sqrt(3))


def test_fold_summary(spark):
    df = spark.createDataFrame([(0.0, 0), (2.0, 0), (4.0, 1), (6.0, 1)], "label double, fold int")
    rows = {r["fold"]: r for r in M.fold_summary(df).collect()}
    assert [rows[0][k] for k in ("n", "mean", "std", "median", "min", "max")] == [2, 1.0, 1.0, 1.0, 0.0, 2.0]
    assert [rows[1][k] for k in ("n", "mean", "std", "median", "min", "max")] == [2, 5.0, 1.0, 5.0, 4.0, 6.0]


def test_empty_band_keeps_a_row(spark):
    rows = M.band_report(pairs(spark, [(1, 2), (2, 2)]), M.closed_band("y"), ["LOW", "MID", "HIGH"], "y", "p").collect()
    found = {r["band"]: r for r in rows}
    assert found["LOW"]["n"] == 2 and found["MID"]["n"] == 0 and found["HIGH"]["rmse"] is None


def test_labels_in_the_gaps_belong_to_no_closed_band(spark):
    df = pairs(spark, [(2.2, 0), (4.2, 0)]).select(M.closed_band("y").alias("b"))
    assert [r["b"] for r in df.collect()] == [None, None]


def test_classify(spark):
    df = spark.createDataFrame([(0.9, 0.6), (0.9, 0.4), (1.1, 0.4), (None, 0.5)], "r double, p double")
    got = df.select(C.classify(F.col("r"), F.col("p"), F.lit(1.0), F.lit(0.5)).alias("c")).collect()
    assert [r["c"] for r in got] == ["dominates", "tradeoff", "worse", None]


def test_best_epoch_takes_the_first_minimum(spark):
    df = spark.createDataFrame([(0, 1, 0.5), (0, 2, 0.3), (0, 3, 0.3)], "fold int, epoch int, m double")
    assert one(M.best_epoch(df, "fold", "epoch", "m"))["best_epoch"] == 2


def test_report_numbers(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (1.5,)], "v double")
    assert [r[0] for r in df.select(report_number("v")).collect()] == [None, "Infinity", "-Infinity", "1.5"]
