import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rubrica.operators import drift as D
from rubrica.operators import ranking as R

from .conftest import one


def column(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "v double")


@pytest.mark.parametrize(
    "values",
    [
        np.random.default_rng(0).normal(size=500),
        np.exp(np.random.default_rng(1).normal(scale=6, size=400)),  # heavy tail: most values share a cell
        np.r_[np.zeros(300), np.arange(100)],  # a third and more in one value
        np.array([4.0]),
        np.array([-1e300, 0.0, 1e-300, 7.0]),
    ],
)
@pytest.mark.parametrize("accuracy", [4, 60, 10_000])
def test_exact_quantiles_match_numpy(spark, values, accuracy):
    probabilities = {"a": 0.0, "b": 0.01, "c": 0.37, "d": 0.5, "e": 0.99, "f": 1.0}
    got = one(R.exact_quantiles(column(spark, values), [], "v", probabilities, accuracy=accuracy))
    for name, p in probabilities.items():
        assert got[name] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-12)


def test_quantiles_when_the_sketch_misleads(spark, monkeypatch):
    """Brackets that miss the wanted ranks are found out, and the group's extremes take their place."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(R.F, "percentile_approx", lambda c, points, accuracy: F.array(*[F.max(c)] * len(points)))
    values = np.random.default_rng(3).normal(size=200)
    got = one(R.exact_quantiles(column(spark, values), [], "v", {"a": 0.1, "b": 0.5, "c": 0.9}))
    assert [got[k] for k in "abc"] == pytest.approx(list(np.quantile(values, [0.1, 0.5, 0.9])))


def test_quantiles_by_group(spark):
    """Groups of very different sizes, a NULL group, NULL values, NaN and infinities."""
    nan, inf = float("nan"), float("inf")
    rows = [("a", float(v)) for v in range(101)] + [("b", 5.0), ("b", None), (None, 1.0), (None, 2.0), ("c", None), ("d", nan), ("d", 1.0), ("d", 2.0), ("e", -inf), ("e", 0.0), ("e", inf), ("e", inf), ("e", nan)]
    got = {r["g"]: r for r in R.exact_quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"low": 0.25, "mid": 0.5, "top": 1.0}).collect()}
    assert set(got) == {"a", "b", None, "d", "e"}
    assert (got["a"]["low"], got["a"]["mid"], got["a"]["top"]) == (25, 50, 100) and got["b"]["mid"] == 5 and got[None]["mid"] == 1.5
    assert got["d"]["mid"] == 2 and np.isnan(got["d"]["top"]) and got["e"]["low"] == 0 and np.isnan(got["e"]["top"])


@pytest.mark.parametrize("ranges", [1, 7])
def test_running_counts_over_ranges(spark, ranges):
    rng = np.random.default_rng(6)
    rows = [(int(g) if g else None, float(v)) for g, v in zip(rng.integers(0, 3, 600), np.round(np.exp(rng.normal(scale=4, size=600)), 1))]
    df = spark.createDataFrame(rows, "g int, v double")
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = R.cumulative(R.value_counts(df, ["g"], "v"), ["g"], "v").select("g", "v", "n", "n_before").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = [(g, v, sum(r == (g, v) for r in rows), sum(r[0] == g and r[1] < v for r in rows)) for g, v in set(rows)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_positions_are_a_permutation(spark):
    from pyspark.sql import functions as F

    df = spark.range(300).withColumn("h", F.md5(F.col("id").cast("string"))).withColumn("g", F.col("id") % 2)
    rows = R.hashed_positions(df, ["g"], "h", ["id"]).collect()
    for g in (0, 1):
        part = sorted((r["h"], r["position"]) for r in rows if r["g"] == g)
        assert [p for _, p in part] == list(range(1, 151))


def test_distribution_summary(spark):
    got = one(D.distribution_summary(column(spark, [0, 1, 2, 3]), ["v"]))
    assert got["mean"] == 1.5 and got["std"] == pytest.approx((5 / 3) ** 0.5)
    assert got["p01"] == pytest.approx(0.03) and got["p99"] == pytest.approx(2.97) and got["zero_fraction"] == 0.25


def test_smd_and_ks(spark):
    rows = [("train", v) for v in (1.0, 2.0, 3.0)] + [("test", v) for v in (2.0, 3.0, 4.0)]
    df = spark.createDataFrame(rows, "split string, v double")
    assert one(D.smd_sample(df, "split", ["v"]))["smd"] == pytest.approx(-1)
    assert one(D.ks_statistic(df, "split", ["v"]))["ks"] == pytest.approx(1 / 3)


@pytest.mark.parametrize("a, b, expected", [(1.0, 1.0, 0.0), (2.0, 1.0, float("inf")), (1.0, 2.0, float("-inf"))])
def test_smd_of_constants(spark, a, b, expected):
    rows = [("train", a), ("train", a), ("test", b), ("test", b)]
    assert one(D.smd_sample(spark.createDataFrame(rows, "split string, v double"), "split", ["v"]))["smd"] == expected


def test_shift_of_constants_over_many_partitions(spark):
    # 2 / 49 * 49 is not 2: the means of merged partial aggregates differ in the last digit.
    rows = spark.range(0, 4 * 98, 1, 4).selectExpr("if(id % 2 = 0, 'train', 'test') AS split", "if(id % 2 = 0, 2D, 4D) AS v")
    assert one(D.smd_sample(rows, "split", ["v"]))["smd"] == -math.inf
    audit = one(D.smd_shift_audit(rows, "split", ["v"]))
    assert audit["smd"] == math.inf and audit["shift"] == "large"


def test_high_correlation_pairs(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, -1.0 * i, 1.0) for i in range(1, 6)], "a double, b double, c double, d double")
    rows = {(r["left"], r["right"]): r for r in D.high_correlation_pairs(df, ["a", "b", "c", "d"]).collect()}
    assert set(rows) == {("a", "b"), ("a", "c"), ("b", "c")} and all(r["near_exact_affine"] for r in rows.values())
    assert rows[("a", "b")]["affine_slope"] == pytest.approx(2)


def test_label_correlations(spark):
    df = spark.createDataFrame([(1.0, 1.0, 5.0), (2.0, 2.0, 5.0), (3.0, 3.0, 5.0), (10.0, 4.0, 5.0)], "x double, y double, c double")
    rows = {r["feature"]: r for r in D.label_correlations(df, "y", ["x", "c"]).collect()}
    assert rows["x"]["pearson"] == pytest.approx(0.8854377448471462) and rows["x"]["spearman"] == pytest.approx(1)
    assert rows["c"]["pearson"] is None and rows["c"]["spearman"] is None


def test_label_correlations_of_many_rows(spark):
    # Sums of squared ranks pass 2^53 by far.
    df = spark.range(0, 100_000, 1, 4).selectExpr("cast(id * 7919 % 1000003 AS double) AS x", "cast(id % 7 AS double) AS y", "1e8 + id % 3 AS far", "3D AS c")
    rows = {r["feature"]: r for r in D.label_correlations(df, "y", ["x", "far", "c"]).collect()}
    assert rows["c"]["pearson"] is None and rows["c"]["spearman"] is None
    x, far, y = (np.array(v) for v in zip(*((i * 7919 % 1000003, i % 3, i % 7) for i in range(100_000)), strict=True))
    assert rows["far"]["pearson"] == pytest.approx(np.corrcoef(far, y)[0, 1], abs=1e-10)
    assert rows["x"]["pearson"] == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-10)


def test_variance_sparsity(spark):
    rows = [(0.0, 0.0 if i < 95 else 1.0, 0.0 if i < 96 else 1.0, float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "constant double, edge double, rare double, free double")
    got = {r["feature"]: r for r in D.variance_sparsity(df, ["constant", "edge", "rare", "free"]).collect()}
    assert got["constant"]["zero_variance"] and got["constant"]["zero_over_99_percent"]
    assert got["edge"]["near_zero_variance"] and not got["edge"]["zero_over_95_percent"]
    assert got["rare"]["near_zero_variance"] and got["rare"]["zero_over_95_percent"]
    assert not got["free"]["near_zero_variance"]


def audited(spark):
    rows = [
        (i, "train" if i % 10 < 7 else "test", float(i % 4), None if i % 5 == 0 else i * 0.37 % 11, 3.0, 0.1 if i % 10 < 7 else 0.3, float("nan") if i == 11 else i / 7, None)
        for i in range(90)
    ]
    return spark.createDataFrame(rows + [(0, "train", None, 1.0, 3.0, 0.1, 2.0, None), (5, "none", 1.0, 7.0, 4.0, 9.0, 2.0, None)], "k int, s string, y double, a double, b double, c double, d double, e double")


def test_audit_report_equals_its_single_operators(spark):
    df, names = audited(spark), list("abcde")
    got = {(r["section"], r["split"], r["name"], r["metric"]): r["value"] for r in D.audit_report(df, "s", "k", "y", names, {n: "all" for n in names}).collect()}
    want = {}

    def add(section, split, table, metrics):
        for row in table.collect():
            want.update({(section, split, row["feature"], m): None if row[m] is None else float(row[m]) for m in metrics})

    for side in ("train", "test"):
        own = df.where(F.col("s") == side)
        add("variance_sparsity", side, D.variance_sparsity(own, names), ["zero_variance", "near_zero_variance", "zero_over_95_percent", "zero_over_99_percent"])
        add("distribution", side, D.distribution_summary(own, names), ["mean", "std", "min", "max", *D.PERCENTILES, "zero_fraction"])
    add("shift", None, D.smd_sample(df, "s", names), ["smd", "abs_smd"])
    add("shift", None, D.ks_statistic(df, "s", [n for n in names if n != "e"]), ["ks"])
    add("label_correlation", "train", D.label_correlations(df.where("s = 'train'"), "y", names), ["pearson", "spearman"])
    mine = {k: v for k, v in got.items() if k[0] not in ("integrity", "high_correlation", "family_correlation")}
    assert set(mine) == set(want)
    for k, v in want.items():
        assert mine[k] == (v if v is None else pytest.approx(v, abs=1e-9, nan_ok=True)), k


def test_audit_report_orders_its_values_once(spark, monkeypatch):
    ordered = []
    plain = R.cumulative
    for module in (R, D):
        monkeypatch.setattr(module, "cumulative", lambda *args: ordered.append(args) or plain(*args))
    D.audit_report(audited(spark), "s", "k", "y", list("abc"), {n: "all" for n in "abc"}).collect()
    assert len(ordered) == 1
