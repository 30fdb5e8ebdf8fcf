import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from rubrica.operators import blend as B
from rubrica.operators import folds as FO
from rubrica.operators import linear as L
from rubrica.operators import tfidf as X
from rubrica.session import shared_dir

from .conftest import one


def ridge(x, y, z, alpha, scale=True):
    mean, sd = x.mean(axis=0), x.std(axis=0)
    sd = np.where(sd == 0, 1, sd) if scale else np.ones(x.shape[1])
    a, b = (x - mean) / sd, y - y.mean()
    beta = np.linalg.solve(a.T @ a + alpha * np.eye(x.shape[1]), a.T @ b)
    return y.mean() + (z - mean) / sd @ beta


def table(spark, x, y, folds):
    rows = [(i, float(y[i]), int(folds[i]), [float(v) for v in x[i]]) for i in range(len(y))]
    return spark.createDataFrame(rows, "id int, label double, fold int, x array<double>")


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(120, 20))
    x[:, 3] = 2.0
    y = x[:, 0] * 2 - x[:, 1] + rng.normal(size=120) + 50
    return x, y, np.arange(120) % 5


def oof(x, y, folds, alpha):
    out = np.empty(len(y))
    for k in np.unique(folds):
        out[folds == k] = ridge(x[folds != k], y[folds != k], x[folds == k], alpha)
    return out


def predictions(df):
    return np.array([r["prediction"] for r in df.orderBy("id").collect()])


def test_ridge_oof_many_features_with_a_constant(spark, data):
    x, y, folds = data
    got = predictions(L.ridge_oof(table(spark, x, y, folds), "x", "label", "fold", 3.0, dimension=20))
    assert np.allclose(got, oof(x, y, folds, 3.0), atol=1e-9)


@pytest.mark.parametrize("tile, fan, parts", [(128, 64, 3), (4, 2, 9)])
def test_moments_of_blocks_and_rounds(spark, data, monkeypatch, tile, fan, parts):
    """Far from zero, in many small partitions, with weights, a NULL cell and rows that are no observations."""
    monkeypatch.setattr(L, "TILE", tile)
    monkeypatch.setattr(L, "FAN", fan)
    x, y, folds = data
    x = x[:, :9] + 1e6
    rows = [(None if folds[i] == 4 else f"f{folds[i]}", float(y[i]), float(i % 3), [float(v) for v in x[i]]) for i in range(len(y))]
    rows += [("f0", None, 1.0, [0.0] * 9), ("f1", 1.0, 1.0, [None] * 9), ("f1", 1.0, None, [0.0] * 9), ("f1", 1.0, 1.0, [0.0] * 8)]
    df = spark.createDataFrame(rows, "fold string, label double, weight double, x array<double>").repartition(parts)
    got = L.collect_moments(df, "x", "label", ["fold"], 9, F.col("weight"))
    assert got.skipped == 4 and sorted(map(str, got.cells)) == sorted(map(str, {r[:1] for r in rows}))
    z, w = np.column_stack([x, y]), np.arange(len(y)) % 3
    for cell, n, s, g in zip(got.cells, got.n, got.s, got.g, strict=True):
        own = (folds == (4 if cell[0] is None else int(cell[0][1:])))
        off = z[own] - got.centre
        assert n == w[own].sum() and np.allclose(s, w[own] @ off, atol=1e-5) and np.allclose(g, (off * w[own][:, None]).T @ off, rtol=1e-9, atol=1e-5)


def test_held_out_labels_never_reach_their_own_predictions(spark, data):
    x, y, folds = data
    bad = np.where(folds == 2, 1000.0, y)
    a = predictions(L.ridge_oof(table(spark, x, y, folds), "x", "label", "fold", 3.0, dimension=20))
    b = predictions(L.ridge_oof(table(spark, x, bad, folds), "x", "label", "fold", 3.0, dimension=20))
    assert np.allclose(a[folds == 2], b[folds == 2], atol=1e-7)
    assert not np.allclose(a[folds != 2], b[folds != 2])


def test_fold_models_mean(spark, data):
    x, y, folds = data
    df = table(spark, x, y, folds)
    got = predictions(L.fold_models_predict(df, df.select("id", "x"), "x", "label", "fold", 2.0, dimension=20))
    each = [ridge(x[folds != k], y[folds != k], x, 2.0) for k in range(5)]
    assert np.allclose(got, np.mean(each, axis=0), atol=1e-9)


def test_training_rmse_from_moments(spark, data):
    x, y, folds = data
    errors = np.concatenate([y[folds != k] - ridge(x[folds != k], y[folds != k], x[folds != k], 2.0) for k in range(5)])
    rows = L.training_rmse(table(spark, x, y, folds), "x", "label", "fold", 2.0, dimension=20).collect()
    pooled = next(r for r in rows if r["scope"] == "pooled")
    assert pooled["training_rmse"] == pytest.approx(np.sqrt((errors**2).mean()))


def test_ols_rank_of_a_repeated_column(spark):
    df = spark.createDataFrame([(i, float(i), 2.0 * i, 3.0 * i + 1, i % 2) for i in range(10)], "id int, a double, b double, label double, fold int")
    assert {r["rank"] for r in L.ols_parameters(df, ["a", "b"], "label", "fold").collect()} == {1}
    assert np.allclose(predictions(L.ols_oof(df, ["a", "b"], "label", "fold")), [3.0 * i + 1 for i in range(10)])


def test_stratified_folds_are_balanced(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(rng.choice([0, 1, 2, 3, 4], 237))], "id int, y double")
    rows = FO.stratified_folds(df, "id", "y").collect()
    again = FO.stratified_folds(df, "id", "y").collect()
    assert sorted(rows) == sorted(again)
    sizes = np.bincount([r["fold"] for r in rows])
    assert len(sizes) == 5 and sizes.max() - sizes.min() <= 1
    for b in {r["bin"] for r in rows}:
        inside = np.bincount([r["fold"] for r in rows if r["bin"] == b], minlength=5)
        assert inside.max() - inside.min() <= 1


def test_constant_target_falls_back_to_one_bin(spark):
    df = spark.createDataFrame([(i, 2.0) for i in range(20)], "id int, y double")
    assert {r["bin"] for r in FO.stratification_bins(df, "y").collect()} == {0}


def test_unseen_group_mask(spark):
    df = spark.createDataFrame(list(zip([0, 0, 1, 1, 2], [0, 1, 2, 2, 3], range(5))), "g int, f int, i int")
    assert [r["unseen"] for r in FO.unseen_group_mask(df, "g", "f").orderBy("i").collect()] == [False, False, True, True, True]


def test_importance_and_cell_weights(spark):
    df = spark.createDataFrame([(i, i < 3, True) for i in range(10)], "i int, short boolean, m boolean")
    w = B.importance_weights(df, "short", "m", 0.7).collect()
    assert sum(r["weight"] for r in w if r["short"]) / sum(r["weight"] for r in w) == pytest.approx(0.7)
    with pytest.raises(ValueError):
        B.importance_weights(df.withColumn("short", F.lit(True)), "short", "m", 0.7)
    have = spark.createDataFrame([(c,) for c in (0, 0, 0, 1, 1, 2)], "cell int")
    want = spark.createDataFrame([(c,) for c in (0, 1, 1, 1, 2, 2, 2, 2)], "cell int")
    rows, missing = B.cell_weights(have, want, "cell")
    got = rows.collect()
    total = sum(r["weight"] for r in got)
    for cell, target in ((0, 1 / 8), (1, 3 / 8), (2, 4 / 8)):
        assert sum(r["weight"] for r in got if r["cell"] == cell) / total == pytest.approx(target)
    assert missing.isEmpty()
    assert not B.cell_weights(have, want.unionByName(spark.createDataFrame([(9,)], "cell int")), "cell")[1].isEmpty()


def test_simplex_and_best_weights(spark):
    grid = B.simplex_weights(3, 0.5)
    assert len(grid) == 6 and np.allclose(grid.sum(axis=1), 1) and len(B.simplex_weights(3)) == 231
    assert B.simplex_grid(spark, 3, 0.05).count() == 231
    rng = np.random.default_rng(1)
    y = rng.uniform(1, 5, 50)
    df = spark.createDataFrame([(float(a), float(a), float(b), float(c)) for a, b, c in zip(y, rng.uniform(1, 5, 50), rng.uniform(1, 5, 50))], "y double, a double, b double, c double")
    got = one(B.best_weights_table(df, ["a", "b", "c"], "y"))
    assert (got["a"], got["b"], got["c"]) == (1.0, 0.0, 0.0)


def test_weighted_calibration(spark):
    df = spark.createDataFrame([(2.0, 1.0, 1.0), (3.0, 3.0, 2.0), (4.0, 5.0, 5.0)], "p double, y double, w double")
    line = B.calibration_table(df, "p", "y", "w")
    assert one(line) == pytest.approx({"intercept": -3.0, "slope": 2.0})
    new = spark.createDataFrame([(1.0,), (3.5,), (9.0,)], "p double")
    assert [r["calibrated"] for r in B.apply_calibration(new, line, "p", 1.0, 5.0).orderBy("p").collect()] == pytest.approx([1, 4, 5])


def nested(y, c, folds, w):
    grid = B.simplex_weights(c.shape[1])
    out = np.empty(len(y))
    for k in np.unique(folds):
        fit, use = folds != k, folds == k
        errors = [np.average((y[fit] - c[fit] @ g) ** 2, weights=w[fit]) for g in grid]
        g = grid[int(np.argmin(np.round(np.sqrt(errors), 9)))]
        slope, intercept = np.polyfit(c[fit] @ g, y[fit], 1, w=np.sqrt(w[fit]))
        out[use] = np.clip(intercept + slope * (c[use] @ g), 1, 5)
    return out


def blend_rows(spark, y, c, folds, w):
    rows = [(i, float(y[i]), int(folds[i]), float(w[i]), *[float(v) for v in c[i]]) for i in range(len(y))]
    return spark.createDataFrame(rows, "id int, y double, fold int, w double, a double, b double, c double")


def test_nested_blend_matches_brute_force_and_does_not_leak(spark):
    rng = np.random.default_rng(5)
    y = rng.uniform(1, 5, 90)
    c = np.column_stack([y + rng.normal(scale=s, size=90) for s in (0.6, 0.9, 1.2)])
    folds, w = np.arange(90) % 5, rng.uniform(0.5, 2, 90)
    got = predictions(B.nested_blend(blend_rows(spark, y, c, folds, w), ["a", "b", "c"], "y", "fold", "w")[0])
    assert np.allclose(got, nested(y, c, folds, w), atol=1e-8)
    bad = np.where(folds == 1, 99.0, y)
    other = predictions(B.nested_blend(blend_rows(spark, bad, c, folds, w), ["a", "b", "c"], "y", "fold", "w")[0])
    assert np.allclose(got[folds == 1], other[folds == 1], atol=1e-7)


def test_tfidf_vocabulary_ignores_validation_rows(spark):
    rows = [(0, "alpha beta alpha", True), (1, "alpha gamma", True), (2, "gamma gamma delta", False), (3, "delta delta", False)]
    df = spark.createDataFrame(rows, "id int, t string, train boolean")
    out = {r["id"]: {t["term"]: t["weight"] for t in r["terms"]} for r in X.tfidf(df, "id", X.word_grams("t"), F.col("train")).collect()}
    assert set(out) == {0, 1} and out[0] == {"alpha": pytest.approx(1.0)}


def test_char_grams_by_hand(spark):
    df = spark.createDataFrame([("Ab c",)], "t string")
    assert one(df.select(X.char_grams("t").alias("g")))["g"] == [" ab", "ab ", " ab ", " c "]


def test_tfidf_ridge_does_not_see_held_out_labels(spark):
    rng = np.random.default_rng(2)
    words = ["good", "bad", "fine", "poor", "great"]
    rows = [(i, " ".join(rng.choice(words, 6)), float(rng.normal()), i % 2) for i in range(24)]
    schema = "id int, t string, y double, fold int"
    run = lambda r: {x["id"]: x["prediction"] for x in X.tfidf_ridge_oof(spark.createDataFrame(r, schema), "id", "t", "y", "fold").collect()}
    a, b = run(rows), run([(i, t, 1000.0 if f == 1 else y, f) for i, t, y, f in rows])
    assert len(a) == 24
    assert all(a[i] == pytest.approx(b[i], abs=1e-6) for i in a if i % 2 == 1)


@pytest.mark.parametrize("include_char", [False, True])
def test_tfidf_ridge_is_the_dense_ridge(spark, include_char):
    from collections import Counter

    rng = np.random.default_rng(5)
    words = [f"{a}{b}x" for a in "bcdfg" for b in "aeiou"]
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(0, 12)))), float(rng.normal()), i % 3) for i in range(45)]

    def grams(text, char):
        if not char:
            w = text.split()
            return w + [" ".join(p) for p in zip(w, w[1:])]
        return [p[i : i + n] for w in text.split() for p in [f" {w} "] for n in (3, 4, 5) for i in range(len(p) - n + 1)]

    def block(char, k):
        counts = [Counter(grams(t, char)) for _, t, _, _ in rows]
        train = [c for c, r in zip(counts, rows) if r[3] != k]
        df = Counter(t for c in train for t in c)
        terms = sorted(t for t, n in df.items() if n >= 2)
        x = np.array([[(1 + np.log(c[t])) * (np.log((1 + len(train)) / (1 + df[t])) + 1) if c[t] else 0.0 for t in terms] for c in counts])
        size = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(size == 0, 1, size)

    want = {}
    y, fold = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    for k in range(3):
        x = np.hstack([block(False, k), block(True, k)]) if include_char else block(False, k)
        train = fold != k
        for i, p in zip(np.flatnonzero(~train), ridge(x[train], y[train], x[~train], 1.0, scale=False), strict=True):
            want[int(i)] = p
    df = spark.createDataFrame(rows, "id int, t string, y double, fold int")
    got = {r["id"]: r["prediction"] for r in X.tfidf_ridge_oof(df, "id", "t", "y", "fold", 1.0, include_char).collect()}
    assert got == pytest.approx(want, abs=1e-6)


def test_tfidf_stores_nothing_and_deals_texts_once(spark):
    def files():
        folder = shared_dir(spark).removeprefix("file:")
        return {os.path.join(d, f) for d, _, names in os.walk(folder) for f in names}

    before = files()
    df = spark.createDataFrame([(1, "aa bb aa"), (2, "aa bb cc"), (3, "cc aa bb")], "id long, t string")
    found = {r["id"]: {t["term"]: t["weight"] for t in r["terms"]} for r in X.tfidf(df, "id", X.word_grams("t")).collect()}
    assert files() == before
    plain = {"aa": (1 + np.log(2)), "bb": 1.0, "aa bb": 1.0}  # each in all documents
    size = np.sqrt(sum(v * v for v in plain.values()))
    assert found[1] == pytest.approx({k: v / size for k, v in plain.items()})


def test_tfidf_ridge_leaves_no_table_of_a_past_step(spark):
    def tables():
        folder = shared_dir(spark).removeprefix("file:")
        return {n for n in os.listdir(folder) if n.startswith("sparse-ridge")} if os.path.isdir(folder) else set()

    before = tables()
    df = spark.createDataFrame([(i, f"aa bb c{i % 7} d{i % 5} e{i % 3}", float(i % 4), i % 3) for i in range(60)], "id long, t string, y double, fold int")
    assert X.tfidf_ridge_oof(df, "id", "t", "y", "fold").count() == 60
    assert len(tables() - before) <= 3  # the rows, the start and the end


def test_tfidf_ridge_refuses_an_unsettled_fit(spark):
    df = spark.createDataFrame([(i, f"good bad w{i % 4} v{i % 3}", float(i * i % 7), i % 2) for i in range(20)], "id int, t string, y double, fold int")
    with pytest.raises(ValueError, match="settled"):
        X.tfidf_ridge_oof(df, "id", "t", "y", "fold", 0.001, max_iter=2)


@pytest.mark.parametrize("seed", range(4))
def test_groups_are_packed_as_one_by_one(seed):
    rng = np.random.default_rng(seed)
    sizes = np.minimum(rng.zipf(1.5, 300), 60).tolist()
    totals, want = [0] * 5, {}
    for size in sorted(sizes, reverse=True):
        fold = totals.index(min(totals))
        totals[fold] += size
        want[size, fold] = want.get((size, fold), 0) + 1
    got = FO.pack_sizes({s: sizes.count(s) for s in set(sizes)}, 5)
    assert {(s, f): last - first + 1 for s, f, first, last in got} == want
    assert sum(last - first + 1 for _, _, first, last in FO.pack_sizes({1: 10**12 + 3, 7: 2}, 5)) == 10**12 + 5


def test_char_hashes_are_the_char_grams(spark):
    import pyarrow as pa

    from rubrica.operators.sparse_ridge import char_hashes

    texts = ["ab  abc\tx", "", None, " \n ", "größe 東京都 🙂🙂", "a\x0bb c d", "x" * 40, "ab"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    want = {r["i"]: r["g"] or [] for r in df.select("i", X.char_grams("t").alias("g")).collect()}
    # As a slice, whose offsets do not begin at zero.
    row, code = char_hashes(pa.array(["before", *texts], pa.string()).slice(1))
    found = {i: [] for i in want}
    for i, c in zip(row.tolist(), code.tolist(), strict=True):
        found[i].append(c)
    name = {}
    for i, grams in want.items():
        assert len(found[i]) == len(grams)
        # The grams of one size come in the order of the text.
        for n in (3, 4, 5):
            name |= dict.fromkeys(g for g in grams if len(g) == n)
    assert len({c for codes in found.values() for c in codes}) == len(name)
    from collections import Counter

    for i in want:
        assert sorted(Counter(found[i]).values()) == sorted(Counter(want[i]).values())
    assert set(found[7]) <= set(char_hashes(pa.array(["ab  abc\tx"]))[1].tolist()) and not set(found[6]) & set(found[0])


def test_ridge_blocks_stay_where_they_are(spark, monkeypatch):
    """Only what the terms need is dealt anew in a step, and a block's terms are told once."""
    from pyspark.sql.pandas.group_ops import PandasCogroupedOps

    from rubrica.operators import sparse_ridge

    plans, old = [], PandasCogroupedOps.applyInArrow

    def apply(self, fn, schema):
        out = old(self, fn, schema)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(PandasCogroupedOps, "applyInArrow", apply)
    monkeypatch.setattr(sparse_ridge, "BLOCK_ENTRIES", 40)
    monkeypatch.setattr(sparse_ridge, "PIECE_GRAMS", 16)
    rows = [(i, f"aa bb c{i % 7} d{i % 5} e{i % 3}", float(i % 4), i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, t string, y double, fold int")
    got = {r["id"]: r["prediction"] for r in X.tfidf_ridge_oof(df, "id", "t", "y", "fold", 1.0, True).collect()}
    steps = [p for p in plans if "InMemoryTableScan" in p]
    assert len(steps) > 4
    for p in steps:
        lines = p.splitlines()
        at = next(i for i, line in enumerate(lines) if "InMemoryTableScan" in line)
        above = [line for line in lines[:at] if len(line) - len(line.lstrip(" :+-")) < len(lines[at]) - len(lines[at].lstrip(" :+-"))]
        assert not any("Exchange" in line for line in above)
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == 0
    monkeypatch.undo()
    one_block = {r["id"]: r["prediction"] for r in X.tfidf_ridge_oof(df.coalesce(1), "id", "t", "y", "fold", 1.0, True).collect()}
    assert got == pytest.approx(one_block, abs=1e-7)


def test_tfidf_deals_texts_and_packed_hashes_only(spark):
    """No exchange carries a row for each document and term."""
    df = spark.createDataFrame([(i, f"aa bb c{i % 7} d{i % 5} e{i}", i % 3 > 0) for i in range(40)], "id long, t string, train boolean")
    plan = X.tfidf(df, "id", X.word_grams("t"), F.col("train"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "Generate" not in plan and "SortMergeJoin" not in plan and "collect_list" not in plan


def test_tfidf_rows_of_one_key_are_one_document(spark):
    rows = [(1, "aa bb", True), (1, "aa", True), (2, "aa cc", True), (3, "bb aa \U0001f642x", False), (4, None, True), (None, "cc", True)]
    df = spark.createDataFrame(rows, "id long, t string, train boolean")
    found = {r["id"]: {t["term"]: t["weight"] for t in r["terms"]} for r in X.tfidf(df, "id", X.word_grams("t"), F.col("train")).collect()}
    # Five training rows; "aa" is in two training documents, "cc" in two, "bb" in one.
    idf = np.log(6 / 3) + 1
    assert set(found) == {1, 2, 3, None} and found[3] == {"aa": pytest.approx(1.0)} and found[None] == {"cc": pytest.approx(1.0)}
    assert found[1] == {"aa": pytest.approx(1.0)} and found[2] == {"aa": pytest.approx(idf / np.hypot(idf, idf)), "cc": pytest.approx(np.sqrt(0.5))}


def test_hashes_and_counts_come_back_whole():
    rng = np.random.default_rng(3)
    for ranges in (1, 3, 12):
        for size in (0, 1, 5, 60000):
            hashes = np.unique(rng.integers(0, 2**64, size, np.uint64))
            cuts = X.ranges_of(hashes, ranges)
            for r in range(ranges):
                part, least = hashes[cuts[r] : cuts[r + 1]], X.range_start(r, ranges)
                assert (X.unpacked_hashes(X.packed_hashes(part, least), least, len(part)) == part).all()
    counts = rng.integers(0, 2**32, 1000)
    assert (X.unpacked_counts(X.packed_counts(counts)) == counts).all()
    import pyarrow as pa

    codes = X.term_hashes(pa.array(["skipped", "a", "ab", "ba", "", "a", "\x00", "\x00a"]).slice(1))
    assert codes[0] == codes[4] and len(set(codes.tolist())) == 6
