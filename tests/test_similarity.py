import numpy as np
import pytest

from rubrica.operators import similarity as S
from rubrica.operators import vectors as V

from .conftest import one


def frame(spark, x, offset=0):
    return spark.createDataFrame([(i + offset, [float(v) for v in row]) for i, row in enumerate(x)], "id int, v array<double>")


def brute_groups(x, reference, t):
    u = x - reference.mean(axis=0)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T > t
    label = np.arange(len(x))
    while True:
        new = np.array([label[near[i] | (np.arange(len(x)) == i)].min() for i in range(len(x))])
        if (new == label).all():
            return label
        label = new


def clumps(rng, centres=12, each=15, dim=6, noise=0.15):
    return np.concatenate([c + noise * rng.normal(size=(each, dim)) for c in rng.normal(size=(centres, dim))])


@pytest.mark.parametrize("cells, blocks, threshold", [(4096, 2048, 0.9), (10, 4, 0.97), (15, 8, 0.9), (20, 7, 0.5)])
def test_groups_match_brute_force_for_any_cell_size(spark, cells, blocks, threshold):
    x = clumps(np.random.default_rng(cells))
    x = np.concatenate([x, x[:20], x[:5]])  # exact copies
    df = frame(spark, x)
    got = S.similarity_groups(df, "id", "v", df, 6, threshold, cell_rows=cells, block_rows=blocks)
    rows = {r["id"]: r["group"] for r in got.collect()}
    assert [rows[i] for i in range(len(x))] == list(brute_groups(x, x, threshold))


def test_a_clump_with_a_third_of_all_rows(spark):
    rng = np.random.default_rng(4)
    hot = np.array([1.0, 0, 0, 0, 0, 0]) + 0.01 * rng.normal(size=(60, 6))
    x = np.concatenate([hot, rng.normal(size=(120, 6))])
    df = frame(spark, x)
    got = {r["id"]: r["group"] for r in S.similarity_groups(df, "id", "v", df, 6, 0.95, cell_rows=20, block_rows=8).collect()}
    assert [got[i] for i in range(180)] == list(brute_groups(x, x, 0.95))


def test_zero_vectors_keep_every_link(spark):
    x = clumps(np.random.default_rng(2), 4, 10)
    rows = [(f"k{i:03d}", [float(v) for v in row]) for i, row in enumerate(x)]
    centre = x.mean(axis=0)
    zeros = [(f"a{i}", [float(v) for v in centre]) for i in range(3)]  # zero after centring, first in key order
    reference = spark.createDataFrame(rows, "id string, v array<double>")
    df = spark.createDataFrame(zeros + rows, "id string, v array<double>")
    got = {r["id"]: r["group"] for r in S.similarity_groups(df, "id", "v", reference, 6, 0.9, cell_rows=8, block_rows=4).collect()}
    want = brute_groups(x, x, 0.9)
    assert [got[f"k{i:03d}"] for i in range(len(x))] == [f"k{g:03d}" for g in want]
    assert len(got) == len(x) + 3 and len(set(want)) < len(x)


@pytest.mark.parametrize("cells, blocks, threshold", [(4, 3, 0.2), (16, 5, 0.9), (64, 64, 0.5)])
def test_no_pair_is_compared_twice(spark, cells, blocks, threshold):
    x = np.random.default_rng(7).normal(size=(120, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tasks, _ = S.block_pairs(frame(spark, x), "id", "v", float(np.sqrt(2 - 2 * threshold)), cells, blocks)
    compared = 0
    for _, g in tasks.toPandas().groupby(["__pa", "__ba", "__pb", "__bb"]):
        n = len(g)
        compared += n * (n - 1) // 2 if g["__both"].all() else g["__left"].sum() * (n - g["__left"].sum())
        assert g["id"].is_unique
    assert compared <= 120 * 119 // 2


def test_nearest_match_without_partners(spark):
    left = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [None, None])], "id string, v array<double>")
    right = spark.createDataFrame([("x", [0.0, 1.0]), ("w", [0.0, 1.0]), ("z", [None, None])], "id string, v array<double>")
    assert {r["id"]: r["match"] for r in S.nearest_match(left, right, "id", "v").collect()} == {"a": "w", "b": None}
    assert {r["id"]: r["match"] for r in S.nearest_match(left, right.limit(0), "id", "v").collect()} == {"a": None, "b": None}


def test_chain_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a int, b int")
    got = {r["node"]: r["component"] for r in S.connected_components(links).collect()}
    assert {got[i] for i in range(41)} == {0} and got[101] == 100 and len(got) == 43


@pytest.mark.parametrize("groups, bits", [(1, 4), (2, 3), (4, 2), (8, 1)])
def test_lists_keep_every_link(spark, monkeypatch, groups, bits):
    """Any number of groups and medians gives the same links, also where most lists are reached."""
    x = np.random.default_rng(bits).normal(size=(150, 16)) * np.linspace(2, 0.2, 16)
    x = np.concatenate([x, x[:40] + 0.15 * np.random.default_rng(1).normal(size=(40, 16))])

    def plan(sample, rows, r, *others):
        _, axes = np.linalg.eigh(sample.T @ sample)
        lists = S.Lists(axes[:, ::-1], groups, bits, r * r / groups)
        lists.medians = np.median(lists.features(sample), axis=1)[:, None, :]
        return lists

    monkeypatch.setattr(S, "plan_lists", plan)
    df = frame(spark, x)
    got = {r["id"]: r["group"] for r in S.similarity_groups(df, "id", "v", df, 16, 0.93, cell_rows=20, block_rows=16).collect()}
    want = brute_groups(x, x, 0.93)
    assert [got[i] for i in range(len(x))] == list(want) and len(set(want)) < len(x)


def test_rows_go_only_to_lists_in_reach(spark):
    """Shuffled rows stay below half of those of all pairs of blocks."""
    x = clumps(np.random.default_rng(3), 60, 100, 16, 0.1)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    n, block = len(x), 64
    tasks, _ = S.block_pairs(frame(spark, x), "id", "v", float(np.sqrt(2 - 2 * 0.93)), 64, block)
    assert tasks.count() < n * n / (2 * block) / 2
    # At a billion rows without any structure the lists still beat whole blocks.
    sample = np.random.default_rng(4).normal(size=(1024, 64))
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    lists = S.plan_lists(sample, 10**9, float(np.sqrt(2 - 2 * 0.93)))
    copies = sum(np.count_nonzero(found > home[row]) / len(home) + 1 for _, row, found, home in lists.reach(sample[:256]))
    assert lists.bits > 4 and copies * max(1.0, 10**9 / 2**lists.bits / S.BLOCK_ROWS) < 10**9 / 2048 / 8


def test_open_leaves_hold_the_nearest_row(spark):
    rng = np.random.default_rng(6)
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    x, q = unit(clumps(rng, 30, 40, 8)), unit(rng.normal(size=(50, 8)))
    tree = S.build_tree(x[::3], 60)
    leaf, near = tree.home(x)
    tree.count({int(n): (int((leaf == n).sum()), float(near[leaf == n].max())) for n in np.unique(leaf)})
    assert tree.size[0] == len(x) and max(len(c) for c in tree.children) <= S.BRANCHES and any(tree.children[c] for c in tree.children[0])
    cosine = q @ x.T
    row, found, least = tree.open_leaves(q, np.sqrt(2 - 2 * cosine.max(axis=1)))
    for i in range(len(q)):
        assert leaf[cosine[i].argmax()] in found[row == i]
    assert len(row) < 0.7 * len(q) * len(np.unique(leaf))


def test_nearest_match_reports_what_it_saw(spark):
    rng = np.random.default_rng(8)
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    right = unit(clumps(rng, 40, 30, 8, 0.05))
    left = unit(right[::12] + 0.02 * rng.normal(size=(100, 8)))
    rows = S.nearest_match(frame(spark, left), frame(spark, right), "id", "v", cell_rows=20, block_rows=16, count_seen=True).collect()
    cosine = left @ right.T
    assert [r["match"] for r in sorted(rows, key=lambda r: r["id"])] == list(cosine.argmax(axis=1))
    assert sum(r["seen"] for r in rows) < 0.2 * len(left) * len(right)


@pytest.mark.parametrize("cells", [4096, 12])
def test_nearest_match_is_exact(spark, cells):
    rng = np.random.default_rng(9)
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    left, right = unit(clumps(rng, 6, 8)), unit(clumps(rng, 10, 12))
    rows = S.nearest_match(frame(spark, left), frame(spark, right), "id", "v", cell_rows=cells, block_rows=5).collect()
    cosine = left @ right.T
    assert len(rows) == len(left)
    for r in rows:
        assert r["cosine"] == pytest.approx(cosine[r["id"]].max()) and r["match"] == cosine[r["id"]].argmax()


def test_nearest_match_stores_a_row_once_however_many_cells_are_open(spark, monkeypatch):
    rng = np.random.default_rng(12)
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    left, right = unit(rng.normal(size=(70, 16))), unit(rng.normal(size=(300, 16)))  # no structure: all cells stay open
    tables, old = [], S.stored

    def stored(df, name):
        out = old(df, name)
        tables.append((name, out))
        return out

    monkeypatch.setattr(S, "stored", stored)
    monkeypatch.setattr(S, "PAIRS", 64, raising=False)
    rows = S.nearest_match(frame(spark, left), frame(spark, right), "id", "v", cell_rows=10, block_rows=7, count_seen=True).collect()
    assert [r["match"] for r in sorted(rows, key=lambda r: r["id"])] == list((left @ right.T).argmax(axis=1))
    assert sum(r["seen"] for r in rows) > 0.7 * 70 * 300
    found = [t for name, t in tables if name == "match-wanted"]
    assert len(found) == 2
    for table in found:
        assert 0 < table.count() <= 70 and table.select("id").distinct().count() == table.count()


def test_cells_hold_all_leaves_in_order(spark):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(500, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = S.build_tree(x, 60)
    leaf, near = tree.home(x)
    tree.count({int(n): (int((leaf == n).sum()), float(near[leaf == n].max())) for n in np.unique(leaf)})
    cell = tree.cells(40)
    assert (cell[leaf] >= 0).all() and (cell[[n for n, c in enumerate(tree.children) if c]] == -1).all()
    sizes = {c: sum(tree.size[n] for n in np.flatnonzero(cell == c)) for c in set(cell.tolist()) - {-1}}
    assert sum(sizes.values()) == 500 and len(sizes) < len(np.unique(leaf))
    assert all(n <= 40 or (cell == c).sum() == 1 for c, n in sizes.items())


def test_has_partner(spark):
    groups = spark.createDataFrame([(0, 0), (1, 0), (2, 2)], "id int, group int")
    assert {r["id"]: r["has_partner"] for r in S.has_partner(groups, "id").collect()} == {0: True, 1: True, 2: False}


def test_pooling(spark):
    x = np.random.default_rng(0).normal(size=(7, 3))
    df = frame(spark, x).selectExpr("id", "v", "id < 4 AS keep")
    from pyspark.sql import functions as F

    assert np.allclose(one(V.masked_mean_pool(df, [], "v", F.col("keep"), 3))["vector"], x[:4].mean(axis=0))
    assert one(V.masked_mean_pool(df, [], "v", F.lit(False), 3))["vector"] == [0, 0, 0]
    stats = one(V.layer_stats(df, [], "v", 3))
    assert np.allclose(stats["mean"], x.mean(axis=0)) and np.allclose(stats["std"], x.std(axis=0))
    u = (x / np.linalg.norm(x, axis=1, keepdims=True)).mean(axis=0)
    assert np.allclose(one(V.unit_mean(df, [], "v", 3))["vector"], u / np.linalg.norm(u))
