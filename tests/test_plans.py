import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from rubrica.plans import honest_blend as H

from .test_models import nested, oof
from .test_similarity import brute_groups

FOLDER = "/root/testdata/sf0.001"
TABLES = ["part", "orders", "lineitem", "customer", "events", "documents", "labels", "conversations", "benchmark", "embeddings"]
SAMPLE = [
    "oof_regression_metrics", "paired_comparison", "key_check", "set_overlap", "disfluency_rates", "token_edit_distance",
    "segment_fluency", "activity_runs", "ks_statistic", "stratified_folds", "ridge_oof", "nested_blend", "similarity_groups",
    "tfidf_char_wb", "resume_append", "stream_resume_ingest", "stream_activity_sessions", "stream_running_stats",
]


def plain(value):
    return round(value, 5) + 0.0 if isinstance(value, float) else value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    df = entry.queries()[name](spark, FOLDER)
    cursor = db.execute(entry.oracle_sql()[name])
    wanted = rows([d[0] for d in cursor.description], cursor.fetchall())
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == wanted and wanted


def test_entry(spark):
    assert entry.entry(spark).count() == 6


def test_honest_blend_matches_numpy(spark):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(30, 6))
    owner = np.r_[np.repeat(np.arange(20), 3), 20 + np.arange(10)]
    x = centres[owner] + 0.02 * rng.normal(size=(70, 6))
    y = rng.uniform(1, 5, 70)
    f = np.column_stack([y[:, None] + rng.normal(size=(70, 2)), rng.normal(size=(70, 2))])
    run = y + rng.normal(scale=0.8, size=70)
    schema = "id int, y double, v array<double>, f array<double>, r double, short boolean"
    table = [(i, float(y[i]), x[i].tolist(), f[i].tolist(), float(run[i]), bool(i % 2)) for i in range(70)]
    df = spark.createDataFrame(table, schema)
    is_target = np.arange(70) % 7 == 3
    train, target = df.where("id % 7 <> 3"), df.where("id % 7 = 3").drop("y")
    out = H.run(train, target, "id", "y", ("v", 6), 0.95, ["r"], [H.Channel("audio", [("f", 4)], 10.0)], "short")

    got = sorted(out.oof.collect(), key=lambda r: r["id"])
    ids = np.array([r["id"] for r in got])
    assert list(ids) == list(np.flatnonzero(~is_target))
    groups = brute_groups(x[~is_target], x, 0.95)
    assert [r["group"] for r in got] == [int(ids[g]) for g in groups]
    folds = np.array([r["fold"] for r in got])
    for g in set(groups):
        assert len(set(folds[groups == g])) == 1
    audio = oof(f[ids], y[ids], folds, 10.0)
    assert np.allclose([r["audio"] for r in got], audio, atol=1e-9)
    weight = np.array([r["weight"] for r in got])
    cells = 2 * (ids % 2) + np.array([r["partner"] for r in got])
    tg = brute_groups(x[is_target], x, 0.95)
    tcells = 2 * (np.flatnonzero(is_target) % 2) + np.array([(tg == g).sum() > 1 for g in tg])
    expected = np.array([(tcells == c).mean() / (cells == c).mean() for c in cells])
    assert np.allclose(weight, expected)
    blended = nested(y[ids], np.column_stack([run[ids], audio]), folds, weight)
    assert np.allclose([r["prediction"] for r in got], blended, atol=1e-8)
    assert out.predictions.count() == is_target.sum()
    assert {r["section"] for r in out.report.collect()} >= {"size", "share", "target_like_rmse", "final_weight", "calibration"}


def test_honest_blend_of_one_group_and_of_uncovered_cells(spark):
    """Similarity may join all training rows, and leave target rows of a kind that training has not."""
    def table(first, vectors, short):
        rng = np.random.default_rng(first)
        return spark.createDataFrame(
            [(first + i, float(rng.uniform(1, 5)), [float(v) for v in x], [float(v) for v in rng.normal(size=2)], float(i % 5), i % 2 == short) for i, x in enumerate(vectors)],
            "id long, y double, v array<double>, f array<double>, run double, short boolean",
        )

    def run(train, target):
        return H.run(train, target.drop("y"), "id", "y", ("v", 3), 0.8, ["run"], [H.Channel("audio", [("f", 2)], 1.0)], "short")

    def report(out):
        return {(r["section"], r["name"]): r["value"] for r in out.report.collect()}

    near = [(1.0, 0.01 * i, 0.0) for i in range(8)]
    apart = [(-1.0, 0.0, 0.0), (0.0, -1.0, 0.0), (0.0, 0.0, 1.0)]
    one = run(table(0, near, 0), table(100, near[:2] + apart, 0))
    found = report(one)
    assert found["size", "groups"] == 1 and found["size", "target_uncovered"] == 3
    assert found["final_weight", "audio"] is None and found["rmse", "blend_nested"] is None and found["rmse", "text"] > 0
    assert one.oof.count() == 8 and {r["prediction"] for r in one.oof.collect()} == {None}
    assert one.predictions.count() == 5 and one.choices.count() == 0
