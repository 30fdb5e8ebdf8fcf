import pytest

from rubrica.operators import alignment as A
from rubrica.operators import quality as Q
from rubrica.operators import scoring as S
from rubrica.session import scratch_path
from rubrica.sources import tables as TB
from rubrica.sources import transcripts as TR


def test_key_check_and_enforce(spark):
    df = spark.createDataFrame([("a.wav",), (None,), (" ",), ("x/y",), ("..",), ("a.wav",)], "name string")
    rules = sorted(r["rule"] for r in Q.key_check(df, ["name"], safe_name=True).collect())
    assert rules == ["blank:name", "duplicate", "missing:name", "unsafe:name", "unsafe:name"]
    with pytest.raises(Q.QualityError):
        Q.enforce(Q.key_check(df, ["name"]))
    Q.enforce(Q.key_check(spark.createDataFrame([("a",), ("b",)], "name string"), ["name"]))


@pytest.mark.parametrize("value, rule", [(None, "null"), ("x", "not_numeric"), ("NaN", "not_numeric"), ("6", "out_of_range"), ("-0.1", "out_of_range")])
def test_range_check(spark, value, rule):
    df = spark.createDataFrame([(1, value)], "id int, v string")
    assert [r["rule"] for r in Q.range_check(df, "id", "v", 0, 5).collect()] == [rule]


def test_schema_check(spark):
    df = spark.createDataFrame([(1, 2.0)], "a int, b double")
    assert Q.schema_check(df, [("a", "int"), ("b", "double")]) == []
    assert Q.schema_check(df, [("b", "double"), ("a", "int")]) == ["columns out of order"]
    assert Q.schema_check(df, [("a", "string")])


@pytest.mark.parametrize("folds, valid", [([0, 1, 0, 1], True), ([0, 0, 0, 1], False), ([0, 1, 2, 2], False), ([0, 0, 0, 0], False)])
def test_fold_check(spark, folds, valid):
    df = spark.createDataFrame([(f,) for f in folds], "fold int")
    assert Q.fold_check(df, "fold", 2).first()["valid"] is valid


LINES = [
    '{"split": "train", "filename": "a.wav", "text": "Hi", "language": "en", "duration_seconds": 2, "segments": [{"start": 0.0, "end": 1.5, "text": "Hi"}], "model": "x"}',
    "",
    "{broken",
    '{"split": "train", "filename": "b.wav", "text": "Hi", "language": "en", "segments": []}',
    '{"split": "train", "filename": "c.wav", "text": 3, "language": "en", "duration_seconds": 2, "segments": []}',
    '{"split": "train", "filename": "d.wav", "text": "Hi", "language": "en", "duration_seconds": true, "segments": []}',
    '{"split": "train", "filename": "e.wav", "text": "Hi", "language": "en", "duration_seconds": -1, "segments": []}',
    '{"split": "train", "filename": " ", "text": "Hi", "language": "en", "duration_seconds": 1, "segments": []}',
    '{"split": "train", "filename": "f.wav", "text": "Hi", "language": "en", "duration_seconds": 1, "segments": {}}',
    '{"split": "train", "filename": "g.wav", "text": "Hi", "language": "en", "duration_seconds": 1, "segments": []}',
    '{"split": "train", "filename": "g.wav", "text": "Ho", "language": "en", "duration_seconds": 1, "segments": []}',
    '{"split": "test", "filename": "a.wav", "text": "Hi", "language": "en", "duration_seconds": 0, "segments": []}',
]


def test_read_transcripts(spark):
    path = scratch_path(spark, "lines")
    spark.createDataFrame([(line,) for line in LINES], "value string").write.text(path)
    good, bad = TR.read_transcripts(spark, path)
    rows = {(r["split"], r["filename"]): r for r in good.collect()}
    assert set(rows) == {("train", "a.wav"), ("test", "a.wav")}
    assert rows[("train", "a.wav")]["segments"][0]["end"] == 1.5 and '"model"' in rows[("train", "a.wav")]["record"]
    assert sorted(r["rule"] for r in bad.collect()) == sorted(
        ["malformed", "missing_field", "text_not_string", "bad_duration", "bad_duration", "bad_identity", "segments_not_list", "duplicate_identity", "duplicate_identity"]
    )


def test_csv_header_must_match(spark):
    path = scratch_path(spark, "csv")
    spark.createDataFrame([("a", 1.0)], "filename string, label double").write.option("header", True).csv(path)
    assert TB.read_labeled_csv(spark, path, "filename string, label double").count() == 1
    for schema in ("label double, filename string", "filename string, other double"):
        with pytest.raises(Exception):
            TB.read_labeled_csv(spark, path, schema).collect()


def test_guarded_write_refuses(spark):
    path = scratch_path(spark, "guard")
    df = spark.range(3)
    TB.guarded_write(df, path)
    with pytest.raises(Exception):
        TB.guarded_write(df, path)
    TB.guarded_write(df, path, overwrite=True)


def test_resume_append(spark):
    sink = scratch_path(spark, "resume")
    first = TB.resume_append(spark.range(4), sink, ["id"], lambda d: d, {"m": 1}).first()
    second = TB.resume_append(spark.range(6), sink, ["id"], lambda d: d, {"m": 1}).first()
    assert (first["processed"], first["skipped"]) == (4, 0) and (second["processed"], second["skipped"]) == (2, 4)
    assert spark.read.parquet(f"{sink}/data").count() == 6
    with pytest.raises(ValueError):
        TB.resume_append(spark.range(6), sink, ["id"], lambda d: d, {"m": 2})


def test_fingerprint_ignores_order(spark):
    a, b = spark.range(50), spark.range(50).orderBy("id", ascending=False)
    assert TB.table_fingerprint(a, ["id"]).first() == TB.table_fingerprint(b, ["id"]).first()
    assert TB.table_fingerprint(a, ["id"]).first() != TB.table_fingerprint(spark.range(1, 51), ["id"]).first()


def test_aligned_join_reports_gaps(spark):
    labels = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, label double")
    features = spark.createDataFrame([("a", 1.0), ("c", 2.0)], "k string, f double")
    folds = spark.createDataFrame([("a", 0), ("b", 1)], "k string, fold int")
    joined, bad = A.aligned_join(labels, features, folds, ["k"], extra_allowed=False)
    assert joined.count() == 1
    assert sorted((r["rule"], r["table"]) for r in bad.collect()) == [("missing", "features"), ("unexpected", "features")]


def test_scoring_guards(spark):
    df = spark.createDataFrame([(1, 2.0, 0), (2, 3.0, 1)], "id int, x double, fold int")
    assert {r["id"]: r["prediction"] for r in S.batch_score(df, ["id"], ["x"], lambda b: b["x"] * 2).collect()} == {1: 4.0, 2: 6.0}
    with pytest.raises(Exception):
        S.batch_score(df, ["id"], ["x"], lambda b: b["x"] * float("nan")).collect()
    routed = S.fold_routed_score(df, ["id"], "fold", ["x"], {0: lambda b: b["x"], 1: lambda b: -b["x"]})
    assert {r["id"]: r["prediction"] for r in routed.collect()} == {1: 2.0, 2: -3.0}
    assert S.leakage_violations(routed, "fold").isEmpty()
