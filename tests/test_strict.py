"""No row is lost in silence, names and keys are free, and bad input is refused."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from rubrica.operators import alignment as A
from rubrica.operators import blend as B
from rubrica.operators import comparison as C
from rubrica.operators import folds as FO
from rubrica.operators import linear as L
from rubrica.operators import metrics as M
from rubrica.operators import quality as Q
from rubrica.operators import ranking as R
from rubrica.operators import series as S
from rubrica.sources import tables as TB
from rubrica.sources import transcripts as TR
from rubrica.streaming import jobs as J

from .conftest import one


def test_rows_without_a_fold_stay(spark):
    df = spark.createDataFrame([(1, 1.0, 0), (2, 3.0, 1), (3, 100.0, None)], "key int, label double, fold int")
    got = {r["key"]: r["prediction"] for r in FO.mean_baseline_oof(df).collect()}
    assert got == {1: 3.0, 2: 1.0, 3: None}


def test_unmatched_keys_are_reported(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "key int, prediction double")
    b = spark.createDataFrame([(1, 1.0), (3, 2.0)], "key int, prediction double")
    with pytest.raises(Q.QualityError):
        B.fixed_blend(a, b, ["key"], 0.5)
    assert one(A.oof_parity(a, b, ["key"], 1e-9)).items() >= {"n": 1, "unmatched": 2, "within_tolerance": False}.items()
    assert one(A.oof_parity(a, a, ["key"], 1e-9))["within_tolerance"] is True
    labels, folds = a.select("key", F.lit(1.0).alias("label")), b.select("key", F.lit(0).alias("fold"))
    with pytest.raises(Q.QualityError):
        A.assemble_texts(labels, folds, a, None, "key", F.lit(True))
    metrics = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "metric string, value double")
    stored = spark.createDataFrame([("x", 1.0)], "metric string, reference double")
    assert {r["metric"]: r["material"] for r in M.reference_deviation(metrics, stored, ["metric"], 0.1).collect()} == {"x": False, "y": True}
    assert one(A.merge_coverage(A.merge_indicator(a.drop("prediction"), b.drop("prediction"), ["key"]))) == {"n": 3, "both": 1, "left_only": 1, "right_only": 1}


def test_null_cells_have_a_weight(spark):
    df = spark.createDataFrame([(1, 0), (2, None), (3, None), (4, 0)], "key int, cell int")
    weighted, missing = B.cell_weights(df, spark.createDataFrame([(0,), (None,), (None,), (None,), (7,)], "cell int"), "cell")
    assert {r["key"]: r["weight"] for r in weighted.collect()} == pytest.approx({1: 0.4, 4: 0.4, 2: 1.2, 3: 1.2})
    assert [r["key"] for r in missing.collect()] == ["7"]


@pytest.mark.parametrize("wide", [False, True])
def test_null_rows_do_not_bias_a_fit(spark, monkeypatch, wide):
    if wide:
        monkeypatch.setattr(L, "TILE", 1)
    rows = [(0, float(x), 2.0 * x + 1) for x in range(5)] + [(0, None, 9.0), (0, None, 50.0), (0, 3.0, None)]
    df = spark.createDataFrame(rows, "fold int, x double, y double")
    moments = L.collect_moments(df, ["x"], "y", ["fold"])
    line = L.solve(moments.pick(lambda c: True), moments.centre, 0.0, False)
    assert moments.skipped == 3 and moments.n.sum() == 5
    assert line.intercept == pytest.approx(1) and np.allclose(line.coef, [2])


def test_group_and_value_names_are_free(spark):
    df = spark.createDataFrame([(g, float(v), 1) for g in range(2) for v in range(4)], "k int, n double, a int").withColumn("b", F.col("a"))
    for groups in (["k"], ["k", "a"], ["k", "b"]):
        got = R.exact_quantiles(df, groups, "n", {"median": 0.5}).collect()
        assert [r["median"] for r in got] == [1.5, 1.5]
        cells = R.exact_quantiles(df, groups, "n", {"median": 0.5}, accuracy=4).collect()
        assert [r["median"] for r in cells] == [1.5, 1.5]
    assert R.average_ranks(df.withColumnRenamed("n", "v"), ["k"], "v", "n").count() == 8
    swapped = df.select(F.col("n").alias("k"), F.col("k").alias("n"))
    assert sorted(r["m"] for r in R.exact_quantiles(swapped, ["n"], "k", {"m": 0.0}).collect()) == [0.0, 0.0]
    pair = A.set_overlap({"a": df.select("k"), "b": df.select("k").limit(0)}, "k")
    assert one(pair)["first_only"] == 2


def test_no_spread_of_values_is_too_wide(spark):
    df = spark.createDataFrame([(float(v),) for v in [*range(50), 1e12, -1e300, 1e300]], "v double")
    got = one(R.exact_quantiles(df, [], "v", {"m": 0.5, "top": 1.0}, accuracy=5))
    assert got["m"] == 25 and got["top"] == 1e300


def test_string_keys(spark):
    df = spark.createDataFrame([("b.wav", 10.0), ("a.wav", 10.0), ("c.wav", 50.0)], "name string, seconds double")
    got = {r["bucket"]: r["name"] for r in S.bucket_representatives(df, "name", "seconds").collect()}
    assert set(got.values()) == {"a.wav", "c.wav", None}
    assert sorted(r["name"] for r in S.fill_representatives(df, "name", "seconds").collect()) == ["a.wav", "b.wav", "c.wav"]


def test_blank_means_any_white_space(spark, tmp_path):
    df = spark.createDataFrame([("\t",), (" ",), ("x",)], "name string")
    assert [r["rule"] for r in Q.key_check(df, ["name"]).collect()] == ["blank:name", "blank:name"]
    record = {"split": "train", "filename": "\t", "text": "t", "language": "en", "duration_seconds": 1.0, "segments": []}
    (tmp_path / "t.jsonl").write_text("\t\n" + json.dumps(record) + "\n")
    good, bad = TR.read_transcripts(spark, str(tmp_path / "t.jsonl"))
    assert good.count() == 0 and [r["rule"] for r in bad.collect()] == ["bad_identity"]


def test_csv_is_checked_where_it_is_not_read(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("filename,score\na,1.5\nb,oops\n")
    df = TB.read_labeled_csv(spark, str(tmp_path / "bad.csv"), "filename string, score double")
    for read in (lambda: df.count(), lambda: df.select("filename").collect()):
        with pytest.raises(Exception, match="(?i)malformed|parse|oops"):
            read()
    (tmp_path / "case.csv").write_text("FILENAME,score\na,1.5\n")
    with pytest.raises(ValueError, match="header"):
        TB.read_labeled_csv(spark, str(tmp_path / "case.csv"), "filename string, score double")


def test_fingerprint_tells_fields_apart(spark):
    print_of = lambda *rows: one(TB.table_fingerprint(spark.createDataFrame(list(rows), "a string, b string"), ["a", "b"]))
    assert print_of(("a|", "b")) != print_of(("a", "|b"))
    assert print_of((None, "b")) != print_of(("", "b"))
    assert print_of(("x", "y"), ("p", "q")) == print_of(("p", "q"), ("x", "y"))


def test_metrics_of_missing_numbers(spark):
    df = spark.createDataFrame([(1.0, 1.0, 0), (2.0, None, 0)], "label double, prediction double, fold int")
    assert one(M.regression_metrics(df, by=None))["n"] == 1
    verdict = C.classify(F.lit(0.1), F.lit(None).cast("double"), F.lit(0.5), F.lit(0.5))
    assert one(spark.range(1).select(verdict.alias("v")))["v"] is None


def test_prediction_columns_and_order(spark):
    reference = spark.createDataFrame([(1, 0.0, 1), (2, 0.0, 2)], "key int, prediction double, row int")
    good = reference.select("key", "prediction", "row")
    assert Q.prediction_schema_check(good, reference, "key", "prediction", "row").collect() == []
    swapped = good.select("prediction", "key", (3 - F.col("row")).alias("row"))
    got = {r["rule"]: r["n"] for r in Q.prediction_schema_check(swapped, reference, "key", "prediction", "row").collect()}
    assert got == {"columns": 1, "order": 2}


def test_late_rows_are_ingested_and_windows_close(spark, tmp_path):
    source, sink, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    schema = "id int, ts timestamp, v double"
    rows = lambda *r: spark.createDataFrame(list(r), "id int, ts string, v double").withColumn("ts", F.to_timestamp("ts"))
    fields = rows((1, "2024-01-01 00:00:00", 1.0)).schema
    for batch in (
        [(1, "2024-01-10 00:00:00", 1.0), (2, "2024-01-10 00:05:00", 3.0), (1, "2024-01-10 00:00:00", 1.0)],
        [(3, "2024-01-01 00:00:00", 5.0), (1, "2024-01-10 00:00:00", 1.0)],
    ):
        rows(*batch).write.mode("append").parquet(source)
        stream = J.event_stream(spark, source, fields).withColumn("day", F.to_date("ts"))
        J.resume_ingest(stream, sink, check, ["id"], "day")
    assert sorted(r["id"] for r in spark.read.parquet(sink).collect()) == [1, 2, 3], schema
    frames, state = str(tmp_path / "frames"), str(tmp_path / "state")
    run = lambda: J.run_append(J.hopping_frames(J.event_stream(spark, source, fields), ["id"], "ts", "v", "1 hour", "1 hour", "30 days"), frames, state)
    assert run() == 0
    J.closing_row(spark.read.parquet(source), "ts", "60 DAYS").write.mode("append").parquet(source)
    assert run() == 0
    assert spark.read.parquet(frames).where("id IS NOT NULL").agg(F.sum("n")).first()[0] == 5
    rows((4, "2024-01-01 00:00:00", 5.0)).write.mode("append").parquet(source)
    assert run() == 1  # behind the watermark, and counted
