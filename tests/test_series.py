import numpy as np
import pytest
from pyspark.sql import functions as F

from rubrica.functions import tokens as T
from rubrica.operators import series as S

from .conftest import one

SEGMENT = "array<struct<start:double,end:double,text:string>>"


def record(spark, segments, text, duration):
    return spark.createDataFrame([(1, text, float(duration), segments)], f"id int, text string, duration double, segments {SEGMENT}")


def test_segment_fluency_by_hand(spark):
    segments = [(0.0, 1.0, "Um uh"), (2.0, 4.0, "erm hmm"), (4.5, 6.5, "go go"), (8.0, 10.0, "go")]
    got = one(S.segment_fluency(record(spark, segments, "Um uh erm hmm go go go", 12), ["id"], "text", "duration", "segments"))
    gaps = np.array([1.0, 0.5, 1.5])
    assert got["segment_count"] == 4 and got["recognized_speech_seconds"] == 7
    assert got["speech_coverage_ratio"] == pytest.approx(7 / 12)
    assert got["gap_count"] == 3 and got["gap_mean"] == pytest.approx(gaps.mean()) and got["gap_std"] == pytest.approx(gaps.std())
    assert [got[f"long_gap_{g}_count"] for g in ("0_5", "1_0", "2_0")] == [3, 2, 0]
    assert got["filler_rate"] == pytest.approx(4 / 7) and got["immediate_repetition_rate"] == pytest.approx(2 / 6)


def test_segment_fluency_edges(spark):
    overlap = [(0.0, 3.0, "a"), (2.0, 1.0, "b")]
    got = one(S.segment_fluency(record(spark, overlap, "a b", 5), ["id"], "text", "duration", "segments"))
    assert got["recognized_speech_seconds"] == 3 and got["gap_count"] == 1 and got["gap_max"] == 0
    empty = one(S.segment_fluency(record(spark, [], "", 0), ["id"], "text", "duration", "segments"))
    assert all(empty[n] == 0 for n in S.FLUENCY)


def test_tall_and_array_forms_agree_across_buckets(spark):
    rng = np.random.default_rng(3)
    starts = np.sort(rng.uniform(0, 500, 60))
    words = ["um", "go", "home", "uh"]
    segments = [(float(s), float(s + rng.uniform(0.1, 6)), " ".join(rng.choice(words, 3))) for s in starts]
    text = " ".join(s[2] for s in segments)
    duration = max(s[1] for s in segments) - segments[0][0]
    wide = one(S.segment_fluency(record(spark, segments, text, duration), ["id"], "text", "duration", "segments"))
    tall = spark.createDataFrame([(1, i, *s) for i, s in enumerate(segments)], "id int, pos int, start double, end double, text string")
    tall = tall.withColumn("bucket", F.floor(F.col("start") / 50)).withColumn("tokens", T.letter_tokens("text"))
    got = one(S.segment_fluency_tall(tall, ["id"], "bucket", ["start", "pos"], "start", "end", "tokens"))
    for name in S.FLUENCY:
        assert got[name] == pytest.approx(wide[name]), name


def test_segment_pauses(spark):
    segments = [(0.0, 3.0, "a b c"), (3.2, 6.0, "d e"), (7.0, 10.0, "f g")]
    got = one(S.segment_pauses(record(spark, segments, "", 20), ["id"], "duration", "segments"))
    assert got["speech_seconds"] == 10 and got["words_per_second"] == pytest.approx(0.7)
    assert got["long_pauses"] == 1 and got["pause_seconds"] == pytest.approx(1)


def test_activity_runs(spark):
    values = [0, 0, 5, 5, 0, 0, 0, 5, 0, 5, 0]
    df = spark.createDataFrame([(1, i, i // 3, float(v)) for i, v in enumerate(values)], "k int, i int, b int, v double")
    got = one(S.activity_runs(df, ["k"], "b", ["i"], "v", 1.0, 1.0, 2.0))
    assert got["active_ratio"] == pytest.approx(4 / 11)
    assert got["pause_count"] == 1 and got["mean_pause_duration"] == 3 and got["median_pause_duration"] == 3
    assert got["mean_active_segment_duration"] == pytest.approx(4 / 3)


def test_no_activity_gives_zero_pauses(spark):
    df = spark.createDataFrame([(1, i, 0, 0.0) for i in range(4)], "k int, i int, b int, v double")
    got = one(S.activity_runs(df, ["k"], "b", ["i"], "v", 1.0, 1.0, 1.0))
    assert got["silence_ratio"] == 1 and got["pause_count"] == 0 and got["mean_active_segment_duration"] == 0


@pytest.mark.parametrize(
    "n, chunk, tail, expected", [(25, 10, 0, [(0, 10), (10, 20), (20, 25)]), (25, 10, 6, [(0, 10), (10, 25)]), (4, 10, 6, [(0, 4)]), (20, 10, 5, [(0, 10), (10, 20)])]
)
def test_plan_chunks(spark, n, chunk, tail, expected):
    df = spark.range(1).select(S.plan_chunks(F.lit(n).cast("bigint"), chunk, tail).alias("c"))
    assert [(c["start"], c["end"]) for c in one(df)["c"]] == expected


@pytest.mark.parametrize("n, window, expected", [(25, 10, [(0, 10), (10, 20)]), (4, 10, [(0, 4)]), (10, 10, [(0, 10)])])
def test_plan_full_windows(spark, n, window, expected):
    df = spark.range(1).select(S.plan_full_windows(F.lit(n).cast("bigint"), window).alias("c"))
    assert [(c["start"], c["end"]) for c in one(df)["c"]] == expected


@pytest.mark.parametrize("dealt", [(0, 1, 2), (2, 1, 0)])
def test_a_row_at_the_mean_keeps_its_sign_in_any_order_of_rows(spark, dealt):
    # 0.1 + 0.2 + 0.3 is more than three times 0.2 in one order of summation and less in another.
    rows = [(1, 0, 0, 0, 0.1), (1, 0, 0, 2, 0.2), (1, 0, 0, 1, 0.3)]
    df = spark.createDataFrame([rows[i] for i in dealt], "k int, f int, b int, i int, v double").coalesce(1)
    got = one(S.zero_crossing(df, ["k"], "f", "b", ["i"], "v"))
    assert got["frames"] == 1 and got["zcr_mean"] == 0.5


def test_infinite_values_keep_their_order_about_the_mean(spark):
    df = spark.createDataFrame([(1, 0, 0, 0, 1.0), (1, 0, 0, 1, float("inf")), (1, 0, 0, 2, 2.0)], "k int, f int, b int, i int, v double")
    assert one(S.zero_crossing(df, ["k"], "f", "b", ["i"], "v"))["zcr_mean"] == 1


def test_events_arrive_day_after_day_in_small_files(spark, tmp_path, monkeypatch):
    from catalog import streams
    from catalog.base import Tables

    monkeypatch.setattr(streams, "ROWS_PER_FILE", 10)
    rows = spark.range(200).selectExpr(
        "id AS event_id", "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, int(id * 37 % 96)) AS ts", "id % 3 AS user_id", "'a' AS event_type", "double(id) AS value"
    )
    rows.write.parquet(str(tmp_path / "events.parquet"))
    path, _ = streams.arriving(Tables(spark, str(tmp_path)))
    got = spark.read.parquet(path).select("event_id", F.to_date("ts").cast("string").alias("day"), "_metadata.file_path", "_metadata.file_modification_time").collect()
    assert sorted(r["event_id"] for r in got) == list(range(200))
    files = {}
    for r in got:
        files.setdefault((r["file_modification_time"], r["file_path"]), []).append(r["day"])
    assert max(len(days) for days in files.values()) <= 10
    days = [sorted(set(files[f])) for f in sorted(files)]
    assert all(len(d) == 1 for d in days) and days == sorted(days)
