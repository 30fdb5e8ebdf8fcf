"""Segments, series and chunk plans on events and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from rubrica.functions import tokens as T
from rubrica.operators import series as S

from rubrica.sources.tables import spread

from .base import query
from .text import sql_spans

HOUR = 3600


def events(t):
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    return t.events.select(
        "event_id", "user_id", "event_type", "value", (micros / 1e6).alias("start"), F.floor(micros / (1e6 * HOUR)).alias("hour"), F.floor(micros / (24e6 * HOUR)).alias("day")
    )


def segments(t):
    return events(t).select("*", (F.col("start") + F.col("value")).alias("end"), T.letter_tokens("event_type").alias("tokens"))


EVENTS = "ev AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) / 1e6 AS start, epoch_us(ts) / 1e6 + value AS \"end\", CAST(floor(epoch_us(ts) / 86400e6) AS BIGINT) AS day FROM events)"
LAGGED = f"{EVENTS}, seg AS (SELECT *, greatest(\"end\" - start, 0) AS len, start - lag(\"end\") OVER w AS raw_gap, greatest(start - lag(\"end\") OVER w, 0) AS gap, lag(event_type) OVER w AS prev FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY start, event_id))"


@query(
    "segment_fluency",
    f"""WITH {LAGGED} SELECT user_id, CAST(count(*) AS DOUBLE) AS segment_count, 1e0 AS words_per_segment_mean, 0e0 AS words_per_segment_std, avg(len) AS segment_duration_mean, stddev_pop(len) AS segment_duration_std,
      avg(CASE WHEN len < 2 THEN 1e0 ELSE 0e0 END) AS short_segment_ratio, sum(len) AS recognized_speech_seconds, coalesce(sum(len) / nullif(max("end") - min(start), 0), 0) AS speech_coverage_ratio,
      coalesce(count(*) / nullif(sum(len), 0), 0) AS words_per_recognized_speech_second, CAST(count(raw_gap) AS DOUBLE) AS gap_count, coalesce(avg(gap) FILTER (WHERE raw_gap IS NOT NULL), 0) AS gap_mean,
      coalesce(stddev_pop(gap) FILTER (WHERE raw_gap IS NOT NULL), 0) AS gap_std, coalesce(max(gap) FILTER (WHERE raw_gap IS NOT NULL), 0) AS gap_max, coalesce(sum(gap) FILTER (WHERE raw_gap IS NOT NULL), 0) AS total_gap_seconds,
      CAST(count(*) FILTER (WHERE raw_gap >= 0.5) AS DOUBLE) AS long_gap_0_5_count, CAST(count(*) FILTER (WHERE raw_gap >= 1) AS DOUBLE) AS long_gap_1_0_count, CAST(count(*) FILTER (WHERE raw_gap >= 2) AS DOUBLE) AS long_gap_2_0_count,
      count(*) FILTER (WHERE event_type IN ('view', 'error')) / count(*) AS filler_rate, count(*) FILTER (WHERE prev = event_type) / greatest(count(*) - 1, 1) AS immediate_repetition_rate FROM seg GROUP BY user_id""",
    " ".join(S.FLUENCY),
    digits=4,
)
def _(t):
    return S.segment_fluency_tall(segments(t), ["user_id"], "hour", ["start", "event_id"], "start", "end", "tokens", ("view", "error"))


@query(
    "segment_pauses",
    f"""WITH {LAGGED} SELECT user_id, greatest(arg_max("end", start * 1e0) - min(start), 1e-6) AS speech_seconds, count(*) / greatest(arg_max("end", start) - min(start), 1e-6) AS words_per_second,
      CAST(count(*) FILTER (WHERE raw_gap >= 0.5) AS DOUBLE) AS long_pauses, coalesce(sum(raw_gap) FILTER (WHERE raw_gap >= 0.5), 0) AS pause_seconds FROM seg GROUP BY user_id""",
    "speech_seconds words_per_second long_pauses pause_seconds",
    digits=4,
)
def _(t):
    rows = segments(t).withColumn("words", F.size("tokens"))
    return S.segment_pauses_tall(rows, ["user_id"], "hour", ["start", "event_id"], "start", "end", "words")


def records(t):
    """Documents as records: one segment per sentence, three seconds apart."""
    spans = F.filter(T.sentence_spans("text"), lambda s: s != "")
    segs = F.transform(
        spans,
        lambda s, i: F.struct(
            (i * 3.0 + (F.length(s) % 5) * 0.25).alias("start"), (i * 3.0 + (F.length(s) % 5) * 0.25 + (F.length(s) % 23) * 0.125).alias("end"), s.alias("text")
        ),
    )
    return spread(t.documents, "doc_id").select("doc_id", "text", (F.col("n_chars") / 16).alias("duration"), segs.alias("segments"))


RECORDS = rf"""r AS (SELECT doc_id, text, n_chars / 16e0 AS duration, {sql_spans('text')} AS spans FROM documents),
  rec AS (SELECT *, list_transform(spans, lambda s, i: (i - 1) * 3e0 + (length(s) % 5) * 0.25e0) AS st, list_transform(spans, lambda s, i: (i - 1) * 3e0 + (length(s) % 5) * 0.25e0 + (length(s) % 23) * 0.125e0) AS en,
    list_transform(spans, lambda s: len(regexp_extract_all(lower(s), '[a-z]+'))) AS wo, regexp_extract_all(lower(text), '[a-z]+') AS tok FROM r),
  rg AS (SELECT *, len(spans) AS n, list_transform(range(1, len(spans) + 1), lambda i: greatest(en[i] - st[i], 0)) AS lens, list_transform(range(1, len(spans)), lambda i: st[i + 1] - en[i]) AS raw FROM rec),
  g AS (SELECT *, list_transform(raw, lambda x: greatest(x, 0)) AS gaps FROM rg)"""


@query(
    "segment_fluency_array",
    f"""WITH {RECORDS} SELECT doc_id, CAST(n AS DOUBLE) AS segment_count, CAST(coalesce(list_avg(wo), 0) AS DOUBLE) AS words_per_segment_mean, CAST(coalesce(list_stddev_pop(wo), 0) AS DOUBLE) AS words_per_segment_std, CAST(coalesce(list_avg(lens), 0) AS DOUBLE) AS segment_duration_mean,
      coalesce(list_stddev_pop(lens), 0) AS segment_duration_std, coalesce(len(list_filter(lens, lambda x: x < 2)) / nullif(n, 0), 0) AS short_segment_ratio, coalesce(list_sum(lens), 0) AS recognized_speech_seconds, coalesce(list_sum(lens) / nullif(duration, 0), 0) AS speech_coverage_ratio,
      coalesce(len(tok) / nullif(list_sum(lens), 0), 0) AS words_per_recognized_speech_second, CAST(len(gaps) AS DOUBLE) AS gap_count, coalesce(list_avg(gaps), 0) AS gap_mean, coalesce(list_stddev_pop(gaps), 0) AS gap_std, coalesce(list_max(gaps), 0) AS gap_max, coalesce(list_sum(gaps), 0) AS total_gap_seconds,
      CAST(len(list_filter(gaps, lambda x: x >= 0.5)) AS DOUBLE) AS long_gap_0_5_count, CAST(len(list_filter(gaps, lambda x: x >= 1)) AS DOUBLE) AS long_gap_1_0_count, CAST(len(list_filter(gaps, lambda x: x >= 2)) AS DOUBLE) AS long_gap_2_0_count,
      coalesce(len(list_filter(tok, lambda w: w IN ('um', 'uh', 'erm', 'hmm'))) / nullif(len(tok), 0), 0) AS filler_rate, len(list_filter(range(1, len(tok)), lambda i: tok[i] = tok[i + 1])) / greatest(len(tok) - 1, 1) AS immediate_repetition_rate FROM g""",
    " ".join(S.FLUENCY),
)
def _(t):
    return S.segment_fluency(records(t), ["doc_id"], "text", "duration", "segments")


@query(
    "segment_pauses_array",
    f"""WITH {RECORDS}, p AS (SELECT *, greatest(en[n] - st[1], 1e-6) AS span, list_filter(raw, lambda x: x >= 0.5) AS lg, list_sum(list_transform(spans, lambda s: len(list_filter(string_split(s, ' '), lambda x: x <> '')))) AS words FROM g)
      SELECT doc_id, CASE WHEN n = 0 THEN 0e0 WHEN duration > 0 THEN least(span, duration) ELSE span END AS speech_seconds, CASE WHEN n = 0 THEN 0e0 ELSE CAST(words / span AS DOUBLE) END AS words_per_second,
      CASE WHEN n = 0 THEN 0e0 ELSE CAST(len(lg) AS DOUBLE) END AS long_pauses, CASE WHEN n = 0 THEN 0e0 ELSE coalesce(list_sum(lg), 0) END AS pause_seconds FROM p""",
    "speech_seconds words_per_second long_pauses pause_seconds",
)
def _(t):
    return S.segment_pauses(records(t), ["doc_id"], "duration", "segments")


@query(
    "activity_runs",
    f"""WITH {EVENTS}, flag AS (SELECT user_id, start, event_id, value > greatest(5, 0.1e0 * q90) AS active FROM ev JOIN (SELECT user_id, quantile_cont(value, 0.9) AS q90 FROM ev GROUP BY user_id) USING (user_id)),
      isl AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start, event_id) - row_number() OVER (PARTITION BY user_id, active ORDER BY start, event_id) AS grp, row_number() OVER (PARTITION BY user_id ORDER BY start, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS total FROM flag),
      runs AS (SELECT user_id, active, count(*) * 0.5e0 AS seconds, min(rn) AS a, max(rn) AS b, max(total) AS total FROM isl GROUP BY user_id, active, grp),
      p AS (SELECT *, CASE WHEN NOT active AND a > 1 AND b < total AND seconds >= 1 THEN seconds END AS pause, CASE WHEN active THEN seconds END AS segment FROM runs)
      SELECT user_id, coalesce(sum(segment), 0) / sum(seconds) AS active_ratio, 1 - coalesce(sum(segment), 0) / sum(seconds) AS silence_ratio, CAST(count(pause) AS DOUBLE) AS pause_count, coalesce(count(pause) / nullif(sum(segment), 0), 0) AS pause_rate_per_active_second,
       coalesce(avg(pause), 0) AS mean_pause_duration, coalesce(quantile_cont(pause, 0.5), 0) AS median_pause_duration, coalesce(stddev_pop(pause), 0) AS std_pause_duration, coalesce(max(pause), 0) AS max_pause_duration, coalesce(avg(segment), 0) AS mean_active_segment_duration, coalesce(stddev_pop(segment), 0) AS std_active_segment_duration FROM p GROUP BY user_id""",
    "active_ratio silence_ratio pause_count pause_rate_per_active_second mean_pause_duration median_pause_duration std_pause_duration max_pause_duration mean_active_segment_duration std_active_segment_duration",
)
def _(t):
    return S.activity_runs(events(t), ["user_id"], "hour", ["start", "event_id"], "value", 0.5, 5.0, 1.0)


@query(
    "energy_stats",
    """SELECT user_id, avg(value) AS rms_mean, stddev_pop(value) AS rms_std, CASE WHEN avg(value) > 1e-12 THEN stddev_pop(value) / avg(value) ELSE 0 END AS rms_cv, quantile_cont(value, 0.1) AS rms_q10, quantile_cont(value, 0.5) AS rms_q50, quantile_cont(value, 0.9) AS rms_q90,
      max(abs(value)) / sqrt(avg(value * value)) AS peak_to_rms FROM events GROUP BY user_id""",
    "rms_mean rms_std rms_cv rms_q10 rms_q50 rms_q90 peak_to_rms",
)
def _(t):
    return S.energy_stats(events(t), ["user_id"], "value")


@query(
    "zero_crossing",
    f"""WITH {EVENTS}, s AS (SELECT user_id, day, start, event_id, value < avg(value) OVER (PARTITION BY user_id) AS neg FROM ev), l AS (SELECT *, lag(neg) OVER (PARTITION BY user_id, day ORDER BY start, event_id) AS was FROM s),
      f AS (SELECT user_id, day, coalesce(avg(CASE WHEN was <> neg THEN 1e0 WHEN was IS NOT NULL THEN 0e0 END), 0) AS rate FROM l GROUP BY user_id, day)
      SELECT user_id, count(*) AS frames, avg(rate) AS zcr_mean, stddev_pop(rate) AS zcr_std FROM f GROUP BY user_id""",
    "zcr_mean zcr_std",
)
def _(t):
    return S.zero_crossing(events(t), ["user_id"], "day", "hour", ["start", "event_id"], "value")


@query(
    "sliding_frames",
    f"""WITH {EVENTS}, i AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY start, event_id) - 1 AS r, count(*) OVER (PARTITION BY user_id) AS n FROM ev),
      f AS (SELECT user_id, value, unnest(CASE WHEN n < 25 THEN [0] ELSE list_filter(range(0, (n - 25) // 10 + 1), lambda k: k * 10 <= r AND r < k * 10 + 25) END) AS frame FROM i)
      SELECT user_id, CAST(frame AS BIGINT) AS frame, count(*) AS n, sqrt(avg(value * value)) AS rms FROM f GROUP BY user_id, frame""",
    "rms",
)
def _(t):
    return S.sliding_frames(events(t), ["user_id"], "hour", ["start", "event_id"], "value", 25, 10)


@query(
    "hopping_frames",
    """SELECT user_id, start, count(*) AS n, sqrt(avg(value * value)) AS rms FROM (SELECT user_id, value, unnest(list_transform(range(0, 4), lambda k: time_bucket(INTERVAL '15 minutes', ts) - k * INTERVAL '15 minutes')) AS start FROM events) GROUP BY user_id, start""",
    "rms",
)
def _(t):
    return S.hopping_windows(t.events.withColumn("ts", F.col("ts").cast("timestamp")), ["user_id"], "ts", "value", "1 hour", "15 minutes")


@query(
    "plan_chunks",
    """SELECT doc_id, i AS chunk, CAST(i * 1000 AS BIGINT) AS start, CASE WHEN i = k - 1 THEN n_chars ELSE (i + 1) * 1000 END AS "end"
      FROM (SELECT doc_id, n_chars, k, CAST(unnest(range(0, k)) AS INTEGER) AS i FROM (SELECT doc_id, n_chars, CASE WHEN n_chars > 1000 AND n_chars - ((n_chars + 999) // 1000 - 1) * 1000 < 200 THEN (n_chars + 999) // 1000 - 1 ELSE (n_chars + 999) // 1000 END AS k FROM documents))""",
)
def _(t):
    plan = S.plan_chunks(F.col("n_chars"), 1000, 200)
    return t.documents.select("doc_id", F.posexplode(plan).alias("chunk", "c")).select("doc_id", "chunk", "c.*")


@query(
    "plan_full_windows",
    """SELECT doc_id, i AS "window", CAST(i * 700 AS BIGINT) AS start, least((i + 1) * 700, n_chars) AS "end" FROM (SELECT doc_id, n_chars, CAST(unnest(range(0, greatest(n_chars // 700, 1))) AS INTEGER) AS i FROM documents)""",
)
def _(t):
    plan = S.plan_full_windows(F.col("n_chars"), 700)
    return t.documents.select("doc_id", F.posexplode(plan).alias("window", "c")).select("doc_id", "window", "c.*")


@query(
    "bucket_representatives",
    """WITH b AS (SELECT doc_id, n_chars / 50e0 AS duration, CASE WHEN n_chars / 50e0 > 0 AND n_chars / 50e0 < 20 THEN '<20 seconds' WHEN n_chars / 50e0 BETWEEN 20 AND 40 THEN '20-40 seconds' WHEN n_chars / 50e0 > 40 THEN '>40 seconds' END AS bucket FROM documents)
      SELECT n.bucket, doc_id, duration FROM (VALUES ('<20 seconds'), ('20-40 seconds'), ('>40 seconds')) n(bucket) LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY duration DESC, doc_id) AS r FROM b) b ON b.bucket = n.bucket AND r = 1""",
    "duration",
)
def _(t):
    return S.bucket_representatives(t.documents.select("doc_id", (F.col("n_chars") / 50).alias("duration")), "doc_id", "duration")


@query(
    "fill_representatives",
    """WITH d AS (SELECT doc_id, n_chars + 50e0 AS duration FROM documents), a AS (SELECT doc_id, duration FROM d ORDER BY duration DESC, doc_id LIMIT 1),
      b AS (SELECT d.doc_id, d.duration FROM d, a WHERE d.doc_id <> a.doc_id ORDER BY abs(d.duration - a.duration) DESC, d.doc_id LIMIT 1),
      c AS (SELECT d.doc_id, d.duration FROM d, a, b WHERE d.doc_id NOT IN (a.doc_id, b.doc_id) ORDER BY least(abs(d.duration - a.duration), abs(d.duration - b.duration)) DESC, d.doc_id LIMIT 1)
      SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c""",
    "duration",
)
def _(t):
    return S.fill_representatives(t.documents.select("doc_id", (F.col("n_chars") + 50.0).alias("duration")), "doc_id", "duration")
