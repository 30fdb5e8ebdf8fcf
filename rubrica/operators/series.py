"""Ordered series per key: segments, activity runs, frames and chunk plans.

A key may own a third of all rows, so nothing here orders a whole key in one
window.  Rows are ordered inside (key, time bucket); what has to cross a bucket
border (the row before, a running count) travels through one summary row per
bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tokens as T
from ..functions.numeric import count_where, is_finite, ratio
from ..session import cut_lineage
from .ranking import exact_quantiles

# ---- fixed values ----
FLUENCY = (
    "segment_count", "words_per_segment_mean", "words_per_segment_std", "segment_duration_mean",
    "segment_duration_std", "short_segment_ratio", "recognized_speech_seconds", "speech_coverage_ratio",
    "words_per_recognized_speech_second", "gap_count", "gap_mean", "gap_std", "gap_max", "total_gap_seconds",
    "long_gap_0_5_count", "long_gap_1_0_count", "long_gap_2_0_count", "filler_rate", "immediate_repetition_rate",
)
SHORT_SEGMENT_SECONDS = 2.0
LONG_GAPS = (0.5, 1.0, 2.0)
LONG_PAUSE_SECONDS = 0.5
ACTIVITY_RELATIVE_THRESHOLD = 0.1
MEAN_ROUNDING = 1e-12  # of the mean magnitude: what the order of summation may do to a mean
DURATION_BUCKETS = ("<20 seconds", "20-40 seconds", ">40 seconds")
# ----------------------


def previous_row(
    df: DataFrame, groups: Sequence[str], bucket: str, order: Sequence[str], values: dict[str, Column]
) -> DataFrame:
    """Add the values of the row before in the group, across bucket borders.

    NULL for the first row of a group.
    """
    groups = list(groups)
    packed = df.withColumn("__v", F.struct(*[c.alias(n) for n, c in values.items()]))
    last = packed.groupBy(*groups, bucket).agg(F.max_by("__v", F.struct(*order)).alias("__last"))
    carry = last.withColumn(
        "__carry", F.lag("__last").over(Window.partitionBy(*groups).orderBy(bucket))
    ).drop("__last")
    inside = Window.partitionBy(*groups, bucket).orderBy(*order)
    return (
        packed.withColumn("__lag", F.lag("__v").over(inside))
        .join(carry, [*groups, bucket])
        .withColumn("__prev", F.coalesce("__lag", "__carry"))
        .select(*df.columns, *[F.col(f"__prev.{n}").alias(n) for n in values])
    )


def running_sum(
    df: DataFrame, groups: Sequence[str], bucket: str, order: Sequence[str], value: Column, name: str
) -> DataFrame:
    """Inclusive running sum inside each group, across bucket borders."""
    groups = list(groups)
    valued = df.withColumn("__x", value)
    sums = valued.groupBy(*groups, bucket).agg(F.sum("__x").alias("__s"))
    before = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__before", F.coalesce(F.sum("__s").over(before), F.lit(0))).drop("__s")
    inside = Window.partitionBy(*groups, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        valued.withColumn("__run", F.sum("__x").over(inside))
        .join(sums, [*groups, bucket])
        .withColumn(name, F.col("__run") + F.col("__before"))
        .select(*df.columns, name)
    )


# ---------------------------------------------------------------------------
# Segments
# ---------------------------------------------------------------------------


def segment_fluency(
    df: DataFrame, key: Sequence[str], text: str, duration: str, segments: str, fillers: Sequence[str] = T.SEGMENT_FILLERS
) -> DataFrame:
    """19 timing and lexical features of records that hold their segments in an array."""
    n = F.size("__segs")
    rest = F.greatest(n - 1, F.lit(0))
    work = (
        df.withColumn("__segs", F.col(segments))
        .withColumn("__tokens", T.letter_tokens(text))
        .withColumn("__words", F.transform("__segs", lambda s: F.size(T.letter_tokens(s["text"]))))
        .withColumn("__lens", F.transform("__segs", lambda s: F.greatest(s["end"] - s["start"], F.lit(0.0))))
        .withColumn(
            "__gaps",
            F.zip_with(
                F.slice("__segs", F.lit(1), rest),
                F.slice("__segs", F.lit(2), rest),
                lambda a, b: F.greatest(b["start"] - a["end"], F.lit(0.0)),
            ),
        )
        .withColumn("__speech", T.array_sum(F.col("__lens")))
    )
    gaps, tokens = F.col("__gaps"), F.col("__tokens")
    m = F.size(tokens)

    def at_least(limit: float) -> Column:
        return F.size(F.filter(gaps, lambda g: g >= limit))

    long_gaps = [at_least(limit) for limit in LONG_GAPS]
    values = (
        n, T.array_mean(F.col("__words")), T.array_std(F.col("__words")), T.array_mean(F.col("__lens")),
        T.array_std(F.col("__lens")), ratio(F.size(F.filter("__lens", lambda x: x < SHORT_SEGMENT_SECONDS)), n),
        F.col("__speech"), ratio("__speech", duration), ratio(m, "__speech"), F.size(gaps), T.array_mean(gaps),
        T.array_std(gaps), F.coalesce(F.array_max(gaps), F.lit(0.0)), T.array_sum(gaps), *long_gaps,
        ratio(F.size(F.filter(tokens, lambda w: w.isin(*fillers))), m),
        T.adjacent_repeats(tokens) / F.greatest(m - 1, F.lit(1)),
    )
    return work.select(*key, *[v.cast("double").alias(name) for name, v in zip(FLUENCY, values)])


def segment_fluency_tall(
    df: DataFrame,
    key: Sequence[str],
    bucket: str,
    order: Sequence[str],
    start: str,
    end: str,
    tokens: str,
    fillers: Sequence[str] = T.SEGMENT_FILLERS,
) -> DataFrame:
    """The same 19 features from one row per segment.

    The record text is the concatenation of the segments' tokens and the record
    lasts from the first start to the last end.
    """
    key = list(key)
    linked = previous_row(
        df, key, bucket, order, {"prev_end": F.col(end), "prev_token": F.element_at(F.col(tokens), -1)}
    )
    length = F.greatest(F.col(end) - F.col(start), F.lit(0.0))
    gap = F.when(F.col("prev_end").isNotNull(), F.greatest(F.col(start) - F.col("prev_end"), F.lit(0.0)))
    words = F.size(tokens)
    border = F.coalesce(F.col("prev_token") == F.get(F.col(tokens), F.lit(0)), F.lit(False)).cast("int")
    rows = linked.select(
        *key, start, end, length.alias("len"), gap.alias("gap"), words.alias("words"),
        (T.adjacent_repeats(F.col(tokens)) + border).alias("repeats"),
        F.size(F.filter(tokens, lambda w: w.isin(*fillers))).alias("fillers"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    agg = rows.groupBy(*key).agg(
        F.count("*").alias("segment_count"),
        F.avg("words").alias("words_per_segment_mean"),
        F.stddev_pop("words").alias("words_per_segment_std"),
        F.avg("len").alias("segment_duration_mean"),
        F.stddev_pop("len").alias("segment_duration_std"),
        F.avg(F.when(F.col("len") < SHORT_SEGMENT_SECONDS, 1.0).otherwise(0.0)).alias("short_segment_ratio"),
        F.sum("len").alias("recognized_speech_seconds"),
        (F.max(end) - F.min(start)).alias("__duration"),
        F.sum("words").alias("__words"),
        F.count("gap").alias("gap_count"),
        zero(F.avg("gap")).alias("gap_mean"),
        zero(F.stddev_pop("gap")).alias("gap_std"),
        zero(F.max("gap")).alias("gap_max"),
        zero(F.sum("gap")).alias("total_gap_seconds"),
        *[count_where(F.col("gap") >= g).alias(n) for g, n in zip(LONG_GAPS, FLUENCY[14:17])],
        F.sum("fillers").alias("__fillers"),
        F.sum("repeats").alias("__repeats"),
    )
    full = agg.withColumns(
        {
            "speech_coverage_ratio": ratio("recognized_speech_seconds", "__duration"),
            "words_per_recognized_speech_second": ratio("__words", "recognized_speech_seconds"),
            "filler_rate": ratio("__fillers", "__words"),
            "immediate_repetition_rate": F.col("__repeats") / F.greatest(F.col("__words") - 1, F.lit(1)),
        }
    )
    return full.select(*key, *[F.col(n).cast("double").alias(n) for n in FLUENCY])


def segment_pauses(df: DataFrame, key: Sequence[str], duration: str, segments: str) -> DataFrame:
    """Speech span, words per span second and pauses of at least half a second."""
    n = F.size("__segs")
    rest = F.greatest(n - 1, F.lit(0))
    work = (
        df.withColumn("__segs", F.col(segments))
        .withColumn("__words", F.aggregate("__segs", F.lit(0), lambda acc, s: acc + F.size(T.space_tokens(s["text"]))))
        .withColumn("__span", F.greatest(F.element_at("__segs", -1)["end"] - F.get("__segs", F.lit(0))["start"], F.lit(1e-6)))
        .withColumn(
            "__long",
            F.filter(
                F.zip_with(F.slice("__segs", F.lit(1), rest), F.slice("__segs", F.lit(2), rest), lambda a, b: b["start"] - a["end"]),
                lambda g: g >= LONG_PAUSE_SECONDS,
            ),
        )
    )
    some = n > 0
    return work.select(
        *key,
        F.when(some, F.when(F.col(duration) > 0, F.least("__span", duration)).otherwise(F.col("__span"))).otherwise(0.0).alias("speech_seconds"),
        F.when(some, ratio("__words", "__span")).otherwise(0.0).alias("words_per_second"),
        F.when(some, F.size("__long").cast("double")).otherwise(0.0).alias("long_pauses"),
        F.when(some, T.array_sum(F.col("__long"))).otherwise(0.0).alias("pause_seconds"),
    )


def segment_pauses_tall(
    df: DataFrame, key: Sequence[str], bucket: str, order: Sequence[str], start: str, end: str, words: str
) -> DataFrame:
    key = list(key)
    linked = previous_row(df, key, bucket, order, {"prev_end": F.col(end)})
    gap = F.col(start) - F.col("prev_end")
    long_gap = F.when(gap >= LONG_PAUSE_SECONDS, gap)
    span = F.greatest(F.max_by(end, F.struct(*order)) - F.min_by(start, F.struct(*order)), F.lit(1e-6))
    return (
        linked.groupBy(*key)
        .agg(
            span.alias("speech_seconds"),
            F.sum(words).alias("__w"),
            F.count(long_gap).cast("double").alias("long_pauses"),
            F.coalesce(F.sum(long_gap), F.lit(0.0)).alias("pause_seconds"),
        )
        .select(*key, "speech_seconds", ratio("__w", "speech_seconds").alias("words_per_second"), "long_pauses", "pause_seconds")
    )


# ---------------------------------------------------------------------------
# Series
# ---------------------------------------------------------------------------


def activity_runs(
    df: DataFrame, key: Sequence[str], bucket: str, order: Sequence[str], value: str, step: float, floor: float, minimum_pause: float
) -> DataFrame:
    """Ten statistics of active runs and internal pauses of a series.

    A row is active above max(floor, 0.1 x the series' 90th percentile).  Runs
    come from a running count of state changes; pauses at either end of the
    series and pauses shorter than the minimum do not count.
    """
    key = list(key)
    q90 = cut_lineage(exact_quantiles(df, key, value, {"__q90": 0.9}))
    limit = F.greatest(F.lit(float(floor)), F.col("__q90") * ACTIVITY_RELATIVE_THRESHOLD)
    flagged = df.join(q90, key).select(*key, bucket, *order, (F.col(value) > limit).alias("active"))
    changed = previous_row(flagged, key, bucket, order, {"was": F.col("active")})
    change = F.when(F.col("was").isNull() | (F.col("was") != F.col("active")), 1).otherwise(0)
    runs = cut_lineage(
        running_sum(changed, key, bucket, order, change, "run")
        .groupBy(*key, "run", "active")
        .agg((F.count("*") * F.lit(float(step))).alias("seconds"))
    )
    ends = runs.groupBy(*key).agg(F.max("run").alias("__last"))
    tagged = runs.join(ends, key)
    internal = ~F.col("active") & (F.col("run") > 1) & (F.col("run") < F.col("__last")) & (F.col("seconds") >= minimum_pause)
    tagged = tagged.withColumn("pause", F.when(internal, F.col("seconds"))).withColumn(
        "segment", F.when(F.col("active"), F.col("seconds"))
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    stats = tagged.groupBy(*key).agg(
        F.sum("seconds").alias("__all"),
        zero(F.sum("segment")).alias("__active"),
        F.count("pause").cast("double").alias("pause_count"),
        zero(F.avg("pause")).alias("mean_pause_duration"),
        zero(F.stddev_pop("pause")).alias("std_pause_duration"),
        zero(F.max("pause")).alias("max_pause_duration"),
        zero(F.avg("segment")).alias("mean_active_segment_duration"),
        zero(F.stddev_pop("segment")).alias("std_active_segment_duration"),
    )
    medians = exact_quantiles(tagged.where("pause IS NOT NULL"), key, "pause", {"median_pause_duration": 0.5})
    return stats.join(medians, key, "left").select(
        *key,
        ratio("__active", "__all").alias("active_ratio"),
        ratio(F.col("__all") - F.col("__active"), "__all").alias("silence_ratio"),
        "pause_count",
        ratio("pause_count", "__active").alias("pause_rate_per_active_second"),
        "mean_pause_duration",
        zero(F.col("median_pause_duration")).alias("median_pause_duration"),
        "std_pause_duration",
        "max_pause_duration",
        "mean_active_segment_duration",
        "std_active_segment_duration",
    )


def energy_stats(df: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Mean, spread, quantiles and peak-to-RMS of a series; zero-safe."""
    key = list(key)
    base = df.groupBy(*key).agg(
        F.avg(value).alias("rms_mean"),
        F.stddev_pop(value).alias("rms_std"),
        F.max(F.abs(F.col(value))).alias("__peak"),
        F.sqrt(F.avg(F.col(value) * F.col(value))).alias("__rms"),
    )
    q = exact_quantiles(df, key, value, {"rms_q10": 0.1, "rms_q50": 0.5, "rms_q90": 0.9})
    tiny = 1e-12
    return base.join(q, key).select(
        *key, "rms_mean", "rms_std",
        F.when(F.col("rms_mean") > tiny, F.try_divide("rms_std", "rms_mean")).otherwise(0.0).alias("rms_cv"),
        "rms_q10", "rms_q50", "rms_q90",
        F.when(F.col("__rms") > tiny, F.try_divide("__peak", "__rms")).otherwise(0.0).alias("peak_to_rms"),
    )


def zero_crossing(
    df: DataFrame, key: Sequence[str], frame: str, bucket: str, order: Sequence[str], value: str
) -> DataFrame:
    """Share of sign changes of the centred series inside frames: mean and spread.

    A row that equals the mean is not negative.  The order of summation moves a mean by its last
    digits, so a row within ``MEAN_ROUNDING`` of it counts as equal; otherwise such a row would
    change its sign with the partitioning.
    """
    key = list(key)
    size = F.avg(F.abs(F.col(value)))
    centre = df.groupBy(*key).agg(F.avg(value).alias("__centre"), F.when(is_finite(size), size * MEAN_ROUNDING).otherwise(0.0).alias("__slack"))
    below = (F.col(value) < F.col("__centre")) & (F.col("__centre") - F.col(value) > F.col("__slack"))
    signed = df.join(centre, key).select(*key, frame, bucket, *order, below.alias("negative"))
    linked = previous_row(signed, [*key, frame], bucket, order, {"was": F.col("negative")})
    crossed = F.when(F.col("was") != F.col("negative"), 1.0).when(F.col("was").isNotNull(), 0.0)
    per_frame = linked.groupBy(*key, frame).agg(F.coalesce(F.avg(crossed), F.lit(0.0)).alias("rate"))
    return per_frame.groupBy(*key).agg(
        F.count("*").alias("frames"), F.avg("rate").alias("zcr_mean"), F.stddev_pop("rate").alias("zcr_std")
    )


def sliding_frames(
    df: DataFrame, key: Sequence[str], bucket: str, order: Sequence[str], value: str, length: int, hop: int
) -> DataFrame:
    """RMS of complete frames of ``length`` rows every ``hop`` rows.

    A series shorter than one frame gives one short frame.  Each row is sent to
    the few frames that hold it, so no range join is needed.
    """
    key = list(key)
    indexed = running_sum(df, key, bucket, order, F.lit(1), "__row").withColumn("__row", F.col("__row") - 1)
    sizes = df.groupBy(*key).agg(F.count("*").alias("__n"))
    first = F.greatest(F.ceil((F.col("__row") - (length - 1)) / F.lit(float(hop))), F.lit(0))
    last = F.least(F.floor(F.col("__row") / F.lit(float(hop))), F.floor((F.col("__n") - length) / F.lit(float(hop))))
    frames = F.when(F.col("__n") < length, F.array(F.lit(0).cast("bigint"))).when(
        last >= first, F.sequence(first.cast("bigint"), last.cast("bigint"))
    )
    return (
        indexed.join(sizes, key)
        .select(*key, value, F.explode(frames).alias("frame"))
        .groupBy(*key, "frame")
        .agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"))
    )


def hopping_windows(df: DataFrame, key: Sequence[str], ts: str, value: str, duration: str, slide: str) -> DataFrame:
    """RMS per key and hopping event-time window."""
    return (
        df.groupBy(*key, F.window(ts, duration, slide).alias("w"))
        .agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"))
        .select(*key, F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "rms")
    )


# ---------------------------------------------------------------------------
# Plans over a length
# ---------------------------------------------------------------------------


def plan_chunks(length: Column, chunk: int, min_tail: int) -> Column:
    """Consecutive chunks that cover a length; a short tail joins its neighbour."""
    full = F.ceil(length / F.lit(float(chunk))).cast("bigint")
    tail = length - (full - 1) * chunk
    count = F.when((full > 1) & (tail < min_tail), full - 1).otherwise(full)
    return F.transform(
        F.sequence(F.lit(0).cast("bigint"), count - 1),
        lambda i: F.struct(
            (i * chunk).alias("start"), F.when(i == count - 1, length).otherwise((i + 1) * chunk).alias("end")
        ),
    )


def plan_full_windows(length: Column, window: int) -> Column:
    """Full windows only; a length below one window gives one short window."""
    count = F.greatest(F.floor(length / F.lit(float(window))).cast("bigint"), F.lit(1).cast("bigint"))
    return F.transform(
        F.sequence(F.lit(0).cast("bigint"), count - 1),
        lambda i: F.struct((i * window).alias("start"), F.least((i + 1) * window, length).alias("end")),
    )


def duration_bucket(duration: Column) -> Column:
    return (
        F.when((duration > 0) & (duration < 20), DURATION_BUCKETS[0])
        .when(duration.between(20, 40), DURATION_BUCKETS[1])
        .when(duration > 40, DURATION_BUCKETS[2])
    )


def bucket_representatives(df: DataFrame, key: str, duration: str) -> DataFrame:
    """Longest row of each duration bucket; missing buckets keep a NULL row."""
    best = (
        df.withColumn("bucket", duration_bucket(F.col(duration)))
        .where("bucket IS NOT NULL")
        .groupBy("bucket")
        .agg(F.min_by(F.struct(key, duration), F.struct(-F.col(duration), F.col(key))).alias("r"))
        .select("bucket", f"r.{key}", f"r.{duration}")
    )
    buckets = df.sparkSession.createDataFrame([(b,) for b in DURATION_BUCKETS], "bucket string")
    return buckets.join(best, "bucket", "left")


def fill_representatives(df: DataFrame, key: str, duration: str, wanted: int = 3) -> DataFrame:
    """Representatives topped up to ``wanted`` by the rows farthest from those chosen.

    Only the chosen rows (at most ``wanted``) pass through the driver.
    """
    chosen = [
        (r[key], r[duration]) for r in bucket_representatives(df, key, duration).where(F.col(key).isNotNull()).collect()
    ]
    while len(chosen) < wanted:
        gaps = [F.abs(F.col(duration) - F.lit(d)) for _, d in chosen]
        distance = F.least(*gaps) if len(gaps) > 1 else (gaps[0] if gaps else F.col(duration))
        rest = df.where(~F.col(key).isin([k for k, _ in chosen])) if chosen else df
        row = rest.agg(F.min_by(F.struct(key, duration), F.struct(-distance, F.col(key))).alias("r")).first()
        if row["r"] is None:
            break
        chosen.append((row["r"][key], row["r"][duration]))
    schema = df.select(key, duration).schema
    return df.sparkSession.createDataFrame(chosen, schema)
