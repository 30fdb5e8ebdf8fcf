"""Transcript records: reading JSON lines with a quarantine, building records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEGMENT = T.StructType(
    [
        T.StructField("start", T.DoubleType()),
        T.StructField("end", T.DoubleType()),
        T.StructField("text", T.StringType()),
    ]
)
REQUIRED = ("split", "filename", "text", "language", "duration_seconds", "segments")
IDENTITY = ("split", "filename")
NUMBER_TYPE = r"^(BIGINT|DOUBLE|DECIMAL.*)$"


def _field(name: str) -> Column:
    return F.expr(f"try_variant_get(v, '$.{name}', 'variant')")


def _kind(name: str) -> Column:
    return F.schema_of_variant(_field(name))


def read_transcripts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Good records and quarantined lines ``(rule, line, file)``.

    Lines are parsed once into a variant, so field presence and JSON types are
    checked strictly (a number is not a text, a boolean is not a number).  The
    raw line stays in ``record`` and keeps any extra fields.  A repeated
    identity quarantines all its lines; repeats are found by counting.
    """
    lines = (
        spark.read.text(path)
        .where(F.col("value").rlike(r"(?U)\S"))
        .select(F.col("value").alias("record"), F.input_file_name().alias("file"), F.expr("try_parse_json(value)").alias("v"))
    )
    is_object = F.schema_of_variant("v").startswith("OBJECT")
    missing = F.lit(False)
    for name in REQUIRED:
        missing = missing | _field(name).isNull()
    blank = F.lit(False)
    for name in IDENTITY:
        text = F.expr(f"try_variant_get(v, '$.{name}', 'string')")
        blank = blank | (_kind(name) != "STRING") | ~text.rlike(r"(?U)\S")
    duration = F.expr("try_variant_get(v, '$.duration_seconds', 'double')")
    bad_duration = (
        ~_kind("duration_seconds").rlike(NUMBER_TYPE)
        | duration.isNull()
        | F.isnan(duration)
        | (duration < 0)
        | (duration == F.lit(float("inf")))
    )
    rule = (
        F.when(F.col("v").isNull(), "malformed")
        .when(~is_object, "not_an_object")
        .when(missing, "missing_field")
        .when(blank, "bad_identity")
        .when(_kind("text") != "STRING", "text_not_string")
        .when(bad_duration, "bad_duration")
        .when(~_kind("segments").startswith("ARRAY"), "segments_not_list")
    )
    checked = lines.withColumn("rule", rule).withColumns(
        {name: F.expr(f"try_variant_get(v, '$.{name}', 'string')") for name in IDENTITY}
    )
    repeated = (
        checked.where("rule IS NULL").groupBy(*IDENTITY).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    ).withColumn("__repeated", F.lit(True))
    flagged = checked.join(repeated, list(IDENTITY), "left").withColumn(
        "rule", F.coalesce("rule", F.when(F.col("__repeated"), "duplicate_identity"))
    )
    good = flagged.where("rule IS NULL").select(
        *IDENTITY,
        F.expr("try_variant_get(v, '$.text', 'string')").alias("text"),
        F.expr("try_variant_get(v, '$.language', 'string')").alias("language"),
        duration.alias("duration_seconds"),
        F.expr("try_variant_get(v, '$.segments', 'array<struct<start:double,end:double,text:string>>')").alias("segments"),
        "record",
    )
    quarantine = flagged.where("rule IS NOT NULL").select("rule", F.col("record").alias("line"), "file")
    return good, quarantine


def normalized_text(text: Column | str) -> Column:
    """Lower case with every whitespace run collapsed to one blank."""
    text = F.col(text) if isinstance(text, str) else text
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def transcript_record(split: Column, filename: Column, text: Column, duration: Column, language: str = "en") -> Column:
    """A record without timing, in the shape ``read_transcripts`` accepts."""
    return F.struct(
        split.alias("split"),
        filename.alias("filename"),
        normalized_text(text).alias("text"),
        F.lit(language).alias("language"),
        duration.cast("double").alias("duration_seconds"),
        F.array().cast(T.ArrayType(SEGMENT)).alias("segments"),
    )
