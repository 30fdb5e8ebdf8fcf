"""Typed tables, guarded writes, resumable appends, fingerprints and reports."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import count_where, is_finite, report_number


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give a scan of few splits one partition per core before heavy row work.

    A large table already has far more splits than cores and is left alone, so
    this adds a shuffle only where the input is a handful of small files.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def read_labeled_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Typed CSV.  Every file's header must equal the schema's names in order and
    case, and a cell that does not fit its type fails the read, also where the
    column is not asked for."""
    names = (T._parse_datatype_string(schema) if isinstance(schema, str) else schema).fieldNames()
    raw = spark.read.schema(", ".join(f"`{n}` string" for n in names)).csv(path)
    # Files whose first line differs in case only pass the reader's own check.
    alike = F.lit(True)
    for n in names:
        alike = alike & (F.lower(F.trim(F.col(f"`{n}`"))) == n.lower())
    exact = F.struct(*[F.col(f"`{n}`") for n in names]) == F.struct(*[F.lit(n) for n in names])
    if not raw.where(alike & ~exact).limit(1).isEmpty():
        raise ValueError(f"A header differs from {names}")
    typed = (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .csv(path)
    )
    # True for every row, but it needs every cell, so none is left unparsed.
    return typed.where(F.xxhash64(*[F.col(f"`{n}`") for n in names]) >= F.lit(-(2**63)))


def guarded_write(df: DataFrame, path: str, fmt: str = "parquet", overwrite: bool = False, **options) -> None:
    """Write unless the target exists; overwriting has to be asked for."""
    df.write.mode("overwrite" if overwrite else "errorifexists").options(**options).format(fmt).save(path)


def embedding_violations(df: DataFrame, key: Sequence[str], vector: str, dimension: int) -> DataFrame:
    """Wrong dimension, non-finite entries, zero length; repeated identities."""
    from ..operators.quality import duplicate_keys, row_violations

    v = F.col(vector)
    length = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    whole = F.concat_ws("|", *[F.col(k).cast("string") for k in key])
    rows = row_violations(
        df,
        whole,
        {
            "dimension": F.coalesce(F.size(v), F.lit(-1)) != dimension,
            "not_finite": ~F.forall(v, lambda x: F.coalesce(is_finite(x), F.lit(False))),
            "zero_length": length == 0,
        },
    )
    repeated = duplicate_keys(df, key).select(
        "rule", F.concat_ws("|", *[F.col(k).cast("string") for k in key]).alias("key"), F.col("copies").cast("string").alias("detail")
    )
    return rows.unionByName(repeated)


def save_embeddings(df: DataFrame, path: str, key: Sequence[str], vector: str, dimension: int, overwrite: bool = False) -> None:
    """Check, then store identities with float32 vectors."""
    from ..operators.quality import enforce

    enforce(embedding_violations(df, key, vector, dimension), "embedding set")
    guarded_write(df.select(*key, F.col(vector).cast("array<float>").alias(vector)), path, overwrite=overwrite)


def load_embeddings(spark: SparkSession, path: str, key: Sequence[str], vector: str = "embedding") -> DataFrame:
    fields = [T.StructField(k, spark.read.parquet(path).schema[k].dataType) for k in key]
    schema = T.StructType([*fields, T.StructField(vector, T.ArrayType(T.FloatType()))])
    return spark.read.schema(schema).parquet(path)


def table_fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Order-free content hash: row count and the sums of both halves of the rows' hashes.

    Every field is written with its length, and NULL as ``N``, so rows that
    differ in any field differ in what is hashed.  The sums are decimals and
    cannot overflow.
    """
    field = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("N"))
    digest = F.md5(F.concat_ws("|", *[field(F.col(c).cast("string")) for c in columns]))
    half = lambda at: F.sum(F.conv(F.substring(digest, at, 16), 16, 10).cast("decimal(20,0)"))
    total = F.concat_ws("-", half(1).cast("string"), half(17).cast("string"))
    return df.agg(F.count("*").alias("n"), total.alias("fingerprint"))


def _existing(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def pending(source: DataFrame, done: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key is not in the output yet."""
    return source.join(done.select(*key).distinct(), list(key), "left_anti")


def resume_append(
    source: DataFrame,
    sink: str,
    key: Sequence[str],
    process: Callable[[DataFrame], DataFrame],
    settings: dict,
) -> DataFrame:
    """Process only keys that are not in the sink, append, and report the counts.

    Settings are kept beside the sink; a rerun with other settings is refused.
    """
    spark = source.sparkSession
    stamp = json.dumps(settings, sort_keys=True)
    sidecar, data = f"{sink}/settings", f"{sink}/data"
    if _existing(spark, sidecar):
        if spark.read.text(sidecar).first()[0] != stamp:
            raise ValueError("Settings changed since the output was started")
    else:
        spark.createDataFrame([(stamp,)], "value string").coalesce(1).write.text(sidecar)
    before = 0
    todo = source
    if _existing(spark, data):
        done = spark.read.parquet(data)
        before = done.count()
        todo = pending(source, done, key)
    process(todo).write.mode("append").parquet(data)
    after = spark.read.parquet(data).count()
    counts = source.agg(F.count("*").alias("total"))
    return counts.select(
        F.lit(after - before).cast("bigint").alias("processed"),
        (F.col("total") - (after - before)).cast("bigint").alias("skipped"),
    )


def json_reports(df: DataFrame, key: str, numbers: Sequence[str]) -> DataFrame:
    """One JSON object per row: sorted names, NaN as null, infinities as words."""
    fields = [report_number(c).alias(c) for c in sorted(numbers)]
    return df.select(
        F.col(key), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("report")
    )


def format_inventory(df: DataFrame, split: str, duration: str, failed: Column, low: float, high: float) -> DataFrame:
    """Counts and duration statistics per split; the median is exact."""
    from ..operators.ranking import exact_quantiles

    read = df.where(~failed)
    d = F.col(duration)
    base = df.groupBy(split).agg(
        F.count("*").alias("rows"), count_where(~failed).alias("readable"), count_where(failed).alias("failed")
    )
    stats = read.groupBy(split).agg(
        F.min(d).alias("min"),
        F.max(d).alias("max"),
        F.avg(d).alias("mean"),
        F.stddev_pop(d).alias("std"),
        F.sum(d).alias("total"),
        count_where(d < low).alias("short"),
        count_where(d > high).alias("long"),
    )
    median = exact_quantiles(read, [split], duration, {"median": 0.5})
    return base.join(stats, split, "left").join(median, split, "left")


def format_values(df: DataFrame, split: str, columns: Sequence[str]) -> DataFrame:
    """Value counts of format columns, tall."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    )
    return df.select(split, pairs.alias("p")).select(split, "p.*").groupBy(split, "column", "value").agg(F.count("*").alias("n"))


def extreme_durations(df: DataFrame, split: str, name: str, duration: str, low: float, high: float) -> DataFrame:
    """Rows that are very short or very long, ordered by duration and name."""
    kind = F.when(F.col(duration) < low, "short").when(F.col(duration) > high, "long")
    return df.withColumn("kind", kind).where("kind IS NOT NULL").select(split, name, duration, "kind").orderBy(duration, name)
