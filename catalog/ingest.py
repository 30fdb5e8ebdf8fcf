"""Sources, sinks and ingest: each query writes below the shared folder and reads back."""

from __future__ import annotations

from pyspark.sql import functions as F

from rubrica.operators import alignment as A
from rubrica.session import scratch_path
from rubrica.sources import tables as S
from rubrica.sources import transcripts as T

from .base import SCORED, query, scored, sql_fold
from .metrics import runs


@query(
    "read_labeled_csv",
    "SELECT CAST(o_orderkey AS VARCHAR) AS filename, o_totalprice AS label, o_orderpriority AS priority FROM orders",
    "label",
)
def _(t):
    path = scratch_path(t.spark, "labels-csv")
    rows = t.orders.select(
        F.col("o_orderkey").cast("string").alias("filename"), F.col("o_totalprice").alias("label"), F.col("o_orderpriority").alias("priority")
    )
    S.guarded_write(rows, path, "csv", header=True)
    return S.read_labeled_csv(t.spark, path, "filename string, label double, priority string")


def transcript_lines(t):
    k = F.col("doc_id")

    def record(text):
        return F.to_json(
            F.struct(
                F.lit("train").alias("split"),
                F.when(k % 41 == 0, " ").when(k % 43 == 0, "same.wav").otherwise(F.concat(k.cast("string"), F.lit(".wav"))).alias("filename"),
                text.alias("text"),
                F.col("lang").alias("language"),
                F.when(k % 47 == 0, -1.0).otherwise(F.col("n_chars") / 10.0).alias("duration_seconds"),
                F.array(F.struct(F.lit(0.0).alias("start"), F.lit(1.5).alias("end"), F.col("source").alias("text"))).alias("segments"),
                F.col("source").alias("extra"),
            )
        )

    line = (
        F.when(k % 29 == 0, F.lit('{"split": "train", '))
        .when(k % 31 == 0, F.lit("[1, 2]"))
        .when(k % 37 == 0, F.lit('{"split": "train", "filename": "x.wav", "text": "hi"}'))
        .when(k % 53 == 0, record(F.lit(5)))
        .when(k % 59 == 0, F.lit("   "))
        .otherwise(record(F.col("text")))
    )
    return t.documents.select(line.alias("value"))


PLANTED_RULE = """CASE WHEN doc_id % 29 = 0 THEN 'malformed' WHEN doc_id % 31 = 0 THEN 'not_an_object' WHEN doc_id % 37 = 0 THEN 'missing_field'
  WHEN doc_id % 53 = 0 THEN CASE WHEN doc_id % 41 = 0 THEN 'bad_identity' ELSE 'text_not_string' END WHEN doc_id % 59 = 0 THEN 'blank_line'
  WHEN doc_id % 41 = 0 THEN 'bad_identity' WHEN doc_id % 47 = 0 THEN 'bad_duration' WHEN doc_id % 43 = 0 THEN 'duplicate_identity' ELSE 'good' END"""


@query(
    "read_transcripts_jsonl",
    f"SELECT rule, count(*) AS n, CAST(coalesce(sum(CASE WHEN rule = 'good' THEN length(text) END), 0) AS BIGINT) AS chars, coalesce(sum(CASE WHEN rule = 'good' THEN n_chars / 10e0 END), 0) AS seconds FROM (SELECT *, {PLANTED_RULE} AS rule FROM documents) WHERE rule <> 'blank_line' GROUP BY rule",
    "seconds",
)
def _(t):
    path = scratch_path(t.spark, "transcripts")
    transcript_lines(t).write.text(path)
    good, quarantine = T.read_transcripts(t.spark, path)
    kept = good.agg(
        F.lit("good").alias("rule"),
        F.count("*").alias("n"),
        F.sum(F.length("text")).cast("bigint").alias("chars"),
        F.sum("duration_seconds").alias("seconds"),
    )
    bad = quarantine.groupBy("rule").agg(
        F.count("*").alias("n"), F.lit(0).cast("bigint").alias("chars"), F.lit(0.0).alias("seconds")
    )
    return kept.unionByName(bad)


@query(
    "guarded_write",
    "SELECT c_mktsegment, count(*) AS n, sum(c_acctbal) AS balance, true AS refused FROM customer GROUP BY c_mktsegment",
    "balance",
    digits=4,
)
def _(t):
    path = scratch_path(t.spark, "customer")
    S.guarded_write(t.customer, path)
    refused = False
    try:
        S.guarded_write(t.customer, path)
    except Exception:  # noqa: BLE001
        refused = True
    S.guarded_write(t.customer, path, overwrite=True)
    return t.spark.read.parquet(path).groupBy("c_mktsegment").agg(
        F.count("*").alias("n"), F.sum("c_acctbal").alias("balance"), F.lit(refused).alias("refused")
    )


@query(
    "embedding_artifact",
    """SELECT label, count(*) AS n, sum(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS squared_norm, CAST(64 AS INTEGER) AS dimension FROM embeddings GROUP BY label""",
    "squared_norm",
)
def _(t):
    path = scratch_path(t.spark, "embeddings")
    S.save_embeddings(t.embeddings.withColumn("split", F.lit("train")), path, ["split", "vec_id"], "embedding", 64)
    loaded = S.load_embeddings(t.spark, path, ["split", "vec_id"])
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return loaded.join(t.embeddings.select("vec_id", "label"), "vec_id").groupBy("label").agg(
        F.count("*").alias("n"), F.sum(norm).alias("squared_norm"), F.max(F.size("embedding")).alias("dimension")
    )


@query(
    "embedding_violations",
    """SELECT rule, CAST(vec_id AS VARCHAR) AS key, CAST(NULL AS VARCHAR) AS detail FROM (SELECT vec_id, CASE WHEN vec_id % 50 = 7 THEN 'dimension' WHEN vec_id % 50 = 8 THEN 'not_finite' WHEN vec_id % 50 = 9 THEN 'zero_length' END AS rule FROM embeddings) WHERE rule IS NOT NULL
      UNION ALL SELECT 'duplicate', CAST(vec_id - 1 AS VARCHAR), '2' FROM embeddings WHERE vec_id % 50 = 11""",
)
def _(t):
    k, v = F.col("vec_id"), F.col("embedding")
    planted = t.embeddings.select(
        F.when(k % 50 == 11, k - 1).otherwise(k).alias("vec_id"),
        F.when(k % 50 == 7, F.slice(v, 1, 63))
        .when(k % 50 == 8, F.transform(v, lambda x: F.lit(float("nan")).cast("float")))
        .when(k % 50 == 9, F.transform(v, lambda x: F.lit(0.0).cast("float")))
        .otherwise(v)
        .alias("embedding"),
    )
    return S.embedding_violations(planted, ["vec_id"], "embedding", 64)


@query(
    "resume_append",
    """SELECT event_type, count(*) AS n, sum(value) AS total, (SELECT count(*) FROM events WHERE event_type IN ('click', 'view')) AS processed,
      (SELECT count(*) FROM events WHERE event_type NOT IN ('click', 'view')) AS skipped, true AS refused FROM events GROUP BY event_type""",
    "total",
    digits=4,
)
def _(t):
    sink = scratch_path(t.spark, "resume")
    source = t.events.select("event_id", "event_type", "value")
    keep = lambda df: df
    S.resume_append(source.where("event_type NOT IN ('click', 'view')"), sink, ["event_id"], keep, {"model": "a"})
    counts = S.resume_append(source, sink, ["event_id"], keep, {"model": "a"})
    refused = False
    try:
        S.resume_append(source, sink, ["event_id"], keep, {"model": "b"})
    except ValueError:
        refused = True
    out = t.spark.read.parquet(f"{sink}/data")
    return (
        out.groupBy("event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .crossJoin(F.broadcast(counts))
        .withColumn("refused", F.lit(refused))
    )


@query(
    "transcript_record",
    r"""SELECT doc_id, 'train' AS split, doc_id || '.wav' AS filename, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS text, 'en' AS language, n_chars / 10e0 AS duration_seconds, CAST(0 AS INTEGER) AS segments FROM documents""",
    "duration_seconds",
)
def _(t):
    record = T.transcript_record(
        F.lit("train"), F.concat(F.col("doc_id").cast("string"), F.lit(".wav")), F.col("text"), F.col("n_chars") / 10
    )
    return t.documents.select("doc_id", record.alias("r")).select("doc_id", "r.*").withColumn("segments", F.size("segments"))


@query(
    "json_report_sink",
    """SELECT 'Brand#' || b AS brand, '{"count":"' || n || '.0","ratio":' || CASE WHEN b % 3 = 0 THEN 'null' WHEN b % 3 = 1 THEN '"Infinity"' ELSE '"-Infinity"' END || '}' AS report
      FROM (SELECT CAST(substr(p_brand, 7) AS INTEGER) AS b, count(*) AS n FROM part GROUP BY p_brand)""",
)
def _(t):
    b = F.substring("brand", 7, 3).cast("int")
    per_brand = t.part.groupBy(F.col("p_brand").alias("brand")).agg(F.count("*").cast("double").alias("count"))
    ratio = F.when(b % 3 == 0, float("nan")).when(b % 3 == 1, float("inf")).otherwise(float("-inf"))
    reports = S.json_reports(per_brand.withColumn("ratio", ratio), "brand", ["ratio", "count"])
    path = scratch_path(t.spark, "reports")
    S.guarded_write(reports, path, "json")
    return t.spark.read.schema(reports.schema).json(path)


@query(
    "table_fingerprint",
    "SELECT count(*) AS n, sum(CAST('0x' || substr(h, 1, 16) AS UBIGINT)) || '-' || sum(CAST('0x' || substr(h, 17, 16) AS UBIGINT)) AS fingerprint FROM (SELECT md5(coalesce(length(CAST(o_orderkey AS VARCHAR)) || ':' || o_orderkey, 'N') || '|' || coalesce(length(CAST(o_custkey AS VARCHAR)) || ':' || o_custkey, 'N') || '|' || coalesce(length(CAST(o_orderstatus AS VARCHAR)) || ':' || o_orderstatus, 'N') || '|' || coalesce(length(CAST(o_orderpriority AS VARCHAR)) || ':' || o_orderpriority, 'N')) AS h FROM orders)",
)
def _(t):
    return S.table_fingerprint(t.orders, ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])


@query(
    "run_set_load",
    f"""WITH {SCORED} SELECT key, label, fold, text AS "text-a", CASE WHEN size <> 3 THEN text * 0.9e0 + 0.2e0 END AS "text-b", audio AS "audio-a", size <> 3 AS agrees FROM scored""",
    'label "text-a" "text-b" "audio-a"',
    digits=9,
)
def _(t):
    path = scratch_path(t.spark, "runs")
    rows = runs(t).drop("family").join(scored(t).select("key", "size"), "key")
    rows.where("NOT (run = 'text-b' AND size = 3)").drop("size").write.partitionBy("run").parquet(path)
    loaded = t.spark.read.parquet(path)
    return A.run_set(loaded, ["text-a", "text-b", "audio-a"])


@query(
    "multi_text_assemble",
    f"""SELECT d.doc_id, l.quality, {sql_fold('d.doc_id')} AS fold, length(d.text) AS primary_chars, length(b.text) AS other_chars
      FROM labels l JOIN documents d ON d.doc_id = l.doc_id LEFT JOIN benchmark b ON b.item_id = d.doc_id WHERE l.quality > 0""",
)
def _(t):
    from .base import fold_of

    folds = t.documents.select("doc_id", fold_of("doc_id").alias("fold"))
    primary = t.documents.select("doc_id", F.length("text").cast("bigint").alias("primary_chars"))
    other = t.benchmark.select(F.col("item_id").alias("doc_id"), F.length("text").cast("bigint").alias("other_chars"))
    rows = A.assemble_texts(t.labels, folds, primary, other, "doc_id", F.col("quality") > 0)
    return rows.select("doc_id", "quality", "fold", "primary_chars", "other_chars")


@query(
    "format_inventory",
    """SELECT split, count(*) AS rows, count(*) FILTER (WHERE NOT bad) AS readable, count(*) FILTER (WHERE bad) AS failed, min(d) FILTER (WHERE NOT bad) AS min, max(d) FILTER (WHERE NOT bad) AS max,
      avg(d) FILTER (WHERE NOT bad) AS mean, stddev_pop(d) FILTER (WHERE NOT bad) AS std, sum(d) FILTER (WHERE NOT bad) AS total, count(*) FILTER (WHERE NOT bad AND d < 30) AS short,
      count(*) FILTER (WHERE NOT bad AND d > 90) AS long, quantile_cont(d, 0.5) FILTER (WHERE NOT bad) AS median
      FROM (SELECT CASE WHEN doc_id % 4 = 0 THEN 'test' ELSE 'train' END AS split, n_chars / 20e0 AS d, source = 'src1' AS bad FROM documents) GROUP BY split""",
    "min max mean std total median",
)
def _(t):
    rows = inventory_rows(t)
    return S.format_inventory(rows, "split", "d", F.col("source") == "src1", 30, 90)


def inventory_rows(t):
    return t.documents.select(
        "doc_id", F.when(F.col("doc_id") % 4 == 0, "test").otherwise("train").alias("split"), (F.col("n_chars") / 20).alias("d"), "source", "lang"
    )


@query(
    "format_values",
    """SELECT CASE WHEN doc_id % 4 = 0 THEN 'test' ELSE 'train' END AS split, 'lang' AS column, lang AS value, count(*) AS n FROM documents GROUP BY ALL
      UNION ALL SELECT CASE WHEN doc_id % 4 = 0 THEN 'test' ELSE 'train' END, 'source', source, count(*) FROM documents GROUP BY ALL""",
)
def _(t):
    return S.format_values(inventory_rows(t), "split", ["lang", "source"])


@query(
    "extreme_durations",
    """SELECT CASE WHEN doc_id % 4 = 0 THEN 'test' ELSE 'train' END AS split, doc_id, n_chars / 20e0 AS d, CASE WHEN n_chars / 20e0 < 30 THEN 'short' ELSE 'long' END AS kind FROM documents WHERE n_chars / 20e0 < 30 OR n_chars / 20e0 > 90""",
    "d",
)
def _(t):
    return S.extreme_durations(inventory_rows(t), "split", "doc_id", "d", 30, 90)
