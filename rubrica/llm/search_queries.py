"""Queries of vector codes, ranked search and fingerprints, with the SQL for their rows where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, ranked_search, vector_codes
from .base import query, table

VECTORS = """
e AS (SELECT vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS r,
  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM e),
p AS (SELECT r, part, q[part * (len(q) // 16) + 1 : (part + 1) * (len(q) // 16)] AS x FROM v, range(16) AS t(part)),
c0 AS (SELECT part, r AS entry, x AS c FROM p WHERE r < 64)"""


def sql_assigned(n: int) -> str:
    return f"""a{n} AS MATERIALIZED (SELECT r, part, min(CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) * 64 + entry) AS m
  FROM p JOIN c{n} USING (part) GROUP BY r, part)"""


def sql_round(n: int) -> str:
    return f"""{sql_assigned(n)},
s{n} AS (SELECT part, m % 64 AS entry, i, CAST(floor(CAST(sum(x[i]) AS DOUBLE) / count(*)) AS BIGINT) AS y
  FROM (SELECT part, m, x, unnest(range(1, len(x) + 1)) AS i FROM a{n} JOIN p USING (r, part)) GROUP BY ALL),
n{n} AS (SELECT part, entry, list(y ORDER BY i) AS y FROM s{n} GROUP BY part, entry),
c{n + 1} AS MATERIALIZED (SELECT part, entry, coalesce(y, c) AS c FROM c{n} LEFT JOIN n{n} USING (part, entry))"""


@query(
    "op11_vector_codes",
    f"""
WITH {VECTORS}, {sql_round(0)}, {sql_round(1)}, {sql_assigned(2)},
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c2),
g AS (SELECT r, string_agg(format('{{:02x}}', m % 64), '' ORDER BY part) AS code, CAST(sum(m // 64) AS BIGINT) AS error FROM a2 GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN g USING (r), h""",
)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    rows, books = vector_codes.compress(table(spark, folder, "embeddings"))
    return rows.select(F.col("key").alias("vec_id"), "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query(
    "op12_ranked_search",
    f"""
WITH d AS (SELECT doc_id, coalesce({WORDS}, []) AS w FROM documents),
s AS (SELECT CAST(sum(len(w)) AS BIGINT) AS l, count(*) FILTER (len(w) > 0) AS n FROM d),
t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(coalesce({WORDS}, [])) AS term FROM benchmark) GROUP BY ALL),
m AS (SELECT doc_id, 25 + (75 * CAST(len(w) AS BIGINT) * n) // l AS m FROM d, s),
scored AS (SELECT item_id, doc_id,
  CAST(sum(times * CAST(floor(1000 * ln((2 * n + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN f USING (term) JOIN t USING (term) JOIN m USING (doc_id), s GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10""",
)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op13_fingerprints")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.against_next(table(spark, folder, "documents").select("doc_id", "text")).withColumnRenamed("doc", "doc_id")
