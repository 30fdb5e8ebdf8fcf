"""Data-quality gates and keyed alignment on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rubrica.operators import alignment as A
from rubrica.operators import quality as Q

from .base import SCORED, query, scored


def planted_names(t):
    k = F.col("c_custkey")
    return t.customer.select(
        F.when(k % 97 == 0, F.lit(None).cast("string"))
        .when(k % 89 == 0, "  ")
        .when(k % 83 == 0, F.concat(F.lit("dir/"), F.col("c_name")))
        .when(k % 79 == 0, "..")
        .when(k % 10 == 0, F.concat(F.lit("clip"), (k % 70).cast("string")))
        .otherwise(F.col("c_name"))
        .alias("name")
    )


PLANTED = """planted AS (SELECT CASE WHEN c_custkey % 97 = 0 THEN NULL WHEN c_custkey % 89 = 0 THEN '  ' WHEN c_custkey % 83 = 0 THEN 'dir/' || c_name
   WHEN c_custkey % 79 = 0 THEN '..' WHEN c_custkey % 10 = 0 THEN 'clip' || CAST(c_custkey % 70 AS VARCHAR) ELSE c_name END AS name FROM customer)"""


@query(
    "key_check",
    f"""WITH {PLANTED} SELECT 'missing:name' AS rule, '' AS key, CAST(NULL AS VARCHAR) AS detail FROM planted WHERE name IS NULL
      UNION ALL SELECT 'blank:name', name, NULL FROM planted WHERE trim(name) = ''
      UNION ALL SELECT 'unsafe:name', name, NULL FROM planted WHERE contains(name, '/') OR contains(name, chr(92)) OR name IN ('.', '..')
      UNION ALL SELECT 'duplicate', name, CAST(count(*) AS VARCHAR) FROM planted WHERE name IS NOT NULL GROUP BY name HAVING count(*) > 1""",
)
def _(t):
    return Q.key_check(planted_names(t), ["name"], safe_name=True)


@query(
    "range_check",
    """SELECT rule, CAST(p_partkey AS VARCHAR) AS key, v AS detail FROM (
        SELECT p_partkey, v, CASE WHEN v IS NULL THEN 'null' WHEN try_cast(v AS DOUBLE) IS NULL THEN 'not_numeric'
          WHEN try_cast(v AS DOUBLE) NOT BETWEEN 1 AND 40 THEN 'out_of_range' END AS rule
        FROM (SELECT p_partkey, CASE WHEN p_partkey % 101 = 0 THEN NULL WHEN p_partkey % 103 = 0 THEN p_brand ELSE CAST(p_size AS VARCHAR) END AS v FROM part))
      WHERE rule IS NOT NULL""",
)
def _(t):
    k = F.col("p_partkey")
    v = F.when(k % 101 == 0, F.lit(None).cast("string")).when(k % 103 == 0, F.col("p_brand")).otherwise(F.col("p_size").cast("string"))
    return Q.range_check(t.part.select("p_partkey", v.alias("v")), "p_partkey", "v", 1, 40)


@query(
    "vocabulary_check",
    "SELECT 'unknown_value' AS rule, CAST(o_orderkey AS VARCHAR) AS key, o_orderstatus AS detail FROM orders WHERE o_orderstatus NOT IN ('O', 'F')",
)
def _(t):
    return Q.vocabulary_check(t.orders, "o_orderkey", "o_orderstatus", ["O", "F"])


def holed_lines(t):
    k = F.col("l_orderkey")
    return t.lineitem.select(
        F.when(k % 211 == 0, F.lit(None).cast("double")).when(k % 223 == 0, F.lit(float("nan"))).otherwise(F.col("l_quantity")).alias("quantity"),
        F.when(k % 227 == 0, F.lit(float("-inf"))).otherwise(F.col("l_extendedprice")).alias("price"),
        (F.col("l_discount") - 0.05).alias("discount"),
    )


@query(
    "finite_check",
    """WITH h AS (SELECT CASE WHEN l_orderkey % 211 = 0 THEN NULL WHEN l_orderkey % 223 = 0 THEN CAST('nan' AS DOUBLE) ELSE l_quantity END AS quantity,
        CASE WHEN l_orderkey % 227 = 0 THEN CAST('-infinity' AS DOUBLE) ELSE l_extendedprice END AS price, l_discount - 0.05e0 AS discount FROM lineitem)
      SELECT 'quantity' AS column, count(*) FILTER (WHERE quantity IS NULL) AS nulls, count(*) FILTER (WHERE isnan(quantity)) AS nans, count(*) FILTER (WHERE isinf(quantity)) AS infinities, CAST(0 AS BIGINT) AS non_positive FROM h
      UNION ALL SELECT 'price', count(*) FILTER (WHERE price IS NULL), count(*) FILTER (WHERE isnan(price)), count(*) FILTER (WHERE isinf(price)), 0 FROM h
      UNION ALL SELECT 'discount', count(*) FILTER (WHERE discount IS NULL), count(*) FILTER (WHERE isnan(discount)), count(*) FILTER (WHERE isinf(discount)), count(*) FILTER (WHERE discount <= 0) FROM h""",
)
def _(t):
    return Q.finite_check(holed_lines(t), ["quantity", "price", "discount"], ["discount"])


@query(
    "key_reconcile",
    """SELECT coalesce(o_orderkey, l_orderkey) AS orderkey, CASE WHEN l_orderkey IS NULL THEN 'missing' ELSE 'unexpected' END AS rule
      FROM (SELECT DISTINCT CASE WHEN o_orderstatus = 'P' THEN -o_orderkey ELSE o_orderkey END AS o_orderkey FROM orders) o FULL JOIN (SELECT DISTINCT l_orderkey FROM lineitem) l ON o_orderkey = l_orderkey
      WHERE o_orderkey IS NULL OR l_orderkey IS NULL""",
)
def _(t):
    moved = F.when(F.col("o_orderstatus") == "P", -F.col("o_orderkey")).otherwise(F.col("o_orderkey"))  # keys without a partner
    orders = t.orders.select(moved.alias("orderkey"))
    return A.key_reconcile(orders, t.lineitem.select(F.col("l_orderkey").alias("orderkey")), ["orderkey"])


@query(
    "split_guard",
    "SELECT 'wrong_split' AS rule, CAST(doc_id AS VARCHAR) AS key, lang AS detail FROM documents WHERE lang <> 'en'",
)
def _(t):
    return Q.split_guard(t.documents.select("doc_id", "lang"), "doc_id", "lang", "en")


@query(
    "population_filter",
    "SELECT count(*) AS total, count(*) FILTER (WHERE quality > 0) AS retained, count(*) FILTER (WHERE quality <= 0) AS removed FROM labels",
)
def _(t):
    return Q.population_filter(t.labels, F.col("quality") > 0)[1]


def s(sql: str) -> str:
    return f"WITH {SCORED} {sql}"


@query(
    "aligned_join",
    s("SELECT s.key, s.label, s.text, s.fold, l_lines FROM scored s JOIN (SELECT l_partkey, count(*) AS l_lines FROM lineitem GROUP BY l_partkey) l ON s.key = l.l_partkey"),
    "label text",
)
def _(t):
    rows = scored(t)
    features = t.lineitem.groupBy(F.col("l_partkey").alias("key")).agg(F.count("*").alias("l_lines"))
    joined, _ = A.aligned_join(rows.select("key", "label", "text"), features, rows.select("key", "fold"), ["key"])
    return joined


@query(
    "aligned_join_violations",
    """WITH f AS (SELECT CASE WHEN l_partkey % 7 = 0 THEN -l_partkey ELSE l_partkey END AS k FROM lineitem)
      SELECT '{"key":' || p_partkey || '}' AS key, 'missing' AS rule, 'features' AS table FROM part WHERE p_partkey NOT IN (SELECT k FROM f)
      UNION ALL SELECT '{"key":' || k || '}', 'duplicate', 'features' FROM f GROUP BY k HAVING count(*) > 1""",
)
def _(t):
    rows = scored(t)
    moved = F.when(F.col("l_partkey") % 7 == 0, -F.col("l_partkey")).otherwise(F.col("l_partkey"))
    features = t.lineitem.select(moved.alias("key"), "l_tax")
    return A.aligned_join(rows.select("key", "label"), features, rows.select("key", "fold"), ["key"])[1]


@query(
    "keyed_reorder",
    s("SELECT s.key, label, pos FROM scored s JOIN (SELECT p_partkey AS key, row_number() OVER (ORDER BY md5(CAST(p_partkey AS VARCHAR)), p_partkey) AS pos FROM part) r ON r.key = s.key"),
    "label",
)
def _(t):
    from rubrica.operators.ranking import hashed_positions

    names = t.part.select(F.col("p_partkey").alias("key"), F.md5(F.col("p_partkey").cast("string")).alias("h"))
    reference = hashed_positions(names, [], "h", ["key"], "pos")
    return A.keyed_reorder(scored(t).select("key", "label"), reference, ["key"], "pos")


@query(
    "oof_agreement",
    s("""SELECT count(*) FILTER (WHERE b.key IS NOT NULL AND a.key IS NOT NULL) AS matched, count(*) FILTER (WHERE b.key IS NULL) AS missing, count(*) FILTER (WHERE a.key IS NULL) AS unexpected,
      count(*) FILTER (WHERE abs(a.label - b.label) > 1e-9) AS label_differs, count(*) FILTER (WHERE a.fold <> b.fold) AS fold_differs
      FROM (SELECT * REPLACE (CASE WHEN size = 7 THEN -key ELSE key END AS key) FROM scored) a FULL JOIN (SELECT CASE WHEN size = 9 THEN -key ELSE key END AS key, CASE WHEN size = 3 THEN label + 0.5e0 ELSE label END AS label, CASE WHEN size = 4 THEN (fold + 1) % 5 ELSE fold END AS fold FROM scored) b ON a.key = b.key"""),
)
def _(t):
    rows = scored(t)
    moved = lambda size: F.when(F.col("size") == size, -F.col("key")).otherwise(F.col("key")).alias("key")
    other = rows.select(
        moved(9),
        F.when(F.col("size") == 3, F.col("label") + 0.5).otherwise(F.col("label")).alias("label"),
        F.when(F.col("size") == 4, (F.col("fold") + 1) % 5).otherwise(F.col("fold")).alias("fold"),
    )
    return A.oof_agreement(rows.withColumn("key", moved(7)), other, ["key"])


@query(
    "oof_parity",
    s("""SELECT count(*) FILTER (WHERE size <> 9) AS n, 2 * count(*) FILTER (WHERE size = 9) AS unmatched, max(abs(text - voice)) FILTER (WHERE size <> 9) AS max_difference,
      max(abs(text - voice)) FILTER (WHERE size <> 9) <= 0.000001e0 AND count(*) FILTER (WHERE size = 9) = 0 AS within_tolerance FROM scored"""),
    "max_difference",
)
def _(t):
    rows = scored(t)
    moved = F.when(F.col("size") == 9, -F.col("key")).otherwise(F.col("key"))  # keys without a partner
    return A.oof_parity(
        rows.select("key", F.col("text").alias("prediction")), rows.select(moved.alias("key"), F.col("voice").alias("prediction")), ["key"], 1e-6
    )


@query(
    "residual_consistency",
    s("SELECT count(*) AS n, count(*) FILTER (WHERE size = 5) AS residual_differs, count(*) FILTER (WHERE size = 6) AS abs_error_differs FROM scored"),
)
def _(t):
    residual = F.col("label") - F.col("text")
    rows = scored(t).select(
        "label",
        F.col("text").alias("prediction"),
        F.when(F.col("size") == 5, residual + 0.1).otherwise(residual).alias("residual"),
        F.when(F.col("size") == 6, F.abs(residual) + 0.1).otherwise(F.abs(residual)).alias("abs_error"),
    )
    return Q.residual_consistency(rows)


@query(
    "fold_check",
    s("""SELECT count(*) FILTER (WHERE fold BETWEEN 0 AND 4) AS known_folds, count(*) FILTER (WHERE fold NOT BETWEEN 0 AND 4) AS unknown_folds, min(n) AS smallest, max(n) AS largest,
      count(*) FILTER (WHERE fold BETWEEN 0 AND 4) = 5 AND count(*) FILTER (WHERE fold NOT BETWEEN 0 AND 4) = 0 AND max(n) - min(n) <= 1 AS valid FROM (SELECT fold, count(*) AS n FROM scored GROUP BY fold)"""),
)
def _(t):
    return Q.fold_check(scored(t), "fold", 5)


@query(
    "fold_group_leak",
    "SELECT o_custkey, min(o_orderkey % 5) AS first_fold, max(o_orderkey % 5) AS last_fold, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderkey % 5) > 1",
)
def _(t):
    return Q.fold_group_leak(t.orders.select("o_custkey", (F.col("o_orderkey") % 5).alias("fold")), "o_custkey", "fold")


@query(
    "oof_coverage",
    s("SELECT key, CASE WHEN size = 2 THEN 'not_predicted' ELSE 'predicted_twice' END AS rule, CASE WHEN size = 2 THEN 0 ELSE 2 END::BIGINT AS predictions FROM scored WHERE size = 2 OR size = 8 UNION ALL SELECT -key, 'unexpected', 1 FROM scored WHERE size = 2"),
)
def _(t):
    rows = scored(t).select("key", "size")
    moved = rows.withColumn("key", F.when(F.col("size") == 2, -F.col("key")).otherwise(F.col("key")))
    pieces = A.union_frames({"a": moved, "b": rows.where("size = 8")}, "piece")
    return Q.oof_coverage(rows, pieces, "key")


@query(
    "prediction_schema_check",
    s("""SELECT rule, n FROM (SELECT 'missing' AS rule, count(*) AS n FROM scored WHERE size IN (2, 8) UNION ALL SELECT 'unexpected', count(*) FROM scored WHERE size IN (2, 8)
      UNION ALL SELECT 'not_finite', 2 * count(*) FROM scored WHERE size = 9 UNION ALL SELECT 'duplicate', count(*) FROM scored WHERE size = 9
      UNION ALL SELECT 'columns', 1 UNION ALL SELECT 'order', count(*) FROM scored WHERE size = 4) WHERE n > 0"""),
)
def _(t):
    rows = scored(t).select("key", "size", F.when(F.col("size") == 9, F.lit(float("nan"))).otherwise(F.col("text")).alias("prediction"))
    rows = rows.withColumn("row", F.col("key"))
    moved = lambda size: rows.withColumn("key", F.when(F.col("size") == size, -F.col("key")).otherwise(F.col("key")))
    predictions = moved(2).unionByName(rows.where("size = 9"))
    predictions = predictions.withColumn("row", F.when(F.col("size") == 4, -F.col("row")).otherwise(F.col("row")))
    return Q.prediction_schema_check(predictions, moved(8), "key", "prediction", "row")


@query(
    "merge_indicator",
    """SELECT coalesce(c_custkey, o_custkey) AS custkey, c_mktsegment, orders, CASE WHEN o_custkey IS NULL THEN 'left_only' WHEN c_custkey IS NULL THEN 'right_only' ELSE 'both' END AS merge
      FROM (SELECT CASE WHEN c_acctbal > 0 THEN c_custkey ELSE -c_custkey END AS c_custkey, c_mktsegment FROM customer) FULL JOIN (SELECT CASE WHEN o_custkey % 9 = 0 THEN o_custkey + 1000000000 ELSE o_custkey END AS o_custkey, count(*) AS orders FROM orders GROUP BY ALL) ON c_custkey = o_custkey""",
)
def _(t):
    owing = F.when(F.col("c_acctbal") > 0, F.col("c_custkey")).otherwise(-F.col("c_custkey"))
    left = t.customer.select(owing.alias("custkey"), "c_mktsegment")
    moved = F.when(F.col("o_custkey") % 9 == 0, F.col("o_custkey") + 1_000_000_000).otherwise(F.col("o_custkey"))
    right = t.orders.groupBy(moved.alias("custkey")).agg(F.count("*").alias("orders"))
    return A.merge_indicator(left, right, ["custkey"])


@query(
    "merge_coverage",
    """SELECT count(*) AS n, count(*) FILTER (WHERE c_custkey = k) AS both, count(*) FILTER (WHERE k IS NULL) AS left_only, count(*) FILTER (WHERE c_custkey IS NULL) AS right_only
      FROM customer FULL JOIN (SELECT CASE WHEN o_custkey % 9 = 0 THEN -o_custkey ELSE o_custkey END AS k FROM orders GROUP BY ALL) ON c_custkey = k""",
)
def _(t):
    left = t.customer.select(F.col("c_custkey").alias("custkey"), "c_mktsegment")
    moved = F.when(F.col("o_custkey") % 9 == 0, -F.col("o_custkey")).otherwise(F.col("o_custkey"))
    right = t.orders.groupBy(moved.alias("custkey")).agg(F.count("*").alias("orders"))
    return A.merge_coverage(A.merge_indicator(left, right, ["custkey"]))


@query(
    "set_overlap",
    """WITH o AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P'), c AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0),
        f AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT'), m AS (SELECT k, k IN (FROM c) AS cust, k IN (FROM o) AS p, k IN (FROM f) AS urgent FROM (FROM o UNION FROM c UNION FROM f))
      SELECT 'customer' AS first, 'pending' AS second, count(*) FILTER (WHERE cust AND p) AS both, count(*) FILTER (WHERE cust AND NOT p) AS first_only, count(*) FILTER (WHERE NOT cust AND p) AS second_only FROM m
      UNION ALL SELECT 'customer', 'urgent', count(*) FILTER (WHERE cust AND urgent), count(*) FILTER (WHERE cust AND NOT urgent), count(*) FILTER (WHERE NOT cust AND urgent) FROM m
      UNION ALL SELECT 'pending', 'urgent', count(*) FILTER (WHERE p AND urgent), count(*) FILTER (WHERE p AND NOT urgent), count(*) FILTER (WHERE NOT p AND urgent) FROM m""",
)
def _(t):
    return A.set_overlap(
        {
            "customer": t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("k")),
            "pending": t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")),
            "urgent": t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k")),
        },
        "k",
    )


@query(
    "integrity_report",
    """SELECT lang, count(*) AS rows, CAST(2 AS BIGINT) AS features, count(*) - count(DISTINCT doc_id // 3) AS duplicates,
      count(*) FILTER (WHERE source = 'src1') AS missing, count(*) FILTER (WHERE source = 'src2') AS non_finite FROM documents GROUP BY lang""",
)
def _(t):
    rows = t.documents.select(
        "lang",
        F.floor(F.col("doc_id") / 3).alias("k"),
        F.col("n_chars").cast("double").alias("chars"),
        F.when(F.col("source") == "src1", F.lit(None).cast("double")).when(F.col("source") == "src2", F.lit(float("inf"))).otherwise(1.0).alias("other"),
    )
    return Q.integrity_report(rows, "lang", ["k"], ["chars", "other"])
