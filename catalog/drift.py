"""Drift and feature audits on lineitem and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from rubrica.operators import drift as D

from .base import query, sql_pearson

FEATURES = ["quantity", "price", "discount", "tax", "late"]


def features(t):
    """Line features, a train/test split by order and one almost constant column."""
    return t.lineitem.select(
        F.when(F.col("l_orderkey") % 10 < 7, "train").otherwise("test").alias("split"),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_extendedprice") / 1000).alias("price"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        F.when(F.col("l_orderkey") % 200 == 0, 1.0).otherwise(0.0).alias("late"),
        F.lit(3.0).alias("constant"),
        F.when(F.col("l_orderkey") % 10 < 7, 1.0).otherwise(2.0).alias("marker"),
        F.col("l_linenumber").cast("double").alias("label"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("key"),
    )


LINES = """f AS (SELECT CASE WHEN l_orderkey % 10 < 7 THEN 'train' ELSE 'test' END AS split, l_quantity AS quantity, l_extendedprice / 1000 AS price, l_discount AS discount, l_tax AS tax,
   CASE WHEN l_orderkey % 200 = 0 THEN 1e0 ELSE 0e0 END AS late, 3e0 AS constant, CASE WHEN l_orderkey % 10 < 7 THEN 1e0 ELSE 2e0 END AS marker, CAST(l_linenumber AS DOUBLE) AS label, l_orderkey * 8 + l_linenumber AS key FROM lineitem)"""


def tall_sql(columns, keep="split, label"):
    return "m AS (" + " UNION ALL ".join(f"SELECT {keep}, '{c}' AS feature, {c} AS value FROM f" for c in columns) + ")"


QS = ", ".join(f"quantile_cont(value, {p}) AS {n}" for n, p in D.PERCENTILES.items())


@query(
    "distribution_summary",
    f"WITH {LINES}, {tall_sql(FEATURES)} SELECT feature, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max, {QS}, avg(CASE WHEN value = 0 THEN 1e0 ELSE 0e0 END) AS zero_fraction FROM m GROUP BY feature",
    "mean std min max p01 p05 p25 median p75 p95 p99 zero_fraction",
)
def _(t):
    return D.distribution_summary(features(t), FEATURES)


@query(
    "variance_sparsity",
    f"""WITH {LINES}, {tall_sql(FEATURES + ['constant'])}, c AS (SELECT feature, value, count(*) AS n, row_number() OVER (PARTITION BY feature ORDER BY count(*) DESC) AS r FROM m GROUP BY feature, value),
      s AS (SELECT feature, count(*) AS d, sum(n) AS total, max(n) FILTER (WHERE r = 1) AS top, max(n) FILTER (WHERE r = 2) AS second, coalesce(sum(n) FILTER (WHERE value = 0), 0) AS zeros FROM c GROUP BY feature)
      SELECT feature, d <= 1 AS zero_variance, d > 1 AND d / total <= 0.1 AND top / second >= 19 AS near_zero_variance, zeros / total > 0.95 AS zero_over_95_percent, zeros / total > 0.99 AS zero_over_99_percent FROM s""",
)
def _(t):
    return D.variance_sparsity(features(t), FEATURES + ["constant"])


DRIFTED = FEATURES + ["constant", "marker"]
SPLIT_STATS = f"""WITH {LINES}, {tall_sql(DRIFTED)}, s AS (SELECT feature, avg(value) FILTER (WHERE split = 'train') AS am, avg(value) FILTER (WHERE split = 'test') AS bm, var_samp(value) FILTER (WHERE split = 'train') AS av, var_samp(value) FILTER (WHERE split = 'test') AS bv,
  var_pop(value) FILTER (WHERE split = 'train') AS ap, var_pop(value) FILTER (WHERE split = 'test') AS bp, min(value) FILTER (WHERE split = 'train') AS a0, max(value) FILTER (WHERE split = 'train') AS a1, min(value) FILTER (WHERE split = 'test') AS b0, max(value) FILTER (WHERE split = 'test') AS b1 FROM m GROUP BY feature)"""


@query(
    "smd_sample",
    f"""{SPLIT_STATS} SELECT feature, CASE WHEN isinf(smd) THEN CASE WHEN smd > 0 THEN 'Infinity' ELSE '-Infinity' END ELSE 'finite' END AS kind, CASE WHEN NOT isinf(smd) THEN smd END AS smd, CASE WHEN NOT isinf(smd) THEN abs(smd) END AS abs_smd
      FROM (SELECT feature, CASE WHEN av + bv > 0 THEN (am - bm) / sqrt((av + bv) / 2) WHEN am = bm THEN 0e0 WHEN am > bm THEN CAST('infinity' AS DOUBLE) ELSE CAST('-infinity' AS DOUBLE) END AS smd FROM s)""",
    "smd abs_smd",
)
def _(t):
    inf = F.abs("smd") == float("inf")
    out = D.smd_sample(features(t), "split", DRIFTED)
    return out.select(
        "feature",
        F.when(inf, F.when(F.col("smd") > 0, "Infinity").otherwise("-Infinity")).otherwise("finite").alias("kind"),
        F.when(~inf, F.col("smd")).alias("smd"),
        F.when(~inf, F.col("abs_smd")).alias("abs_smd"),
    )


@query(
    "smd_shift_audit",
    f"""{SPLIT_STATS} SELECT feature, am AS train_mean, bm AS test_mean, sqrt(ap) AS train_std, sqrt(bp) AS test_std, a0 AS train_min, a1 AS train_max, b0 AS test_min, b1 AS test_max, CASE WHEN NOT isinf(smd) THEN smd END AS smd,
       CASE WHEN abs(smd) >= 0.8 THEN 'large' WHEN abs(smd) >= 0.5 THEN 'moderate' ELSE 'low' END AS shift
      FROM (SELECT *, CASE WHEN ap + bp > 0 THEN (bm - am) / sqrt((ap + bp) / 2) WHEN am = bm THEN 0e0 WHEN bm > am THEN CAST('infinity' AS DOUBLE) ELSE CAST('-infinity' AS DOUBLE) END AS smd FROM s)""",
    "train_mean test_mean train_std test_std train_min train_max test_min test_max smd",
)
def _(t):
    out = D.smd_shift_audit(features(t), "split", DRIFTED)
    return out.withColumn("smd", F.when(F.abs("smd") != float("inf"), F.col("smd")))


KS = f"""{tall_sql(FEATURES + ['marker'])}, c AS (SELECT feature, value, count(*) FILTER (WHERE split = 'train') AS a, count(*) FILTER (WHERE split = 'test') AS b FROM m GROUP BY feature, value),
  r AS (SELECT feature, abs(sum(a) OVER w / sum(a) OVER (PARTITION BY feature) - sum(b) OVER w / sum(b) OVER (PARTITION BY feature)) AS gap FROM c WINDOW w AS (PARTITION BY feature ORDER BY value))"""


@query("ks_statistic", f"WITH {LINES}, {KS} SELECT feature, max(gap) AS ks FROM r GROUP BY feature", "ks")
def _(t):
    return D.ks_statistic(features(t), "split", FEATURES + ["marker"])


@query(
    "ecdf",
    "SELECT DISTINCT o_orderstatus, v, count(*) OVER (PARTITION BY o_orderstatus, v) AS n, cume_dist() OVER (PARTITION BY o_orderstatus ORDER BY v) AS ecdf FROM (SELECT o_orderstatus, floor(o_totalprice / 100) AS v FROM orders)",
    "v ecdf",
)
def _(t):
    return D.ecdf(t.orders.select("o_orderstatus", F.floor(F.col("o_totalprice") / 100).cast("double").alias("v")), "o_orderstatus", "v")


PAIRED = ["quantity", "twice", "minus", "net", "price"]


@query(
    "high_correlation_pairs",
    "WITH p AS (SELECT l_quantity AS quantity, 2 * l_quantity + 1 AS twice, -l_quantity AS minus, l_extendedprice / 1000 AS price, l_extendedprice / 1000 * (1 - l_discount) AS net FROM lineitem), "
    + "c AS (" + " UNION ALL ".join(
        f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", {sql_pearson(a, b)} AS pearson, covar_pop({a}, {b}) / var_pop({a}) AS affine_slope, avg({b}) - covar_pop({a}, {b}) / var_pop({a}) * avg({a}) AS affine_intercept FROM p"
        for i, a in enumerate(PAIRED) for b in PAIRED[i + 1:]) + "), "
    + "r AS (" + " UNION ALL ".join(
        f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", max(abs({b} - (affine_slope * {a} + affine_intercept))) AS max_affine_residual, max(abs({b})) AS largest FROM p, c WHERE \"left\" = '{a}' AND \"right\" = '{b}'"
        for i, a in enumerate(PAIRED) for b in PAIRED[i + 1:]) + ") "
    + 'SELECT "left", "right", pearson, abs(pearson) AS abs_pearson, affine_slope, affine_intercept, max_affine_residual, max_affine_residual <= 1e-10 * greatest(1, largest) AS near_exact_affine FROM c JOIN r USING ("left", "right") WHERE abs(pearson) >= 0.95',
    "pearson abs_pearson affine_slope affine_intercept max_affine_residual",
)
def _(t):
    q, price = F.col("l_quantity"), F.col("l_extendedprice") / 1000
    rows = t.lineitem.select(
        q.alias("quantity"), (q * 2 + 1).alias("twice"), (-q).alias("minus"), price.alias("price"), (price * (1 - F.col("l_discount"))).alias("net")
    )
    return D.high_correlation_pairs(rows, PAIRED)


CORRELATED = FEATURES + ["constant"]


def ranks_sql(columns, where="true"):
    one = lambda c: (
        f"SELECT '{c}' AS feature, {sql_pearson(c, 'label')} AS pearson, {sql_pearson('rx', 'ry')} AS spearman FROM (SELECT {c}, label, rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS rx, rank() OVER (ORDER BY label) + (count(*) OVER (PARTITION BY label) - 1) / 2 AS ry FROM f WHERE {where})"
    )
    return " UNION ALL ".join(one(c) for c in columns)


@query("label_correlations", f"WITH {LINES} {ranks_sql(CORRELATED)}", "pearson spearman")
def _(t):
    return D.label_correlations(features(t), "label", CORRELATED)


FAMILY = {"quantity": "amount", "price": "amount", "discount": "rate", "tax": "rate", "late": "flag"}


@query(
    "family_correlations",
    f"""WITH {LINES}, c AS ({ranks_sql(FEATURES)}) SELECT CASE WHEN feature IN ('quantity', 'price') THEN 'amount' WHEN feature IN ('discount', 'tax') THEN 'rate' ELSE 'flag' END AS family, count(*) AS feature_count,
      median(abs(pearson)) AS median_absolute_pearson, max(abs(pearson)) AS max_absolute_pearson, median(abs(spearman)) AS median_absolute_spearman, max(abs(spearman)) AS max_absolute_spearman FROM c GROUP BY 1""",
    "median_absolute_pearson max_absolute_pearson median_absolute_spearman max_absolute_spearman",
)
def _(t):
    return D.family_correlations(D.label_correlations(features(t), "label", FEATURES), FAMILY)


WIDER = {"net": "price * (1 - discount)", "taxed": "price * (1 + tax)", "each": "price / quantity", "square": "quantity * quantity", "spread": "tax - discount", "marked": "marker * price"}
WIDER_SQL = ", ".join(f"{e} AS {name}" for name, e in WIDER.items())


@query(
    "residual_feature_correlations",
    f"WITH {LINES}, g AS (SELECT *, {WIDER_SQL} FROM f) SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {sql_pearson(c, '(price - quantity)')} AS residual_correlation FROM g" for c in [*CORRELATED, *WIDER]) + ") ORDER BY abs(residual_correlation) DESC NULLS LAST, feature LIMIT 10",
    "residual_correlation",
)
def _(t):
    rows = features(t).withColumns({name: F.expr(e) for name, e in WIDER.items()})
    return D.residual_feature_correlations(rows, F.col("price") - F.col("quantity"), [*CORRELATED, *WIDER], 10)


AUDITED = FEATURES + ["net"]
AUDIT_FAMILY = {**FAMILY, "net": "amount"}


def rows_of(section: str, split: str, name: str, metrics: list[str], table: str) -> str:
    return " UNION ALL ".join(f"SELECT '{section}' AS section, {split} AS split, {name} AS name, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM {table}" for m in metrics)


@query(
    "audit_report",
    f"""WITH {LINES.replace("f AS (", "plain AS (", 1)}, f AS (SELECT *, price * (1 - discount) AS net FROM plain), {tall_sql(AUDITED)},
      i AS (SELECT split, count(*) AS row_count, {len(AUDITED)} AS feature_count, count(*) - count(DISTINCT key) AS duplicate_identities, 0 AS missing_values, 0 AS non_finite_values FROM f GROUP BY split),
      vc AS (SELECT split, feature, value, count(*) AS n, row_number() OVER (PARTITION BY split, feature ORDER BY count(*) DESC) AS r FROM m GROUP BY split, feature, value),
      vs AS (SELECT split, feature, count(*) AS d, sum(n) AS total, max(n) FILTER (WHERE r = 1) AS top, max(n) FILTER (WHERE r = 2) AS second, coalesce(sum(n) FILTER (WHERE value = 0), 0) AS zeros FROM vc GROUP BY split, feature),
      v AS (SELECT split, feature, d <= 1 AS zero_variance, d > 1 AND d / total <= 0.1 AND top / second >= 19 AS near_zero_variance, zeros / total > 0.95 AS zero_over_95_percent, zeros / total > 0.99 AS zero_over_99_percent FROM vs),
      d AS (SELECT split, feature, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max, {QS}, avg(CASE WHEN value = 0 THEN 1e0 ELSE 0e0 END) AS zero_fraction FROM m GROUP BY split, feature),
      s AS (SELECT feature, (avg(value) FILTER (WHERE split = 'train') - avg(value) FILTER (WHERE split = 'test')) / sqrt((var_samp(value) FILTER (WHERE split = 'train') + var_samp(value) FILTER (WHERE split = 'test')) / 2) AS smd FROM m GROUP BY feature),
      sa AS (SELECT *, abs(smd) AS abs_smd FROM s),
      c AS (SELECT feature, value, count(*) FILTER (WHERE split = 'train') AS a, count(*) FILTER (WHERE split = 'test') AS b FROM m GROUP BY feature, value),
      r AS (SELECT feature, abs(sum(a) OVER w / sum(a) OVER (PARTITION BY feature) - sum(b) OVER w / sum(b) OVER (PARTITION BY feature)) AS gap FROM c WINDOW w AS (PARTITION BY feature ORDER BY value)),
      kk AS (SELECT feature, max(gap) AS ks FROM r GROUP BY feature),
      p AS ("""
    + " UNION ALL ".join(
        f"SELECT '{a}|{b}' AS name, {sql_pearson(a, b)} AS pearson, covar_pop({a}, {b}) / var_pop({a}) AS affine_slope, avg({b}) - covar_pop({a}, {b}) / var_pop({a}) * avg({a}) AS affine_intercept, false AS near_exact_affine FROM f WHERE split = 'train'"
        for i, a in enumerate(AUDITED) for b in AUDITED[i + 1 :]
    )
    + f"""), hp AS (SELECT * FROM p WHERE abs(pearson) >= 0.95), k AS ({ranks_sql(AUDITED, "split = 'train'")}),
      fc AS (SELECT CASE feature {" ".join(f"WHEN '{x}' THEN '{y}'" for x, y in AUDIT_FAMILY.items())} END AS family, count(*) AS feature_count, median(abs(pearson)) AS median_absolute_pearson, max(abs(pearson)) AS max_absolute_pearson,
        median(abs(spearman)) AS median_absolute_spearman, max(abs(spearman)) AS max_absolute_spearman FROM k GROUP BY 1)
      """
    + " UNION ALL ".join([
        rows_of("integrity", "split", "'all'", ["row_count", "feature_count", "duplicate_identities", "missing_values", "non_finite_values"], "i"),
        rows_of("variance_sparsity", "split", "feature", ["zero_variance", "near_zero_variance", "zero_over_95_percent", "zero_over_99_percent"], "v"),
        rows_of("distribution", "split", "feature", ["mean", "std", "min", "max", *D.PERCENTILES, "zero_fraction"], "d"),
        rows_of("shift", "NULL", "feature", ["smd", "abs_smd"], "sa"), rows_of("shift", "NULL", "feature", ["ks"], "kk"),
        rows_of("high_correlation", "'train'", "name", ["pearson", "affine_slope", "affine_intercept", "near_exact_affine"], "hp"),
        rows_of("label_correlation", "'train'", "feature", ["pearson", "spearman"], "k"),
        rows_of("family_correlation", "'train'", "family", ["feature_count", "median_absolute_pearson", "max_absolute_pearson", "median_absolute_spearman", "max_absolute_spearman"], "fc"),
    ]),
    "value",
    digits=4,
)
def _(t):
    rows = features(t).withColumn("net", F.col("price") * (1 - F.col("discount")))
    return D.audit_report(rows, "split", "key", "label", AUDITED, AUDIT_FAMILY)
