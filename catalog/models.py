"""Folds, baselines and cross-fitted linear models."""

from __future__ import annotations

from pyspark.sql import functions as F

from rubrica.operators import folds as FO
from rubrica.operators import linear as L

from .base import SCORED, fold_of, query, scored, sql_fold
from .metrics import MEAN_OOF, part_folds

EDGES = "e AS (SELECT quantile_cont(o_totalprice, [0.2, 0.4, 0.6, 0.8]) AS q FROM orders)"
BIN = "CAST((o_totalprice > q[1])::INT + (o_totalprice > q[2])::INT + (o_totalprice > q[3])::INT + (o_totalprice > q[4])::INT AS BIGINT)"


@query(
    "stratification_bins",
    f"WITH {EDGES} SELECT o_orderkey, {BIN} AS bin FROM orders, e",
)
def _(t):
    return FO.stratification_bins(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice").select("o_orderkey", "bin")


@query(
    "stratification_bins_ties",
    f"""WITH {SCORED}, e AS (SELECT list_sort(list_distinct(quantile_cont(label, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS q FROM scored)
      SELECT key, CAST(len(list_filter(q[2:len(q) - 1], lambda x: x < label)) AS BIGINT) AS bin FROM scored, e""",
)
def _(t):
    return FO.stratification_bins(scored(t).select("key", "label"), "label").select("key", "bin")


@query(
    "stratified_folds",
    f"""WITH {EDGES}, b AS (SELECT o_orderkey, {BIN} AS bin FROM orders, e), r AS (SELECT *, row_number() OVER (ORDER BY bin, md5('42|' || o_orderkey), o_orderkey) AS rn FROM b)
      SELECT o_orderkey, bin, CAST((rn - 1) % 5 AS BIGINT) AS fold FROM r""",
)
def _(t):
    return FO.stratified_folds(t.orders.select("o_orderkey", "o_totalprice"), "o_orderkey", "o_totalprice").select("o_orderkey", "bin", "fold")


@query(
    "group_folds",
    """WITH RECURSIVE g AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), s AS MATERIALIZED (SELECT n, row_number() OVER (ORDER BY n DESC) AS rn FROM g),
      walk(rn, t, f) AS (SELECT CAST(0 AS BIGINT), CAST([0, 0, 0, 0, 0] AS BIGINT[]), CAST(-1 AS BIGINT) UNION ALL
        SELECT s.rn, list_transform(range(1, 6), lambda i: t[i] + CASE WHEN i = list_position(t, list_min(t)) THEN n ELSE 0 END), CAST(list_position(t, list_min(t)) - 1 AS BIGINT) FROM walk JOIN s ON s.rn = walk.rn + 1),
      upto AS (SELECT n, f, c, sum(c) OVER (PARTITION BY n ORDER BY f) AS last FROM (SELECT n, f, count(*) AS c FROM walk JOIN s USING (rn) GROUP BY n, f)),
      r AS (SELECT o_custkey, n, row_number() OVER (PARTITION BY n ORDER BY md5(CAST(o_custkey AS VARCHAR)), o_custkey) AS p FROM g)
      SELECT o_custkey, r.n AS group_size, f AS fold FROM r JOIN upto ON r.n = upto.n AND p BETWEEN last - c + 1 AND last""",
)
def _(t):
    return FO.group_folds(t.orders.select("o_custkey"), "o_custkey")


@query(
    "unseen_group_mask",
    "SELECT o_orderkey, o_custkey, count(DISTINCT o_orderkey % 3) OVER (PARTITION BY o_custkey) = 1 AS unseen FROM orders",
)
def _(t):
    rows = t.orders.select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 3).alias("fold"))
    return FO.unseen_group_mask(rows, "o_custkey", "fold").select("o_orderkey", "o_custkey", "unseen")


@query("mean_baseline_oof", f"WITH {MEAN_OOF} SELECT key, label, fold, prediction, label - prediction AS residual FROM oof", "label prediction residual")
def _(t):
    oof = FO.mean_baseline_oof(part_folds(t))
    return oof.select("key", "label", "fold", "prediction", (F.col("label") - F.col("prediction")).alias("residual"))


@query(
    "mean_baseline_report",
    f"""WITH p AS (SELECT p_retailprice / 100 AS label, {sql_fold('p_partkey')} AS fold FROM part), k AS (SELECT DISTINCT fold AS k FROM p)
      SELECT k AS fold, count(*) AS train_n, avg(label) AS train_mean, stddev_pop(label) AS train_rmse FROM p JOIN k ON p.fold <> k.k GROUP BY k""",
    "train_mean train_rmse",
)
def _(t):
    return FO.mean_baseline_report(part_folds(t).withColumn("label", F.col("label") / 100))


# ---------------------------------------------------------------------------
# Line items: price from quantity and discount, folds by order and line.
# ---------------------------------------------------------------------------


def lines(t):
    fold = fold_of(F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    return t.lineitem.select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_returnflag",
        (F.col("l_extendedprice") / 1000).alias("label"), F.col("l_quantity").alias("quantity"), (F.col("l_discount") * 100).alias("discount"),
        (F.col("l_quantity") * 1.5 + F.col("l_tax") * 20).alias("base"), fold.alias("fold"),
    )


LINES = f"""li AS (SELECT l_orderkey, l_partkey, l_linenumber, l_returnflag, l_extendedprice / 1000 AS label, l_quantity AS quantity, l_discount * 100 AS discount, l_quantity * 1.5e0 + l_tax * 20 AS base, {sql_fold('l_orderkey * 8 + l_linenumber')} AS fold FROM lineitem)"""
KEYS = "l_orderkey, l_partkey, l_linenumber"


def sql_ridge2(rows: str, y: str, alpha: float, x1: str = "quantity", x2: str = "discount", scale1: bool = True, pick: str = "r.fold <> k.k", by: str = "k.k") -> str:
    """Ridge coefficients with two features by Cramer's rule, per held-out fold."""
    d1 = "sqrt(v1)" if scale1 else "1"
    return f"""SELECT k, b1 / d1 AS w1, b2 / d2 AS w2, b1 AS s1, b2 AS s2, my - b1 / d1 * m1 - b2 / d2 * m2 AS w0 FROM (
      SELECT k, m1, m2, my, d1, d2, (r1 * a22 - r2 * a12) / (a11 * a22 - a12 * a12) AS b1, (a11 * r2 - a12 * r1) / (a11 * a22 - a12 * a12) AS b2 FROM (
        SELECT k, m1, m2, my, d1, d2, n * v1 / (d1 * d1) + {alpha}e0 AS a11, n * v2 / (d2 * d2) + {alpha}e0 AS a22, n * c12 / (d1 * d2) AS a12, n * c1y / d1 AS r1, n * c2y / d2 AS r2 FROM (
          SELECT *, {d1} AS d1, sqrt(v2) AS d2 FROM (
            SELECT {by} AS k, count(*) AS n, avg({x1}) AS m1, avg({x2}) AS m2, avg({y}) AS my, var_pop({x1}) AS v1, var_pop({x2}) AS v2, covar_pop({x1}, {x2}) AS c12, covar_pop({x1}, {y}) AS c1y, covar_pop({x2}, {y}) AS c2y
            FROM {rows} r JOIN (SELECT DISTINCT fold AS k FROM {rows}) k ON {pick} GROUP BY {by}))))"""


@query(
    "ridge_oof",
    f"WITH {LINES}, w AS ({sql_ridge2('li', 'label', 500)}) SELECT {KEYS}, fold, w0 + w1 * quantity + w2 * discount AS prediction FROM li JOIN w ON li.fold = w.k",
    "prediction",
)
def _(t):
    return L.ridge_oof(lines(t), ["quantity", "discount"], "label", "fold", 500.0).select("l_orderkey", "l_partkey", "l_linenumber", "fold", "prediction")


#: Gauss-Jordan elimination on the penalised normal equations of each held-out fold, one column a step.
VECTOR_RIDGE = f"""RECURSIVE e AS MATERIALIZED (SELECT vec_id, CAST(label AS DOUBLE) AS y, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x, {sql_fold('vec_id')} AS fold FROM embeddings),
  k AS (SELECT DISTINCT fold AS k FROM e), tall AS (SELECT vec_id, y, fold, unnest(x) AS v, unnest(range(1, 65)) AS i FROM e),
  st AS (SELECT k, i, avg(v) AS m, stddev_pop(v) AS sd, avg(y) AS my FROM tall JOIN k ON fold <> k GROUP BY k, i),
  lists AS (SELECT k, list(m ORDER BY i) AS ms, list(sd ORDER BY i) AS sds, any_value(my) AS my FROM st GROUP BY k),
  z AS MATERIALIZED (SELECT k, vec_id, y - my AS y, list_transform(range(1, 65), lambda i: (x[i] - ms[i]) / sds[i]) AS z FROM e JOIN k ON fold <> k JOIN lists USING (k)),
  rows AS (SELECT k, i, list_transform(range(1, 66), lambda j: CASE WHEN j = 65 THEN sum_y ELSE sums[j] + CASE WHEN j = i THEN 100e0 ELSE 0e0 END END) AS r
    FROM (SELECT k, i, list(s ORDER BY j) AS sums, any_value(sy) AS sum_y FROM (SELECT k, i, j, sum(z[i] * z[j]) AS s, sum(z[i] * y) AS sy FROM z, (SELECT unnest(range(1, 65)) AS i) a, (SELECT unnest(range(1, 65)) AS j) b GROUP BY k, i, j) GROUP BY k, i)),
  g(k, step, a) AS (SELECT k, 0, list(r ORDER BY i) FROM rows GROUP BY k UNION ALL
    SELECT k, step + 1, list_transform(range(1, 65), lambda i: CASE WHEN i = step + 1 THEN list_transform(a[i], lambda v: v / a[i][step + 1])
      ELSE list_transform(list_zip(a[i], a[step + 1]), lambda u: u[1] - u[2] * a[i][step + 1] / a[step + 1][step + 1]) END) FROM g WHERE step < 64),
  w AS (SELECT k, list_transform(a, lambda r: r[65]) AS beta FROM g WHERE step = 64)
  SELECT vec_id, fold, y AS label, my + list_sum(list_transform(range(1, 65), lambda i: (x[i] - ms[i]) / sds[i] * beta[i])) AS prediction FROM e JOIN w ON fold = w.k JOIN lists ON fold = lists.k"""


@query("ridge_oof_vectors", f"WITH {VECTOR_RIDGE}", "prediction")
def _(t):
    rows = t.embeddings.select("vec_id", F.col("label").cast("double").alias("label"), "embedding", fold_of("vec_id").alias("fold"))
    return L.ridge_oof(rows, "embedding", "label", "fold", 100.0, dimension=64).select("vec_id", "fold", "label", "prediction")


TRAIN = f"{LINES}, tr AS (SELECT *, 0 AS f FROM li WHERE l_returnflag <> 'R')"
FIT_ALL = sql_ridge2("(SELECT * EXCLUDE (fold), f AS fold FROM tr)", "label", 500, pick="true")


@query(
    "ridge_fit_predict",
    f"WITH {TRAIN}, w AS ({FIT_ALL}) SELECT {KEYS}, w0 + w1 * quantity + w2 * discount AS prediction FROM li, w WHERE l_returnflag = 'R'",
    "prediction",
)
def _(t):
    rows = lines(t)
    out = L.ridge_fit_predict(rows.where("l_returnflag <> 'R'"), rows.where("l_returnflag = 'R'"), ["quantity", "discount"], "label", 500.0)
    return out.select("l_orderkey", "l_partkey", "l_linenumber", "prediction")


@query(
    "ridge_coefficients",
    f"WITH {TRAIN}, w AS ({FIT_ALL}) SELECT 'quantity' AS feature, s1 AS standardized, w1 AS raw FROM w UNION ALL SELECT 'discount', s2, w2 FROM w",
    "standardized raw",
)
def _(t):
    line = L.ridge_fit(lines(t).where("l_returnflag <> 'R'"), ["quantity", "discount"], "label", 500.0)
    return L.coefficient_table(t.spark, line, ["quantity", "discount"])


@query(
    "fold_models_predict",
    f"WITH {TRAIN}, w AS ({sql_ridge2('tr', 'label', 500)}) SELECT {KEYS}, w0 + w1 * quantity + w2 * discount AS prediction FROM li, (SELECT avg(w0) AS w0, avg(w1) AS w1, avg(w2) AS w2 FROM w) WHERE l_returnflag = 'R'",
    "prediction",
)
def _(t):
    rows = lines(t)
    out = L.fold_models_predict(rows.where("l_returnflag <> 'R'"), rows.where("l_returnflag = 'R'"), ["quantity", "discount"], "label", "fold", 500.0)
    return out.select("l_orderkey", "l_partkey", "l_linenumber", "prediction")


OLS1 = "SELECT k, regr_intercept(label, quantity) AS intercept, regr_slope(label, quantity) AS quantity FROM li JOIN (SELECT DISTINCT fold AS k FROM li) ON fold <> k GROUP BY k"


@query("ols_oof", f"WITH {LINES}, w AS ({OLS1}) SELECT {KEYS}, fold, intercept + w.quantity * li.quantity AS prediction FROM li JOIN w ON fold = k", "prediction")
def _(t):
    return L.ols_oof(lines(t), ["quantity"], "label", "fold").select("l_orderkey", "l_partkey", "l_linenumber", "fold", "prediction")


@query("ols_parameters", f"WITH {LINES} SELECT k AS fold, intercept, quantity, CAST(1 AS INTEGER) AS rank FROM ({OLS1})", "intercept quantity")
def _(t):
    return L.ols_parameters(lines(t), ["quantity"], "label", "fold")


@query(
    "residual_correction_oof",
    f"WITH {LINES}, w AS ({sql_ridge2('li', '(label - base)', 500)}) SELECT {KEYS}, fold, base + w0 + w1 * quantity + w2 * discount AS prediction FROM li JOIN w ON li.fold = w.k",
    "prediction",
)
def _(t):
    return L.residual_correction_oof(lines(t), ["quantity", "discount"], "label", "base", "fold", 500.0).select("l_orderkey", "l_partkey", "l_linenumber", "fold", "prediction")


@query(
    "stack_oof",
    f"WITH {LINES}, w AS ({sql_ridge2('li', 'label', 500, 'base', 'discount', scale1=False)}) SELECT {KEYS}, fold, w0 + w1 * base + w2 * discount AS prediction FROM li JOIN w ON li.fold = w.k",
    "prediction",
)
def _(t):
    return L.stack_oof(lines(t), ["discount"], "label", "base", "fold", 500.0).select("l_orderkey", "l_partkey", "l_linenumber", "fold", "prediction")


def sql_ridge1(x: str, alpha: str, extra: str = "") -> str:
    return f"SELECT k, n * c / (v * (n + {alpha})) AS w1, my - n * c / (v * (n + {alpha})) * mx AS w0 FROM (SELECT k, count(*) AS n, avg({x}) AS mx, avg(label) AS my, var_pop({x}) AS v, covar_pop({x}, label) AS c FROM li JOIN (SELECT DISTINCT fold AS k FROM li) ON fold <> k {extra} GROUP BY k)"


@query(
    "fusion_oof",
    f"""WITH {LINES}, a AS ({sql_ridge1('quantity', '500')}), b AS ({sql_ridge1('discount', '500')}), w AS ({sql_ridge2('li', 'label', 500)})
      SELECT {KEYS}, fold, a.w0 + a.w1 * quantity AS prediction_amount, b.w0 + b.w1 * discount AS prediction_rate, w.w0 + w.w1 * quantity + w.w2 * discount AS prediction_both FROM li JOIN a ON fold = a.k JOIN b ON fold = b.k JOIN w ON fold = w.k""",
    "prediction_amount prediction_rate prediction_both",
)
def _(t):
    out = L.fusion_oof(lines(t), {"amount": ["quantity"], "rate": ["discount"]}, "label", "fold", 500.0)
    return out.select("l_orderkey", "l_partkey", "l_linenumber", "fold", "prediction_amount", "prediction_rate", "prediction_both")


INNER = f"""{SCORED}, li AS (SELECT key, label, text AS x, fold, {sql_fold('key', 4, 'inner')} AS inner_fold FROM scored), ks AS (SELECT DISTINCT fold AS k FROM li), js AS (SELECT DISTINCT inner_fold AS j FROM li),
  al AS (SELECT unnest([1e0, 100e0, 1000e0]) AS alpha, generate_subscripts([1, 2, 3], 1) AS pos),
  m AS (SELECT k, j, count(*) AS n, avg(x) AS mx, avg(label) AS my, var_pop(x) AS v, covar_pop(x, label) AS c FROM li JOIN ks ON fold <> k JOIN js ON inner_fold <> j GROUP BY k, j),
  p AS (SELECT k, j, alpha, pos, n * c / (v * (n + alpha)) AS w1, my - n * c / (v * (n + alpha)) * mx AS w0 FROM m, al),
  sc AS (SELECT p.k, p.j, alpha, pos, sqrt(avg((label - w0 - w1 * x) * (label - w0 - w1 * x))) AS e FROM li JOIN p ON fold <> p.k AND inner_fold = p.j GROUP BY ALL),
  mean AS (SELECT k, alpha, pos, avg(e) AS e FROM sc GROUP BY ALL), best AS (SELECT k, alpha, e FROM mean QUALIFY row_number() OVER (PARTITION BY k ORDER BY e, pos) = 1)"""


def searched(t):
    rows = scored(t).select("key", "label", "text", "fold", fold_of("key", 4, "inner").alias("inner_fold"))
    return L.inner_cv_search(rows, ["text"], "label", "fold", "inner_fold", [1.0, 100.0, 1000.0])


@query("inner_cv_search", f"WITH {INNER} SELECT k AS fold, alpha, e AS inner_rmse FROM best", "alpha inner_rmse")
def _(t):
    return searched(t)[1]


@query(
    "inner_cv_predictions",
    f"""WITH {INNER}, f AS (SELECT k, count(*) AS n, avg(x) AS mx, avg(label) AS my, var_pop(x) AS v, covar_pop(x, label) AS c FROM li JOIN ks ON fold <> k GROUP BY k)
      SELECT key, fold, my + n * c / (v * (n + alpha)) * (x - mx) AS prediction FROM li JOIN f ON fold = f.k JOIN best ON fold = best.k""",
    "prediction",
)
def _(t):
    return searched(t)[0].select("key", "fold", "prediction")


@query(
    "training_rmse",
    f"""WITH {LINES}, w AS ({sql_ridge2('li', 'label', 500)}), e AS (SELECT k, label - w0 - w1 * quantity - w2 * discount AS e FROM li JOIN w ON fold <> k)
      SELECT CASE WHEN grouping(k) = 1 THEN 'pooled' ELSE 'fold' END AS scope, k AS fold, count(*) AS n, sqrt(avg(e * e)) AS training_rmse FROM e GROUP BY GROUPING SETS ((k), ())""",
    "training_rmse",
)
def _(t):
    return L.training_rmse(lines(t), ["quantity", "discount"], "label", "fold", 500.0)
