"""Blends, calibration and evaluation weights on scored rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from rubrica.operators import blend as B

from .base import SCORED, query, scored, sql_pearson, sql_rmse


def s(sql: str) -> str:
    return f"WITH {SCORED} {sql}"


@query("fixed_blend", s("SELECT key, text * 0.55e0 + audio * 0.45e0 AS prediction FROM scored"), "prediction", digits=9)
def _(t):
    rows = scored(t)
    return B.fixed_blend(rows.select("key", F.col("text").alias("prediction")), rows.select("key", F.col("audio").alias("prediction")), ["key"], 0.55)


P = "(w * text + (1 - w) * audio)"
GRID = s(f"""SELECT g.weight, g.scope, g.fold, g.n, g.rmse, g.pearson, g.rmse - b.rmse AS rmse_delta, g.pearson - b.pearson AS pearson_delta FROM
  (SELECT w AS weight, CASE WHEN grouping(fold) = 1 THEN 'pooled' ELSE 'fold' END AS scope, fold, count(*) AS n, {sql_rmse('label', P)} AS rmse, {sql_pearson(P, 'label')} AS pearson FROM scored, (SELECT unnest(range(10, 21)) / 20e0 AS w) GROUP BY GROUPING SETS ((w, fold), (w))) g
  JOIN (SELECT fold, {sql_rmse('label', 'text')} AS rmse, {sql_pearson('text', 'label')} AS pearson FROM scored GROUP BY GROUPING SETS ((fold), ())) b ON g.fold IS NOT DISTINCT FROM b.fold""")


def grid(t):
    return B.blend_grid(scored(t), "text", "audio", "label", "fold", [k / 20 for k in range(10, 21)])


@query("blend_grid", GRID, "weight rmse pearson rmse_delta pearson_delta")
def _(t):
    return grid(t)


@query(
    "blend_grid_summary",
    f"""WITH g AS ({GRID}), r AS (SELECT weight, max(rmse) FILTER (WHERE scope = 'pooled') AS rmse, max(pearson) FILTER (WHERE scope = 'pooled') AS pearson, count(*) FILTER (WHERE scope = 'fold' AND rmse_delta < -1e-12) AS folds_improving_rmse,
       count(*) FILTER (WHERE scope = 'fold' AND pearson_delta > 1e-12) AS folds_improving_pearson, max(rmse_delta) FILTER (WHERE scope = 'fold') AS worst_fold_rmse_delta, min(pearson_delta) FILTER (WHERE scope = 'fold') AS worst_fold_pearson_delta FROM g GROUP BY weight)
      SELECT *, rmse = min(rmse) OVER () AS best_by_rmse, pearson = max(pearson) OVER () AS best_by_pearson FROM r""",
    "weight rmse pearson worst_fold_rmse_delta worst_fold_pearson_delta",
)
def _(t):
    return B.blend_grid_summary(grid(t))


SIMPLEX = "SELECT i / 20e0 AS w1, j / 20e0 AS w2, (20 - i - j) / 20e0 AS w3, CAST(i * 21 + j AS BIGINT) AS code FROM (SELECT unnest(range(0, 21)) AS i), (SELECT unnest(range(0, 21)) AS j) WHERE i + j <= 20"


BEST = f"""gr AS ({SIMPLEX}), er AS (SELECT w1, w2, w3, code, sqrt(sum(size * pow(label - w1 * text - w2 * audio - w3 * voice, 2)) / sum(size)) AS e FROM scored, gr GROUP BY ALL)"""


@query("simplex_grid", s("").rstrip() + f", {BEST} SELECT code, w1, w2, w3, e AS weighted_rmse FROM er", "w1 w2 w3 weighted_rmse")
def _(t):
    return B.simplex_errors(scored(t), ["text", "audio", "voice"], "label", "size")


@query(
    "best_weights",
    s("").rstrip() + f", {BEST} SELECT w1 AS text, w2 AS audio, w3 AS voice, e AS weighted_rmse FROM er ORDER BY round(e, 9), code LIMIT 1",
    "text audio voice weighted_rmse",
)
def _(t):
    return B.best_weights_table(scored(t), ["text", "audio", "voice"], "label", "size")


@query(
    "nested_two_channel",
    s("").rstrip() + """, ks AS (SELECT DISTINCT fold AS k FROM scored), er AS (SELECT k, w, sqrt(avg(pow(label - (1 - w) * text - w * audio, 2))) AS e FROM scored JOIN ks ON fold <> k, (SELECT unnest(range(0, 15)) * 0.05e0 AS w) GROUP BY k, w),
      b AS (SELECT k, w FROM er QUALIFY row_number() OVER (PARTITION BY k ORDER BY round(e, 9), w) = 1) SELECT key, fold, (1 - w) * text + w * audio AS prediction FROM scored JOIN b ON fold = k""",
    "prediction",
    digits=8,
)
def _(t):
    return B.nested_two_channel(scored(t), "text", "audio", "label", "fold").select("key", "fold", "prediction")


@query(
    "affine_calibration",
    s("SELECT key, least(greatest(regr_intercept + regr_slope * text, 1), 5) AS calibrated FROM scored, (SELECT regr_intercept(label, text) AS regr_intercept, regr_slope(label, text) AS regr_slope FROM scored)"),
    "calibrated",
)
def _(t):
    rows = scored(t)
    return B.apply_calibration(rows, B.calibration_table(rows, "text", "label"), "text", 1.0, 5.0).select("key", "calibrated")


@query(
    "weighted_calibration",
    s("""SELECT my - slope * mx AS intercept, slope FROM (SELECT mx, my, sum(size * (text - mx) * (label - my)) / sum(size * (text - mx) * (text - mx)) AS slope
      FROM scored, (SELECT sum(size * text) / sum(size) AS mx, sum(size * label) / sum(size) AS my FROM scored) GROUP BY mx, my)"""),
    "intercept slope",
)
def _(t):
    return B.calibration_table(scored(t), "text", "label", "size")


CROSS = "SELECT k, regr_intercept(label, text) AS a, regr_slope(label, text) AS b FROM scored JOIN (SELECT DISTINCT fold AS k FROM scored) ON fold <> k GROUP BY k"


@query(
    "crossfit_calibration",
    s(f"SELECT key, fold, a + b * text AS calibrated, least(greatest(a + b * text, 1), 5) AS clipped FROM scored JOIN ({CROSS}) ON fold = k"),
    "calibrated clipped",
)
def _(t):
    raw = B.crossfit_calibration(scored(t), "text", "label", "fold")
    return B.crossfit_calibration(raw, "text", "label", "fold", 1.0, 5.0, "clipped").select("key", "fold", "calibrated", "clipped")


def nested_sql(where: str = "true") -> str:
    return f""", gr AS ({SIMPLEX}), rows_used AS (SELECT * FROM scored WHERE {where}), ks AS (SELECT DISTINCT fold AS k FROM rows_used),
  er AS (SELECT k, w1, w2, w3, code, sum(size * pow(label - w1 * text - w2 * audio - w3 * voice, 2)) / sum(size) AS e FROM rows_used JOIN ks ON fold <> k, gr GROUP BY ALL),
  best AS (SELECT * FROM er QUALIFY row_number() OVER (PARTITION BY k ORDER BY round(sqrt(e), 9), code) = 1),
  bl AS (SELECT k, w1, w2, w3, size, label, w1 * text + w2 * audio + w3 * voice AS b FROM rows_used JOIN best ON fold <> k),
  mn AS (SELECT k, sum(size * b) / sum(size) AS mb, sum(size * label) / sum(size) AS my FROM bl GROUP BY k),
  ln AS (SELECT bl.k, w1, w2, w3, sum(size * (b - mb) * (label - my)) / sum(size * (b - mb) * (b - mb)) AS slope, any_value(my) AS my, any_value(mb) AS mb FROM bl JOIN mn ON bl.k = mn.k GROUP BY bl.k, w1, w2, w3)"""


@query(
    "nested_blend",
    s("").rstrip() + nested_sql() + " SELECT key, fold, least(greatest(my - slope * mb + slope * (w1 * text + w2 * audio + w3 * voice), 1), 5) AS prediction FROM scored JOIN ln ON fold = k",
    "prediction",
)
def _(t):
    return B.nested_blend(scored(t), ["text", "audio", "voice"], "label", "fold", "size")[0].select("key", "fold", "prediction")


@query(
    "nested_blend_choices",
    s("").rstrip() + nested_sql() + " SELECT k AS fold, w1 AS text, w2 AS audio, w3 AS voice, my - slope * mb AS intercept, slope FROM ln",
    "text audio voice intercept slope",
)
def _(t):
    return B.nested_blend(scored(t), ["text", "audio", "voice"], "label", "fold", "size")[1]


@query(
    "nested_blend_masked",
    s("").rstrip() + nested_sql("kind <> 'PROMO'") + " SELECT key, fold, CASE WHEN kind <> 'PROMO' THEN least(greatest(my - slope * mb + slope * (w1 * text + w2 * audio + w3 * voice), 1), 5) END AS prediction FROM scored JOIN ln ON fold = k",
    "prediction",
)
def _(t):
    rows = scored(t).withColumn("mask", F.col("kind") != "PROMO")
    return B.nested_blend_masked(rows, ["text", "audio", "voice"], "label", "fold", "mask", "size").select("key", "fold", "prediction")


@query(
    "importance_weights",
    s("SELECT key, CASE WHEN size < 20 THEN 0.7e0 / sh ELSE 0.3e0 / (1 - sh) END AS weight FROM scored, (SELECT avg(CASE WHEN size < 20 THEN 1e0 ELSE 0e0 END) AS sh FROM scored WHERE kind <> 'PROMO')"),
    "weight",
)
def _(t):
    rows = scored(t).withColumn("short", F.col("size") < 20).withColumn("mask", F.col("kind") != "PROMO")
    return B.importance_weights(rows, "short", "mask", 0.7).select("key", "weight")


CELLS = """o AS (SELECT o_orderkey, o_custkey, o_orderstatus, 2 * (o_totalprice < 150000)::INT + (count(*) OVER (PARTITION BY o_custkey, o_orderstatus = 'P') > 1)::INT AS cell FROM orders)"""


def celled(t):
    rows = t.orders.withColumn("target", F.col("o_orderstatus") == "P")
    sizes = rows.groupBy("o_custkey", "target").agg(F.count("*").alias("n"))
    joined = rows.join(sizes, ["o_custkey", "target"])
    return joined.withColumn("cell", B.property_cells(joined, F.col("o_totalprice") < 150000, F.col("n") > 1))


@query("property_cells", f"WITH {CELLS} SELECT o_orderkey, CAST(cell AS BIGINT) AS cell FROM o")
def _(t):
    return celled(t).select("o_orderkey", "cell")


@query(
    "cell_weights",
    f"""WITH {CELLS}, h AS (SELECT cell, count(*) / sum(count(*)) OVER () AS have FROM o WHERE o_orderstatus <> 'P' GROUP BY cell), w AS (SELECT cell, count(*) / sum(count(*)) OVER () AS want FROM o WHERE o_orderstatus = 'P' GROUP BY cell)
      SELECT o_orderkey, CAST(o.cell AS BIGINT) AS cell, coalesce(want, 0) / have AS weight FROM o JOIN h ON h.cell = o.cell LEFT JOIN w ON w.cell = o.cell WHERE o_orderstatus <> 'P'""",
    "weight",
)
def _(t):
    rows = celled(t).select("o_orderkey", "target", "cell")
    return B.cell_weights(rows.where("NOT target"), rows.where("target"), "cell")[0].select("o_orderkey", "cell", "weight")


@query(
    "ensemble_report",
    s(f""", m AS (SELECT *, text * 0.9e0 + 0.2e0 AS second, (text + text * 0.9e0 + 0.2e0 + audio) / 3 AS mean FROM scored), k AS (SELECT k, regr_intercept(label, mean) AS a, regr_slope(label, mean) AS b FROM m JOIN (SELECT DISTINCT fold AS k FROM scored) ON fold <> k GROUP BY k),
       c AS (SELECT label, a + b * mean AS calibrated FROM m JOIN k ON fold = k.k) """
      + " UNION ALL ".join(
        f"SELECT '{n}' AS model, count(*) AS n, {sql_rmse('label', c)} AS rmse, {sql_pearson('label', c)} AS pearson FROM {tab}"
        for n, c, tab in (("text-a", "text", "m"), ("text-b", "second", "m"), ("audio-a", "audio", "m"), ("mean", "mean", "m"), ("mean_calibrated_cv", "calibrated", "c")))).replace("scored AS", "scored AS", 1),
    "rmse pearson",
)
def _(t):
    from rubrica.operators.metrics import run_report

    rows = scored(t).withColumn("second", F.col("text") * 0.9 + 0.2)
    rows = rows.withColumn("mean", (F.col("text") + F.col("second") + F.col("audio")) / 3)
    rows = B.crossfit_calibration(rows, "mean", "label", "fold")
    return run_report(rows, "label", {"text-a": "text", "text-b": "second", "audio-a": "audio", "mean": "mean", "mean_calibrated_cv": "calibrated"})
