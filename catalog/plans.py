"""Composed plans: the honest blend and the studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from rubrica.functions.numeric import hash_int
from rubrica.plans import honest_blend as H
from rubrica.plans import studies as S

from .base import SCORED, query, scored, sql_pearson, sql_rmse
from .models import LINES, lines, sql_ridge2


def honest(t):
    """Embeddings as recordings: two feature views, two noisy text runs, a target fifth."""
    noise = lambda salt: (hash_int(F.lit(salt), "vec_id") % 1000) / 250.0
    y = F.col("label") / 2.0 + 0.5
    rows = t.embeddings.select(
        "vec_id", "embedding", y.alias("y"),
        (y * 0.6 + noise("a") * 0.4).alias("run_a"), (y * 0.5 + noise("b") * 0.5).alias("run_b"),
        F.slice("embedding", 1, 32).alias("low"), F.slice("embedding", 33, 32).alias("high"),
        (hash_int(F.lit("short"), "vec_id") % 3 == 0).alias("short"), (hash_int(F.lit("split"), "vec_id") % 5 == 0).alias("is_target"),
    )
    return H.run(
        rows.where("NOT is_target").drop("is_target"), rows.where("is_target").drop("is_target", "y"), "vec_id", "y", ("embedding", 64), 0.42,
        ["run_a", "run_b"], [H.Channel("audio", [("low", 32), ("high", 32)], 1000.0), H.Channel("speech", [("embedding", 64)], 3000.0)], "short",
    )


@query("honest_blend_report")
def _(t):
    return honest(t).report


@query("honest_blend_oof")
def _(t):
    return honest(t).oof.select("vec_id", "y", "fold", "group", "weight", "text", "audio", "speech", "prediction")


@query(
    "baseline_study",
    f"""WITH {LINES}, al AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN 'test' ELSE 'train' END AS split FROM li), tr AS (SELECT * FROM al WHERE split = 'train'), w AS ({sql_ridge2('tr', 'label', 500)}),
      o AS (SELECT label, base, fold, w0 + w1 * quantity + w2 * discount AS p FROM tr JOIN w ON fold = k), e AS (SELECT k, label - w0 - w1 * quantity - w2 * discount AS e FROM tr JOIN w ON fold <> k),
      m AS (SELECT coalesce(CAST(fold AS VARCHAR), 'pooled') AS name, {sql_rmse('label', 'p')} AS rmse, {sql_pearson('label', 'p')} AS pearson, {sql_pearson('base', 'p')} AS pc, {sql_pearson('(label - base)', '(label - p)')} AS rc FROM o GROUP BY GROUPING SETS ((fold), ())),
      te AS (SELECT coalesce(CAST(k AS VARCHAR), 'pooled') AS name, sqrt(avg(e * e)) AS v FROM e GROUP BY GROUPING SETS ((k), ())),
      b AS (SELECT w, {sql_rmse('label', '(w * base + (1 - w) * p)')} AS rmse, {sql_pearson('label', '(w * base + (1 - w) * p)')} AS pearson FROM o, (SELECT unnest(range(10, 21)) / 20e0 AS w) GROUP BY w),
      d AS ({" UNION ALL ".join(f"SELECT '{c}' AS name, (avg({c}) FILTER (WHERE split = 'test') - avg({c}) FILTER (WHERE split = 'train')) / sqrt((var_pop({c}) FILTER (WHERE split = 'train') + var_pop({c}) FILTER (WHERE split = 'test')) / 2) AS v FROM al" for c in ("quantity", "discount"))})
      SELECT 'oof' AS section, name, 'rmse' AS metric, rmse AS value FROM m UNION ALL SELECT 'oof', name, 'pearson', pearson FROM m UNION ALL SELECT 'complementarity', name, 'prediction_correlation', pc FROM m
      UNION ALL SELECT 'complementarity', name, 'residual_correlation', rc FROM m UNION ALL SELECT 'training', name, 'training_rmse', v FROM te UNION ALL SELECT 'drift', name, 'smd', v FROM d
      UNION ALL SELECT 'blend', printf('%.2f', w), 'rmse', rmse FROM b UNION ALL SELECT 'blend', printf('%.2f', w), 'pearson', pearson FROM b""",
    "value",
)
def _(t):
    rows = lines(t).withColumn("split", F.when(F.col("l_returnflag") == "R", "test").otherwise("train"))
    return S.baseline_study(rows, ["quantity", "discount"], "label", "base", "fold", "split", 500.0, [k / 20 for k in range(10, 21)])


ABLATION = """k AS (SELECT DISTINCT fold AS k FROM scored), a AS (SELECT k, avg(label) AS m FROM scored JOIN k ON fold <> k GROUP BY k), b AS (SELECT k, avg(label) AS m FROM scored JOIN k ON fold <> k WHERE label > 0 GROUP BY k),
  j AS (SELECT s.fold, s.label, a.m AS old, b.m AS new FROM scored s JOIN a ON a.k = s.fold JOIN b ON b.k = s.fold WHERE label > 0)"""


@query(
    "population_ablation",
    f"""WITH {SCORED}, {ABLATION} SELECT CASE WHEN grouping(fold) = 1 THEN 'pooled' ELSE 'fold' END AS scope, fold, count(*) AS n, {sql_rmse('label', 'old')} AS old_rmse, {sql_rmse('label', 'new')} AS new_rmse,
      {sql_rmse('label', 'new')} - {sql_rmse('label', 'old')} AS rmse_delta FROM j GROUP BY GROUPING SETS ((fold), ())""",
    "old_rmse new_rmse rmse_delta",
)
def _(t):
    return S.population_ablation(scored(t), F.col("label") > 0, "label", "fold", "key")


OTHERS = ["audio", "voice"]
CANDIDATES = (
    [("text", "raw", "text")]
    + [(o, "raw", o) for o in OTHERS]
    + [("text_clipped", "clipping", "least(greatest(text, 0), 5)"), ("text_calibrated", "crossfit", "ca"), ("text_calibrated_clipped", "crossfit", "least(greatest(ca, 0), 5)")]
    + [(f"text_{o}_w{k / 20:.2f}", "fixed_grid", f"(text * {k / 20}e0 + {o} * {1 - k / 20}e0)") for o in OTHERS for k in range(21)]
    + [x for o in OTHERS for x in ((f"text_{o}_learned", "crossfit", f"l_{o}"), (f"text_{o}_learned_clipped", "crossfit", f"least(greatest(l_{o}, 0), 5)"))]
)


@query(
    "oof_candidate_study",
    f"""WITH {SCORED}, cal AS (SELECT k, regr_intercept(label, text) AS a, regr_slope(label, text) AS b FROM scored JOIN (SELECT DISTINCT fold AS k FROM scored) ON fold <> k GROUP BY k),
      """ + ", ".join(f"w_{o} AS ({sql_ridge2('scored', 'label', 0, 'text', o)})" for o in OTHERS)
    + ", rows AS (SELECT s.*, a + b * text AS ca, " + ", ".join(f"w_{o}.w0 + w_{o}.w1 * text + w_{o}.w2 * {o} AS l_{o}" for o in OTHERS)
    + " FROM scored s JOIN cal ON s.fold = cal.k " + " ".join(f"JOIN w_{o} ON s.fold = w_{o}.k" for o in OTHERS) + "), c AS ("
    + " UNION ALL ".join(f"SELECT '{n}' AS candidate, '{kind}' AS kind, {sql_rmse('label', e)} AS rmse, {sql_pearson('label', e)} AS pearson FROM rows" for n, kind, e in CANDIDATES)
    + "), r AS (SELECT rmse AS r0, pearson AS p0 FROM c WHERE candidate = 'text') SELECT candidate, kind, rmse, pearson, CASE WHEN rmse < r0 - 1e-9 AND pearson > p0 + 1e-9 THEN 'dominates' WHEN rmse < r0 - 1e-9 OR pearson > p0 + 1e-9 THEN 'tradeoff' ELSE 'worse' END AS verdict FROM c, r",
    "rmse pearson",
)
def _(t):
    return S.candidate_study(scored(t), "label", "fold", "text", OTHERS)
