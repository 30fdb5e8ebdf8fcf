"""Metrics, error reports and comparisons on scored rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from rubrica.operators import comparison as C
from rubrica.operators import folds as FO
from rubrica.operators import metrics as M

from .base import SCORED, fold_of, query, scored, sql_fold, sql_pearson, sql_rmse


def s(sql: str) -> str:
    return f"WITH {SCORED} {sql}"


MEAN_OOF = f"""part_folds AS (SELECT p_partkey AS key, p_retailprice AS label, {sql_fold('p_partkey')} AS fold FROM part),
sums AS (SELECT fold, sum(label) AS s, count(*) AS n FROM part_folds GROUP BY fold),
params AS (SELECT fold, (sum(s) OVER () - s) / (sum(n) OVER () - n) AS prediction FROM sums),
oof AS (SELECT key, label, f.fold, prediction FROM part_folds f JOIN params p ON f.fold = p.fold)"""


def part_folds(t):
    return t.part.select(
        F.col("p_partkey").alias("key"),
        F.col("p_retailprice").alias("label"),
        fold_of("p_partkey").alias("fold"),
    )


@query(
    "oof_regression_metrics",
    f"""WITH {MEAN_OOF}
    SELECT CASE WHEN grouping(fold) = 1 THEN 'pooled' ELSE 'fold' END AS scope, fold, count(*) AS n,
      {sql_rmse('label', 'prediction')} AS rmse,
      CASE WHEN grouping(fold) = 1 THEN {sql_pearson('label', 'prediction')} END AS pearson
    FROM oof GROUP BY GROUPING SETS ((fold), ())""",
    "rmse pearson",
)
def _(t):
    oof = FO.mean_baseline_oof(part_folds(t))
    return M.regression_metrics(oof)


METRIC_COLUMNS = f"count(*) AS n, {sql_rmse('label', 'text')} AS rmse, {sql_pearson('label', 'text')} AS pearson"


@query("rmse", s(f"SELECT {sql_rmse('label', 'text')} AS rmse FROM scored"), "rmse")
def _(t):
    from rubrica.functions.numeric import rmse

    return scored(t).agg(rmse("label", "text").alias("rmse"))


@query(
    "pearson",
    s(f"SELECT kind, {sql_pearson('label', 'text')} AS pearson, CAST(NULL AS DOUBLE) AS constant FROM scored GROUP BY kind"),
    "pearson constant",
)
def _(t):
    from rubrica.functions.numeric import pearson

    return scored(t).groupBy("kind").agg(
        pearson("label", "text").alias("pearson"), pearson("label", F.lit(2.0)).alias("constant")
    )


@query(
    "regression_metrics",
    s(f"SELECT CASE WHEN grouping(fold) = 1 THEN 'pooled' ELSE 'fold' END AS scope, fold, {METRIC_COLUMNS} FROM scored GROUP BY GROUPING SETS ((fold), ())"),
    "rmse pearson",
)
def _(t):
    return M.regression_metrics(scored(t), "label", "text")


@query(
    "weighted_rmse",
    s("SELECT fold, count(*) AS n, sqrt(sum(size * (label - text) * (label - text)) / sum(size)) AS weighted_rmse FROM scored GROUP BY fold"),
    "weighted_rmse",
)
def _(t):
    return M.weighted_error(scored(t), "label", "text", "size", ["fold"])


@query(
    "fold_summary",
    s("SELECT fold, count(*) AS n, avg(label) AS mean, stddev_pop(label) AS std, quantile_cont(label, 0.5) AS median, min(label) AS min, max(label) AS max FROM scored GROUP BY fold"),
    "mean std median min max",
)
def _(t):
    return M.fold_summary(scored(t))


@query(
    "score_diagnostics",
    s(f"""SELECT label, count(*) AS n, avg(text) AS prediction_mean, stddev_pop(text) AS prediction_std,
      min(text) AS prediction_min, max(text) AS prediction_max, avg(text - label) AS mean_signed_error,
      avg(abs(text - label)) AS mae, {sql_rmse('label', 'text')} AS rmse FROM scored GROUP BY label"""),
    "label prediction_mean prediction_std prediction_min prediction_max mean_signed_error mae rmse",
)
def _(t):
    return M.score_diagnostics(scored(t), "label", "text")


BAND = f"""{sql_rmse('label', 'text')} AS rmse, {sql_pearson('label', 'text')} AS pearson, avg(abs(text - label)) AS mae,
 avg(text) AS mean_prediction, avg(label) AS mean_target, avg(text - label) AS mean_signed_error"""


@query(
    "score_bands",
    s(f"""SELECT scheme || ':' || b.band AS band, count(key) AS n, {BAND}
      FROM (VALUES ('open', 'low'), ('open', 'mid'), ('open', 'high'), ('open', 'none'), ('closed', 'LOW'), ('closed', 'MID'), ('closed', 'HIGH')) b(scheme, band)
      LEFT JOIN (
        SELECT *, CASE WHEN label < 3 THEN 'low' WHEN label < 4 THEN 'mid' ELSE 'high' END AS band FROM scored
        UNION ALL
        SELECT *, CASE WHEN label <= 2 THEN 'LOW' WHEN label BETWEEN 2.5 AND 4 THEN 'MID' WHEN label >= 4.5 THEN 'HIGH' END AS band FROM scored) x
      ON x.band = b.band GROUP BY scheme, b.band"""),
    "rmse pearson mae mean_prediction mean_target mean_signed_error",
)
def _(t):
    rows = scored(t)
    first = M.band_report(rows, M.open_band("label"), ["low", "mid", "high", "none"], "label", "text")
    second = M.band_report(rows, M.closed_band("label"), ["LOW", "MID", "HIGH"], "label", "text")
    return first.withColumn("band", F.concat(F.lit("open:"), "band")).unionByName(
        second.withColumn("band", F.concat(F.lit("closed:"), "band"))
    )


CUT = "CASE " + " ".join(
    f"WHEN label > {a} AND label <= {b} THEN '{n}'"
    for a, b, n in zip(M.SCORE_CUTS[:-1], M.SCORE_CUTS[1:], M.SCORE_CUT_NAMES)
) + " END"


@query(
    "residual_by_cut",
    s(f"SELECT band, avg(text - label) AS mean_residual, count(*) AS n FROM (SELECT *, {CUT} AS band FROM scored) WHERE band IS NOT NULL GROUP BY band"),
    "mean_residual",
)
def _(t):
    return M.residual_by_cut(scored(t), "label", "text")


@query(
    "subset_metrics",
    s(f"""SELECT subset, count(*) AS n, {sql_rmse('label', 'text')} AS rmse_text, {sql_rmse('label', 'voice')} AS rmse_voice, avg(voice - label) AS mean_error
      FROM (SELECT 'short' AS subset, * FROM scored WHERE size < 20 UNION ALL SELECT 'long', * FROM scored WHERE size >= 20
        UNION ALL SELECT 'short_promo', * FROM scored WHERE size < 20 AND kind = 'PROMO' UNION ALL SELECT 'all', * FROM scored) GROUP BY subset"""),
    "rmse_text rmse_voice mean_error",
)
def _(t):
    short = F.col("size") < 20
    return M.subset_metrics(
        scored(t),
        {"short": short, "long": ~short, "short_promo": short & (F.col("kind") == "PROMO"), "all": F.lit(True)},
        "label",
        ["text", "voice"],
    )


COMPARE = s(f"""SELECT scope, fold, band, n, old_rmse, new_rmse, old_pearson, new_pearson, mean_old, mean_new,
   new_rmse - old_rmse AS rmse_delta, 100 * (new_rmse - old_rmse) / nullif(old_rmse, 0) AS rmse_change_percent, new_pearson - old_pearson AS pearson_delta
 FROM (SELECT CASE WHEN grouping(fold) = 0 THEN 'fold' WHEN grouping(band) = 0 THEN 'band' ELSE 'pooled' END AS scope, fold, band, count(*) AS n,
     {sql_rmse('label', 'text')} AS old_rmse, {sql_rmse('label', 'voice')} AS new_rmse, {sql_pearson('label', 'text')} AS old_pearson,
     {sql_pearson('label', 'voice')} AS new_pearson, avg(text) AS mean_old, avg(voice) AS mean_new
   FROM (SELECT *, CASE WHEN label < 3 THEN 'low' WHEN label < 4 THEN 'mid' ELSE 'high' END AS band FROM scored)
   GROUP BY GROUPING SETS ((), (fold), (band)))""")


@query(
    "paired_comparison",
    COMPARE,
    "old_rmse new_rmse old_pearson new_pearson mean_old mean_new rmse_delta rmse_change_percent pearson_delta",
)
def _(t):
    return C.paired_comparison(scored(t), "label", "text", "voice")


@query(
    "improving_folds",
    f"""SELECT CAST(count(*) FILTER (WHERE rmse_delta < 0) AS BIGINT) AS folds_improving_rmse, count(*) FILTER (WHERE pearson_delta > 0) AS folds_improving_pearson,
     count(*) FILTER (WHERE rmse_delta < 0 AND pearson_delta > 0) AS folds_improving_both FROM ({COMPARE}) WHERE scope = 'fold'""",
)
def _(t):
    return C.improving_folds(C.paired_comparison(scored(t), "label", "text", "voice"))


@query(
    "win_rate",
    s("SELECT count(*) AS n, count(*) FILTER (WHERE abs(label - voice) < abs(label - text)) AS wins, avg(CASE WHEN abs(label - voice) < abs(label - text) THEN 1e0 ELSE 0e0 END) AS win_rate FROM scored"),
    "win_rate",
)
def _(t):
    return C.win_rate(scored(t), "label", "text", "voice")


EXTREME = "key, label - text AS old_residual, label - voice AS new_residual, abs(label - text) AS old_abs_error, abs(label - voice) AS new_abs_error, abs(label - text) - abs(label - voice) AS improvement"


@query(
    "error_extremes",
    s(f"""SELECT * FROM (SELECT {EXTREME}, 'improvement' AS kind FROM scored ORDER BY improvement DESC, key LIMIT 20)
      UNION ALL SELECT * FROM (SELECT {EXTREME}, 'deterioration' AS kind FROM scored ORDER BY improvement ASC, key LIMIT 20)"""),
    "old_residual new_residual old_abs_error new_abs_error improvement",
)
def _(t):
    errors = C.paired_errors(scored(t), "label", "text", "voice").select(
        "key", "old_residual", "new_residual", "old_abs_error", "new_abs_error", "improvement"
    )
    return C.error_extremes(errors, "key")


@query(
    "complementarity",
    s(f"""SELECT CASE WHEN grouping(fold) = 1 THEN 'pooled' ELSE 'fold' END AS scope, fold, count(*) AS n, {sql_pearson('text', 'audio')} AS prediction_correlation,
      {sql_pearson('(label - text)', '(label - audio)')} AS residual_correlation FROM scored GROUP BY GROUPING SETS ((fold), ())"""),
    "prediction_correlation residual_correlation",
)
def _(t):
    return M.complementarity(scored(t), "label", "text", "audio")


PAIRS = [("text", "audio"), ("text", "voice"), ("audio", "voice")]


@query(
    "pairwise_oof_correlation",
    s(" UNION ALL ".join(
        f"SELECT '{a}' AS first, '{b}' AS second, {sql_pearson(a, b)} AS prediction_correlation, {sql_pearson(f'(label - {a})', f'(label - {b})')} AS residual_correlation FROM scored"
        for a, b in PAIRS)),
    "prediction_correlation residual_correlation",
)
def _(t):
    return M.pairwise_model_correlations(scored(t), "label", ["text", "audio", "voice"])


@query(
    "channel_correlation_matrix",
    s(" UNION ALL ".join(
        f"SELECT '{a}' AS first, '{b}' AS second, {sql_pearson(a, b)} AS pearson FROM scored"
        for a in ("text", "audio", "voice") for b in ("text", "audio", "voice"))),
    "pearson",
)
def _(t):
    return M.column_correlations(scored(t), ["text", "audio", "voice"])


@query(
    "classify_candidate",
    s(f"""SELECT kind, rmse, pearson, CASE WHEN rmse < ref_rmse - 1e-12 AND pearson > ref_pearson + 1e-12 THEN 'dominates'
        WHEN rmse < ref_rmse - 1e-12 OR pearson > ref_pearson + 1e-12 THEN 'tradeoff' ELSE 'worse' END AS verdict
      FROM (SELECT kind, {sql_rmse('label', 'text')} AS ref_rmse, {sql_pearson('label', 'text')} AS ref_pearson,
        {sql_rmse('label', 'audio')} AS rmse, {sql_pearson('label', 'audio')} AS pearson FROM scored GROUP BY kind)"""),
    "rmse pearson",
)
def _(t):
    from rubrica.functions.numeric import pearson, rmse

    per_kind = scored(t).groupBy("kind").agg(
        rmse("label", "text").alias("ref_rmse"),
        pearson("label", "text").alias("ref_pearson"),
        rmse("label", "audio").alias("rmse"),
        pearson("label", "audio").alias("pearson"),
    )
    verdict = C.classify(F.col("rmse"), F.col("pearson"), F.col("ref_rmse"), F.col("ref_pearson"))
    return per_kind.select("kind", "rmse", "pearson", verdict.alias("verdict"))


@query(
    "acceptance_gate",
    f"""SELECT max(new_rmse) FILTER (WHERE scope = 'pooled') AS new_rmse, max(new_pearson) FILTER (WHERE scope = 'pooled') AS new_pearson,
      count(*) FILTER (WHERE scope = 'fold' AND rmse_delta < 0) AS folds_improving_rmse,
      max(new_rmse) FILTER (WHERE scope = 'pooled') <= 0.9 AND max(new_pearson) FILTER (WHERE scope = 'pooled') >= 0.9
        AND count(*) FILTER (WHERE scope = 'fold' AND rmse_delta < 0) >= 4 AS accepted FROM ({COMPARE})""",
    "new_rmse new_pearson",
)
def _(t):
    return C.acceptance_gate(C.paired_comparison(scored(t), "label", "text", "voice"), 0.9, 0.9, 4)


@query(
    "reference_deviation",
    s(f"""SELECT fold, value, reference, value - reference AS delta, abs(value - reference) > 0.01 AS material
      FROM (SELECT fold, {sql_rmse('label', 'text')} AS value, {sql_rmse('label', 'voice')} AS reference FROM scored GROUP BY fold)"""),
    "value reference delta",
)
def _(t):
    rows = scored(t)
    value = M.regression_metrics(rows, "label", "text").where("scope = 'fold'").select("fold", F.col("rmse").alias("value"))
    stored = M.regression_metrics(rows, "label", "voice").where("scope = 'fold'").select("fold", F.col("rmse").alias("reference"))
    return M.reference_deviation(value, stored, ["fold"], 0.01)


@query(
    "prediction_distribution",
    s("""SELECT count(*) AS n, min(p) AS min, max(p) AS max, avg(p) AS mean, stddev_pop(p) AS std, count(*) FILTER (WHERE p < 0) AS below,
      count(*) FILTER (WHERE p > 5) AS above, count(*) FILTER (WHERE p < 0 OR p > 5) AS clipped FROM (SELECT text * 1.5e0 - 1 AS p FROM scored)"""),
    "min max mean std",
)
def _(t):
    return M.prediction_distribution(scored(t).select((F.col("text") * 1.5 - 1).alias("p")), "p")


@query(
    "best_epoch",
    s("""SELECT fold, arg_min(epoch, metric * 1000 + epoch) AS best_epoch, min(metric) AS best_metric
      FROM (SELECT fold, CAST(size AS BIGINT) AS epoch, min(CAST(label AS DOUBLE)) + floor(avg(text)) AS metric FROM scored GROUP BY ALL) GROUP BY fold"""),
    "best_metric",
)
def _(t):
    history = scored(t).groupBy("fold", F.col("size").cast("bigint").alias("epoch")).agg(
        (F.min("label") + F.floor(F.avg("text"))).cast("double").alias("metric")
    )
    return M.best_epoch(history, "fold", "epoch", "metric")


RUNS = s("""SELECT key, 'text-a' AS run, 'text' AS family, text AS prediction FROM scored
  UNION ALL SELECT key, 'text-b', 'text', text * 0.9e0 + 0.2e0 FROM scored UNION ALL SELECT key, 'audio-a', 'audio', audio FROM scored""")


def runs(t):
    rows = scored(t)
    base = rows.select("key", "label", "fold", F.explode(F.array(
        F.struct(F.lit("text-a").alias("run"), F.lit("text").alias("family"), F.col("text").alias("prediction")),
        F.struct(F.lit("text-b").alias("run"), F.lit("text").alias("family"), (F.col("text") * 0.9 + 0.2).alias("prediction")),
        F.struct(F.lit("audio-a").alias("run"), F.lit("audio").alias("family"), F.col("audio").alias("prediction")),
    )).alias("r"))
    return base.select("key", "label", "fold", "r.*")


@query(
    "seed_group_mean",
    f"SELECT key, avg(p) AS prediction FROM (SELECT key, family, avg(prediction) AS p FROM ({RUNS}) GROUP BY key, family) GROUP BY key",
    "prediction",
    digits=9,
)
def _(t):
    return M.seed_group_mean(runs(t), ["key"], "family", "prediction")


@query(
    "pairwise_combinations",
    "SELECT a.p_type AS first, b.p_type AS second FROM (SELECT DISTINCT p_type FROM part) a JOIN (SELECT DISTINCT p_type FROM part) b ON a.p_type < b.p_type",
)
def _(t):
    return M.pairwise_combinations(t.part, "p_type")


@query(
    "union_frames",
    "SELECT 'customer' AS split, c_custkey AS key, c_acctbal AS balance FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal FROM supplier",
    "balance",
)
def _(t):
    from rubrica.operators.alignment import union_frames

    return union_frames({
        "customer": t.customer.select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance")),
        "supplier": t.supplier.select(F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("key")),
    })


@query(
    "topk_rows",
    s("SELECT key, label, text, abs(label - text) AS absolute FROM scored ORDER BY absolute DESC, key LIMIT 10"),
    "label text absolute",
)
def _(t):
    rows = scored(t).select("key", "label", "text", F.abs(F.col("label") - F.col("text")).alias("absolute"))
    return M.topk_rows(rows, F.col("absolute"), 10, ["key"])


@query(
    "first_n_per_partition",
    s("SELECT fold, key, rank FROM (SELECT fold, key, CAST(row_number() OVER (PARTITION BY fold ORDER BY key) AS INTEGER) AS rank FROM scored) WHERE rank <= 16"),
)
def _(t):
    return M.first_n_per_partition(scored(t).select("fold", "key"), "fold", ["key"], 16)


@query(
    "label_frequencies",
    s("SELECT label, count(*) AS n, CAST(least(floor(label / 0.5e0), 9) AS BIGINT) AS bin FROM scored GROUP BY label"),
    "label",
)
def _(t):
    return M.label_frequencies(scored(t), "label", 0.0, 5.0, 10)


@query(
    "label_describe",
    """SELECT o_orderstatus, count(*) AS n, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS min, max(v) AS max, quantile_cont(v, 0.25) AS p25,
      quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS p75 FROM (SELECT o_orderstatus, o_totalprice / 1000 AS v FROM orders) GROUP BY o_orderstatus""",
    "mean std min max p25 median p75",
)
def _(t):
    return M.describe(t.orders.select("o_orderstatus", (F.col("o_totalprice") / 1000).alias("v")), "v", ["o_orderstatus"])


@query(
    "label_duration_stats",
    s("SELECT label, count(*) AS n, avg(size) AS mean, quantile_cont(size, 0.5) AS median, stddev_samp(size) AS std FROM scored GROUP BY label"),
    "label mean median std",
)
def _(t):
    return M.label_value_stats(scored(t), "label", "size")


@query(
    "label_subset_stats",
    s("""SELECT label, count(*) AS n, avg(size) AS mean, count(*) FILTER (WHERE size < 10) AS subset_n, avg(size) FILTER (WHERE size < 10) AS subset_mean,
      count(*) / (SELECT count(*) FROM scored) AS share, count(*) FILTER (WHERE size < 10) / (SELECT count(*) FROM scored WHERE size < 10) AS subset_share FROM scored GROUP BY label"""),
    "label mean subset_mean share subset_share",
)
def _(t):
    return M.label_subset_stats(scored(t), "label", "size", F.col("size") < 10)


@query("shared_keys", "SELECT o_custkey, count(DISTINCT o_orderpriority) AS parts FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) > 1")
def _(t):
    return M.shared_keys(t.orders, "o_orderpriority", ["o_custkey"])


@query(
    "group_spread",
    """SELECT count(*) AS groups, count(*) FILTER (WHERE n > 1) AS repeated_groups, max(n) AS largest_group, avg(sd) FILTER (WHERE n > 1) AS mean_within_std,
      (SELECT stddev_pop(o_totalprice / 1000) FROM orders) AS overall_std
      FROM (SELECT o_custkey, count(*) AS n, stddev_pop(o_totalprice / 1000) AS sd FROM orders GROUP BY o_custkey)""",
    "mean_within_std overall_std",
)
def _(t):
    rows = t.orders.select("o_custkey", (F.col("o_totalprice") / 1000).alias("v"))
    return M.group_spread(rows, "o_custkey", "v")


@query(
    "mix_shares",
    """SELECT CASE WHEN c_custkey < 1000 THEN 'train' ELSE 'test' END AS split, count(*) AS n, avg(CASE WHEN c_acctbal < 1000 THEN 1e0 ELSE 0e0 END) AS short,
      avg(CASE WHEN c_mktsegment = 'BUILDING' THEN 1e0 ELSE 0e0 END) AS building FROM customer GROUP BY 1""",
    "short building",
)
def _(t):
    rows = t.customer.withColumn("split", F.when(F.col("c_custkey") < 1000, "train").otherwise("test"))
    return M.mix_shares(rows, "split", {"short": F.col("c_acctbal") < 1000, "building": F.col("c_mktsegment") == "BUILDING"})

