"""Vector pooling, similarity groups and nearest matches on embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from rubrica.operators import similarity as S
from rubrica.operators import vectors as V

from .base import SCORED, query, scored

D = 64
TALL = "e AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)"
THRESHOLD = 0.42


def tall(df, key, vector="vector", name="value"):
    return df.select(*key, F.posexplode(vector).alias("dim", name)).withColumn("dim", F.col("dim").cast("bigint"))


@query(
    "masked_mean_pool",
    f"WITH {TALL} SELECT label, dim, coalesce(avg(x) FILTER (WHERE vec_id % 3 <> 0), 0) AS value FROM e GROUP BY label, dim",
    "value",
)
def _(t):
    return tall(V.masked_mean_pool(t.embeddings, ["label"], "embedding", F.col("vec_id") % 3 != 0, D), ["label"])


@query(
    "weighted_vector_mean",
    f"WITH {TALL} SELECT label, dim, sum(x * (vec_id % 7 + 1)) / sum(vec_id % 7 + 1) AS value FROM e GROUP BY label, dim",
    "value",
)
def _(t):
    return tall(V.weighted_vector_mean(t.embeddings, ["label"], "embedding", F.col("vec_id") % 7 + 1, D), ["label"])


@query(
    "layer_stats",
    f"WITH {TALL} SELECT label, count(*) AS frames, dim, avg(x) AS mean, sqrt(greatest(avg(x * x) - avg(x) * avg(x), 0)) AS std FROM e GROUP BY label, dim",
    "mean std",
)
def _(t):
    stats = V.layer_stats(t.embeddings, ["label"], "embedding", D)
    return stats.select(
        "label", "frames", F.posexplode(F.arrays_zip("mean", "std")).alias("dim", "s")
    ).select("label", "frames", F.col("dim").cast("bigint").alias("dim"), "s.mean", "s.std")


@query(
    "unit_mean",
    f"""WITH {TALL}, u AS (SELECT label, dim, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS x FROM e), m AS (SELECT label, dim, avg(x) AS x FROM u GROUP BY label, dim)
      SELECT label, dim, x / sqrt(sum(x * x) OVER (PARTITION BY label)) AS value FROM m""",
    "value",
)
def _(t):
    return tall(V.unit_mean(t.embeddings, ["label"], "embedding", D), ["label"])


CENTRED = f"""{TALL}, c AS (SELECT dim, avg(x) AS m FROM e GROUP BY dim), s AS (SELECT vec_id, label, e.dim, x - m AS x FROM e JOIN c ON c.dim = e.dim),
  units AS (SELECT vec_id, label, list(x / n ORDER BY dim) AS u FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS n FROM s) GROUP BY vec_id, label),
  near AS (SELECT a.vec_id AS a, b.vec_id AS b FROM units a JOIN units b ON a.vec_id < b.vec_id AND list_dot_product(a.u, b.u) > {THRESHOLD}),
  links AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near)"""


@query(
    "similarity_groups",
    f"""WITH RECURSIVE {CENTRED}, reach(node, root) AS (SELECT vec_id, vec_id FROM units UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node WHERE r.root < l.b)
      SELECT node AS vec_id, min(root) AS "group" FROM reach GROUP BY node""",
)
def _(t):
    return S.similarity_groups(t.embeddings, "vec_id", "embedding", t.embeddings, D, THRESHOLD)


@query("has_partner", f"WITH {CENTRED} SELECT vec_id, vec_id IN (SELECT a FROM links) AS has_partner FROM units")
def _(t):
    return S.has_partner(S.similarity_groups(t.embeddings, "vec_id", "embedding", t.embeddings, D, THRESHOLD), "vec_id")


@query(
    "nearest_match",
    f"""WITH {CENTRED}, d AS (SELECT a.vec_id, b.vec_id AS match, list_dot_product(a.u, b.u) AS cosine, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.u, b.u) DESC, b.vec_id) AS r
        FROM units a JOIN units b ON a.vec_id % 4 = 0 AND b.vec_id % 4 <> 0)
      SELECT vec_id, match, cosine, cosine > {THRESHOLD} AS above FROM d WHERE r = 1""",
    "cosine",
)
def _(t):
    units = V.centred_units(t.embeddings, "embedding", t.embeddings, D).select("vec_id", "unit")
    left, right = units.where("vec_id % 4 = 0"), units.where("vec_id % 4 <> 0")
    return S.nearest_match(left, right, "vec_id", "unit").withColumn("above", F.col("cosine") > THRESHOLD)


@query(
    "view_average",
    f"WITH {SCORED} SELECT key, (text + audio + voice) / 3 AS prediction FROM scored",
    "prediction",
    digits=9,
)
def _(t):
    views = scored(t).select("key", F.explode(F.array("text", "audio", "voice")).alias("prediction"))
    return V.view_average(views, ["key"])
