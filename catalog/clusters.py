"""Clusters of embeddings and their scores."""

from pyspark.sql import functions as F

from catalog.tables import table
from topictide.operators import cluster

QUERIES, ORACLES = {}, {}
# The unit vectors have no close groups; at this distance there are clusters, border and noise.
EPS, MIN_SIZE = 1.15, 4


def _vectors(spark, folder):
    return table(spark, folder, "embeddings")


QUERIES["density_cluster"] = lambda spark, folder: cluster.density_cluster(
    _vectors(spark, folder), "vec_id", "embedding", EPS, MIN_SIZE
)
ORACLES["density_cluster"] = f"""
    WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
    near AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
             ON list_distance(a.x, b.x) <= {EPS}),
    core AS (SELECT a FROM near GROUP BY a HAVING count(*) >= {MIN_SIZE}),
    link AS (SELECT a, b FROM near WHERE a IN (FROM core) AND b IN (FROM core)),
    reach(a, z) AS (SELECT a, a FROM core
                    UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.z),
    named AS (SELECT a, min(z) AS name FROM reach GROUP BY a),
    found AS (SELECT near.a, CASE WHEN near.a IN (FROM core)
                     THEN min(CASE WHEN near.a = near.b THEN name END) ELSE min(name) END AS name
              FROM near JOIN named ON named.a = near.b GROUP BY near.a)
    SELECT vec_id, coalesce(name, -1) AS prediction FROM embeddings LEFT JOIN found ON a = vec_id"""


_LONG = """
    SELECT vec_id, label, unnest(range(1, 65)) AS d,
           CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings"""
QUERIES["silhouette"] = lambda spark, folder: cluster.silhouette(
    _vectors(spark, folder), "embedding", "label"
).select(F.round("score", 6).alias("score"))
# Mean squared distance to a cluster = |x|^2 + mean |y|^2 - 2 x . mean y.
ORACLES["silhouette"] = f"""
    WITH e AS ({_LONG}),
    p AS (SELECT vec_id, any_value(label) AS label, sum(x * x) AS xx FROM e GROUP BY vec_id),
    s AS (SELECT label, count(*) AS n, sum(xx) / count(*) AS yy FROM p GROUP BY label),
    m AS (SELECT label, d, sum(x) AS sx FROM e GROUP BY label, d),
    dot AS (SELECT e.vec_id, m.label, sum(e.x * m.sx) AS xy FROM e JOIN m ON m.d = e.d
            GROUP BY ALL),
    dist AS (SELECT p.vec_id, p.label AS own, s.label AS other, s.n,
                    p.xx + s.yy - 2 * dot.xy / s.n AS far
             FROM p CROSS JOIN s JOIN dot ON dot.vec_id = p.vec_id AND dot.label = s.label),
    ab AS (SELECT vec_id, max(CASE WHEN own = other THEN n END) AS n,
                  max(CASE WHEN own = other THEN far * n / greatest(n - 1, 1) END) AS a,
                  min(CASE WHEN own <> other THEN far END) AS b FROM dist GROUP BY vec_id)
    SELECT round(avg(CASE WHEN n = 1 THEN 0.0 WHEN a < b THEN 1 - a / b
                          WHEN a > b THEN b / a - 1 ELSE 0.0 END), 6) AS score FROM ab"""

QUERIES["calinski_harabasz"] = lambda spark, folder: cluster.calinski_harabasz(
    _vectors(spark, folder), "embedding", "label"
).select("points", "clusters", F.round("score", 6).alias("score"))
ORACLES["calinski_harabasz"] = f"""
    WITH e AS ({_LONG}),
    m AS (SELECT label, d, count(*) AS n, avg(x) AS m, var_pop(x) * count(*) AS w
          FROM e GROUP BY label, d),
    g AS (SELECT d, avg(x) AS m FROM e GROUP BY d),
    t AS (SELECT sum(m.w) AS w, sum(m.n * (m.m - g.m) * (m.m - g.m)) AS b
          FROM m JOIN g ON g.d = m.d)
    SELECT points, clusters,
           round((b / (clusters - 1)) / (w / (points - clusters)), 6) AS score
    FROM t, (SELECT count(*) AS points, count(DISTINCT label) AS clusters FROM embeddings)"""


def _texts(spark, folder):
    texts = table(spark, folder, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    labels = _vectors(spark, folder).select("vec_id", F.col("label").alias("prediction"))
    return cluster.texts_by_cluster(texts, labels, "vec_id").select("prediction", "vec_id", "text")


QUERIES["texts_by_cluster"] = _texts
ORACLES["texts_by_cluster"] = """
    SELECT e.label AS prediction, e.vec_id, d.text
    FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id WHERE e.label <> -1"""
