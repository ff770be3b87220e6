"""Scores of clusters of embedding vectors, and the texts of clusters.

``density_cluster`` is in ``density``. Scores come from each cluster's count and sums.
"""

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topictide.lineage import cut_lineage, import_path
from topictide.operators.density import NOISE, density_cluster  # noqa: F401

# Points and clusters whose distances are taken together.
POINT_BLOCK = 1024
CLUSTER_BLOCK = 512


def _in_cluster(label: str) -> Column:
    # Compared as text, for labels are keys of any type.
    return F.col(label).cast("string") != str(NOISE)


def _vectors(df: DataFrame, vector: str) -> DataFrame:
    """Add ``_features``: the array column as an ML vector."""
    doubles = F.transform(vector, lambda value: value.cast("double"))
    return df.withColumn("_features", array_to_vector(doubles))


def _packed(size: int, kinds: list[str]):
    """Kernel: rows of number columns and one of doubles, some to a row, as bytes."""
    names = ["pack", *(f"p{i}" for i in range(len(kinds) + 1))]

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), size):
                part = batch.slice(at, size)
                numbers = [part.column(i).to_numpy().astype(kind).tobytes() for i, kind in enumerate(kinds)]
                body = part.column(len(kinds)).flatten().to_numpy().tobytes()
                first = part.column(0)[0].as_py()
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (first, *numbers, body)], names=names)

    return run


def _distances(batches):
    """Kernel over a pack of points and one of clusters: own (or null) and least other mean squared distance."""
    names = ["row", "own", "other"]
    for batch in batches:
        for r in batch.to_pylist():
            rows, label = (np.frombuffer(r[x], "<i8") for x in ("p0", "p1"))
            known, sizes = (np.frombuffer(r[x], "<i8") for x in ("c0", "c1"))
            squares = np.frombuffer(r["c2"])
            x = np.frombuffer(r["p2"]).reshape(len(rows), -1)
            sums = np.frombuffer(r["c3"]).reshape(len(known), -1)
            far = (x * x).sum(axis=1)[:, None] + squares / sizes - 2 * (x @ sums.T) / sizes
            mine = label[:, None] == known
            own = np.where(mine, far * sizes / np.maximum(sizes - 1, 1), -np.inf).max(axis=1)
            own = np.where(mine & (sizes == 1), np.nan, own[:, None]).min(axis=1)  # nan: alone in its cluster
            other = np.where(mine, np.inf, far).min(axis=1)
            columns = [pa.array(rows), pa.array(own, mask=np.isneginf(own)), pa.array(other)]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def silhouette(
    df: DataFrame, vector: str = "embedding", label: str = "prediction"
) -> DataFrame:
    """``points, clusters, score``: the mean silhouette by squared distance; noise is a cluster.

    The mean squared distance to a cluster comes from its count, its sum and its sum of
    squares, so points meet clusters and not each other. Both come in blocks; every block of
    points meets every block of clusters, each in a task of its own. A point alone in its
    cluster has 0. The score is null under two clusters besides noise.
    """
    import_path(df.sparkSession)
    doubles = F.transform(vector, lambda x: x.cast("double")).alias("x")
    rows = cut_lineage(df.select(F.monotonically_increasing_id().alias("row"), F.col(label).alias("_label"), doubles))
    names = rows.groupBy("_label").agg(
        F.min("row").alias("cluster"), F.count(F.lit(1)).alias("n"),
        F.sum(F.aggregate("x", F.lit(0.0), lambda a, b: a + b * b)).alias("xx"),
        vector_to_array(Summarizer.sum(array_to_vector("x"))).alias("sum"),
    )
    clusters = cut_lineage(names.select("_label", "cluster", "n", "xx", "sum"))
    counted = clusters.agg(F.sum("n").alias("points"), F.count(F.lit(1)).alias("clusters"),
                           F.count_if(_in_cluster("_label")).alias("real"))
    # Clusters are named by their first row: labels may be of any type.
    named = rows.join(clusters.select(F.col("_label").alias("_l"), "cluster"), F.col("_label").eqNullSafe(F.col("_l")))
    points = named.select("row", "cluster", "x").mapInArrow(
        _packed(POINT_BLOCK, ["<i8", "<i8"]), "pack long, p0 binary, p1 binary, p2 binary")
    packs = cut_lineage(clusters.select("cluster", "n", "xx", "sum").mapInArrow(
        _packed(CLUSTER_BLOCK, ["<i8", "<i8", "<f8"]), "pack long, p0 binary, p1 binary, p2 binary, p3 binary"))
    several = packs.select(F.col("pack").alias("_with"), *[F.col(f"p{i}").alias(f"c{i}") for i in range(4)])
    keys = packs.agg(F.array_sort(F.collect_list("pack"))).first()[0] or [0]
    dealt = points.withColumn("_with", F.explode(F.lit(keys)))
    met = dealt.join(several, "_with").select("p0", "p1", "p2", "c0", "c1", "c2", "c3")
    far = met.mapInArrow(_distances, "row long, own double, other double").groupBy("row").agg(
        F.max("own").alias("a"), F.min("other").alias("b"))
    a, b = F.col("a"), F.col("b")
    one = F.when(F.isnan(a) | (a == b), 0.0).when(a < b, 1 - a / b).otherwise(b / a - 1)
    score = far.agg(F.avg(one).alias("score"))
    return counted.select("points", "clusters", F.when(F.col("real") >= 2, score.select("score").scalar()).alias("score"))


def calinski_harabasz(
    df: DataFrame, vector: str = "embedding", label: str = "prediction"
) -> DataFrame:
    """``points, clusters, score``: scatter between over scatter within; noise is a cluster.

    One grouping leaves a mean, a variance and a count per cluster; the rest is
    arithmetic on clusters times dimensions. Means are held against the mean of all
    points, so nothing cancels where they lie far from the origin.
    """
    stats = _vectors(df, vector).groupBy(label).agg(
        Summarizer.metrics("mean", "variance", "count").summary(F.col("_features")).alias("s")
    )
    cells = stats.select(
        F.col(label), F.col("s.count").alias("n"),
        F.posexplode(F.arrays_zip(vector_to_array("s.mean").alias("m"),
                                  vector_to_array("s.variance").alias("v"))).alias("d", "x"),
    )
    cells = cut_lineage(cells)
    middle = cells.groupBy("d").agg(
        (F.sum(F.col("n") * F.col("x.m")) / F.sum("n")).alias("_middle")
    )
    off = F.col("x.m") - F.col("_middle")
    parts = cells.join(middle, "d").groupBy("d").agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("n").alias("n"),
        F.sum(F.col("x.v") * (F.col("n") - 1)).alias("within"),
        F.sum(F.col("n") * off * off).alias("between"),
    )
    sums = parts.agg(
        F.max("n").alias("points"), F.max("k").alias("clusters"),
        F.sum("within").alias("w"), F.sum("between").alias("b"),
    )
    score = F.try_divide(
        F.try_divide(F.col("b"), F.col("clusters") - 1),
        F.try_divide(F.col("w"), F.col("points") - F.col("clusters")),
    )
    return sums.select("points", "clusters", score.alias("score"))


def texts_by_cluster(
    texts: DataFrame, clusters: DataFrame, key: str = "id", label: str = "prediction"
) -> DataFrame:
    """Texts with the label of their cluster, noise left out."""
    return texts.join(clusters.where(_in_cluster(label)).select(key, label), key)
