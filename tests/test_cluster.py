import math
from pathlib import Path

import numpy as np
import pytest

from topictide.operators import cluster
from topictide.operators.components import connected
from topictide.operators.density import density_cluster


def blobs(seed=0):
    rng = np.random.default_rng(seed)
    centres = np.eye(8)[:3] * 20
    points, truth = [], []
    for c, size in zip(range(3), (120, 40, 25), strict=True):
        points += list(centres[c] + rng.normal(0, 0.05, (size, 8)))
        truth += [c] * size
    points += [centres[0] + 0.01] * 60  # copies
    truth += [0] * 60
    points += list(centres[1] * -1 + rng.normal(0, 0.01, (4, 8)))  # too small a group
    truth += [-1] * 4
    points += list(rng.uniform(200, 900, (6, 8)))  # far apart
    truth += [-1] * 6
    return points, truth


@pytest.fixture(scope="module")
def frame(spark):
    points, truth = blobs()
    rows = [(i, [float(x) for x in p], t) for i, (p, t) in enumerate(zip(points, truth, strict=True))]
    return spark.createDataFrame(rows, "id LONG, embedding ARRAY<FLOAT>, truth INT").repartition(6)


def connected_by_distance(points, eps, min_size):
    """All pairs: core points within eps of each other are one cluster; None beside them."""
    x = np.array(points, float)
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= eps
    core = near.sum(1) >= min_size
    label = {}
    for i in np.flatnonzero(core):
        if i in label:
            continue
        todo = [i]
        while todo:
            j = todo.pop()
            if j not in label:
                label[j] = i
                todo += list(np.flatnonzero(near[j] & core))
    return label


def labels_by_distance(points, eps, min_size):
    """Smallest core point of each cluster; border points join the smallest cluster they touch."""
    x = np.array(points, float)
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= eps
    core = connected_by_distance(points, eps, min_size)
    out = dict(core)
    for i in range(len(points)):
        touched = [core[j] for j in np.flatnonzero(near[i]) if j in core]
        if i not in core and touched:
            out[i] = min(touched)
    return out


@pytest.mark.parametrize("eps,part_rows,cell_rows", [(2.0, 4096, 1024), (2.0, 7, 20), (0.5, 50, 30)])
def test_density_clusters_equal_all_pairs(frame, eps, part_rows, cell_rows):
    got = {r.id: r.prediction for r in density_cluster(
        frame, eps=eps, min_size=10, part_rows=part_rows, cell_rows=cell_rows).collect()}
    known = labels_by_distance(blobs()[0], eps, 10)
    assert got == {i: known.get(i, -1) for i in got}
    assert set(got.values()) > {-1} and len(set(got.values())) == 4


@pytest.mark.parametrize("part_rows,cell_rows", [(4096, 100), (64, 300), (40, 5000)])
def test_uniform_background_loses_no_core_point(spark, part_rows, cell_rows):
    """Points all over, two planted groups, and border points between them."""
    rng = np.random.default_rng(4)
    points = [*rng.uniform(0, 6, (1500, 2)), *rng.normal(3, 0.05, (60, 2)), *rng.normal(1, 0.05, (60, 2)),
              *([np.array([50.0, 50.0])] * 300)]
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)],
                               "id LONG, embedding ARRAY<DOUBLE>").repartition(5)
    for eps, size in ((0.2, 10), (0.15, 4)):
        got = {r.id: r.prediction for r in density_cluster(
            df, eps=eps, min_size=size, part_rows=part_rows, cell_rows=cell_rows).collect()}
        known = labels_by_distance(points, eps, size)
        core = connected_by_distance(points, eps, size)
        assert got == {i: known.get(i, -1) for i in got}
        assert len(set(known) - set(core)) > 20 and -1 in got.values()


def test_high_dimensions_and_unusable_vectors(spark):
    rng = np.random.default_rng(3)
    points = rng.normal(0, 1, (300, 64))
    points /= np.linalg.norm(points, axis=1)[:, None]
    near = points[:12] * 0.001 + points[0]
    both = [*points, *near]
    rows = [(f"{i:04}", [float(x) for x in p]) for i, p in enumerate(both)]
    rows += [("z0", None), ("z1", [1.0]), ("z2", [float("nan")] * 64), ("z3", []), ("z4", [None] * 64)]
    df = spark.createDataFrame(rows, "id STRING, embedding ARRAY<DOUBLE>")
    for eps in (0.6, 1.2, 1.3):
        got = {r.id: r.prediction for r in density_cluster(df, eps=eps, min_size=10, cell_rows=40).collect()}
        known = labels_by_distance(both, eps, 10)
        assert got == {k: f"{known[int(k)]:04}" if k[0] != "z" and int(k) in known else "-1" for k, _ in rows}
    assert density_cluster(df.where("false")).count() == 0


@pytest.mark.parametrize("kind", ["FLOAT", "DOUBLE"])
def test_far_vectors_are_not_copied_to_each_cell(spark, kind):
    """Unit vectors at like distances: every cell reaches every vector. Few bytes a task, so partitions meet in pairs."""
    rng = np.random.default_rng(6)
    points = rng.normal(0, 1, (600, 32)).astype(np.float32)
    points /= np.linalg.norm(points, axis=1)[:, None]
    points[:20] = points[20:40]
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], f"id LONG, embedding ARRAY<{kind}>").repartition(3)
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    files = lambda: {f: f.stat().st_size for f in folder.rglob("part-*")}
    before, eps, size = files(), 1.05, 4
    got = {r.id: r.prediction for r in density_cluster(df, eps=eps, min_size=size, cell_rows=20, pair_bytes=1_000_000).collect()}
    written = sum(n for f, n in files().items() if f not in before)
    known, core = labels_by_distance(points, eps, size), connected_by_distance(points, eps, size)
    assert got == {i: known.get(i, -1) for i in got}
    assert core and len(known) > len(core) and -1 in got.values()
    assert written < 8 * 600 * 32 * (4 if kind == "FLOAT" else 8)


def test_long_chains_settle(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 501)],
                                  "a LONG, b LONG")
    roots = {r.node: r.root for r in connected(edges).collect()}
    assert {roots[i] for i in range(101)} == {0} and roots[501] == 500


def test_scores(frame):
    rows = [(r.embedding, r.truth) for r in frame.collect()]
    x, y = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows])
    mean = x.mean(0)
    between = sum((y == c).sum() * ((x[y == c].mean(0) - mean) ** 2).sum() for c in set(y))
    within = sum(((x[y == c] - x[y == c].mean(0)) ** 2).sum() for c in set(y))
    n, k = len(y), len(set(y))
    row = cluster.calinski_harabasz(frame, label="truth").first()
    assert (row.points, row.clusters) == (n, k)
    assert math.isclose(row.score, (between / (k - 1)) / (within / (n - k)), rel_tol=1e-6)
    far = frame.selectExpr("transform(embedding, x -> double(x) + 1e6) embedding", "truth")
    assert math.isclose(cluster.calinski_harabasz(far, label="truth").first().score, row.score,
                        rel_tol=1e-3)
    assert cluster.silhouette(frame.where("truth = 0"), label="truth").first().score is None


def mean_silhouette(x, y):
    far = ((x[:, None] - x[None]) ** 2).sum(-1)
    out = []
    for i, c in enumerate(y):
        own = y == c
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = far[i][own].sum() / (own.sum() - 1)
        b = min(far[i][y == o].mean() for o in set(y) if o != c)
        out.append(0.0 if a == b else (b - a) / max(a, b))
    return float(np.mean(out))


@pytest.mark.parametrize("block", [2, 512])
def test_silhouette_equals_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(cluster, "CLUSTER_BLOCK", block)
    monkeypatch.setattr(cluster, "POINT_BLOCK", 7)
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (90, 5))
    y = np.array([f"c{i}" for i in rng.integers(0, 6, 89)] + ["alone"])
    df = spark.createDataFrame([(p.tolist(), c) for p, c in zip(x, y.tolist(), strict=True)],
                               "embedding ARRAY<DOUBLE>, prediction STRING")
    row = cluster.silhouette(df.repartition(3)).first()
    assert (row.points, row.clusters) == (90, len(set(y)))
    assert math.isclose(row.score, mean_silhouette(x, y), rel_tol=1e-9)




def test_texts_of_clusters(frame):
    texts = frame.selectExpr("id", "cast(id as string) text")
    found = cluster.texts_by_cluster(texts, frame.selectExpr("id", "truth prediction"))
    assert found.count() == frame.where("truth <> -1").count()
