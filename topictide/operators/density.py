"""Density clusters of vectors, exactly: the clusters that a comparison of all pairs gives.

Vectors are dealt to cells, each to that of its nearest pivot. A part is a cell or, of a large
one, some of its vectors: one row with a matrix. Parts are joined with each other, and a pair of
them is a matrix product; so a vector is stored once, however many parts it is compared with.
If two vectors lie within ``eps``, their distances to any pivot differ by at most that; so a
vector can be near one of a part only if it lies at most ``2 * eps`` farther from that part's
pivot than from its own, and at most ``eps`` beyond the part's rim. Other pairs of parts, and
other rows of a pair, are not compared. Counts and the names of joined groups leave a task,
never pairs. Equal vectors are one point of so many rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from topictide.lineage import cut_lineage, import_path
from topictide.operators.components import connected

NOISE = -1
# Points of a cell to aim at; pivots are few enough to travel with each task.
CELL_ROWS = 1024
PIVOT_BYTES = 32 * 1024 * 1024
# Rows of a part of a cell, and bytes of its matrix; rows of a slice of a product.
PART_ROWS = 4096
PART_BYTES = 4 * 1024 * 1024
SLICE = 512
# Bytes of the pairs of parts that one task reads, and distances to pivots held at once.
PAIR_BYTES = 128 * 1024 * 1024
DEAL_CELLS = 4 * 1024 * 1024

PART = "part int, center array<double>, rim double, slack double, points binary, rows binary, body binary"


def close(a: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
    """Whether rows of ``a`` and ``b`` lie within ``eps``, exact also where products cancel."""
    of_a, of_b, limit = (a * a).sum(axis=1)[:, None], (b * b).sum(axis=1)[:, None], eps * eps
    one = np.ones_like
    far = np.hstack([-2 * a, of_a, one(of_a)]) @ np.hstack([b, one(of_b), of_b]).T
    near = far <= limit
    unsure = 1e-9 * (of_a.max(initial=0) + of_b.max(initial=0) + limit)
    band = (far <= limit + unsure) & ~(far <= limit - unsure)
    i, j = np.nonzero(band) if band.any() else (np.zeros(0, int), np.zeros(0, int))
    tight = np.abs(far[i, j] - limit) <= 1e-9 * (of_a[i, 0] + of_b[j, 0] + limit)
    i, j = i[tight], j[tight]
    for at in range(0, len(i), 1 << 16):
        some = slice(at, at + (1 << 16))
        step = a[i[some]] - b[j[some]]
        near[i[some], j[some]] = np.sqrt((step * step).sum(axis=1)) <= eps
    return near


def _distance(points: np.ndarray, center: np.ndarray) -> np.ndarray:
    step = points - center
    return np.sqrt((step * step).sum(axis=1))


def _deal(pivots: np.ndarray, kind: str, first: np.ndarray | None):
    """Kernel over point, rows, body: the cell of the nearest pivot; with ``first``, the number of
    the first part of each cell, the part as well."""

    def run(batches):
        for whole in batches:
            for at in range(0, len(whole), step := max(1, DEAL_CELLS // len(pivots))):
                batch = whole.slice(at, step)
                points = np.frombuffer(b"".join(batch.column(2).to_pylist()), kind).reshape(len(batch), -1).astype(float)
                squares = (points * points).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)
                cell = (squares - 2 * (points @ pivots.T)).argmin(axis=1).astype(np.int32)
                if first is None:
                    yield pa.RecordBatch.from_arrays([pa.array(cell)], names=["cell"])
                    continue
                mixed = batch.column(0).to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
                part = first[cell] + mixed.astype(np.int64) % (first[cell + 1] - first[cell])
                arrays = [pa.array(part.astype(np.int32)), pa.array(cell), *batch.columns]
                yield pa.RecordBatch.from_arrays(arrays, names=["part", "cell", "point", "rows", "body"])

    return run


def _pack(pivots: np.ndarray, kind: str):
    """The points of a part as one row of ``PART``."""

    def run(table: pa.Table) -> pa.Table:
        center = pivots[table["cell"][0].as_py()]
        body = b"".join(table["body"].to_pylist())
        points = np.frombuffer(body, kind).reshape(len(table), -1).astype(float)
        slack = 1e-6 * (1 + np.sqrt((points * points).sum(axis=1).max() + (center * center).sum()))  # rounding only costs comparisons
        row = {"part": table["part"][0].as_py(), "center": center.tolist(), "rim": float(_distance(points, center).max() + slack),
               "slack": float(slack), "body": body,
               **{name: table[name].to_numpy().astype(np.int64).tobytes() for name in ("points", "rows")}}
        kinds = [pa.int32(), pa.list_(pa.float64()), pa.float64(), pa.float64(), *[pa.binary()] * 3]
        names = ["part", "center", "rim", "slack", "points", "rows", "body"]
        return pa.table([pa.array([row[name]], k) for name, k in zip(names, kinds, strict=True)], names=names)

    return run


class _Part:
    """A row of ``PART``, of which some may be left out."""

    def __init__(self, row: dict, kind: str, mark: str = ""):
        self.part, self.rim, self.slack = (row[mark + name] for name in ("part", "rim", "slack"))
        self.center = np.array(row[mark + "center"])
        self.points = np.frombuffer(row[mark + "points"], np.int64)
        self.rows = np.frombuffer(row[mark + "rows"], np.int64)
        self.groups = np.frombuffer(row[mark + "groups"], np.int64) if mark + "groups" in row else self.points
        self.body = np.frombuffer(row[mark + "body"], kind).reshape(len(self.points), -1).astype(float)
        self.own = _distance(self.body, self.center)

    def reaching(self, other: _Part, eps: float) -> np.ndarray:
        """The rows that may be near one of the other part."""
        far = _distance(self.body, other.center)
        slack = max(self.slack, other.slack)
        return np.flatnonzero((far <= other.rim + eps + slack) & (far <= self.own + 2 * eps + slack))


def _rows(batches):
    for batch in batches:
        for at in range(len(batch)):
            yield batch.slice(at, 1).to_pylist()[0]


def _pairs(batches, kind: str, eps: float):
    """Pairs of parts, with the rows of either that may be near one of the other."""
    left = None
    for row in _rows(batches):
        if left is None or left.part != row["a_part"]:
            left = _Part(row, kind, "a_")
        right = _Part(row, kind, "b_")
        i, j = left.reaching(right, eps), right.reaching(left, eps)
        if len(i) and len(j):
            yield left, right, i, j


def _counts(eps: float, most: int, kind: str):
    """Kernel over pairs of parts: rows within ``eps`` of each point, no more than ``most``, for each part once."""

    def run(batches):
        found: dict[int, np.ndarray] = {}
        for left, right, i, j in _pairs(batches, kind, eps):
            mine = found.setdefault(left.part, np.zeros(len(left.points), np.int64))
            other = found.setdefault(right.part, np.zeros(len(right.points), np.int64))
            weight = right.rows[j].astype(float)
            for at in range(0, len(i), SLICE):
                rows = i[at : at + SLICE]
                near = close(left.body[rows], right.body[j], eps).astype(float)
                mine[rows] += (near @ weight).astype(np.int64)
                if left.part != right.part:
                    other[j] += (left.rows[rows].astype(float) @ near).astype(np.int64)
        counts = [np.minimum(n, most).tobytes() for n in found.values()]
        yield pa.RecordBatch.from_arrays([pa.array([*found], pa.int32()), pa.array(counts, pa.binary())], names=["part", "near"])

    return run


def _cores(min_size: int):
    """Which points of a part are core points, from the counts of its pairs."""

    def run(table: pa.Table) -> pa.Table:
        near = sum(np.frombuffer(n, np.int64) for n in table["near"].to_pylist())
        core = (near >= min_size).tobytes()
        return pa.table([table["part"].slice(0, 1).cast(pa.int32()), pa.array([core], pa.binary())], names=["part", "core"])

    return run


def _of(core: bool, kind: str):
    """Kernel over parts with their core marks: the core points of each, or the others."""

    def run(batches):
        for batch in batches:
            columns = {name: [] for name in batch.schema.names if name != "core"}
            for row in _rows([batch]):
                taken = np.flatnonzero(np.frombuffer(row.pop("core"), bool) == core)
                if len(taken):
                    for name, width in (("points", 8), ("rows", 8), ("body", len(row["center"]) * np.dtype(kind).itemsize)):
                        row[name] = np.frombuffer(row[name], f"V{width}")[taken].tobytes()
                    for name, value in row.items():
                        columns[name].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, batch.schema.field(n).type) for n, v in columns.items()], names=[*columns])

    return run


class _Groups:
    """Names, and which of them were joined; a name's number is its place."""

    def __init__(self):
        self.names: dict[int, int] = {}
        self.label = np.zeros(0, np.int64)
        self._of: dict[int, np.ndarray] = {}

    def numbers(self, part: _Part) -> np.ndarray:
        if part.part not in self._of:
            names, each = np.unique(part.groups, return_inverse=True)
            self._of[part.part] = np.array([self.names.setdefault(n, len(self.names)) for n in names.tolist()])[each]
            self.label = np.append(self.label, np.arange(len(self.label), len(self.names)))
        return self._of[part.part]

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.label[i], self.label[j]
            i, j = i[a != b], j[a != b]
            self.label[np.maximum(a, b)] = np.minimum(a, b)
            while (self.label != (following := self.label[self.label])).any():
                self.label = following

    def link(self, left: _Part, right: _Part, i: np.ndarray, j: np.ndarray, eps: float) -> None:
        """Join the groups of near points; rows of one group are not compared."""
        ours, theirs = self.numbers(left), self.numbers(right)
        for at in range(0, len(i), SLICE):
            rows = i[at : at + SLICE]
            home = np.bincount(self.label[theirs[j]]).argmax()
            out = self.label[ours[rows]] != home
            self._compare(left, right, rows[out], j, ours, theirs, eps)
            self._compare(left, right, rows[~out], j[self.label[theirs[j]] != self.label[home]], ours, theirs, eps)

    def _compare(self, left, right, i, j, ours, theirs, eps):
        if len(i) and len(j):
            x, y = np.nonzero(close(left.body[i], right.body[j], eps))
            self.join(ours[i[x]], theirs[j[y]])

    def roots(self) -> tuple[np.ndarray, np.ndarray]:
        """All names, and for each the first name of those it was joined with."""
        names = np.fromiter(self.names, np.int64, len(self.names))
        return names, names[self.label]


def _join_inside(eps: float, kind: str):
    """Kernel over parts of core points: the same with groups, joined over all parts of the task."""

    def run(batches):
        parts, rows, groups = [], [], _Groups()
        for row in _rows(batches):
            rows.append(row)
            parts.append(_Part(row, kind))
            for other in parts:
                i, j = parts[-1].reaching(other, eps), other.reaching(parts[-1], eps)
                if len(i) and len(j):
                    groups.link(parts[-1], other, i, j, eps)
                groups.numbers(parts[-1])
        _, root = groups.roots()
        for row, part in zip(rows, parts, strict=True):
            named = root[groups.numbers(part)].tobytes()
            kinds = [pa.int32(), pa.list_(pa.float64()), pa.float64(), pa.float64(), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip([*row.values(), named], kinds, strict=True)],
                                             names=[*row, "groups"])

    return run


def _join_across(eps: float, kind: str):
    """Kernel over pairs of parts of core points: links (a, b) that join groups as all near points do."""

    def run(batches):
        groups = _Groups()
        for left, right, i, j in _pairs(batches, kind, eps):
            groups.link(left, right, i, j, eps)
        names, root = groups.roots()
        moved = names != root
        yield pa.RecordBatch.from_arrays([pa.array(names[moved]), pa.array(root[moved])], names=["a", "b"])

    return run


def _touched(eps: float, kind: str):
    """Kernel over parts of other points with parts of core points: each point with each group near it."""

    def run(batches):
        found = np.zeros((0, 2), np.int64)
        for left, right, i, j in _pairs(batches, kind, eps):
            for at in range(0, len(i), SLICE):
                x, y = np.nonzero(close(left.body[rows := i[at : at + SLICE]], right.body[j], eps))
                both = np.stack([left.points[rows[x]], right.groups[j[y]]], axis=1)
                found = np.concatenate([found, np.unique(both, axis=0)])
            if len(found) > 1 << 20:
                found = np.unique(found, axis=0)
        found = np.unique(found, axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["point", "a"])

    return run


def _joined(left: DataFrame, right: DataFrame, eps: float, on: Column | None = None) -> DataFrame:
    """Pairs of parts of which some points may be near each other; ``on`` says which pairs count."""
    a = left.select(*[F.col(name).alias(f"a_{name}") for name in left.columns])
    b = right.select(*[F.col(name).alias(f"b_{name}") for name in right.columns])
    squares = F.zip_with("a_center", "b_center", lambda x, y: (x - y) * (x - y))
    apart = F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, x: total + x))
    reach = F.least(F.col("a_rim") + F.col("b_rim") + eps, 2 * F.least("a_rim", "b_rim") + 2 * eps)
    meet = apart <= reach if on is None else on & (apart <= reach)
    # Partitions meet in pairs; no side goes through the driver.
    return a.join(b.hint("shuffle_replicate_nl"), meet)


def _of_points(parts: DataFrame, *names: str) -> DataFrame:
    """A row for each point, with the numbers of the columns named."""
    def run(batches):
        for batch in batches:
            columns = [np.frombuffer(b"".join(column.to_pylist()), np.int64) for column in batch.columns]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[*names])

    return parts.select(*names).mapInArrow(run, ", ".join(f"{name} long" for name in names))


def _bodies(kind: str):
    def body(vectors: pa.Array) -> pa.Array:
        return pa.array([(np.asarray(v.values, kind) + 0).tobytes() if v.is_valid else None for v in vectors], pa.binary())

    body.__annotations__ = {"vectors": pa.Array, "return": pa.Array}
    return F.arrow_udf(body, "binary")


def density_cluster(
    df: DataFrame,
    key: str = "id",
    vector: str = "embedding",
    eps: float = 1.0,
    min_size: int = 10,
    part_rows: int = PART_ROWS,
    cell_rows: int = CELL_ROWS,
    pair_bytes: int = PAIR_BYTES,
) -> DataFrame:
    """``key, prediction``: the smallest key of the cluster's core points, or -1 for noise.

    A core point has ``min_size`` rows within ``eps``, itself included. Core points within
    ``eps`` of each other are in one cluster; another point within ``eps`` of core points is
    in that one of their clusters with the smallest key. The rest is noise, as are points
    without a usable vector: null, with null or infinite parts, or of another size than that
    of the smallest key. ``key`` identifies a point.
    """
    import_path(df.sparkSession)
    narrow = isinstance(df.schema[vector].dataType.elementType, FloatType)
    kind = "<f4" if narrow else "<f8"
    doubles = F.transform(vector, lambda x: x.cast("double"))
    usable = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    values = F.when((F.size(vector) > 0) & usable, F.col(vector) if narrow else doubles)
    rows = cut_lineage(df.select(
        F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"), _bodies(kind)(values).alias("_body"),
    ))
    sound = rows.where(F.col("_body").isNotNull())
    first = sound.select(F.min(F.struct("_key", F.octet_length("_body").alias("n")))["n"]).first()
    size = first[0] or 0
    sound = sound.where(F.octet_length("_body") == size)
    # One point for each vector, named by its first row.
    points = cut_lineage(sound.groupBy("_body").agg(
        F.min("_row").alias("point"), F.count(F.lit(1)).alias("rows"), F.min("_key").alias("_least")
    ))
    number = points.count()
    noise = F.lit(NOISE).cast(df.schema[key].dataType)
    if not number:
        return df.select(key, noise.alias("prediction"))
    # Pivots are points in the order of their digest, of bounded number and bytes.
    most = max(1, PIVOT_BYTES // (8 * size // int(kind[-1])))
    wanted = min(most, math.ceil(number / cell_rows))
    chosen = points.orderBy(F.xxhash64("_body"), "point").limit(wanted).select("_body").collect()
    pivots = np.array([np.frombuffer(bytes(row["_body"]), kind) for row in chosen], float)
    dealt = points.select("point", "rows", "_body")
    filled = dict(dealt.mapInArrow(_deal(pivots, kind, None), "cell int").groupBy("cell").count().collect())
    part_rows = max(1, min(part_rows, PART_BYTES // size))
    several = [math.ceil(filled.get(cell, 0) / part_rows) for cell in range(len(pivots))]
    first_part = np.concatenate([[0], np.cumsum(several)]).astype(np.int64)
    # As many partitions as keep the pairs of any two of them within pair_bytes.
    spread = math.ceil(math.sqrt(2 * first_part[-1] * number * (size + 16) / pair_bytes))
    placed = dealt.mapInArrow(_deal(pivots, kind, first_part), "part int, cell int, point long, rows long, body binary")
    placed = placed.withColumnRenamed("point", "points")
    parts = cut_lineage(placed.groupBy("part").applyInArrow(_pack(pivots, kind), PART).repartition(spread))
    once = F.col("a_part") <= F.col("b_part")
    counts = _joined(parts, parts, eps, once).mapInArrow(_counts(eps, min_size, kind), "part int, near binary")
    marks = cut_lineage(counts.groupBy("part").applyInArrow(_cores(min_size), "part int, core binary"))
    marked = parts.join(marks, "part")
    cores = marked.mapInArrow(_of(True, kind), PART).repartition(spread)
    cores = cut_lineage(cores.mapInArrow(_join_inside(eps, kind), f"{PART}, groups binary"))
    others = marked.mapInArrow(_of(False, kind), PART).repartition(spread)
    if spread > 1:
        twice = _joined(cores, cores, eps, F.col("a_part") < F.col("b_part"))
        roots = connected(cut_lineage(twice.mapInArrow(_join_across(eps, kind), "a long, b long")))
        roots = roots.withColumnRenamed("node", "a")
    else:
        roots = _of_points(cores, "groups").select(F.col("groups").alias("a"), F.col("groups").alias("root")).distinct()
    touching = _joined(others, cores, eps).mapInArrow(_touched(eps, kind), "point long, a long")
    in_group = _of_points(cores, "points", "groups").select(F.col("points").alias("point"), F.col("groups").alias("a"))
    named = cut_lineage(in_group.join(roots, "a", "left").select("point", "a", F.coalesce("root", "a").alias("root"))
                        .join(points.select("point", "_least"), "point"))
    labels = named.groupBy("root").agg(F.min("_least").alias("label"))
    of_core = cut_lineage(named.join(labels, "root").select("point", "a", "label"))
    of_group = of_core.select("a", "label").distinct()
    of_border = touching.join(of_group, "a").groupBy("point").agg(F.min("label").alias("label"))
    of_point = of_core.select("point", "label").unionByName(of_border)
    by_vector = points.join(of_point, "point").select(F.col("_body").alias("_b"), "label")
    out = rows.join(by_vector, F.col("_body") == F.col("_b"), "left")
    return out.select(F.col("_key").alias(key), F.coalesce("label", noise).alias("prediction"))
