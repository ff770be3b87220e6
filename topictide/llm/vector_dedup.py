"""Near copies of embedding vectors by cross-polytope hashing, verified.

A vector is rotated by three rounds of random signs and a fast Hadamard transform; the
corner of the cross-polytope that it then lies nearest to is one hash. Several hashes make
the key of a table. Each vector is put into the bucket of its own key and into those of the
next likeliest keys (multiprobe). As many tables are used as a simulation says are needed
for pairs right at the threshold to meet. Members of a bucket are compared by a matrix
product; a pair that meets in several buckets belongs to the one with the smallest number,
so links are counted there and never leave as pairs: a block gives a count for each member
and the links of a spanning forest.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topictide.llm.graph import components
from topictide.llm.store import saved

#: Linked from this cosine on.
COSINE = 0.95
#: Part of the pairs right at the threshold that shall meet in some bucket.
RECALL = 0.999
#: Buckets of one vector in one table.
PROBES = 4
#: Pairs of the simulation, and the seed of all signs.
TRIALS, SEED = 1000, 12
#: Rows of one part of a bucket; parts meet in pairs. Rows of one slice of a product.
PART_ROWS, SLICE = 4096, 512


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, not scaled; their length is a power of two."""
    rows, width = x.shape
    step = 1
    while step < width:
        x = x.reshape(rows, -1, 2, step)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2)
        step *= 2
    return x.reshape(rows, width)


@functools.lru_cache(maxsize=64)
def _signs(width: int, table: int, hashes: int) -> np.ndarray:
    draws = np.random.default_rng([SEED, width, table]).integers(0, 2, (hashes, 3, width))
    return draws * 2.0 - 1.0


def _corners(unit: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The three nearest corners of each row for one hash, and how much farther the second and third are."""
    rows, dim = unit.shape
    width = signs.shape[1]
    y = np.zeros((rows, width))
    y[:, :dim] = unit
    for turn in signs:
        y = hadamard(y * turn) / math.sqrt(width)
    size = np.abs(y)
    top = np.argsort(-size, axis=1, kind="stable")[:, :3]
    best = np.take_along_axis(size, top, 1)
    code = top * 2 + (np.take_along_axis(y, top, 1) < 0)
    return code, best[:, :1] - best


def bucket_keys(unit: np.ndarray, table: int, hashes: int, probes: int = PROBES) -> np.ndarray:
    """Keys of the ``probes`` likeliest buckets of each row in a table, its own first."""
    rows, dim = unit.shape
    width = 1 << max(0, (dim - 1).bit_length())
    found = [_corners(unit, signs) for signs in _signs(width, table, hashes)]
    shift = [np.uint64(xxhash.xxh3_64_intdigest(f"{width}/{table}/{h}".encode()) | 1) for h in range(hashes)]
    parts = [_mix((code.astype(np.uint64) + np.uint64(1)) * s) for (code, _), s in zip(found, shift, strict=True)]
    own = sum((p[:, 0] for p in parts), np.uint64(0))
    # Probes: one hash at its second or third corner, or two at their second; the nearest of them.
    choices, costs = [own], [np.zeros(rows)]
    others = range(1, parts[0].shape[1])
    for i, (p, (_, far)) in enumerate(zip(parts, found, strict=True)):
        for j in others:
            choices.append(own - p[:, 0] + p[:, j])
            costs.append(far[:, j] ** 2)
        for q, (_, wide) in zip(parts[:i], found[:i], strict=True):
            if len(others):
                choices.append(own - p[:, 0] + p[:, 1] - q[:, 0] + q[:, 1])
                costs.append(far[:, 1] ** 2 + wide[:, 1] ** 2)
    cost = np.stack(costs, 1)
    near = np.argsort(cost, axis=1, kind="stable")[:, :probes]
    return _mix(np.take_along_axis(np.stack(choices, 1), near, 1))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=256)
def tables_for(dim: int, hashes: int, cosine: float = COSINE, recall: float = RECALL) -> int:
    """Tables after which simulated pairs of just this cosine have met with probability ``recall``."""
    if dim < 2:
        return 1
    draw = np.random.default_rng([SEED, dim, hashes])
    a = draw.standard_normal((TRIALS, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = draw.standard_normal((TRIALS, dim))
    b -= a * (a * b).sum(axis=1, keepdims=True)
    b *= math.sqrt(1 - cosine**2) / np.linalg.norm(b, axis=1, keepdims=True)
    met, tries = 0, 2
    for table in range(tries):
        keys = bucket_keys(a, table, hashes)[:, :, None], bucket_keys(a * cosine + b, table, hashes)[:, None, :]
        met += int((keys[0] == keys[1]).any(axis=(1, 2)).sum())
    share = min(max(met / TRIALS / tries, 1e-3), 1 - 1e-9)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - share)))


def hashes_for(dim: int, rows: int) -> int:
    """Hashes in a key: as many as make at least one bucket for each row."""
    return max(1, math.ceil(math.log(max(rows, 2)) / math.log(2 << max(0, (dim - 1).bit_length()))))


def unit_rows(data: list[bytes], kind: str) -> np.ndarray:
    """Vectors of one dimension from their bytes, in double precision and of length one."""
    v = np.frombuffer(b"".join(data), kind).astype(np.float64).reshape(len(data), -1)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _bodies(kind: str):
    """row, vec_id, and for sound vectors their bytes and a signature of them."""
    names = ["_row", "vec_id", "body", "sig1", "sig2"]
    element = pa.float32() if kind == "<f4" else pa.float64()

    def read(batches):
        for batch in batches:
            bodies = []
            for values in batch.column(2):
                body = None
                if values.is_valid and len(values.values) and values.values.null_count == 0:
                    v = values.values.cast(element).to_numpy(zero_copy_only=False).astype(kind)
                    body = v.tobytes() if np.isfinite(v).all() and v.any() else None
                bodies.append(body)
            signs = [(None, None) if b is None else tuple(np.frombuffer(xxhash.xxh3_128_digest(b), np.int64).tolist()) for b in bodies]
            columns = [pa.array(bodies, pa.binary()), *(pa.array([s[i] for s in signs], pa.int64()) for i in (0, 1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=names)

    return read


def _memberships(kind: str, rows: int, cosine: float, recall: float):
    """node and bucket, for each bucket of each vector."""
    width = np.dtype(kind).itemsize

    def hash_all(batches):
        for batch in batches:
            nodes, bodies = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            sizes = np.array([len(b) // width for b in bodies])
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                unit = unit_rows([bodies[i] for i in at], kind)
                hashes = hashes_for(int(dim), rows)
                for table in range(tables_for(int(dim), hashes, cosine, recall)):
                    salt = np.uint64(xxhash.xxh3_64_intdigest(f"{dim}/{table}".encode()))
                    keys = _mix(bucket_keys(unit, table, hashes) + salt)
                    columns = np.repeat(nodes[at], keys.shape[1]), keys.reshape(-1).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["node", "bucket"])

    return hash_all


def block_links(left: dict, right: dict | None, bucket: int, cosine: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Linked vectors of each row of the left and of the right part, and links that join them as all do.

    A part has unit rows, copies and the buckets of each row. Pairs that also meet in a
    bucket of a smaller number are left to it. With no right part, pairs lie within the left.
    """
    other = left if right is None else right
    n, m = len(left["unit"]), len(other["unit"])
    earlier = [[b for b in row if b < bucket] for row in (left["buckets"] if right is None else left["buckets"] + right["buckets"])]
    flat = np.array([b for row in earlier for b in row], np.int64)
    owner = np.repeat(np.arange(len(earlier)), [len(row) for row in earlier])
    shared, place, times = np.unique(flat, return_inverse=True, return_counts=True)
    keep = np.flatnonzero(times > 1)
    column = np.full(len(shared), -1)
    column[keep] = np.arange(len(keep))
    seen = np.zeros((len(earlier), len(keep)), np.float32)
    column = column[place]
    seen[owner[column >= 0], column[column >= 0]] = 1
    seen_other = seen if right is None else seen[n:]
    counts, other_counts = np.zeros(n, np.int64), np.zeros(m, np.int64)
    label, links = np.arange(n if right is None else n + m), []
    shift = 0 if right is None else n
    for a in range(0, n, SLICE):
        near = left["unit"][a : a + SLICE] @ other["unit"].T >= cosine
        if len(keep):
            near &= seen[a : min(a + SLICE, n)] @ seen_other.T == 0
        if right is None:
            near[np.arange(len(near)), np.arange(a, a + len(near))] = False
        else:
            other_counts += left["copies"][a : a + SLICE] @ near
        counts[a : a + SLICE] = near @ other["copies"]
        for i in np.flatnonzero(near.any(axis=1)):
            found = np.flatnonzero(near[i]) + shift
            while len(found := found[label[found] != label[a + i]]):
                links.append((int(a + i), int(found[0])))
                label[label == label[found[0]]] = label[a + i]
    return counts, other_counts, links


def _compare(kind: str, cosine: float):
    """Kernel over rows sorted by block: bucket, part, other, side, node, copies, buckets, body."""
    names = ["node", "copies", "other"]

    def run(batches):
        block, sides = None, None

        def flush():
            if block is None or not sides[0]["node"] or (block[1] != block[2] and not sides[1]["node"]):
                return
            parts = [{"unit": unit_rows(s["body"], kind), "copies": np.array(s["copies"], np.int64), "buckets": s["buckets"]} if s["node"] else None for s in sides]
            counts, others, links = block_links(*parts, block[0], cosine)
            nodes = sides[0]["node"] + sides[1]["node"]
            both = counts if parts[1] is None else np.concatenate([counts, others])
            for i in np.flatnonzero(both):
                yield nodes[i], int(both[i]), None
            for i, j in links:
                yield nodes[i], 0, nodes[j]

        def emit(found):
            columns = zip(*found, strict=True) if found else ([], [], [])
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=names)

        for batch in batches:
            found = []
            for bucket, part, other, side, node, copies, buckets, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (bucket, part, other) != block:
                    found += flush()
                    block, sides = (bucket, part, other), [{"node": [], "copies": [], "buckets": [], "body": []} for _ in range(2)]
                for name, value in zip(("node", "copies", "buckets", "body"), (node, copies, buckets, body), strict=True):
                    sides[side][name].append(value)
            yield emit(found)
        yield emit([*flush()])

    return run


def _blocks(members: DataFrame, part_rows: int) -> DataFrame:
    """Members dealt to blocks: a bucket is one block, a large one has a block for every two of its parts."""
    sizes = members.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / part_rows).cast("int").alias("_parts"))
    mine = F.pmod(F.xxhash64("node"), F.col("_parts")).cast("int")
    placed = members.join(sizes, "bucket").withColumn("_mine", mine)
    each = placed.select("bucket", "node", "_mine", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_with"))
    return each.select(
        "bucket", F.least("_mine", "_with").alias("part"), F.greatest("_mine", "_with").alias("other"),
        (F.col("_mine") > F.col("_with")).cast("int").alias("side"), "node",
    )


def near_vectors(embeddings: DataFrame, cosine: float = COSINE, recall: float = RECALL, part_rows: int = PART_ROWS) -> DataFrame:
    """vec_id, n_links, component_id and kept (vec_id = component_id) for each row.

    Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing, nor do vectors of different dimensions. Equal vectors are one node with so many
    copies; repeated rows are copies. Null ids are kept; a component of null ids only has a
    null id and is kept. Every pair found is checked in double precision. Pairs at the
    threshold are missed with a probability of 1 - ``recall``, closer ones far more rarely.
    Empty tables give no rows; other columns are not read.
    """
    element = embeddings.schema["embedding"].dataType.elementType.simpleString()
    kind = "<f4" if element == "float" else "<f8"
    rows = embeddings.select(F.monotonically_increasing_id().alias("_row"), F.col("vec_id").cast("long"), "embedding")
    read = saved(rows.mapInArrow(_bodies(kind), "_row long, vec_id long, body binary, sig1 long, sig2 long"))
    sound = read.where(F.col("body").isNotNull())
    nodes = saved(
        sound.groupBy("sig1", "sig2")
        .agg(F.min("_row").alias("node"), F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    )
    bodies = saved(sound.join(nodes.select(F.col("node").alias("_row"), F.col("node"), "copies"), "_row").select("node", "copies", "body"))
    hashed = bodies.select("node", "body").mapInArrow(_memberships(kind, bodies.count(), cosine, recall), "node long, bucket long")
    met = saved(hashed.distinct())
    # Buckets of one vector compare nothing; of buckets with the same members one is enough.
    members = F.sum(F.xxhash64("node").cast("decimal(20,0)")), F.bit_xor(F.xxhash64("node", F.lit(1)))
    sets = met.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), *(m.alias(f"m{i}") for i, m in enumerate(members)))
    shared = sets.where(F.col("n") > 1).groupBy("n", "m0", "m1").agg(F.min("bucket").alias("bucket"))
    placed = saved(met.join(shared.select("bucket"), "bucket"))
    lists = placed.groupBy("node").agg(F.array_sort(F.collect_list("bucket")).alias("buckets"))
    described = bodies.join(lists, "node").select("node", "copies", "buckets", "body")
    dealt = _blocks(placed, part_rows).join(described, "node").repartition("bucket", "part", "other")
    ordered = dealt.sortWithinPartitions("bucket", "part", "other").select("bucket", "part", "other", "side", "node", "copies", "buckets", "body")
    found = saved(ordered.mapInArrow(_compare(kind, cosine), "node long, copies long, other long"))
    counts = found.where(F.col("other").isNull()).groupBy("node").agg(F.sum("copies").alias("_linked"))
    parts = components(found.where(F.col("other").isNotNull()).select("node", "other"), "node", "other")
    labelled = nodes.join(parts, "node", "left").join(counts, "node", "left")
    labelled = saved(labelled.select("sig1", "sig2", "least", F.coalesce("component", "node").alias("component"), (F.coalesce("_linked", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    ids = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    by_vector = labelled.join(ids, "component").select("sig1", "sig2", "n_links", "component_id")
    alone = read.where(F.col("body").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = sound.select("vec_id", "sig1", "sig2").join(by_vector, ["sig1", "sig2"]).select("vec_id", "n_links", "component_id")
    return out.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
