"""Documents whose word n-gram sets have a high Jaccard similarity, and their components.

Rows of the incidence matrix are the distinct n-gram sets, columns the n-grams by hash. The
columns of a row are cut into ranges: sets similar enough differ in at most D n-grams, so
where D + 1 ranges of one of them hold n-grams, one of these is the same in both. Rows that share a range meet in a row block, around the
row that shares most; there the sparse product of rows by columns is accumulated, and pairs
below the bound that their sizes give are discarded. Blocks are bounded: a block with too
many rows is cut, and its parts meet again for the rows that are not yet in one component.
"""

from __future__ import annotations

import functools
import math
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topictide.llm.graph import components
from topictide.llm.store import saved
from topictide.llm.texts import in_slices, worker_memo

#: Similarity as a fraction: linked if NUM[0] * union <= NUM[1] * intersection.
SIMILARITY = (90, 100)
#: Rows of one block.
BLOCK_ROWS = 4096
#: Word hashes kept in one worker's memo; the memo starts anew beyond it.
MEMO_WORDS = 100_000
#: Deviations by which a set's filled ranges shall exceed D; cuts that are tried where they don't.
MARGIN, LEVELS = 4, 8


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < MEMO_WORDS:
            self[word] = value
        return value


def ngram_set(text: str, n: int = 3) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; of all words, if they are fewer."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only
    if not words:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(worker_memo("ngrams", _Words).__getitem__, words), np.uint64, len(words))
    size = min(n, len(words))
    grams = _mix(ids[: len(ids) - size + 1] + np.uint64(size))
    for k in range(1, size):
        grams = _mix(grams * np.uint64(0x9E3779B97F4A7C15) + ids[k : len(ids) - size + 1 + k])
    return np.unique(grams)


@functools.lru_cache(maxsize=None)
def size_windows(largest: int, similarity: tuple[int, int] = SIMILARITY) -> list[tuple[int, int, int, int]]:
    """(first size, last size, D, ranges) such that any two similar sets share a window.

    D is the most n-grams in which similar sets of the window differ. There are as many
    ranges as leave D + 1 of them filled, by ``MARGIN`` deviations, in the window's smallest sets.
    """
    num, den = similarity
    out, low = [], 1
    while low <= largest:
        following = max(low + 1, low * 135 // 100)
        last = (following - 1) * den // num
        differ = (den - num) * 2 * last // (den + num)
        ranges = differ + 1
        while ranges < 4 * low and _filled(low, ranges) < differ + 1:
            ranges += max(1, ranges // 50)
        out.append((low, last, differ, ranges))
        low = following
    return out


def _filled(size: int, ranges: int) -> float:
    """Ranges that hold some of ``size`` n-grams: their mean less the margin."""
    empty = math.exp(-size / ranges)
    spread = ranges * empty * (1 - (1 + size / ranges) * empty)
    return ranges * (1 - empty) - MARGIN * math.sqrt(max(spread, 0.0))


def range_keys(grams: np.ndarray, similarity: tuple[int, int] = SIMILARITY) -> np.ndarray:
    """One key for each filled column range of a set, in each size window that it belongs to.

    Similar sets agree on all but D ranges, so on a filled one if either has D + 1 of them.
    A set that has fewer is cut once more by another hash, as is each set that could miss it;
    after ``LEVELS`` cuts its n-grams first in a fixed order are keys: similar sets share one.
    """
    num, den = similarity
    size, keys = len(grams), []
    for w, (low, last, differ, ranges) in enumerate(size_windows(1 << max(4, int(size).bit_length()), similarity)):
        if not low <= size <= last or not differ:  # without differences, only equal sets are similar
            continue
        for level in range(LEVELS):
            parts, tags = _cut(grams, ranges, w * LEVELS + level)
            full = parts != 0
            keys.append(_mix(parts[full] ^ tags[full]))
            if len(keys[-1]) > differ:
                break
        else:
            first = np.sort(_mix(grams + np.uint64(w)))[: size - -(-num * size // den) + 1]
            keys.append(_mix(first))
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def _cut(grams: np.ndarray, ranges: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of the n-grams in each range, 0 for none, and a tag of each range."""
    spread = np.sort(_mix(grams + np.uint64(salt * 0x1000193 + 7)))
    ends = np.searchsorted((spread >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32), np.arange(ranges + 1, dtype=np.uint64))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(spread), dtype=np.uint64)])
    parts = np.where(ends[1:] > ends[:-1], (total[ends[1:]] - total[ends[:-1]]) | np.uint64(1), np.uint64(0))
    return parts, _mix(np.full(ranges, (salt + 1) << 32, np.uint64) + np.arange(ranges, dtype=np.uint64))


def _described(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles and a 128-bit signature of the set."""
    names = ["doc_id", "n_shingles", "sig1", "sig2"]

    def describe(batches):
        for batch in in_slices(batches):
            sets = [ngram_set(t or "", n) for t in batch.column(1).to_pylist()]
            signs = np.frombuffer(b"".join(map(_signature, sets)), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(signs[:, 0]), pa.array(signs[:, 1])], names=names)

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(describe, "doc_id long, n_shingles long, sig1 long, sig2 long")


def _signature(grams: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(grams.tobytes())


def _ranges(docs: DataFrame, n: int, similarity: tuple[int, int]) -> DataFrame:
    """node and key of each range of each set; sets are read anew, as all keys of a table take more room than its texts."""

    def cut(batches):
        for batch in in_slices(batches, 100):
            sets = [s for s in (ngram_set(t or "", n) for t in batch.column(0).to_pylist()) if len(s)]
            keys = [range_keys(s, similarity).view(np.int64) for s in sets]
            nodes = np.frombuffer(b"".join(map(_signature, sets)), np.int64)[::2]
            every = np.concatenate([*keys, np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(nodes, [len(k) for k in keys])), pa.array(every)], names=["node", "key"])

    return docs.select(F.col("text").cast("string")).mapInArrow(cut, "node long, key long")


def block_links(sets: list[np.ndarray], similarity: tuple[int, int] = SIMILARITY, apart: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join the rows of a block as all of its links would, by a sparse product.

    The first row is multiplied first; then every row that is outside the largest component.
    ``apart`` names known components. Pairs inside a component need no product.
    """
    num, den = similarity
    sizes = np.array([len(s) for s in sets])
    label = np.arange(len(sets)) if apart is None else np.unique(apart, return_inverse=True)[1]
    columns = np.concatenate(sets)
    order = np.argsort(columns, kind="stable")
    owner = np.repeat(np.arange(len(sets)), sizes)[order]
    columns = columns[order]
    links: list[tuple[int, int]] = []

    def multiply(i: int) -> None:
        nonlocal label
        first, last = np.searchsorted(columns, sets[i], "left"), np.searchsorted(columns, sets[i], "right")
        lengths = last - first
        at = np.repeat(first - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        overlap = np.bincount(owner[at], minlength=len(sets))
        near = np.flatnonzero((overlap * (den + num) >= num * (sizes + sizes[i])) & (label != label[i]))
        for other in np.unique(label[near]):
            links.append((i, int(near[label[near] == other][0])))
            label = np.where(label == other, label[i], label)

    multiply(0)
    home = int(np.flatnonzero(label == np.bincount(label).argmax())[0])
    for i in np.flatnonzero(label != label[home]):
        if label[i] != label[home]:
            multiply(int(i))
    return links


def _link_blocks(n: int, similarity: tuple[int, int]):
    """Kernel over rows sorted by block: hub, part, side, node, component, text."""

    def run(batches):
        block, nodes, sets, known, side = None, [], [], [], []

        def flush():
            if len(sets) > 1:
                for i, j in block_links(sets, similarity, np.array(known)):
                    yield nodes[i], nodes[j]

        def emit(found):
            pairs = np.array(found, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            found = []
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for hub, part, other, node, component, text in zip(*columns, strict=True):
                if (hub, part, other) != block:
                    found += flush()
                    block, nodes, sets, known = (hub, part, other), [], [], []
                grams = ngram_set(zlib.decompress(text).decode("utf-8", "surrogatepass"), n)
                # an id may be repeated with another text, which is then another node's
                if np.frombuffer(_signature(grams), np.int64)[0] == node and node not in nodes[:1]:
                    nodes.append(node)
                    sets.append(grams)
                    known.append(component)
            yield emit(found)
        yield emit([*flush()])

    return run


def _compressed():
    def compress(texts: pa.Array) -> pa.Array:
        return pa.array([zlib.compress(text.as_py().encode("utf-8", "surrogatepass"), 1) for text in texts], pa.binary())

    compress.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(compress, "binary")


def _links(rows: DataFrame, nodes: DataFrame, docs: DataFrame, n: int, similarity: tuple[int, int]) -> DataFrame:
    """Links inside blocks; ``rows`` has hub, part, other, node, component, and the hub comes first.

    Texts are compressed before they are dealt out, by id and then by block.
    """
    texts = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("_id"), _compressed()(F.col("text").cast("string")).alias("text"))
    asked = rows.join(nodes.select("node", "doc_id"), "node")
    joined = asked.join(texts, F.col("doc_id").eqNullSafe(F.col("_id")))
    dealt = joined.withColumn("_later", F.col("node") != F.col("hub")).repartition("hub", "part", "other")
    ordered = dealt.sortWithinPartitions("hub", "part", "other", "_later", "node").select("hub", "part", "other", "node", "component", "text")
    return ordered.mapInArrow(_link_blocks(n, similarity), "a long, b long")


def similar_documents(docs: DataFrame, n: int = 3, similarity: tuple[int, int] = SIMILARITY, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id reachable by links.

    Equal sets are one node, so copies cost no pairs; sets are compared by 64-bit hashes. A
    null or empty text has no n-grams and is linked with nothing, not even its like. Repeated
    rows each give a row. Null ids are kept; a component holding only them has a null id. An
    empty table gives no rows; other columns are not read.
    """
    sets = saved(_described(docs, n))
    filled = sets.where(F.col("n_shingles") > 0)
    nodes = saved(filled.groupBy(F.col("sig1").alias("node")).agg(F.min("doc_id").alias("doc_id")))
    # one shuffle of all keys, which are not stored: a key that two sets share stays
    same = Window.partitionBy("key")
    ends = F.min("node").over(same).alias("_a"), F.max("node").over(same).alias("_b"), F.count(F.lit(1)).over(same).alias("_n")
    ranges = _ranges(docs, n, similarity).select("node", "key", *ends)
    met = saved(ranges.where(F.col("_a") != F.col("_b")).select("key", "node", "_n").distinct())
    # of the rows that share a range, the one that shares most is the hub of a block
    weights = met.groupBy("node").agg(F.sum("_n").alias("_w"))
    order = F.shiftleft("_w", 20) + F.pmod(F.xxhash64("node"), F.lit(1 << 20))
    hubs = met.drop("_n").join(weights, "node").groupBy("key").agg(F.max_by("node", order).alias("hub"))
    pairs = saved(met.join(hubs, "key").where(F.col("node") != F.col("hub")).select("hub", "node").distinct())
    parts = pairs.groupBy("hub").agg(F.ceil((F.count(F.lit(1)) + 1) / block_rows).cast("int").alias("_parts"))
    placed = saved(pairs.join(parts, "hub").withColumn("part", F.pmod(F.xxhash64("node"), F.col("_parts")).cast("int")))
    heads = parts.select("hub", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("part"), F.col("hub").alias("node"))
    members = placed.select("hub", "part", "node").unionByName(heads)
    first = members.select("hub", "part", F.lit(-1).alias("other"), "node", F.col("node").alias("component"))
    links = saved(_links(first, nodes, docs, n, similarity))
    if placed.where(F.col("_parts") > 1).limit(1).count():
        links = links.unionByName(saved(_links(_parts_left(placed, links), nodes, docs, n, similarity)))
    labels = components(links, "a", "b")
    named = nodes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_node = saved(named.join(smallest, "component").select(F.col("node").alias("sig1"), "component_id"))
    out = filled.select("doc_id", "n_shingles", "sig1").join(by_node, "sig1").select("doc_id", "n_shingles", "component_id")
    empty = sets.where(F.col("n_shingles") == 0).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(empty)


def _parts_left(placed: DataFrame, links: DataFrame) -> DataFrame:
    """Rows for the blocks of two parts of one hub: those not in the hub's largest component, and the other part."""
    labels = components(links, "a", "b")
    split = placed.where(F.col("_parts") > 1).join(labels, "node", "left")
    split = saved(split.withColumn("component", F.coalesce("component", "node")))
    counted = split.groupBy("hub", "component").agg(F.count(F.lit(1)).alias("_n"))
    largest = counted.groupBy("hub").agg(F.max_by("component", F.struct("_n", "component")).alias("_home"))
    rest = saved(split.join(largest, "hub").where(F.col("component") != F.col("_home")))
    others = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("other")
    mine = rest.select("hub", "part", others, "node", "component").where(F.col("part") != F.col("other"))
    asking = rest.select("hub", "part").distinct()
    theirs = split.select("hub", F.col("part").alias("other"), "node", "component").join(asking, "hub").where(F.col("part") != F.col("other"))
    return mine.unionByName(theirs.select("hub", "part", "other", "node", "component"))
