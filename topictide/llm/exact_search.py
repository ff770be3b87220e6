"""Exact top-k inner products by vector approximations.

Vectors are cut into blocks; a block keeps, for each of its dimensions, a grid of 256 cells
and for each vector its cells, one byte a dimension. A scan of the cells bounds every score
from below and above. Exact vectors are then read in the order of their bounds: first the k
best of each query, whose scores say which others can still be among the k best; only those
are read as well. Queries and vectors meet block by block, spread over salts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topictide.llm.store import saved

BLOCK_ROWS, BLOCK_QUERIES, CELLS = 4096, 1024, 256


def integer_vectors(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """Rows that take part, stored: _row (unique), vec_id, _dim and _v, whole numbers as doubles."""
    whole = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.where(F.col("embedding").isNotNull() & sound)
    return saved(rows.select(F.monotonically_increasing_id().alias("_row"), "vec_id", F.size("embedding").alias("_dim"), whole.alias("_v")))


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _few_copies(vectors: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Places of the rows without those that ``most`` equal rows with smaller ids precede."""
    _, group = np.unique(vectors, axis=0, return_inverse=True) if vectors.shape[1] else (None, np.zeros(len(vectors), int))
    by = np.lexsort((order, group))
    first = np.r_[True, group[by][1:] != group[by][:-1]]
    nth = np.arange(len(by)) - np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))
    return np.sort(by[nth < most])


def _blocks(rows: DataFrame, size: int, k: int | None) -> DataFrame:
    """Blocks of at most ``size`` vectors of one dimension; with ``k``, cells and not vectors.

    Of equal vectors in a block only the k + 1 with the smallest ids can be among the k best
    of a query other than themselves; others are left out of the scan.
    """

    def cut(batches):
        waiting: dict[int, list] = {}

        def emit(dim):
            ids, numbers, vectors = (np.concatenate(x) for x in zip(*waiting.pop(dim), strict=True))
            for a in range(0, len(ids), size):
                row, number, v = ids[a : a + size], numbers[a : a + size], vectors[a : a + size]
                low = step = np.zeros(0)
                body = v
                if k is not None:
                    keep = _few_copies(v, number, k + 1)
                    row, v = row[keep], v[keep]
                    low = v.min(axis=0) if dim else np.zeros(0)
                    step = np.maximum(1, np.ceil((v.max(axis=0) - low + 1) / CELLS)) if dim else np.zeros(0)
                    body = np.clip(np.floor((v - low) / step), 0, CELLS - 1).astype(np.uint8) if dim else np.zeros((len(row), 0), np.uint8)
                values = [[int(row[0])], [dim], [row.tobytes()], [body.tobytes()], [low.tobytes()], [step.tobytes()]]
                kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(values, kinds, strict=True)], names=names)

        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                number = part.column(1).fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
                waiting.setdefault(int(dim), []).append((part.column(0).to_numpy(), number, _matrix(part.column(3), int(dim))))
                if sum(len(x[0]) for x in waiting[int(dim)]) >= size:
                    yield from emit(int(dim))
        for dim in [*waiting]:
            yield from emit(dim)

    names = ["block", "_dim", "ids", "body", "low", "step"]
    return rows.select("_row", "vec_id", "_dim", "_v").mapInArrow(cut, "block long, _dim int, ids binary, body binary, low binary, step binary")


def _scan(k: int):
    """Bounds of each query against each block; keeps what can be among its k best in the block."""
    names = ["_query", "_row", "low", "high"]

    def scan(batches):
        for batch in batches:
            for row in batch.to_pylist():
                dim = row["_dim"]
                queries, ids = np.frombuffer(row["query_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
                q = np.frombuffer(row["queries"]).reshape(len(queries), dim)
                low, step = np.frombuffer(row["low"]), np.frombuffer(row["step"])
                v = low + step * np.frombuffer(row["body"], np.uint8).reshape(len(ids), dim)
                slack = 1e-9 * np.abs(q).sum(axis=1) * (np.abs(low) + CELLS * step).max(initial=0)
                least = q @ v.T + (np.minimum(q, 0) @ (step - 1) - slack)[:, None]
                gap = np.abs(q) @ (step - 1) + 2 * slack
                own = queries[:, None] == ids
                least[own] = -np.inf
                bar = np.partition(least, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(queries), -np.inf)
                i, j = np.nonzero((least + gap[:, None] >= bar[:, None]) & ~own)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (queries[i], ids[j], least[i, j], least[i, j] + gap[i])], names=names)

    return scan


def _kth(rows: DataFrame, value: str, k: int, name: str) -> DataFrame:
    """Each query's k-th largest value; nothing for queries with fewer."""
    order = Window.partitionBy("_query").orderBy(F.col(value).desc())
    ranked = rows.select("_query", value, F.row_number().over(order).alias("_n")).where(F.col("_n") <= k)
    return ranked.groupBy("_query").agg(F.max("_n").alias("_n"), F.min(value).alias(name)).where(F.col("_n") == k).drop("_n")


def _scored(pairs: DataFrame, queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """Exact inner products of (_query, _row) pairs; limits of a long hold beyond it."""
    left = queries.select(F.col("_row").alias("_query"), F.col("vec_id").alias("query_id"), F.col("_v").alias("_q"))
    product = F.aggregate(F.zip_with("_q", "_v", lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    edge = float(2**63 - 1024)
    score = F.greatest(F.lit(-edge), F.least(F.lit(edge), product)).cast("long")
    both = pairs.join(left, "_query").join(vectors.select("_row", "vec_id", "_v"), "_row")
    return both.select("_query", "_row", "query_id", "vec_id", score.alias("score"))


def top_inner_products(embeddings: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best rows for each query row.

    Vectors that are null or hold null or non-finite components take no part; vectors of
    other dimensions than a query's are no candidates of it. The query's own row is left out,
    a repeated row is not. Ties go to the smaller vec_id, null ids last. Scores are exact as
    long as products sum below 2^53. Empty tables give no rows.
    """
    vectors = integer_vectors(embeddings, scale)
    queries = vectors.where(is_query)
    blocks = saved(_blocks(vectors, BLOCK_ROWS, k))
    salts = max(1, math.ceil(blocks.count() / 4))
    asked = _blocks(queries, BLOCK_QUERIES, None).select(
        "_dim", F.col("ids").alias("query_ids"), F.col("body").alias("queries"),
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"),
    )
    dealt = blocks.withColumn("_salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int"))
    met = dealt.join(asked, ["_dim", "_salt"]).select("_dim", "ids", "body", "low", "step", "query_ids", "queries")
    bounds = saved(met.mapInArrow(_scan(k), "_query long, _row long, low double, high double"))
    cut = _kth(bounds, "low", k, "_bar")
    left = saved(bounds.join(cut, "_query", "left").where(F.col("_bar").isNull() | (F.col("high") >= F.col("_bar"))).drop("_bar", "low"))
    by_bound = Window.partitionBy("_query").orderBy(F.col("high").desc(), "_row")
    placed = left.withColumn("_n", F.row_number().over(by_bound))
    first = saved(_scored(placed.where(F.col("_n") <= k).select("_query", "_row"), queries, vectors))
    later = placed.where(F.col("_n") > k).join(_kth(first, "score", k, "_bar"), "_query").where(F.col("high") >= F.col("_bar"))
    scored = first.unionByName(_scored(later.select("_query", "_row"), queries, vectors))
    best = Window.partitionBy("_query").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "_row")
    ranked = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
