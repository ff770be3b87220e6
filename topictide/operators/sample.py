"""Seeded samples that are the same under any partitioning."""

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topictide.functions.rules import contains_any
from topictide.lineage import broadcast_if_small
from topictide.operators.dedupe import first_per_key
from topictide.operators.match import match_terms
from topictide.operators.rank import (
    GROUP_LIMIT,
    draw_digest,
    first_digests,
    smallest_digests,
)

# Draws per pass over the rows, each a minimum of its own.
DRAWS_PER_PASS = 50


def sample_per_group(
    df: DataFrame, group: str, key: Iterable[str], n: int = 10, seed: object = 0
) -> DataFrame:
    """``min(n, size)`` draws with replacement per group, as rows with their ``draw`` number.

    Draw j of a group is the row with the smallest digest of (seed, j, key):
    every row is equally likely and draws are independent. ``key`` identifies a
    row. Only whole numbers are aggregated, in a hash table and map-side, so a
    group of any size reaches the reducer as one row per task; the drawn rows
    are then found again by their digests in a second pass that moves no data.
    """
    key = list(key)
    picked = None
    for start in range(1, n + 1, DRAWS_PER_PASS):
        part = range(start, min(start + DRAWS_PER_PASS, n + 1))
        least = [F.min(_number(key, seed, F.lit(j))).alias(f"_d{j}") for j in part]
        sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_size"), *least)
        draws = F.array(*[F.struct(F.lit(j).alias("draw"), F.col(f"_d{j}").alias("_least"))
                          for j in part])
        drawn = sizes.select(F.col(group).alias("_group"), "_size", F.explode(draws).alias("d"))
        drawn = drawn.select("_group", "d.*").where(F.col("draw") <= F.col("_size"))
        picked = drawn if picked is None else picked.unionByName(drawn)
    # At most n rows per group, measured before they are broadcast.
    wanted = broadcast_if_small(picked.groupBy("_group").agg(
        F.map_from_entries(F.collect_list(F.struct("draw", "_least"))).alias("_draws")
    ))
    rows = df.join(wanted, F.col(group).eqNullSafe(F.col("_group")))
    hits = F.filter(
        F.map_entries("_draws"), lambda e: e["value"] == _number(key, seed, e["key"])
    )
    found = rows.withColumn("draw", F.explode(F.transform(hits, lambda e: e["key"])))
    # Two keys of one digest are a tie: the smaller key is drawn.
    return first_per_key(found, [group, "draw"], key).select("draw", *df.columns)


def _number(key: list[str], seed: object, draw: Column) -> Column:
    """The leading 60 bits of the digest of (seed, draw, key) as a whole number."""
    return F.conv(F.substring(draw_digest(key, seed, draw), 1, 15), 16, 10).cast("bigint")


def sample_proportional(
    df: DataFrame,
    key: Iterable[str],
    total: int = 10_000,
    counted: int | None = None,
    group: str = "dt",
    seed: object = 2025,
) -> DataFrame:
    """About ``total`` rows without replacement, every group at the same rate.

    The rate is ``total`` over ``counted`` rows (the counts the caller knows of;
    by default the rows of ``df``), at most 1. A group of n rows gives exactly
    ``rate * n`` rows, halves rounded to even.
    """

    def quota(size, rows):
        known = counted if counted is not None else rows
        rate = min(1.0, total / known) if known else 0.0
        return F.bround(F.lit(rate) * size.cast("double"), 0)

    return smallest_digests(df, group, key, quota, seed)


def sample_by_counts(
    df: DataFrame,
    counts: DataFrame,
    key: Iterable[str],
    total: int = 10_000,
    topic: str = "keyword_id",
    group: str = "dt",
    seed: object = 2025,
) -> DataFrame:
    """About ``total`` rows of each topic without replacement, every group at the topic's rate.

    ``counts`` is ``topic, group, count`` from the caller. The rate of a topic is ``total``
    over the sum of its counts, at most 1; a listed group of n rows gives ``rate * n`` rows,
    halves rounded to even, and a group that is not listed gives none.
    """
    known = F.sum("count").over(Window.partitionBy(topic))
    rate = F.least(F.lit(1.0), F.coalesce(F.try_divide(F.lit(float(total)), known), F.lit(0.0)))
    listed = counts.groupBy(topic, group).agg(F.sum("count").alias("count")).select(
        topic, group, F.struct(topic, group, rate.alias("rate")).alias("_both")
    )
    rows = df.join(listed, [topic, group]).select(*df.columns, "_both")

    def quota(size, _):
        return F.bround(F.col("_both")["rate"] * size.cast("double"), 0)

    return smallest_digests(rows, "_both", key, quota, seed).drop("_both")


def sample_matching(
    df: DataFrame,
    terms: str | Iterable[str],
    key: Iterable[str],
    n: int = 300,
    text: str = "weibo_content",
    group: str = "dt",
    seed: object = 0,
) -> DataFrame:
    """``n`` rows per group that hold the term (or any of the terms); all of them if fewer."""
    words = [terms] if isinstance(terms, str) else list(terms)
    return _first_n(df.where(contains_any(text, words)), key, n, group, seed)


def sample_each_term(
    df: DataFrame,
    terms: Iterable[str],
    key: Iterable[str],
    n: int = 300,
    text: str = "weibo_content",
    group: str = "dt",
    seed: object = 0,
) -> DataFrame:
    """``n`` rows per group and term that hold the term, with the ``term``; all of them if fewer.

    A row of several terms may be drawn once for each. The pick of a term is that of
    ``sample_matching`` with this term alone.
    """
    hits = match_terms(df, terms, text, "term")
    both = hits.withColumn("_both", F.struct(group, "term"))
    return _first_n(both, key, n, "_both", seed).drop("_both")


def _first_n(df: DataFrame, key: Iterable[str], n: int, group: str, seed: object) -> DataFrame:
    if n <= GROUP_LIMIT:
        return first_digests(df, group, key, n, seed)
    return smallest_digests(df, group, key, lambda size, _: F.least(size, F.lit(n)), seed)
