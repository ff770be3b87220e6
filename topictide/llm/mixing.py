"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source of weight w and size n, of a corpus of size N, is to be read w * N / n times on
average. Each document gets a uniform number from a hash of its id and a seed, and is
repeated as often as the Poisson distribution of that mean says at this number. The copies
are then put in a global random order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topictide.llm.store import saved
from topictide.operators.numbering import numbered

#: Hexadecimal digits (52 bits) that make the uniform number; exact in a double.
HASH_DIGITS = 13
#: Rates are broadcast up to these many sources and table entries (8 bytes each).
BROADCAST_ROWS, BROADCAST_NUMBERS = 20_000, 1_000_000


def uniform(seed: str, *parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 digest of the seed and the parts."""
    texts = [F.coalesce(part.cast("string"), F.lit("null")) for part in parts]
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), *texts)), 1, HASH_DIGITS)
    return F.conv(digits, 16, 10).cast("long").cast("double") / F.lit(float(16**HASH_DIGITS))


def poisson_table(mean: Column) -> Column:
    """Distribution function of a Poisson variable at ``poisson_start``, the next number, and so on.

    The band ends where tails are below 2^-52. Terms are built from logarithms, so a large
    mean does not underflow; the first one of a band that does not begin at 0 comes from
    Stirling's series.
    """
    low, last = poisson_start(mean), F.ceil(mean + 9 * F.sqrt(mean) + 40).cast("int")
    n = low.cast("double")
    stirling = n * F.ln(n) - n + 0.5 * F.ln(2 * math.pi * n) + 1 / (12 * n) - 1 / (360 * n * n * n)
    log = F.when(low > 0, n * F.ln(mean) - mean - stirling).otherwise(-mean)
    first = F.exp(log)
    start = F.struct(log.alias("log"), first.alias("sum"), F.array(first).alias("all"))

    def add(acc: Column, k: Column) -> Column:
        log = acc["log"] + F.ln(mean) - F.ln(k.cast("double"))
        total = acc["sum"] + F.exp(log)
        return F.struct(log.alias("log"), total.alias("sum"), F.concat(acc["all"], F.array(total)).alias("all"))

    table = F.aggregate(F.sequence(low + 1, last), start, add, lambda acc: acc["all"])
    return F.when(mean > 0, table).otherwise(F.array(F.lit(1.0)))


def poisson_start(mean: Column) -> Column:
    """The first number of the band of ``poisson_table``; what lies below it has no chance."""
    return F.greatest(F.lit(0), F.floor(mean - 9 * F.sqrt(mean) - 40).cast("int"))


def drawn_copies(table: Column, start: Column, drawn: Column) -> Column:
    """How many entries of a band lie at or below the drawn number, by halving, and what precedes the band."""
    def halve(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        below = (acc["low"] < acc["high"]) & (F.get(table, middle) <= drawn)
        low = F.when(below, middle + 1).otherwise(acc["low"])
        high = F.when(below | (acc["low"] >= acc["high"]), acc["high"]).otherwise(middle)
        return F.struct(low.alias("low"), high.alias("high"))

    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(table) + 1)).cast("int"))
    ends = F.struct(F.lit(0).alias("low"), F.size(table).alias("high"))
    return (start + F.aggregate(rounds, ends, halve, lambda acc: acc["low"])).cast("long")


def source_rates(docs: DataFrame, weights: dict[str, float] | None, exponent: float, size: Column) -> DataFrame:
    """One row per source: its size, mean repetition rate and Poisson table.

    Without ``weights`` a source weighs its size to the power ``exponent``. With them, a
    source that is not named weighs nothing.
    """
    sizes = docs.groupBy("source").agg(F.sum(F.coalesce(size, F.lit(0)).cast("long")).alias("_size"))
    if weights is None:
        wish = F.pow(F.col("_size").cast("double"), F.lit(exponent))
    else:
        named = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
        wish = F.coalesce(named[F.col("source")], F.lit(0.0)).cast("double")
    sizes = sizes.withColumn("_wish", F.when(F.col("_size") > 0, wish).otherwise(0.0))
    total, wishes = sizes.agg(F.sum("_size"), F.sum("_wish")).first()
    rate = F.when(F.col("_wish") > 0, F.col("_wish") / F.lit(wishes) * F.lit(total) / F.col("_size")).otherwise(0.0)
    return sizes.select("source", "_size", rate.alias("rate")).withColumn("table", poisson_table(F.col("rate")))


def _joinable(rates: DataFrame) -> DataFrame:
    """A broadcast of the rates if they are few, by count; else the plain table."""
    rates = saved(rates)
    rows, numbers = rates.agg(F.count(F.lit(1)), F.sum(F.size("table"))).first()
    return F.broadcast(rates) if rows <= BROADCAST_ROWS and (numbers or 0) <= BROADCAST_NUMBERS else rates


def repeat_documents(
    docs: DataFrame, weights: dict[str, float] | None = None, exponent: float = 0.5,
    seed: str = "mix", size: Column | None = None,
) -> DataFrame:
    """``docs`` repeated at the rate of their source, in a global random order.

    Adds ``copy`` (from 0), ``n_copies`` and ``rate``. ``size`` measures a document; by
    default it is one. Documents without a source are a source of their own, and rows of one
    id share their number, so repeated rows are repeated alike. Rows without an id each have a
    number of their own, from a digest of the row and which of the equal rows it is. An empty
    table stays empty. Columns named like those added are replaced.
    """
    docs = docs.drop("copy", "n_copies", "rate")
    names = docs.columns
    mark = next("_" * i for i in range(1, len(names) + 9) if not any(n.startswith("_" * i) for n in names))
    table, source, named, first, order = (mark + x for x in ("table", "source", "id", "first", "place"))
    size = F.lit(1) if size is None else size
    rates = source_rates(docs, weights, exponent, size)
    rates = _joinable(rates.select(F.col("source").alias(source), "rate", "table", poisson_start(F.col("rate")).alias(first)))
    rates = rates.withColumnRenamed("table", table)
    with_id = docs.where(F.col("doc_id").isNotNull()).withColumn(named, F.col("doc_id").cast("string"))
    digest = F.md5(F.to_json(F.struct(*names)))
    equal = numbered(docs.where(F.col("doc_id").isNull()).withColumn(order, digest), [order], [order], first)
    without = equal.withColumn(named, F.concat_ws(":", F.lit("null"), order, first)).select(*names, named)
    joined = with_id.unionByName(without).join(rates, F.col("source").eqNullSafe(F.col(source))).drop(source)
    copied = drawn_copies(F.col(table), F.col(first), uniform(seed, F.col(named)))
    counted = joined.withColumn("n_copies", copied).drop(table, first)
    copies = counted.where(F.col("n_copies") > 0).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)))
    place = uniform(seed + "/order", F.col(named), F.col("copy"))
    return copies.withColumn(order, place).orderBy(order, named, "copy").drop(order, named)
