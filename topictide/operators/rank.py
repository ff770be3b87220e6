"""Exact picks by rank without a global or per-group sort in one task.

Rows are ordered by a digest of their key. The digest's leading digits are
evenly filled buckets, so a count per bucket tells which buckets a pick takes
whole and where it ends; only the rows of that last bucket are numbered.
"""

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topictide.lineage import broadcast_if_small, cut_lineage

BUCKET_DIGITS = 3  # hexadecimal digits: 4096 buckets per group
GROUP_LIMIT = 1000  # the rank up to which Spark limits groups before the shuffle


def key_digest(key: Iterable[str], *salts: object) -> Column:
    """Digest of a row key: a fixed pseudo-random order, the same under any partitioning."""
    return _digest([F.lit(str(salt)) for salt in salts], key)


def _digest(salts: list[Column], key: Iterable[str]) -> Column:
    # A null part keeps its place, and bars inside a part are escaped, so different keys differ.
    escaped = (
        F.regexp_replace(F.col(name).cast("string"), r"([\\|])", r"\\$1") for name in key
    )
    values = [F.coalesce(part, F.lit("\0")) for part in escaped]
    return F.md5(F.concat_ws("|", *salts, *values))


def draw_digest(key: Iterable[str], seed: object, draw: Column) -> Column:
    """The digest of a row key for one numbered draw."""
    numbered = F.concat_ws("|", F.lit(str(seed)), draw.cast("string"))
    return _digest([numbered], key)


def first_digests(
    df: DataFrame, group: str, key: Iterable[str], n: int, seed: object = 0
) -> DataFrame:
    """The first ``n`` rows of each group in digest order, in one pass; for small ``n``.

    Rows are limited per group and bucket first, which Spark also does before
    the shuffle (window group limit), so the last step sees at most ``n`` rows
    per bucket.
    """
    if n > GROUP_LIMIT:
        raise ValueError(f"n must be at most {GROUP_LIMIT}; use smallest_digests")
    key = list(key)
    rows = df.withColumn("_digest", key_digest(key, seed))
    spread = rows.withColumn("_bucket", F.substring("_digest", 1, 2))
    for parts in ([group, "_bucket"], [group]):
        window = Window.partitionBy(*parts).orderBy("_digest", *key)
        spread = spread.withColumn("_place", F.row_number().over(window)).where(
            F.col("_place") <= n
        )
    return spread.select(*df.columns)


def smallest_digests(
    df: DataFrame,
    group: str | None,
    key: Iterable[str],
    quota: Callable[[Column, int], Column],
    seed: object = 0,
) -> DataFrame:
    """The first ``quota(group_size, all_rows)`` rows of each group in digest order.

    ``key`` must identify a row. ``group`` null means one group of all rows.
    """
    key = list(key)
    name = group or "_all"
    rows = df if group else df.withColumn("_all", F.lit(0))
    digest = key_digest(key, seed)
    bucket = F.substring(digest, 1, BUCKET_DIGITS)
    # Pass 1 reads the keys only and leaves at most 4096 rows per group.
    sizes = cut_lineage(
        rows.groupBy(name, bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
    )
    total = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    upto = Window.partitionBy(name).orderBy("_bucket")
    whole = Window.partitionBy(name)
    last = (
        sizes.withColumn("_upto", F.sum("_n").over(upto))
        .withColumn("_quota", quota(F.sum("_n").over(whole), total).cast("bigint"))
        .where((F.col("_upto") >= F.col("_quota"))
               & (F.col("_upto") - F.col("_n") < F.col("_quota")))
        .select(
            F.col(name).alias("_group"),
            F.col("_bucket").alias("_last"),
            (F.col("_quota") - F.col("_upto") + F.col("_n")).alias("_rest"),
        )
    )
    # One row per group, measured before it is broadcast. Pass 2 then filters map-side, and
    # only the bucket where the pick ends is shuffled and numbered.
    taken = (
        rows.withColumn("_digest", digest)
        .withColumn("_bucket", F.substring("_digest", 1, BUCKET_DIGITS))
        .join(broadcast_if_small(last), F.col(name).eqNullSafe(F.col("_group")))
    )
    below = taken.where(F.col("_bucket") < F.col("_last"))
    within = Window.partitionBy(name).orderBy("_digest", *key)
    ending = (
        taken.where(F.col("_bucket") == F.col("_last"))
        .withColumn("_place", F.row_number().over(within))
        .where(F.col("_place") <= F.col("_rest"))
    )
    return below.select(*df.columns).unionByName(ending.select(*df.columns))
