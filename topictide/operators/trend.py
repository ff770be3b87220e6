"""Daily term counts and their trends by month or year, by term or quality."""

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topictide.functions.periods import month_of, year_of
from topictide.functions.ratios import safe_ratio
from topictide.functions.rules import contains_any
from topictide.functions.text import own_content
from topictide.operators.match import SCAN_TERMS, match_terms

GRAINS = {"month": month_of, "year": year_of}


def child_posts(
    posts: DataFrame, child_terms: Iterable[str], content: str = "weibo_content",
    own: str = "original_weibo_content",
) -> DataFrame:
    """Posts whose whole content, repost tail included, holds a child term; adds own content."""
    return posts.where(contains_any(content, child_terms)).withColumn(own, own_content(content))


def daily_term_counts(
    posts: DataFrame,
    line_counts: DataFrame,
    terms: Mapping[str, Iterable[str]],
    content: str = "original_weibo_content",
    day: str = "dt",
    originals_only: bool = False,
    distinct_posts: bool = False,
    key: str = "weibo_id",
    all_logged_days: bool = False,
) -> DataFrame:
    """``dt, keyword, quality, count, total_count`` for every term of every logged day.

    Counts the rows whose own content holds the term, 0 where none does. Posts
    repeat once per extraction hit and count so, unless ``distinct_posts``.
    Days count if they are logged and have posts, or, with
    ``all_logged_days``, if they are logged.
    """
    quality_of = {word: quality for quality, words in terms.items() for word in words if word}
    rows = posts
    if originals_only:
        rows = rows.where(F.col("is_retweet") == "0")
    rows = rows.select(F.col(day).alias("dt"), F.col(content).alias("_text"),
                       *([key] if distinct_posts else []))
    if distinct_posts:
        rows = rows.dropDuplicates(["dt", key])
    if len(quality_of) <= SCAN_TERMS:
        return _counts_in_columns(rows, line_counts, quality_of, all_logged_days)
    return _counts_in_rows(rows, line_counts, quality_of, all_logged_days)


def _counts_in_columns(
    rows: DataFrame, line_counts: DataFrame, quality_of: dict[str, str], all_days: bool
) -> DataFrame:
    # One pass: a sum per term, combined map-side to one row per day and task.
    names = list(quality_of)
    sums = [
        F.sum(F.contains("_text", F.lit(word)).cast("bigint")).alias(f"_c{i}")
        for i, word in enumerate(names)
    ]
    daily = rows.groupBy("dt").agg(*sums)
    logged = line_counts.join(daily, "dt", "left" if all_days else "inner")
    facts = F.array(*[
        F.struct(
            F.lit(word).alias("keyword"),
            F.lit(quality_of[word]).alias("quality"),
            F.coalesce(F.col(f"_c{i}"), F.lit(0)).alias("count"),
        )
        for i, word in enumerate(names)
    ])
    return logged.select("dt", "total_count", F.explode(facts).alias("f")).select(
        "dt", "f.keyword", "f.quality", "f.count", "total_count"
    )


def _counts_in_rows(
    rows: DataFrame, line_counts: DataFrame, quality_of: dict[str, str], all_days: bool
) -> DataFrame:
    counted = (
        match_terms(rows.select("dt", "_text"), list(quality_of), "_text", "keyword")
        .groupBy("dt", "keyword")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    logged = line_counts
    if not all_days:
        logged = logged.join(rows.select("dt").distinct(), "dt", "left_semi")
    pairs = F.array(*[
        F.struct(F.lit(word).alias("keyword"), F.lit(quality).alias("quality"))
        for word, quality in quality_of.items()
    ])
    grid = logged.select("dt", "total_count", F.explode(pairs).alias("p")).select(
        "dt", "total_count", "p.keyword", "p.quality"
    )
    return grid.join(counted, ["dt", "keyword"], "left").select(
        "dt", "keyword", "quality", F.coalesce("count", F.lit(0)).alias("count"), "total_count"
    )


def map_quality(df: DataFrame, dictionary: DataFrame, term: str = "keyword") -> DataFrame:
    """Add the quality of each term, null for unknown terms; ``dictionary`` is
    ``term, quality``."""
    return df.join(dictionary.select(F.col("term").alias(term), "quality"), term, "left")


def period_totals(line_counts: DataFrame, grain: str) -> DataFrame:
    """``period, period_total_count`` over all logged days, also those without posts."""
    return line_counts.groupBy(GRAINS[grain]("dt").alias("period")).agg(
        F.sum("total_count").alias("period_total_count")
    )


def term_trend(
    daily: DataFrame, line_counts: DataFrame, grain: str = "month", by: str = "keyword"
) -> DataFrame:
    """``period, <by>, frequency, period_total_count, proportion``."""
    sums = daily.groupBy(GRAINS[grain]("dt").alias("period"), by).agg(
        F.sum("count").alias("frequency")
    )
    joined = sums.join(period_totals(line_counts, grain), "period", "left")
    return joined.withColumn(
        "proportion",
        F.try_divide(F.col("frequency").cast("double"),
                     F.col("period_total_count").cast("double")),
    )


def share_within(
    trend: DataFrame, by: str = "quality", exclude: Iterable[str] = ()
) -> DataFrame:
    """``period, <by>, share``: part of each group in the frequency of its period.

    A group missing in a period has share 0, which the long form expresses by
    leaving it out; ``pivot_shares`` gives the wide form with zeros.
    """
    left_out = list(exclude)
    # The undated period is in no list of labels, so it stays.
    inside = F.coalesce(F.col("period").isin(left_out), F.lit(False))
    rows = trend.where(~inside) if left_out else trend
    total = F.sum("frequency").over(Window.partitionBy("period"))
    return rows.select("period", by, safe_ratio(F.col("frequency"), total).alias("share"))


def pivot_shares(shares: DataFrame, groups: Iterable[str], by: str = "quality") -> DataFrame:
    """One row per period and one share column per group, missing groups 0."""
    wide = shares.groupBy("period").pivot(by, list(groups)).agg(F.sum("share"))
    return wide.na.fill(0.0)
