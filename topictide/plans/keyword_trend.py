"""Trend of quality terms in posts about children, from raw posts to trend tables."""

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

from topictide import terms as fixed
from topictide.lineage import cut_lineage
from topictide.operators.counts import line_counts
from topictide.operators.match import extract_posts
from topictide.operators.trend import child_posts, daily_term_counts, share_within, term_trend
from topictide.sources.days import write_days
from topictide.sources.posts import read_lines


def extract_days(
    spark: SparkSession,
    path: str | list[str],
    root: str,
    start: str | None = None,
    end: str | None = None,
    first: Iterable[str] = fixed.CHILD_TERMS,
    second: Iterable[str] = fixed.EXTRACTION_TERMS,
) -> None:
    """Write the matching posts of a range of days, the one table all trends read."""
    write_days(extract_posts(read_lines(spark, path, start, end), first, second), root)


def count_days(
    spark: SparkSession, path: str | list[str], start: str | None = None, end: str | None = None
) -> DataFrame:
    """Raw lines per day of the post files, counted now and stored: one row per day."""
    return cut_lineage(line_counts(read_lines(spark, path, start, end)))


def keyword_trends(
    posts: DataFrame,
    logged: DataFrame,
    child_terms: Iterable[str] = fixed.CHILD_TERMS,
    terms: Mapping[str, Iterable[str]] = fixed.TREND_TERMS,
) -> DataFrame:
    """Daily term counts of extracted posts."""
    return daily_term_counts(child_posts(posts, child_terms), logged, terms)


# Fixed value: the year that the study leaves out of the mix for its faulty data.
FAULTY_YEARS = ("2018",)


def trend_tables(
    daily: DataFrame, logged: DataFrame, left_out: Iterable[str] = FAULTY_YEARS
) -> dict[str, DataFrame]:
    """The trend tables by month and year, by keyword and quality, and the yearly mix.

    The daily counts are stored first, so the posts are read once for all tables.
    ``left_out`` names years that do not count in the mix.
    """
    daily, logged = cut_lineage(daily), cut_lineage(logged)
    tables = {
        f"{grain}_{by}": term_trend(daily, logged, grain, by)
        for grain in ("month", "year")
        for by in ("keyword", "quality")
    }
    tables["year_quality_share"] = share_within(tables["year_quality"], exclude=list(left_out))
    return tables
