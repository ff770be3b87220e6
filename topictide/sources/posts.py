"""Raw posts in their three layouts: JSON, tab separated and quoted CSV."""

from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topictide import schemas
from topictide.functions.rows import only_if
from topictide.functions.rules import contains_any
from topictide.functions.text import full_content, strip
from topictide.sources.paths import day_of_file

# The first day in JSON, and the one day in quoted CSV.
FIRST_JSON_DAY = "2019-08-09"
CSV_DAY = "2020-06-30"


def read_lines(
    spark: SparkSession,
    path: str | list[str],
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Raw lines as ``value, dt``; the day filter is on the file name, so it skips whole files."""
    lines = spark.read.text(path).select("value", day_of_file().alias("dt"))
    if start is not None:
        lines = lines.where(F.col("dt") >= F.lit(start).cast("date"))
    if end is not None:
        lines = lines.where(F.col("dt") <= F.lit(end).cast("date"))
    return lines


def with_any_term(lines: DataFrame, terms: Iterable[str], column: str = "value") -> DataFrame:
    """Raw lines that hold a term in any field. Put in front of parsing, misses are never parsed."""
    return lines.where(contains_any(column, terms))


def _json_post() -> Column:
    """``post, keys``: the fields, and the names that the line has, with a value or with null."""
    text = F.get(F.split(strip("value"), "\t"), 1)
    return F.struct(
        F.from_json(text, schemas.POST_JSON).alias("post"), F.json_object_keys(text).alias("keys")
    )


def _positional_post(fields: Column) -> Column:
    long_enough = F.size(fields) >= schemas.POST_MIN_FIELDS
    post = F.struct(*[F.get(fields, schemas.POST_POSITIONS[name]).alias(name)
                      for name in schemas.POST_FIELDS])
    keys = F.array(*[F.lit(name) for name in schemas.POST_FIELDS])
    return F.when(long_enough, F.struct(post.alias("post"), keys.alias("keys")))


def _tsv_post() -> Column:
    return _positional_post(F.split(strip("value"), "\t", -1))


def _csv_post() -> Column:
    return _positional_post(F.split(strip("value"), '","', -1))


def _parse(lines: DataFrame, post: Column, keep: Iterable[str]) -> DataFrame:
    def complete(found: Column) -> Column:
        # A key may hold null, but it must be there; a repost needs its reposted text.
        has = {name: F.coalesce(F.array_contains(found["keys"], name), F.lit(False))
               for name in schemas.POST_FIELDS}
        reposted = has["r_weibo_content"] | (found["post"]["is_retweet"] == "0")
        return reduce(and_, (has[name] for name in schemas.POST_COLUMNS), reposted)

    found = lines.select(*keep, F.explode(only_if(post, complete)).alias("found"))
    posts = found.select(*keep, F.col("found.post").alias("post"))
    content = full_content("post.weibo_content", "post.r_weibo_content", "post.is_retweet")
    return posts.select(
        *keep,
        *[f"post.{name}" for name in schemas.POST_COLUMNS if name != "weibo_content"],
        content.alias("weibo_content"),
    )


def parse_posts_json(lines: DataFrame, keep: Iterable[str] = ("dt",)) -> DataFrame:
    """Posts of ``id, tab, JSON`` lines; broken lines and lines without a used field are skipped."""
    return _parse(lines, _json_post(), keep)


def parse_posts_tsv(lines: DataFrame, keep: Iterable[str] = ("dt",)) -> DataFrame:
    """Posts of tab-separated lines; lines under 24 fields are skipped."""
    return _parse(lines, _tsv_post(), keep)


def parse_posts_csv(lines: DataFrame, keep: Iterable[str] = ("dt",)) -> DataFrame:
    """Posts of quoted CSV lines; lines under 24 fields are skipped."""
    return _parse(lines, _csv_post(), keep)


def parse_posts(lines: DataFrame, keep: Iterable[str] = ("dt",)) -> DataFrame:
    """Posts of ``value, dt`` lines in the layout of their day, in one scan for all layouts.

    A line without a day is read in the layout that it shows: an object after the first
    tab, fields between quotes, or tabs.
    """
    day, value = F.col("dt"), strip("value")
    post = (
        F.when(day.isNull() & value.rlike(r"^[^\t]*\t\s*\{"), _json_post())
        .when(day.isNull() & ~value.contains("\t") & value.contains('","'), _csv_post())
        .when(day == F.lit(CSV_DAY).cast("date"), _csv_post())
        .when(day >= F.lit(FIRST_JSON_DAY).cast("date"), _json_post())
        .otherwise(_tsv_post())
    )
    return _parse(lines, post, keep)


def read_posts(
    spark: SparkSession,
    path: str | list[str],
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Posts of a folder of daily files, every day in its own layout."""
    return parse_posts(read_lines(spark, path, start, end))
