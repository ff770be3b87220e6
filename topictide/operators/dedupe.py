"""Keeping one row per key, and numbering topics.

One row per key is a row number of one, which Spark applies before the shuffle
as well (window group limit): a key that holds much of the data leaves each
map task as a single row.
"""

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topictide import schemas
from topictide.functions.periods import month_of, year_of
from topictide.operators.numbering import numbered


def first_per_key(df: DataFrame, keys: Iterable[str], order: Iterable[Column | str]) -> DataFrame:
    """The first row of each key in the given order."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(window)).where(F.col("_n") == 1).drop("_n")


def hottest_per_text(
    df: DataFrame,
    by: Iterable[str] = ("month",),
    text: str = "text",
    hot: str = "hot",
    ties: Iterable[str] = ("timestamp",),
) -> DataFrame:
    """The hottest row of each text within its period; ties go to the smallest tie key.

    Rows without heat are dropped first.
    """
    return first_per_key(
        df.where(F.col(hot).isNotNull()), [*by, text], [F.col(hot).desc(), *ties]
    )


def dedupe_posts(
    posts: DataFrame,
    day: str = "dt",
    key: str = "weibo_id",
    order: Iterable[str] = ("keyword_id",),
) -> DataFrame:
    """One row per post and day, the one of the smallest keyword id.

    Ids are compared by their numbers, so 2 comes before 10 and 2022-9 before
    2022-10. Ties go to the smallest of all other columns.
    """
    by = [part for name in order for part in _by_numbers(name)]
    rest = [name for name in posts.columns if name not in {day, key, *order}]
    return first_per_key(posts, [day, key], by + rest)


def _by_numbers(name: str) -> list[Column]:
    """Sort keys of an id: its first two numbers, then its text."""
    numbers = F.regexp_extract_all(F.col(name).cast("string"), F.lit(r"(\d+)"), F.lit(1))
    return [F.get(numbers, i).try_cast("decimal(38,0)") for i in (0, 1)] + [F.col(name)]


def distinct_posts(posts: DataFrame) -> DataFrame:
    """Distinct extracted posts with their day."""
    return posts.select("dt", *schemas.EXTRACTED_COLUMNS).distinct()


def topic_ids(topics: DataFrame, day: str = "date", text: str = "text") -> DataFrame:
    """Add ``month`` and ``id``, a running ``year-n`` by day and text.

    Rows of one day and text are numbered in the order of all their columns. Numbers come
    from ranges of the order, so neither a year nor a day is in one task. Topics without a
    date stay, with a null month and id.
    """
    rest = [name for name in topics.columns if name not in {day, text}]
    dated = topics.withColumn("month", month_of(day)).withColumn("_year", year_of(day))
    running = numbered(dated, [day, text, *rest], ["_year"], "_n")
    return running.withColumn(
        "id", F.concat("_year", F.lit("-"), F.col("_n").cast("string"))
    ).select(*topics.columns, "month", "id")
