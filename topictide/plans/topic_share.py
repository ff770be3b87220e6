"""Share of flagged hot topics over time, from raw snapshots to the share table."""

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from topictide import terms
from topictide.functions.periods import month_of
from topictide.operators.dedupe import hottest_per_text
from topictide.operators.flags import flagged_with_heat, unflag_titles
from topictide.operators.sample import sample_per_group
from topictide.operators.share import flag_share
from topictide.sources.snapshots import explode_topics, read_snapshots


def topics_from_snapshots(
    spark: SparkSession,
    path: str | list[str],
    rules: Iterable[str] = terms.TOPIC_RULES,
    titles: Iterable[str] = terms.RETRACTED_TITLES,
) -> DataFrame:
    """Flagged topic rows of the snapshot files, wrong titles unflagged."""
    return unflag_titles(explode_topics(read_snapshots(spark, path), rules), titles)


def topic_share(
    spark: SparkSession, path: str | list[str], window: str = "year", mode: str = "additive",
    cutoff: int | None = None, exclude: Iterable[str] = (),
) -> DataFrame:
    """Share table of the snapshot files, one lazy plan from text lines to shares."""
    return flag_share(topics_from_snapshots(spark, path), window, mode, cutoff, exclude)


def sampled_topics(topics: DataFrame, n: int = 10, seed: object = 0) -> DataFrame:
    """``n`` draws with replacement per month from its flagged topics, for review by hand."""
    flagged = flagged_with_heat(topics).withColumn("month", month_of("date"))
    hottest = hottest_per_text(flagged, ["month"])
    return sample_per_group(hottest, "month", ["timestamp", "text"], n, seed)
