"""Posts about flagged topics, and the vocabulary of the qualities in them."""

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topictide.functions.periods import month_of, year_of
from topictide.functions.text import clean_post, own_content
from topictide.operators.dedupe import dedupe_posts, hottest_per_text, topic_ids
from topictide.operators.dictionary import (
    counts_of_hits,
    describe_terms,
    quality_hits,
    texts_of_hits,
)
from topictide.operators.flags import flagged_with_heat
from topictide.operators.match import extract_topic_posts
from topictide.operators.sample import sample_by_counts
from topictide.operators.vocabulary import word_frequency
from topictide.sources.days import write_days
from topictide.sources.posts import read_lines


def searched_topics(topics: DataFrame, day: str = "date", text: str = "text") -> DataFrame:
    """Flagged topics, each text once per month, with their ids."""
    flagged = flagged_with_heat(topics).withColumn("month", month_of(day))
    return topic_ids(hottest_per_text(flagged, ["month"], text).drop("month"), day, text)


def clean_posts(posts: DataFrame) -> DataFrame:
    """One row per post and day, with own content and cleaned own content."""
    own = own_content("weibo_content")
    return dedupe_posts(posts).withColumns(
        {"original_weibo_content": own, "cleaned_weibo_content": clean_post(own)}
    )


def topic_post_days(
    spark: SparkSession,
    topics: DataFrame,
    path: str | list[str],
    root: str,
    start: str | None = None,
    end: str | None = None,
) -> None:
    """Write the cleaned posts about the topics of their month, by day."""
    lines = read_lines(spark, path, start, end)
    write_days(clean_posts(extract_topic_posts(lines, searched_topics(topics))), root)


def quality_vocabulary(
    posts: DataFrame,
    dictionary: DataFrame,
    stopwords: DataFrame | None = None,
    tokenizer=None,
    share: float = 0.05,
) -> dict[str, DataFrame]:
    """Texts per quality and year, counts of the terms, and frequent words per quality.

    All three come from one stored table of texts and the terms they hold.
    """
    dated = posts.withColumn("year", year_of(F.col("dt")))
    hits = quality_hits(dated, dictionary, by=("year",))
    texts = texts_of_hits(hits, ("year",))
    options: dict = {} if tokenizer is None else {"tokenizer": tokenizer}
    counts = counts_of_hits(hits)
    words: Iterable[str] = ["kid"]
    return {
        "texts": texts,
        "term_counts": describe_terms(counts, dictionary),
        "frequent_words": word_frequency(
            texts, "text", words, stopwords, share=share, **options
        ),
    }


def topic_samples(
    posts: DataFrame, counts: DataFrame, total: int = 10_000, topic: str = "keyword_id",
    day: str = "dt", key: str = "weibo_id", seed: object = 2025,
) -> DataFrame:
    """About ``total`` posts of each topic, each of its days at the topic's rate.

    ``counts`` is ``topic, day, count`` as the caller knows them: a topic's rate is ``total``
    over the sum of its counts, and days that are not listed give no posts.
    """
    return sample_by_counts(posts, counts, [key], total, topic, day, seed)
