"""Frequent words and clusters of cleaned posts."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topictide.functions.text import clean_for_words, word_tokens
from topictide.lineage import cut_lineage
from topictide.operators.cluster import (
    calinski_harabasz,
    density_cluster,
    silhouette,
    texts_by_cluster,
)
from topictide.operators.vocabulary import top_share, word_counts
from topictide.sources.days import between_days


def gathered_texts(
    posts: DataFrame, key: str = "weibo_id", text: str = "cleaned_weibo_content"
) -> DataFrame:
    """``key, text`` of posts that cleaning left something of."""
    return posts.where(F.col(text).isNotNull()).select(key, F.col(text).alias("text"))


def top_words(
    posts: DataFrame,
    year: int | None = None,
    text: str = "cleaned_weibo_content",
    tokenizer: Callable[[Column], Column] = word_tokens,
    stopwords: DataFrame | None = None,
    whitelist: DataFrame | None = None,
    share: float = 0.1,
) -> DataFrame:
    """The most counted ``share`` of the words of two characters and more, of a year or of all."""
    tokens = tokenizer(clean_for_words(text))
    counts = word_counts(
        between_days(posts, year=year), tokens, (), stopwords, whitelist, min_length=2
    )
    return top_share(counts, share)


def text_clusters(
    texts: DataFrame,
    vectors: DataFrame,
    key: str = "weibo_id",
    vector: str = "embedding",
    width: float = 1.0,
    min_size: int = 10,
) -> dict:
    """Clusters of the texts that have a vector: ``labels``, ``texts`` and the two scores.

    The scores are None under two clusters besides noise.
    """
    points = vectors.join(texts.select(key).distinct(), key, "left_semi").select(key, vector)
    labels = cut_lineage(density_cluster(points, key, vector, width, min_size))
    labelled = points.join(labels, key)
    score = silhouette(labelled, vector).first()["score"]
    return {
        "labels": labels,
        "texts": texts_by_cluster(texts, labels, key),
        "silhouette": score,
        "calinski_harabasz": None if score is None else calinski_harabasz(labelled, vector),
    }
