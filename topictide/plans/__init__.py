"""End-to-end studies built from the operators."""

from topictide.plans.keyword_trend import extract_days, keyword_trends, trend_tables
from topictide.plans.text_clusters import gathered_texts, text_clusters, top_words
from topictide.plans.topic_posts import quality_vocabulary, topic_post_days
from topictide.plans.topic_share import sampled_topics, topic_share, topics_from_snapshots

__all__ = [
    "extract_days", "gathered_texts", "keyword_trends", "quality_vocabulary", "sampled_topics",
    "text_clusters", "top_words", "topic_post_days", "topic_share", "topics_from_snapshots",
    "trend_tables",
]
