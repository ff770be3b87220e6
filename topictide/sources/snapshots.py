"""Hot-list snapshots: JSON inside JSON, one snapshot per line."""

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topictide import schemas
from topictide.functions.rows import only_if
from topictide.functions.rules import match_rules
from topictide.functions.text import heat, strip
from topictide.sources.paths import day_of_file

# The real-time list, the card holding it, and the entry type inside.
REAL_TIME_LIST = "1"
LIST_CARD = "11"
ENTRY_CARD = "4"
MIN_TOPIC_LENGTH = 6


def read_snapshots(
    spark: SparkSession, path: str | list[str], list_type: str = REAL_TIME_LIST
) -> DataFrame:
    """Snapshots as ``timestamp, date, cards``; the day comes from the file name.

    Lines without a tab, with broken JSON, of another list type or without
    cards are skipped.
    """
    lines = spark.read.text(path).select("value", day_of_file().alias("date"))
    return parse_snapshots(lines, list_type)


def parse_snapshots(lines: DataFrame, list_type: str = REAL_TIME_LIST) -> DataFrame:
    """Parse ``value, date`` lines into ``timestamp, date, cards``."""
    body = F.get(F.split(strip("value"), "\t"), 1)
    outer = F.from_json(body, schemas.SNAPSHOT_OUTER)
    wanted = only_if(outer, lambda snapshot: snapshot["type"] == list_type)
    inner = F.from_json("snapshot.bangdan", schemas.SNAPSHOT_INNER)
    pages = only_if(inner, lambda page: page["cards"].isNotNull())
    return (
        lines.select("date", F.explode(wanted).alias("snapshot"))
        .select("date", F.col("snapshot.crawler_time_stamp").alias("timestamp"),
                F.explode(pages).alias("page"))
        .select("timestamp", "date", F.col("page.cards").alias("cards"))
    )


def explode_topics(snapshots: DataFrame, rules: Iterable[str]) -> DataFrame:
    """Entries of the list cards as topic rows ``timestamp, date, text, hot, flag``.

    Entries without text or with five characters and fewer are dropped.
    """
    entries = F.filter(
        F.flatten(
            F.transform(
                F.filter("cards", lambda card: card["card_type"] == LIST_CARD),
                lambda card: F.coalesce(card["card_group"], F.array()),
            )
        ),
        lambda entry: (entry["card_type"] == ENTRY_CARD)
        & (F.length(entry["desc"]) >= MIN_TOPIC_LENGTH),
    )
    return snapshots.select("timestamp", "date", F.explode(entries).alias("entry")).select(
        "timestamp",
        "date",
        F.col("entry.desc").alias("text"),
        heat("entry.desc_extr").alias("hot"),
        match_rules("entry.desc", rules, multiline=True).cast("int").alias("flag"),
    )
