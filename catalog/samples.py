"""Seeded samples. The digest order is plain MD5, so SQL can repeat every draw."""

from pyspark.sql import functions as F

from catalog.tables import TOPICS_SQL, table
from catalog.topics import flagged
from topictide.functions import month_of
from topictide.operators import sample
from topictide.operators.dedupe import hottest_per_text

QUERIES, ORACLES = {}, {}


def _draws(n):
    def query(spark, folder):
        rows = flagged(spark, folder).where("flag = 1").withColumn("month", month_of("date"))
        return sample.sample_per_group(rows, "month", ["timestamp"], n, seed=7).select(
            "month", "draw", "timestamp", "text"
        )
    return query


def _draws_sql(n):
    return f"""
        SELECT month, draw, timestamp, text FROM (
          SELECT month, CAST(j AS INTEGER) AS draw, ts AS timestamp, text,
                 count(*) OVER (PARTITION BY month, j) AS size,
                 row_number() OVER (PARTITION BY month, j ORDER BY
                   md5('7|' || CAST(j AS VARCHAR) || '|' || CAST(ts AS VARCHAR))) AS n
          FROM ({TOPICS_SQL}), range(1, {n + 1}) r(j) WHERE flag = 1)
        WHERE n = 1 AND draw <= size"""


QUERIES["sample_per_group"] = _draws(10)
ORACLES["sample_per_group"] = _draws_sql(10)

QUERIES["sample_proportional"] = lambda spark, folder: sample.sample_proportional(
    table(spark, folder, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd")),
    ["event_id"], total=2_000, group="day",
).select("event_id", "day", "event_type")
ORACLES["sample_proportional"] = """
    SELECT event_id, day, event_type FROM (
      SELECT event_id, event_type, strftime(ts, '%Y-%m-%d') AS day,
             row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d')
               ORDER BY md5('2025|' || CAST(event_id AS VARCHAR))) AS n,
             round_even(least(1.0, 2000.0 / (SELECT count(*) FROM events))
               * count(*) OVER (PARTITION BY strftime(ts, '%Y-%m-%d')), 0) AS quota
      FROM events) WHERE n <= quota"""

QUERIES["sample_matching"] = lambda spark, folder: sample.sample_matching(
    table(spark, folder, "documents"), "tion", ["doc_id"], n=20, text="text", group="source"
).select("source", "doc_id")
ORACLES["sample_matching"] = """
    SELECT source, doc_id FROM (
      SELECT source, doc_id, row_number() OVER (PARTITION BY source
        ORDER BY md5('0|' || CAST(doc_id AS VARCHAR))) AS n
      FROM documents WHERE contains(text, 'tion')) WHERE n <= 20"""

QUERIES["sample_each_term"] = lambda spark, folder: sample.sample_each_term(
    table(spark, folder, "documents"), ["tion", "ation", "heit"], ["doc_id"], n=20, text="text",
    group="source",
).select("source", "term", "doc_id")
ORACLES["sample_each_term"] = """
    SELECT source, term, doc_id FROM (
      SELECT source, term, doc_id, row_number() OVER (PARTITION BY source, term
        ORDER BY md5('0|' || CAST(doc_id AS VARCHAR))) AS n
      FROM documents, (VALUES ('tion'), ('ation'), ('heit')) t(term)
      WHERE contains(text, term)) WHERE n <= 20"""


def _hottest_draws(spark, folder):
    return sample.sample_per_group(
        hottest_per_text(
            flagged(spark, folder).where("flag = 1").withColumn("month", month_of("date"))
        ), "month", ["timestamp"], 10, seed=7,
    ).select("month", "draw", "timestamp", "text")


QUERIES["sample_hottest_per_group"] = _hottest_draws
ORACLES["sample_hottest_per_group"] = _draws_sql(10).replace(f"({TOPICS_SQL})", f"""(
    SELECT * FROM ({TOPICS_SQL}) WHERE flag = 1 AND hot IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY month, text ORDER BY hot DESC, ts) = 1)""")
