"""The benchmark tables, and the views of them that stand in for feeds.

``documents`` stand in for posts. They carry no date, so every document is
given a day computed from its id; that only labels rows and drops none.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOPIC_RULES = ["URGENT", "HIGH& F", "LOW& O"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(spark: SparkSession, folder: str, name: str = "documents") -> DataFrame:
    """A table of texts for heavy text work."""
    return table(spark, folder, name)


def topics(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as topic rows: text from priority and status, heat from the price.

    Orders still pending have no heat.
    """
    heat = F.when(F.col("o_orderstatus") != "P", F.floor("o_totalprice").cast("bigint"))
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("timestamp"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("text"),
        heat.alias("hot"),
    )


TOPICS_SQL = """
    SELECT o_orderkey AS ts, CAST(o_orderdate AS DATE) AS d,
           strftime(o_orderdate, '%Y-%m') AS month, strftime(o_orderdate, '%Y') AS year,
           strftime(o_orderdate, '%Y') || '-' || CASE quarter(o_orderdate)
             WHEN 1 THEN '1-3' WHEN 2 THEN '4-6' WHEN 3 THEN '7-9' ELSE '10-12' END AS quarter,
           o_orderpriority || ' ' || o_orderstatus AS text,
           CASE WHEN o_orderstatus <> 'P' THEN CAST(floor(o_totalprice) AS BIGINT) END AS hot,
           CAST(contains(o_orderpriority, 'URGENT')
             OR (contains(o_orderpriority, 'HIGH') AND o_orderstatus = 'F')
             OR (contains(o_orderpriority, 'LOW') AND o_orderstatus = 'O') AS INTEGER) AS flag
    FROM orders
"""


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a day, ``dt``, over six and a half years."""
    return texts(spark, folder).withColumn(
        "dt", F.date_add(F.lit("1995-01-01").cast("date"), (F.col("doc_id") % 2400).cast("int"))
    )


DOCUMENTS_SQL = """
    SELECT *, CAST(DATE '1995-01-01' + CAST(doc_id % 2400 AS INTEGER) AS DATE) AS dt
    FROM documents
"""


def logged_days(spark: SparkSession, folder: str) -> DataFrame:
    """Orders per day as the log of raw lines per day."""
    days = table(spark, folder, "orders").select(F.col("o_orderdate").cast("date").alias("dt"))
    return days.groupBy("dt").agg(F.count(F.lit(1)).alias("total_count"))


LOGGED_SQL = """
    SELECT CAST(o_orderdate AS DATE) AS dt, count(*) AS total_count FROM orders GROUP BY 1
"""


def with_previous_turn(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns; a turn with a predecessor is a repost of it."""
    turns = texts(spark, folder, "conversations")
    previous = turns.select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("previous")
    )
    return turns.join(previous, ["conv_id", "turn"], "left")


TURNS_SQL = """
    SELECT t.conv_id, t.turn, t.role, t.text, p.text AS previous,
           CASE WHEN p.text IS NULL THEN replace(t.text, chr(10), ' ')
                ELSE replace(t.text, chr(10), ' ') || '//' || replace(p.text, chr(10), ' ')
           END AS content
    FROM conversations t
    LEFT JOIN conversations p ON p.conv_id = t.conv_id AND p.turn = t.turn - 1
"""


def sql_list(values) -> str:
    """Quoted SQL list of strings."""
    return ", ".join("'" + value.replace("'", "''") + "'" for value in values)


def sql_rows(rows) -> str:
    """SQL VALUES of rows of strings."""
    return ", ".join(f"({sql_list(row)})" for row in rows)
