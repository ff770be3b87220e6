"""Hot topics: flags, deduplication, shares and nested snapshots."""

from pyspark.sql import functions as F

from catalog.tables import TOPICS_SQL, TOPIC_RULES, sql_list, table, texts, topics
from topictide.functions import month_of
from topictide.operators import dedupe, flags, share
from topictide.sources.snapshots import explode_topics, parse_snapshots
from topictide.sources.topics import repair_topic_rows, typed_topics

QUERIES, ORACLES = {}, {}
CUTOFF = 200_000


def flagged(spark, folder):
    return flags.flag_rules(topics(spark, folder), TOPIC_RULES)


def _share(**options):
    return lambda spark, folder: share.flag_share(flagged(spark, folder), **options)


def _share_sql(window, weighted=False, cutoff=None, exclude=()):
    rows = f"SELECT * FROM ({TOPICS_SQL})"
    if weighted:
        rows = f"""SELECT * FROM (SELECT *, row_number() OVER (
            PARTITION BY month, text ORDER BY hot DESC, ts) AS n FROM ({rows})
            WHERE hot IS NOT NULL) WHERE n = 1"""
    if cutoff is not None:
        rows = f"SELECT * FROM ({rows}) WHERE hot >= {cutoff}"
    weight = "hot" if weighted else "1"
    where = f"WHERE period NOT IN ({sql_list(exclude)})" if exclude else ""
    return f"""
        SELECT period, flagged, total, CASE WHEN total = 0 THEN 0.0
               ELSE CAST(flagged AS DOUBLE) / CAST(total AS DOUBLE) END AS proportion
        FROM (SELECT {window} AS period, CAST(sum(flag * {weight}) AS BIGINT) AS flagged,
                     CAST(sum({weight}) AS BIGINT) AS total FROM ({rows}) GROUP BY 1) {where}"""


for _window in ("month", "quarter", "year"):
    QUERIES[f"topic_share_{_window}"] = _share(window=_window)
    ORACLES[f"topic_share_{_window}"] = _share_sql(_window)
    QUERIES[f"topic_share_weighted_{_window}"] = _share(window=_window, mode="weighted")
    ORACLES[f"topic_share_weighted_{_window}"] = _share_sql(_window, weighted=True)

QUERIES["cutoff_share"] = _share(window="quarter", cutoff=CUTOFF)
ORACLES["cutoff_share"] = _share_sql("quarter", cutoff=CUTOFF)
QUERIES["cutoff_share_weighted"] = _share(window="year", mode="weighted", cutoff=CUTOFF)
ORACLES["cutoff_share_weighted"] = _share_sql("year", weighted=True, cutoff=CUTOFF)
_EXCLUDED = ("1996-09", "1996-10")
QUERIES["topic_share_excluding"] = _share(window="month", exclude=_EXCLUDED)
ORACLES["topic_share_excluding"] = _share_sql("month", exclude=_EXCLUDED)

QUERIES["missing_share"] = lambda spark, folder: share.missing_share(topics(spark, folder))
ORACLES["missing_share"] = f"""
    SELECT 1.0 - CAST(count(hot) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS missing_share
    FROM ({TOPICS_SQL})"""

QUERIES["yearly_flagged_share"] = lambda spark, folder: share.yearly_flagged_share(
    flagged(spark, folder)
)
ORACLES["yearly_flagged_share"] = f"""
    SELECT year, CAST(sum(flag) AS BIGINT) AS flagged, count(*) AS total,
           CAST(sum(flag) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS proportion
    FROM ({TOPICS_SQL}) GROUP BY year"""


def _hottest(spark, folder):
    rows = flags.flagged_with_heat(flagged(spark, folder)).withColumn("month", month_of("date"))
    return dedupe.hottest_per_text(rows).select("month", "text", "timestamp", "hot")


QUERIES["hottest_flagged_topics"] = _hottest
ORACLES["hottest_flagged_topics"] = f"""
    SELECT month, text, ts AS timestamp, hot FROM (
      SELECT *, row_number() OVER (PARTITION BY month, text ORDER BY hot DESC, ts) AS n
      FROM ({TOPICS_SQL}) WHERE flag = 1 AND hot IS NOT NULL) WHERE n = 1"""


def _ids(spark, folder):
    rows = flags.flagged_with_heat(flagged(spark, folder)).withColumn("month", month_of("date"))
    hottest = dedupe.hottest_per_text(rows).drop("month")
    return dedupe.topic_ids(hottest).select("id", "month", "text", "timestamp")


QUERIES["topic_ids"] = _ids
ORACLES["topic_ids"] = f"""
    SELECT year || '-' || CAST(row_number() OVER (PARTITION BY year ORDER BY d, text) AS VARCHAR)
             AS id, month, text, ts AS timestamp
    FROM (SELECT *, row_number() OVER (PARTITION BY month, text ORDER BY hot DESC, ts) AS n
          FROM ({TOPICS_SQL}) WHERE flag = 1 AND hot IS NOT NULL) WHERE n = 1"""

# Flags on documents: single words, conjunctions, exclusions, saving words.
DOC_RULES = ["Straße", "tion&heit", "http&the", "anything"]
EXCLUDED = ["Lorem", "http"]
PATTERNS = ["t.{0,3}tion", "qu.{0,3}eau"]
TRIGGERS, SAVERS = ["tion", "eau"], ["heit", "there", "que"]

QUERIES["flag_rules"] = lambda spark, folder: flags.flag_rules(
    texts(spark, folder).select("doc_id", "text"), DOC_RULES, multiline=True
).select("doc_id", "flag")
ORACLES["flag_rules"] = r"""
    SELECT doc_id, CAST(contains(text, 'Straße') OR contains(text, 'anything')
        OR regexp_matches(text, 'tion[^\n]*heit|heit[^\n]*tion')
        OR regexp_matches(text, 'http[^\n]*the|the[^\n]*http') AS INTEGER) AS flag
    FROM documents"""

QUERIES["exclude_matches"] = lambda spark, folder: flags.exclude_matches(
    texts(spark, folder), EXCLUDED, PATTERNS
).select("doc_id", "lang")
ORACLES["exclude_matches"] = """
    SELECT doc_id, lang FROM documents
    WHERE NOT (contains(text, 'Lorem') OR contains(text, 'http')
        OR regexp_matches(text, 't.{0,3}tion') OR regexp_matches(text, 'qu.{0,3}eau'))"""


def _saver(spark, folder):
    rows = texts(spark, folder).select("doc_id", "text", F.lit(1).alias("flag"))
    return flags.unflag_without_saver(rows, TRIGGERS, SAVERS).select("doc_id", "flag")


QUERIES["unflag_without_saver"] = _saver
ORACLES["unflag_without_saver"] = """
    SELECT doc_id, CASE WHEN (contains(text, 'tion') OR contains(text, 'eau'))
        AND NOT (contains(text, 'heit') OR contains(text, 'there') OR contains(text, 'que'))
        THEN 0 ELSE 1 END AS flag FROM documents"""

TITLES = ["red plate", "hot ring", "blue bolt", "small widget"]


def _parts(spark, folder):
    return table(spark, folder, "part").select(
        "p_partkey", F.col("p_name").alias("text"), F.lit(1).alias("flag")
    )


QUERIES["unflag_titles"] = lambda spark, folder: flags.unflag_titles(
    _parts(spark, folder), TITLES
).select("p_partkey", "flag")
ORACLES["unflag_titles"] = f"""
    SELECT p_partkey, CASE WHEN p_name IN ({sql_list(TITLES)}) THEN 0 ELSE 1 END AS flag
    FROM part"""

QUERIES["unflag_titles_table"] = lambda spark, folder: flags.unflag_titles(
    _parts(spark, folder),
    table(spark, folder, "part").where(F.col("p_size") == 1).select("p_name"),
).select("p_partkey", "flag")
ORACLES["unflag_titles_table"] = """
    SELECT p_partkey, CASE WHEN p_name IN (SELECT p_name FROM part WHERE p_size = 1)
        THEN 0 ELSE 1 END AS flag FROM part"""


def snapshot_lines(spark, folder):
    """Each order as one snapshot line: JSON with a JSON string of nested cards inside."""
    def entry(kind, desc, extra):
        return F.struct(kind.alias("card_type"), desc.alias("desc"), extra.alias("desc_extr"))

    topic = F.concat_ws(" ", "o_orderpriority", "o_orderstatus")
    price = F.concat(F.lit("about "), F.floor("o_totalprice").cast("string"), F.lit(" of 10"))
    short = F.substring("o_orderpriority", 1, 6)
    cards = F.array(
        F.struct(F.lit("11").alias("card_type"), F.array(
            entry(F.lit("4"), topic, price),
            entry(F.lit("7"), topic, price),
            entry(F.lit("4"), short, F.lit(None).cast("string")),
        ).alias("card_group")),
        F.struct(F.lit("9").alias("card_type"),
                 F.array(entry(F.lit("4"), topic, price)).alias("card_group")),
        F.struct(F.lit("11").alias("card_type"),
                 F.array(entry(F.lit("4"), F.col("o_orderstatus"), price)).alias("card_group")),
    )
    outer = F.to_json(F.struct(
        F.col("o_orderkey").cast("string").alias("crawler_time_stamp"),
        F.when(F.col("o_orderstatus") == "P", "2").otherwise("1").alias("type"),
        F.to_json(F.struct(cards.alias("cards"))).alias("bangdan"),
    ))
    return texts(spark, folder, "orders").select(
        F.concat_ws("\t", "o_orderkey", outer).alias("value"),
        F.col("o_orderdate").cast("date").alias("date"),
    )


QUERIES["nested_topics"] = lambda spark, folder: explode_topics(
    parse_snapshots(snapshot_lines(spark, folder)), TOPIC_RULES
).select("timestamp", F.date_format("date", "yyyy-MM-dd").alias("day"), "text", "hot", "flag")
ORACLES["nested_topics"] = """
    WITH e AS (
      SELECT CAST(o_orderkey AS VARCHAR) AS timestamp, strftime(o_orderdate, '%Y-%m-%d') AS day,
             o_orderpriority || ' ' || o_orderstatus AS text,
             CAST(floor(o_totalprice) AS BIGINT) AS hot
      FROM orders WHERE o_orderstatus <> 'P'
      UNION ALL
      SELECT CAST(o_orderkey AS VARCHAR), strftime(o_orderdate, '%Y-%m-%d'),
             substring(o_orderpriority, 1, 6), NULL
      FROM orders WHERE o_orderstatus <> 'P')
    SELECT timestamp, day, text, hot, CAST(contains(text, 'URGENT')
        OR (contains(text, 'HIGH') AND contains(text, ' F'))
        OR (contains(text, 'LOW') AND contains(text, ' O')) AS INTEGER) AS flag
    FROM e WHERE length(text) > 5"""


def _repaired(spark, folder):
    """Two rows glued at the flag: each order followed by itself with heat 7."""
    fields = [F.col("o_orderkey").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd"),
              F.col("o_orderpriority"), F.floor("o_totalprice").cast("string")]
    row = F.concat_ws(",", *fields, F.lit("1"))
    glued = F.concat(row, F.concat_ws(",", *fields[:3], F.lit("7"), F.lit("0")))
    lines = texts(spark, folder, "orders").select(
        F.when(F.col("o_orderstatus") == "P", glued)
        .when(F.col("o_orderstatus") == "F", row)
        .otherwise(F.concat_ws(",", row, F.lit("extra"))).alias("value")
    )
    return typed_topics(repair_topic_rows(lines)).select(
        "timestamp", F.date_format("date", "yyyy-MM-dd").alias("day"), "text", "hot", "flag"
    )


QUERIES["repair_topic_rows"] = _repaired
ORACLES["repair_topic_rows"] = """
    SELECT CAST(o_orderkey AS VARCHAR) AS timestamp, strftime(o_orderdate, '%Y-%m-%d') AS day,
           o_orderpriority AS text, CAST(floor(o_totalprice) AS BIGINT) AS hot,
           CAST(1 AS INTEGER) AS flag
    FROM orders WHERE o_orderstatus IN ('P', 'F')
    UNION ALL
    SELECT CAST(o_orderkey AS VARCHAR), strftime(o_orderdate, '%Y-%m-%d'), o_orderpriority,
           CAST(7 AS BIGINT), CAST(0 AS INTEGER) FROM orders WHERE o_orderstatus = 'P'"""
