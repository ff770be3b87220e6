"""Terms and topics inside texts."""

from pyspark.sql import functions as F

from catalog.posts import json_lines
from catalog.tables import DOCUMENTS_SQL, TURNS_SQL, documents, sql_rows, table, texts
from topictide import schemas
from topictide.operators import match

QUERIES, ORACLES = {}, {}

TERMS = ["the", "other", "her", "there", "tion", "ion", "ung", "heit", "eau", "que", "x y"]
FIRST, SECOND = ["ung", "eau", "shwh"], ["ing", "tion", "ent", "que", "heit"]


def _terms(strategy):
    return lambda spark, folder: match.match_terms(
        texts(spark, folder).select("doc_id", "text"), TERMS, strategy=strategy
    ).select("doc_id", "term")


QUERIES["match_terms"] = _terms("scan")
QUERIES["match_terms_anchor"] = _terms("anchor")
for _name in ("match_terms", "match_terms_anchor"):
    ORACLES[_name] = f"""
        SELECT doc_id, term FROM documents, (VALUES {sql_rows([(t,) for t in TERMS])}) t(term)
        WHERE contains(text, term)"""


def _vocabulary(spark, folder):
    words = table(spark, folder, "benchmark").select(
        F.explode(F.split("text", "[ \n.,]+")).alias("term")
    ).where(F.col("term") != "")
    docs = texts(spark, folder).select("doc_id", "text")
    return match.match_terms(docs, words).select("doc_id", "term")


QUERIES["match_vocabulary"] = _vocabulary
ORACLES["match_vocabulary"] = """
    SELECT doc_id, term FROM documents, (
        SELECT DISTINCT term FROM (
          SELECT unnest(regexp_split_to_array(text, '[ \n.,]+')) AS term FROM benchmark)
        WHERE term <> '') t
    WHERE contains(text, term)"""

QUERIES["match_passages"] = lambda spark, folder: match.match_terms(
    texts(spark, folder).select("doc_id", "text"),
    table(spark, folder, "benchmark").select(F.col("text").alias("term"), "item_id"),
).select("doc_id", "item_id")
ORACLES["match_passages"] = """
    SELECT doc_id, item_id FROM documents d, benchmark b WHERE contains(d.text, b.text)"""

QUERIES["match_two_sets"] = lambda spark, folder: match.match_two_sets(
    texts(spark, folder).select("doc_id", "text"), FIRST, SECOND, "text"
).select("doc_id", "term")
ORACLES["match_two_sets"] = f"""
    SELECT doc_id, term FROM documents, (VALUES {sql_rows([(t,) for t in SECOND])}) t(term)
    WHERE contains(text, term) AND EXISTS (
        SELECT 1 FROM (VALUES {sql_rows([(t,) for t in FIRST])}) f(a) WHERE contains(text, a))"""


def month_topics(spark, folder):
    """Words of the benchmark texts as topics of months: the item's place in the calendar."""
    months = F.transform(
        F.sequence(F.lit(1995), F.lit(2001)),
        lambda year: F.concat_ws("-", year, F.lpad((F.col("item_id") % 12 + 1).cast("string"),
                                                  2, "0")),
    )
    return (
        table(spark, folder, "benchmark")
        .select(F.explode(months).alias("month"), "text")
        .select("month", F.explode(F.split("text", "[ \n.,]+")).alias("text"))
        .where(F.length("text") >= 6)
        .distinct()
        .withColumn("id", F.concat_ws("/", "month", "text"))
    )


MONTH_TOPICS_SQL = r"""
    SELECT DISTINCT CAST(y AS VARCHAR) || '-' || lpad(CAST(item_id % 12 + 1 AS VARCHAR), 2, '0')
             AS month, term
    FROM (SELECT item_id, unnest(regexp_split_to_array(text, '[ \n.,]+')) AS term FROM benchmark),
         range(1995, 2002) r(y)
    WHERE length(term) >= 6"""

QUERIES["match_topics_month"] = lambda spark, folder: match.match_topics(
    documents(spark, folder).select("doc_id", "dt", "text"), month_topics(spark, folder), "text"
).select("doc_id", "keyword_id")
ORACLES["match_topics_month"] = f"""
    SELECT doc_id, month || '/' || term AS keyword_id
    FROM ({DOCUMENTS_SQL}) d JOIN ({MONTH_TOPICS_SQL}) t ON strftime(d.dt, '%Y-%m') = t.month
    WHERE contains(d.text, t.term)"""

QUERIES["extract_posts"] = lambda spark, folder: match.extract_posts(
    json_lines(spark, folder), FIRST, SECOND
).select("keyword_id", "weibo_id", "weibo_content")
# The raw line also holds the role, the previous text and the names of the
# fields ("ping", "weibo_content"), so a hit may lie there.
_LINE_SQL = f"""
    SELECT *, role || chr(9) || text || chr(9) || coalesce(previous, '') || chr(9)
           || '{' '.join(schemas.POST_FIELDS)}' AS line FROM ({TURNS_SQL})"""
ORACLES["extract_posts"] = f"""
    SELECT DISTINCT kid AS keyword_id,
           CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS weibo_id,
           content AS weibo_content
    FROM ({_LINE_SQL}),
         (VALUES {sql_rows([(t, str(i)) for i, t in enumerate(SECOND)])}) t(term, kid)
    WHERE contains(line, term) AND EXISTS (
        SELECT 1 FROM (VALUES {sql_rows([(t,) for t in FIRST])}) f(a) WHERE contains(line, a))"""


def _dated_lines(spark, folder):
    """JSON lines on days over six and a half years of that layout, by conversation."""
    number = F.split("value", "-")[0].cast("int")
    return json_lines(spark, folder).withColumn(
        "dt", F.date_add(F.lit("2021-01-01").cast("date"), number % 2400)
    )


def _later_topics(spark, folder):
    """The topics of months, 26 years on."""
    year = (F.substring("month", 1, 4).cast("int") + 26).cast("string")
    return month_topics(spark, folder).withColumn(
        "month", F.concat(year, F.substring("month", 5, 3))
    )


QUERIES["extract_topic_posts"] = lambda spark, folder: match.extract_topic_posts(
    _dated_lines(spark, folder), _later_topics(spark, folder)
).select("keyword_id", "weibo_id", "weibo_content")
ORACLES["extract_topic_posts"] = f"""
    SELECT DISTINCT month || '/' || term AS keyword_id,
           CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS weibo_id,
           content AS weibo_content
    FROM ({_LINE_SQL}) c
    JOIN ({MONTH_TOPICS_SQL}) t ON contains(c.line, t.term)
      AND strftime(DATE '2021-01-01' + CAST(conv_id % 2400 AS INTEGER), '%Y-%m')
          = CAST(CAST(t.month[:4] AS INTEGER) + 26 AS VARCHAR) || t.month[5:]"""
