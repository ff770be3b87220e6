"""Raw posts: layouts, contents, cleaning, deduplication and counts."""

from pyspark.sql import functions as F

from catalog.tables import DOCUMENTS_SQL, TURNS_SQL, documents, table, texts, with_previous_turn
from topictide import schemas
from topictide.functions import clean_for_words, clean_post, heat, own_content
from topictide.operators import counts, dedupe
from topictide.sources import posts as layouts

QUERIES, ORACLES = {}, {}


def _fields(spark, folder):
    """Conversation turns with the fields of a post."""
    return with_previous_turn(spark, folder).select(
        "turn",
        F.concat_ws("-", "conv_id", "turn").alias("weibo_id"),
        F.col("role").alias("user_id"),
        F.col("turn").cast("string").alias("time_stamp"),
        F.when(F.col("previous").isNull(), "0").otherwise("1").alias("is_retweet"),
        F.lit("1").alias("zhuan"), F.lit("2").alias("ping"), F.lit("3").alias("zhan"),
        F.col("text").alias("weibo_content"),
        F.coalesce("previous", F.lit("")).alias("r_weibo_content"),
    )


def _json_line():
    return F.concat_ws("\t", "weibo_id", F.to_json(F.struct(*schemas.POST_FIELDS)))


def _positional_line(separator):
    """The used fields at their places, blanks elsewhere; line breaks cannot be in such a line."""
    names = {place: name for name, place in schemas.POST_POSITIONS.items()}
    fields = [
        F.replace(names[i], F.lit("\n"), F.lit(" ")) if i in names else F.lit("-")
        for i in range(schemas.POST_MIN_FIELDS)
    ]
    return F.concat_ws(separator, *fields)


def json_lines(spark, folder):
    return _fields(spark, folder).select(
        _json_line().alias("value"), F.lit("2022-01-01").cast("date").alias("dt")
    )


def mixed_lines(spark, folder):
    """Turn 0 and 1 as early tab-separated days, turn 5 as the CSV day, others as JSON days."""
    return _fields(spark, folder).select(
        F.when(F.col("turn") <= 1, _positional_line("\t"))
        .when(F.col("turn") == 5, F.concat(F.lit('"'), _positional_line('","'), F.lit('"')))
        .otherwise(_json_line()).alias("value"),
        F.when(F.col("turn") == 5, F.lit("2020-06-30").cast("date"))
        .otherwise(F.date_add(F.lit("2019-08-07").cast("date"), F.col("turn").cast("int")))
        .alias("dt"),
    )


_POST_SQL = f"""
    SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS weibo_id, role AS user_id,
           CASE WHEN previous IS NULL THEN '0' ELSE '1' END AS is_retweet,
           content AS weibo_content FROM ({TURNS_SQL})"""
_SHOWN = ["weibo_id", "user_id", "is_retweet", "weibo_content"]


def _tsv(spark, folder):
    lines = _fields(spark, folder).select(
        _positional_line("\t").alias("value"), F.lit("2018-01-01").cast("date").alias("dt")
    )
    return layouts.parse_posts_tsv(lines).select(*_SHOWN)


def _csv(spark, folder):
    line = F.concat(F.lit('"'), _positional_line('","'), F.lit('"'))
    lines = _fields(spark, folder).select(
        line.alias("value"), F.lit("2020-06-30").cast("date").alias("dt")
    )
    return layouts.parse_posts_csv(lines).select(*_SHOWN)


QUERIES["posts_json"] = lambda spark, folder: layouts.parse_posts_json(
    json_lines(spark, folder)
).select(*_SHOWN)
QUERIES["posts_tsv"] = _tsv
QUERIES["posts_csv"] = _csv
QUERIES["posts_by_day"] = lambda spark, folder: layouts.parse_posts(
    mixed_lines(spark, folder)
).select(*_SHOWN)
for _name in ("posts_json", "posts_tsv", "posts_csv", "posts_by_day"):
    ORACLES[_name] = _POST_SQL

QUERIES["own_content"] = lambda spark, folder: layouts.parse_posts_json(
    json_lines(spark, folder)
).select("weibo_id", own_content("weibo_content").alias("own"))
ORACLES["own_content"] = f"SELECT weibo_id, split_part(weibo_content, '//', 1) AS own " \
    f"FROM ({_POST_SQL})"

QUERIES["heat"] = lambda spark, folder: table(spark, folder, "events").select(
    "event_id", heat("props").alias("hot")
)
ORACLES["heat"] = r"""
    SELECT event_id, TRY_CAST(nullif(regexp_extract(props, '([0-9]+)', 1), '') AS BIGINT) AS hot
    FROM events"""

_SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}" \
    r"\x{3000}"
_WORD = r"\p{L}\p{N}_"


def _strip_sql(text):
    return f"regexp_replace({text}, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')"


CLEAN_SQL = _strip_sql(
    "replace(regexp_replace(replace(replace(replace(replace(text, '“', ''), '”', ''), '…', ''), "
    "'点击链接查看更多->', ''), '[a-zA-Z0-9.?/&=:_%,-~#《》]', '', 'g'), chr(10), ' ')"
)
QUERIES["clean_post"] = lambda spark, folder: texts(spark, folder).select(
    "doc_id", clean_post("text").alias("cleaned")
)
ORACLES["clean_post"] = f"""
    SELECT doc_id, CASE WHEN length(text) >= 10 AND length(c) >= 10 THEN c END AS cleaned
    FROM (SELECT doc_id, text, {CLEAN_SQL} AS c FROM documents)"""

QUERIES["clean_for_words"] = lambda spark, folder: texts(spark, folder, "pages").select(
    "page_id", clean_for_words(F.concat_ws(" ", "url", "html")).alias("cleaned")
)
_NOISE_SQL = f"(https?://[^{_SPACE}]+|@[{_WORD}]+|#[{_WORD}]+#)"


def words_sql(text):
    return _strip_sql(
        f"regexp_replace(regexp_replace({text}, '{_NOISE_SQL}', '', 'g'), "
        f"'[^{_WORD}一-鿿，。！？]', '', 'g')"
    )


ORACLES["clean_for_words"] = f"""
    SELECT page_id, {words_sql("url || ' ' || html")} AS cleaned FROM pages"""

QUERIES["dedupe_posts"] = lambda spark, folder: dedupe.dedupe_posts(
    table(spark, folder, "documents"), day="lang", key="text", order=["doc_id"]
).select("lang", "doc_id", "source")
ORACLES["dedupe_posts"] = """
    SELECT lang, doc_id, source FROM (SELECT *, row_number() OVER (
        PARTITION BY lang, text ORDER BY doc_id) AS n FROM documents) WHERE n = 1"""


def _distinct(spark, folder):
    docs = table(spark, folder, "documents")
    blank = [F.lit("").alias(name) for name in schemas.EXTRACTED_COLUMNS
             if name not in ("keyword_id", "weibo_content")]
    posts = docs.select(
        F.lit("2022-01-01").cast("date").alias("dt"), F.col("lang").alias("keyword_id"),
        *blank, F.col("text").alias("weibo_content"),
    )
    return dedupe.distinct_posts(posts).select("keyword_id", "weibo_content")


QUERIES["distinct_posts"] = _distinct
ORACLES["distinct_posts"] = """
    SELECT DISTINCT lang AS keyword_id, text AS weibo_content FROM documents"""

QUERIES["line_counts"] = lambda spark, folder: counts.line_counts(
    documents(spark, folder)
).select(F.date_format("dt", "yyyy-MM-dd").alias("day"), "total_count")
ORACLES["line_counts"] = f"""
    SELECT strftime(dt, '%Y-%m-%d') AS day, count(*) AS total_count
    FROM ({DOCUMENTS_SQL}) GROUP BY 1"""

QUERIES["row_counts"] = lambda spark, folder: counts.row_counts(
    table(spark, folder, "orders"), "o_orderdate"
).select("year", F.date_format("dt", "yyyy-MM-dd").alias("day"), "row_count")
ORACLES["row_counts"] = """
    SELECT year, day, count(*) AS row_count FROM (
      SELECT strftime(o_orderdate, '%Y') AS year, strftime(o_orderdate, '%Y-%m-%d') AS day
      FROM orders) GROUP BY ROLLUP (year, day)"""
