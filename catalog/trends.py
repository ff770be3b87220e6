"""Daily term counts and trends."""

from pyspark.sql import functions as F

from catalog.tables import (
    DOCUMENTS_SQL,
    LOGGED_SQL,
    documents,
    logged_days,
    sql_rows,
)
from topictide.operators import trend

QUERIES, ORACLES = {}, {}

TERMS = {
    "ending": ["tion", "ing", "ent", "heit", "ung"],
    "word": ["the", "der", "que"],
    "rare": ["zzzz", "http", "shwh"],
}
CHILDREN = ["the", "und", "eau"]
_PAIRS = sql_rows([(word, quality) for quality, words in TERMS.items() for word in words])


def daily(spark, folder, **options):
    posts = documents(spark, folder).withColumnRenamed("text", "weibo_content")
    rows = trend.child_posts(posts, CHILDREN)
    return trend.daily_term_counts(rows, logged_days(spark, folder), TERMS, **options)


_CHILD_SQL = f"""
    SELECT *, split_part(text, '//', 1) AS own FROM ({DOCUMENTS_SQL})
    WHERE contains(text, 'the') OR contains(text, 'und') OR contains(text, 'eau')"""
DAILY_SQL = f"""
    SELECT l.dt, keyword, quality, total_count,
           CAST(count(CASE WHEN contains(own, keyword) THEN 1 END) AS BIGINT) AS cnt
    FROM ({LOGGED_SQL}) l JOIN ({_CHILD_SQL}) d ON d.dt = l.dt,
         (VALUES {_PAIRS}) t(keyword, quality)
    GROUP BY ALL"""

QUERIES["child_posts"] = lambda spark, folder: trend.child_posts(
    documents(spark, folder).withColumnRenamed("text", "weibo_content"), CHILDREN
).select("doc_id", "original_weibo_content")
ORACLES["child_posts"] = f"SELECT doc_id, own AS original_weibo_content FROM ({_CHILD_SQL})"


def _shown(df):
    return df.select(F.date_format("dt", "yyyy-MM-dd").alias("day"), "keyword", "quality",
                     F.col("count").alias("cnt"), "total_count")


QUERIES["daily_term_counts"] = lambda spark, folder: _shown(daily(spark, folder))
ORACLES["daily_term_counts"] = f"""
    SELECT strftime(dt, '%Y-%m-%d') AS day, keyword, quality, cnt, total_count
    FROM ({DAILY_SQL})"""

QUERIES["daily_term_counts_all_days"] = lambda spark, folder: _shown(
    daily(spark, folder, all_logged_days=True)
)
ORACLES["daily_term_counts_all_days"] = f"""
    SELECT strftime(l.dt, '%Y-%m-%d') AS day, keyword, quality, total_count,
           CAST(count(CASE WHEN contains(own, keyword) THEN 1 END) AS BIGINT) AS cnt
    FROM ({LOGGED_SQL}) l CROSS JOIN (VALUES {_PAIRS}) t(keyword, quality)
    LEFT JOIN ({_CHILD_SQL}) d ON d.dt = l.dt
    GROUP BY ALL"""


def _trend(grain, by):
    def query(spark, folder):
        return trend.term_trend(daily(spark, folder), logged_days(spark, folder), grain, by)
    return query


_FORMATS = {"month": "%Y-%m", "year": "%Y"}


def _trend_sql(grain, by):
    return f"""
        SELECT period, {by}, frequency, period_total_count,
               CAST(frequency AS DOUBLE) / CAST(period_total_count AS DOUBLE) AS proportion
        FROM (SELECT strftime(dt, '{_FORMATS[grain]}') AS period, {by},
                     CAST(sum(cnt) AS BIGINT) AS frequency FROM ({DAILY_SQL}) GROUP BY 1, 2)
        LEFT JOIN (SELECT strftime(dt, '{_FORMATS[grain]}') AS period,
                     CAST(sum(total_count) AS BIGINT) AS period_total_count
                   FROM ({LOGGED_SQL}) GROUP BY 1) USING (period)"""


for _grain in ("month", "year"):
    for _by in ("keyword", "quality"):
        QUERIES[f"term_trend_{_grain}_{_by}"] = _trend(_grain, _by)
        ORACLES[f"term_trend_{_grain}_{_by}"] = _trend_sql(_grain, _by)

QUERIES["period_totals"] = lambda spark, folder: trend.period_totals(
    logged_days(spark, folder), "month"
)
ORACLES["period_totals"] = f"""
    SELECT strftime(dt, '%Y-%m') AS period, CAST(sum(total_count) AS BIGINT) AS period_total_count
    FROM ({LOGGED_SQL}) GROUP BY 1"""


def _shares(spark, folder):
    yearly = trend.term_trend(daily(spark, folder), logged_days(spark, folder), "year", "quality")
    return trend.share_within(yearly, exclude=["1997"])


QUERIES["quality_share"] = _shares
ORACLES["quality_share"] = f"""
    SELECT period, quality, CASE WHEN total = 0 THEN 0.0
           ELSE CAST(frequency AS DOUBLE) / CAST(total AS DOUBLE) END AS share
    FROM (SELECT period, quality, frequency, sum(frequency) OVER (PARTITION BY period) AS total
          FROM ({_trend_sql('year', 'quality')}) WHERE period <> '1997')"""

QUERIES["quality_share_wide"] = lambda spark, folder: trend.pivot_shares(
    _shares(spark, folder), list(TERMS)
)
ORACLES["quality_share_wide"] = f"""
    SELECT period, {', '.join(f"coalesce(sum(CASE WHEN quality = '{q}' THEN share END), 0.0) AS {q}"
                              for q in TERMS)}
    FROM ({ORACLES['quality_share']}) GROUP BY period"""

QUERIES["map_quality"] = lambda spark, folder: trend.map_quality(
    daily(spark, folder).groupBy("keyword").agg(F.sum("count").alias("cnt")),
    spark.createDataFrame([("tion", "ending"), ("the", "word")], "term STRING, quality STRING"),
)
ORACLES["map_quality"] = f"""
    SELECT keyword, CAST(sum(cnt) AS BIGINT) AS cnt,
           CASE keyword WHEN 'tion' THEN 'ending' WHEN 'the' THEN 'word' END AS quality
    FROM ({DAILY_SQL}) GROUP BY keyword"""
