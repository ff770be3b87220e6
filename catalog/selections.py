"""Rules from tables, periods, originals, day lists, added vocabulary, samples by known counts."""

from pyspark.sql import functions as F

from catalog.posts import CLEAN_SQL
from catalog.tables import DOCUMENTS_SQL, LOGGED_SQL, TURNS_SQL, documents, logged_days, sql_rows, table, texts
from catalog.tables import with_previous_turn
from catalog.trends import TERMS
from topictide.functions import clean_post, day_list, vocabulary_tokens
from topictide.functions.periods import half_year
from topictide.operators import flags, rule_tables, sample, trend, vocabulary
from topictide.plans.text_clusters import gathered_texts
from topictide.sources.days import between_days

QUERIES, ORACLES = {}, {}


def _rules(spark, folder):
    """Every word of the benchmark joined with the one after it, and long words alone."""
    words = F.filter(F.split("text", "[ \n.,]+"), lambda word: word != "")
    pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1),
                        lambda i: F.concat_ws("&", F.element_at("w", i), F.element_at("w", i + 1)))
    alone = F.filter("w", lambda word: F.length(word) >= 9)
    return table(spark, folder, "benchmark").select(words.alias("w")).where(F.size("w") > 1).select(
        F.explode(F.concat(pairs, alone)).alias("rule")
    ).distinct()


_RULES_SQL = r"""
    SELECT DISTINCT unnest(list_transform(range(1, len(w)), lambda i: [w[i], w[i + 1]])
                    || list_transform(list_filter(w, lambda x: length(x) >= 9), lambda x: [x, x])) AS pair
    FROM (SELECT list_filter(regexp_split_to_array(text, '[ \n.,]+'), lambda x: x <> '') AS w FROM benchmark)
    WHERE len(w) > 1"""
_RULE_SQL = "CASE WHEN length(pair[1]) >= 9 AND pair[1] = pair[2] THEN pair[1] ELSE pair[1] || '&' || pair[2] END"

QUERIES["rules_in_texts"] = lambda spark, folder: rule_tables.rules_in_texts(
    texts(spark, folder).select("doc_id", "text"), _rules(spark, folder)
).select("doc_id", "rule")
ORACLES["rules_in_texts"] = f"""
    SELECT DISTINCT doc_id, {_RULE_SQL} AS rule FROM documents, ({_RULES_SQL})
    WHERE contains(text, pair[1]) AND contains(text, pair[2])"""

QUERIES["flag_rule_table"] = lambda spark, folder: flags.flag_rules(
    texts(spark, folder).select("doc_id", "text"), _rules(spark, folder).where("contains(rule, '&')")
).select("doc_id", "flag")
ORACLES["flag_rule_table"] = f"""
    SELECT doc_id, CAST(count(pair) > 0 AS INTEGER) AS flag FROM documents
    LEFT JOIN (SELECT * FROM ({_RULES_SQL}) WHERE contains({_RULE_SQL}, '&'))
      ON contains(text, pair[1]) AND contains(text, pair[2]) GROUP BY doc_id"""

HALVES = [(1996, 0), (1998, 1), (1999, 2)]


def _halves(spark, folder):
    parts = [
        between_days(documents(spark, folder), *half_year(year, half)).withColumn("year", F.lit(year))
        for year, half in HALVES
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("year", "doc_id")


QUERIES["half_years"] = _halves
ORACLES["half_years"] = " UNION ALL ".join(
    f"SELECT {year} AS year, doc_id FROM ({DOCUMENTS_SQL}) WHERE dt >= DATE '{year}-{'07-01' if half == 1 else '01-01'}'"
    f" AND dt <= DATE '{year}-{'06-30' if half == 0 else '12-31'}'"
    for year, half in HALVES
)


def _original_turns(spark, folder):
    turns = with_previous_turn(spark, folder).select(
        F.concat_ws("-", "conv_id", "turn").alias("weibo_id"),
        F.when(F.col("previous").isNull(), "0").otherwise("1").alias("is_retweet"),
        F.col("text").alias("original_weibo_content"),
        F.date_add(F.lit("1995-01-01").cast("date"), (F.col("conv_id") % 2400).cast("int")).alias("dt"),
    )
    return trend.daily_term_counts(turns, logged_days(spark, folder), TERMS, originals_only=True)


QUERIES["daily_term_counts_originals"] = lambda spark, folder: _original_turns(spark, folder).select(
    F.date_format("dt", "yyyy-MM-dd").alias("day"), "keyword", "quality", F.col("count").alias("cnt"), "total_count"
)
_PAIRS = sql_rows([(word, quality) for quality, words in TERMS.items() for word in words])
ORACLES["daily_term_counts_originals"] = f"""
    SELECT strftime(l.dt, '%Y-%m-%d') AS day, keyword, quality, total_count,
           CAST(count(CASE WHEN contains(text, keyword) THEN 1 END) AS BIGINT) AS cnt
    FROM ({LOGGED_SQL}) l
    JOIN (SELECT *, CAST(DATE '1995-01-01' + CAST(conv_id % 2400 AS INTEGER) AS DATE) AS dt
          FROM ({TURNS_SQL}) WHERE previous IS NULL) t ON t.dt = l.dt,
         (VALUES {_PAIRS}) p(keyword, quality)
    GROUP BY ALL"""


def _every_day(spark, folder):
    """All days between the first and the last order with their orders, 0 where there are none."""
    days = logged_days(spark, folder)
    first, last = days.agg(F.min("dt").cast("string"), F.max("dt").cast("string")).first()
    return day_list(spark, first, last).join(days, "dt", "left").select(
        F.date_format("dt", "yyyy-MM-dd").alias("day"), F.coalesce("total_count", F.lit(0)).alias("cnt")
    )


QUERIES["day_list"] = _every_day
ORACLES["day_list"] = f"""
    SELECT strftime(d, '%Y-%m-%d') AS day, coalesce(total_count, 0) AS cnt
    FROM (SELECT CAST(unnest(generate_series(min(dt), max(dt), INTERVAL 1 DAY)) AS DATE) AS d FROM ({LOGGED_SQL}))
    LEFT JOIN ({LOGGED_SQL}) l ON l.dt = d"""


def _added_words(spark, folder):
    """Tokens of a vocabulary with the domain words added and the split hint taken apart."""
    words = vocabulary.domain_vocabulary(["tion", "".join(vocabulary.terms.SPLIT_HINT)])
    hint = "".join([*vocabulary.terms.SPLIT_HINT, *vocabulary.terms.DOMAIN_WORDS])
    text = F.concat(F.col("text"), F.lit(hint))
    tokens = vocabulary_tokens(text, words)
    counts = vocabulary.word_counts(texts(spark, folder).where(F.col("text").isNotNull()), tokens)
    return counts.withColumnRenamed("count", "cnt")


QUERIES["added_vocabulary"] = _added_words
_ADDED = sql_rows([(word,) for word in [*vocabulary.terms.SPLIT_HINT, *vocabulary.terms.DOMAIN_WORDS]])
ORACLES["added_vocabulary"] = f"""
    SELECT 'tion' AS word, CAST(sum(len(regexp_extract_all(text, 'tion'))) AS BIGINT) AS cnt FROM documents
    UNION ALL SELECT word, (SELECT count(text) FROM documents) FROM (VALUES {_ADDED}) w(word)"""

QUERIES["gathered_texts"] = lambda spark, folder: gathered_texts(
    texts(spark, folder).select("doc_id", clean_post("text").alias("cleaned")), "doc_id", "cleaned"
)
ORACLES["gathered_texts"] = f"""
    SELECT doc_id, c AS text FROM (SELECT doc_id, text, {CLEAN_SQL} AS c FROM documents)
    WHERE length(text) >= 10 AND length(c) >= 10"""


def _topic_samples(spark, folder):
    events = table(spark, folder, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    counts = events.groupBy("event_type", "day").agg((F.count(F.lit(1)) * 2).alias("count"))
    return sample.sample_by_counts(events, counts, ["event_id"], 700, "event_type", "day").select(
        "event_type", "day", "event_id"
    )


QUERIES["topic_samples"] = _topic_samples
ORACLES["topic_samples"] = """
    WITH e AS (SELECT event_id, event_type, strftime(ts, '%Y-%m-%d') AS day FROM events),
    r AS (SELECT event_type, least(1.0::DOUBLE, 700.0::DOUBLE / (2 * count(*))) AS rate FROM e GROUP BY event_type)
    SELECT event_type, day, event_id FROM (
      SELECT e.*, row_number() OVER (PARTITION BY event_type, day
               ORDER BY md5('2025|' || CAST(event_id AS VARCHAR))) AS n,
             round_even(rate * count(*) OVER (PARTITION BY event_type, day), 0) AS quota
      FROM e JOIN r USING (event_type)) WHERE n <= quota"""
