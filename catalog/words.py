"""Quality dictionary and vocabulary."""

from pyspark.sql import functions as F

from catalog.posts import CLEAN_SQL, words_sql
from catalog.tables import sql_list, sql_rows, table, texts
from topictide.functions import vocabulary_tokens, word_tokens
from topictide.operators import dictionary as qualities
from topictide.operators import vocabulary
from topictide.plans import top_words
from topictide.sources.dictionaries import dictionary_frame

QUERIES, ORACLES = {}, {}

# Two qualities share a term, and one term lies inside another.
DICTIONARY = {
    "1": {"keyword": "north", "synonyms": ["tion", "eau"], "antonyms": ["heit", "ung"]},
    "2": {"keyword": "south", "synonyms": ["ation", "shwh"], "antonyms": ["que"]},
    "3": {"keyword": "west", "synonyms": ["heit", "zzzz"], "antonyms": ["there"]},
}
_TERM_ROWS = [
    (kid, entry["keyword"], term)
    for kid, entry in DICTIONARY.items()
    for term in entry["synonyms"] + entry["antonyms"]
]
_TERMS_SQL = f"(VALUES {sql_rows(_TERM_ROWS)}) t(kid, keyword, term)"


def _posts(spark, folder):
    return texts(spark, folder).select(
        "doc_id", "lang", F.col("text").alias("weibo_content")
    )


QUERIES["texts_by_quality"] = lambda spark, folder: qualities.texts_by_quality(
    _posts(spark, folder), dictionary_frame(spark, DICTIONARY), by=("lang",)
)
ORACLES["texts_by_quality"] = f"""
    SELECT DISTINCT lang, kid, split_part(text, '//', 1) AS text FROM documents, {_TERMS_SQL}
    WHERE contains(split_part(text, '//', 1), term)"""


def _counts_sql(weight, by=""):
    return f"""
        WITH own AS (SELECT doc_id, lang, split_part(text, '//', 1) AS own FROM documents),
        k AS (SELECT doc_id, count(DISTINCT kid) AS k FROM own, {_TERMS_SQL}
              WHERE contains(own, term) GROUP BY doc_id)
        SELECT {by} term, CAST(sum({weight}) AS BIGINT) AS cnt
        FROM own JOIN k USING (doc_id), (SELECT DISTINCT term FROM {_TERMS_SQL})
        WHERE contains(own, term) GROUP BY {by} term"""


def _counts(weighted, by=()):
    return lambda spark, folder: qualities.term_counts(
        _posts(spark, folder), dictionary_frame(spark, DICTIONARY), weighted=weighted, by=by
    ).withColumnRenamed("count", "cnt")


QUERIES["term_counts"] = _counts(True)
ORACLES["term_counts"] = _counts_sql("k")
QUERIES["term_counts_plain"] = _counts(False, ("lang",))
ORACLES["term_counts_plain"] = _counts_sql("1", "lang,")


def _merged(spark, folder):
    counts = qualities.term_counts(_posts(spark, folder), dictionary_frame(spark, DICTIONARY))
    by_lang = qualities.term_counts(
        _posts(spark, folder), dictionary_frame(spark, DICTIONARY), by=("lang",)
    )
    merged = qualities.merge_counts(counts, by_lang)
    return qualities.describe_terms(merged, dictionary_frame(spark, DICTIONARY)).select(
        "term", "qualities", F.col("count").alias("cnt")
    )


QUERIES["merge_and_describe_terms"] = _merged
ORACLES["merge_and_describe_terms"] = f"""
    SELECT term, qualities, CAST(2 * cnt AS BIGINT) AS cnt FROM ({_counts_sql('k')})
    JOIN (SELECT term, string_agg(DISTINCT keyword, '、' ORDER BY keyword) AS qualities
          FROM {_TERMS_SQL} GROUP BY term) USING (term)"""

STOPWORDS = ["the", "and", "of", "der", "die", "la", "de"]
_WORDS = r"unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+'))"
_COUNTS_SQL = f"""
    SELECT word, count(*) AS count FROM (SELECT {_WORDS} AS word FROM documents)
    WHERE word NOT IN ({sql_list(STOPWORDS)}) AND length(word) >= 2 GROUP BY word"""


def _stopwords(spark):
    return spark.createDataFrame([(word,) for word in STOPWORDS], "word STRING")


def _word_counts(spark, folder):
    return vocabulary.word_counts(
        texts(spark, folder), word_tokens("text"), stopwords=_stopwords(spark),
        min_length=2,
    )


def _renamed(df):
    return df.withColumnRenamed("count", "cnt")


QUERIES["word_counts"] = lambda spark, folder: _renamed(_word_counts(spark, folder))
ORACLES["word_counts"] = f"SELECT word, count AS cnt FROM ({_COUNTS_SQL})"


def _whitelisted(spark, folder):
    known = table(spark, folder, "benchmark").select(
        F.explode(word_tokens("text")).alias("word")
    )
    return _renamed(vocabulary.word_counts(
        texts(spark, folder), word_tokens("text"), by=["lang"], whitelist=known,
        min_length=2, max_length=4,
    ))


QUERIES["word_counts_whitelist"] = _whitelisted
ORACLES["word_counts_whitelist"] = f"""
    SELECT lang, word, count(*) AS cnt FROM (SELECT lang, {_WORDS} AS word FROM documents)
    WHERE length(word) BETWEEN 2 AND 4
      AND word IN (SELECT {_WORDS} FROM benchmark) GROUP BY lang, word"""

QUERIES["top_share_words"] = lambda spark, folder: _renamed(
    vocabulary.top_share(_word_counts(spark, folder), 0.1)
)
ORACLES["top_share_words"] = f"""
    SELECT word, cnt FROM (
      SELECT word, count AS cnt,
             row_number() OVER (ORDER BY count DESC, md5('0|' || word)) AS n,
             count(*) OVER () AS words
      FROM ({_COUNTS_SQL})) WHERE n <= greatest(CAST(floor(words * 0.1) AS BIGINT), 1)"""

QUERIES["frequent_words"] = lambda spark, folder: _renamed(vocabulary.frequent_words(
    _word_counts(spark, folder), table(spark, folder, "documents"), 0.05
))
ORACLES["frequent_words"] = f"""
    SELECT word, count AS cnt FROM ({_COUNTS_SQL})
    WHERE count > (SELECT count(*) FROM documents) * 0.05"""

QUERIES["word_frequency"] = lambda spark, folder: _renamed(vocabulary.word_frequency(
    texts(spark, folder), by=["lang"], stopwords=_stopwords(spark),
    min_length=1, share=0.02,
))
ORACLES["word_frequency"] = rf"""
    WITH c AS (SELECT lang, c FROM (SELECT lang, text, {CLEAN_SQL} AS c FROM documents)
               WHERE length(text) >= 10 AND length(c) >= 10)
    SELECT w.lang, word, cnt FROM (
      SELECT lang, word, count(*) AS cnt
      FROM (SELECT lang, unnest(regexp_extract_all(c, '[\p{{L}}\p{{N}}_]+')) AS word FROM c)
      WHERE length(word) BETWEEN 1 AND 4 AND word NOT IN ({sql_list(STOPWORDS)})
      GROUP BY lang, word) w
    JOIN (SELECT lang, count(*) AS texts FROM c GROUP BY lang) n ON n.lang = w.lang
    WHERE cnt > texts * 0.02"""

VOCABULARY = ["tion", "ation", "nation", "the", "there", "heit", "ung", "eaux", "eau"]


def _known_words(spark, folder):
    tokens = vocabulary_tokens("text", VOCABULARY)
    return _renamed(vocabulary.word_counts(texts(spark, folder), tokens))


QUERIES["vocabulary_word_counts"] = _known_words
ORACLES["vocabulary_word_counts"] = f"""
    SELECT word, count(*) AS cnt FROM (
      SELECT unnest(regexp_extract_all(text,
        '{"|".join(sorted(VOCABULARY, key=lambda w: (-len(w), w)))}')) AS word FROM documents)
    GROUP BY word"""


def _counted_vocabulary(spark, folder):
    words = table(spark, folder, "benchmark").select(
        F.explode(word_tokens("text")).alias("word")
    ).distinct()
    return _renamed(vocabulary.vocabulary_counts(texts(spark, folder), words, by=["lang"]))


QUERIES["vocabulary_match_counts"] = _counted_vocabulary
ORACLES["vocabulary_match_counts"] = r"""
    SELECT lang, word, CAST(sum((length(text) - length(replace(text, word, ''))) // length(word))
           AS BIGINT) AS cnt
    FROM documents, (SELECT DISTINCT word FROM (
        SELECT unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS word FROM benchmark)) w
    WHERE contains(text, word) GROUP BY lang, word"""


def _top_words(spark, folder):
    docs = texts(spark, folder).withColumnRenamed("text", "cleaned_weibo_content")
    found = top_words(docs, tokenizer=lambda text: vocabulary_tokens(text, VOCABULARY), share=0.5)
    return _renamed(found)


QUERIES["top_words_of_cleaned_texts"] = _top_words
ORACLES["top_words_of_cleaned_texts"] = f"""
    SELECT word, cnt FROM (
      SELECT word, cnt, row_number() OVER (ORDER BY cnt DESC, md5('0|' || word)) AS n,
             count(*) OVER () AS words
      FROM (SELECT word, count(*) AS cnt FROM (
              SELECT unnest(regexp_extract_all({words_sql('text')},
                '{"|".join(sorted(VOCABULARY, key=lambda w: (-len(w), w)))}')) AS word
              FROM documents) GROUP BY word))
    WHERE n <= greatest(CAST(floor(words * 0.5) AS BIGINT), 1)"""
