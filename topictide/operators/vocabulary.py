"""Word counts of token columns, and the most frequent words.

Tokens are an array column: ``word_tokens`` for spaced text,
``vocabulary_tokens`` for known words of unspaced text, or a Pandas UDF of the
user for a real segmenter.
"""

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topictide import terms
from topictide.functions.text import clean_post, word_tokens
from topictide.lineage import BROADCAST_MAX_ROWS, cut_lineage
from topictide.operators import automata
from topictide.operators.match import TermLists, match_terms
from topictide.operators.numbering import numbered
from topictide.operators.rank import smallest_digests


def word_counts(
    df: DataFrame,
    tokens: Column | str,
    by: Iterable[str] = (),
    stopwords: DataFrame | None = None,
    whitelist: DataFrame | None = None,
    min_length: int = 1,
    max_length: int | None = None,
) -> DataFrame:
    """``word, count`` (per ``by``): occurrences of kept tokens. Null texts have no words.

    Words are counted first and filtered by the lists after: each list is then
    probed once per word and not once per token.
    """
    by = list(by)
    array = F.col(tokens) if isinstance(tokens, str) else tokens
    words = df.select(*by, F.explode(array).alias("word"))
    words = words.where(F.length("word") >= min_length)
    if max_length is not None:
        words = words.where(F.length("word") <= max_length)
    counts = words.groupBy(*by, "word").agg(F.count(F.lit(1)).alias("count"))
    if stopwords is not None:
        counts = counts.join(stopwords.select("word").distinct(), "word", "left_anti")
    if whitelist is not None:
        counts = counts.join(whitelist.select("word").distinct(), "word", "left_semi")
    return counts.select(*by, "word", "count")


def domain_vocabulary(words: Iterable[str]) -> list[str]:
    """A vocabulary with the domain words kept whole and the split hint taken apart."""
    kept = dict.fromkeys([*words, *terms.DOMAIN_WORDS, *terms.SPLIT_HINT])
    kept.pop("".join(terms.SPLIT_HINT), None)
    return list(kept)


def vocabulary_counts(
    df: DataFrame, vocabulary: DataFrame, text: str = "text", by: Iterable[str] = ()
) -> DataFrame:
    """``word, count`` (per ``by``): occurrences of each word of a table inside unspaced text.

    For vocabularies too large for ``vocabulary_tokens``. Words are counted without overlaps
    of a word with itself; a word inside a longer one counts too, as no segmentation takes
    place. An automaton of all words reads a text once and counts from the places it finds.
    """
    by = list(by)
    words = vocabulary.select("word")
    if automata.ahocorasick is None:
        hits = match_terms(df.select(*by, text), words, text, "word")
        rest = F.length(F.replace(F.col(text), F.col("word"), F.lit("")))
        times = ((F.length(text) - rest) / F.length("word")).cast("bigint")
        return hits.groupBy(*by, "word").agg(F.sum(times).alias("count"))
    result = None
    lists = TermLists(words, "word", [], BROADCAST_MAX_ROWS)
    for _, texts in lists.each(df.select(*by, text), text, automata.terms_counted):
        hits = texts.select(*by, F.explode("_found").alias("hit"))
        part = hits.groupBy(*by, F.col("hit.term").alias("word")).agg(F.sum("hit.n").alias("count"))
        result = part if result is None else result.unionByName(part)
    return result


def top_share(counts: DataFrame, share: float = 0.1) -> DataFrame:
    """The most counted ``share`` of the words, rounded down and at least one.

    Words with equal counts at the border are taken in digest order. The border
    count comes from the running sum of word numbers per count, summed up by ranges of
    counts, never from a sort of all words.
    """
    counts = cut_lineage(counts)
    levels = cut_lineage(counts.groupBy("count").agg(F.count(F.lit(1)).alias("_words")))
    known = levels.agg(F.sum("_words")).first()[0]
    if not known:
        return counts
    wanted = max(int(known * share), 1)
    downto = numbered(levels, [F.col("count").desc()], (), "_upto", "_words")
    border = (
        downto
        .where((F.col("_upto") >= wanted) & (F.col("_upto") - F.col("_words") < wanted))
        .select("count", (F.lit(wanted) - F.col("_upto") + F.col("_words")).alias("_rest"))
        .first()
    )
    above = counts.where(F.col("count") > border["count"])
    level = counts.where(F.col("count") == border["count"])
    rest = smallest_digests(level, None, ["word"], lambda *_: F.lit(border["_rest"]))
    return above.unionByName(rest)


def frequent_words(
    counts: DataFrame, texts: DataFrame, share: float = 0.05, by: Iterable[str] = (),
    text: str | None = None,
) -> DataFrame:
    """Words counted more often than ``share`` of the texts (per ``by``).

    With ``text`` given, only rows where it is not null are texts.
    """
    by = list(by)
    number = F.count(F.lit(1)) if text is None else F.count(text)
    if not by:
        return counts.where(F.col("count") > texts.agg(number).scalar() * F.lit(share))
    numbers = texts.groupBy(*by).agg(number.alias("_texts"))
    return counts.join(numbers, by).where(F.col("count") > F.col("_texts") * share).drop("_texts")


def word_frequency(
    texts: DataFrame,
    text: str = "text",
    by: Iterable[str] = (),
    stopwords: DataFrame | None = None,
    tokenizer=word_tokens,
    min_length: int = 2,
    max_length: int | None = 4,
    share: float = 0.05,
) -> DataFrame:
    """Frequent words of cleaned texts: clean, cut into tokens, count, keep the frequent ones.

    ``tokenizer`` maps a text column to an array column. Texts that cleaning
    empties have no words and do not count.
    """
    by = list(by)
    cleaned = texts.select(*by, clean_post(text).alias("_clean"))
    counts = word_counts(
        cleaned, tokenizer(F.col("_clean")), by, stopwords, None, min_length, max_length
    )
    return frequent_words(counts, cleaned, share, by, "_clean")
