"""Setting, correcting and selecting flags of topic rows."""

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topictide.functions.rules import conditional_keep, match_rules, matches_excluded
from topictide.operators.rule_tables import holds_any


def flag_rules(
    df: DataFrame, rules: Iterable[str] | DataFrame, text: str = "text", flag: str = "flag",
    multiline: bool = False,
) -> DataFrame:
    """Flag 1 where a rule matches the text, else 0, also for a null text.

    ``rules`` is a list, or a table with a rule in its first column, of any number.
    """
    if isinstance(rules, DataFrame):
        held = holds_any(df, rules, text, "_holds", multiline)
        return held.withColumn(flag, F.col("_holds").cast("int")).drop("_holds")
    matched = F.coalesce(match_rules(text, rules, multiline), F.lit(False))
    return df.withColumn(flag, matched.cast("int"))


def exclude_matches(
    df: DataFrame, words: Iterable[str] | DataFrame, patterns: Iterable[str] = (), text: str = "text"
) -> DataFrame:
    """Drop rows that hold an excluded word or match an excluded pattern; null texts stay.

    ``words`` is a list, or a table with a word in its first column, of any number.
    """
    if isinstance(words, DataFrame):
        held = holds_any(df, words, text, "_holds").where(~F.col("_holds")).drop("_holds")
        return exclude_matches(held, (), patterns, text) if patterns else held
    return df.where(~F.coalesce(matches_excluded(text, words, patterns), F.lit(False)))


def unflag_without_saver(
    df: DataFrame, triggers: Iterable[str] | DataFrame, savers: Iterable[str] | DataFrame,
    text: str = "text", flag: str = "flag",
) -> DataFrame:
    """Flag 0 where a trigger word stands without a saving word; both are lists, or both tables."""
    if isinstance(triggers, DataFrame):
        both = holds_any(holds_any(df, triggers, text, "_trigger"), savers, text, "_saver")
        kept = F.when(F.col("_trigger") & ~F.col("_saver"), F.lit(0)).otherwise(F.col(flag))
        return both.withColumn(flag, kept).drop("_trigger", "_saver")
    return df.withColumn(flag, conditional_keep(flag, text, triggers, savers))


def unflag_titles(
    df: DataFrame, titles: Iterable[str] | DataFrame, text: str = "text", flag: str = "flag"
) -> DataFrame:
    """Flag 0 where the whole text is one of the titles; the number of rows stays.

    A Python list becomes a hash-set test inside the projection. A table of
    titles is joined, and Catalyst broadcasts it if its size allows.
    """
    if not isinstance(titles, DataFrame):
        wrong = F.col(text).isin(list(dict.fromkeys(titles)))
        return df.withColumn(flag, F.when(wrong, F.lit(0)).otherwise(F.col(flag)))
    names = titles.select(F.col(titles.columns[0]).alias(text)).distinct()
    marked = df.join(names.withColumn("_wrong", F.lit(True)), text, "left")
    kept = F.when(F.col("_wrong"), F.lit(0)).otherwise(F.col(flag)).alias(flag)
    return marked.select(*[kept if name == flag else name for name in df.columns])


def flagged_with_heat(df: DataFrame, flag: str = "flag", hot: str = "hot") -> DataFrame:
    """Flagged rows whose heat is known."""
    return df.where((F.col(flag) == 1) & F.col(hot).isNotNull())


def hot_enough(df: DataFrame, cutoff: int, hot: str = "hot") -> DataFrame:
    """Rows of at least the cutoff heat; rows without heat are dropped."""
    return df.where(F.col(hot) >= cutoff)
