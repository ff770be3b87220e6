"""Keyword rules from a table, too many for one expression.

The words of all rules are looked up in one pass over each text; a rule holds when all of
its words were found. Rules leave the table in lists of bounded bytes, one column each, so
the texts are read once whatever the number of lists.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topictide.functions.rules import any_of, match_rules
from topictide.lineage import cut_lineage
from topictide.operators import automata


def _lists(rules: DataFrame, list_bytes: int) -> list[list[str]]:
    name = rules.columns[0]
    known = cut_lineage(rules.select(F.col(name).alias("rule")).where(F.col("rule").isNotNull()).distinct())
    size = known.agg(F.coalesce(F.sum(F.octet_length("rule")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(size / list_bytes))
    lists = []
    for block in range(blocks):
        part = known.where(F.pmod(F.xxhash64("rule"), F.lit(blocks)) == block)
        lists.append(sorted(row["rule"] for row in part.collect()))
    return [listed for listed in lists if listed]


def _by_expressions(listed: list[str], text: str, multiline: bool) -> Column:
    return F.filter(F.array(*[F.when(match_rules(text, [rule], multiline), F.lit(rule)) for rule in listed]),
                    lambda rule: rule.isNotNull())


def rules_in_texts(
    df: DataFrame, rules: DataFrame, text: str = "text", rule: str = "rule", multiline: bool = False,
    list_bytes: int = automata.TERM_BYTES,
) -> DataFrame:
    """Rows once per rule that holds in their text, with the rule."""
    if automata.ahocorasick is None:
        held = [_by_expressions(listed, text, multiline) for listed in _lists(rules, list_bytes)]
    else:
        held = [automata.rules_held(df.sparkSession, listed, F.col(text), multiline) for listed in _lists(rules, list_bytes)]
    found = held[0] if len(held) == 1 else F.flatten(F.array(*held)) if held else F.array().cast("array<string>")
    return df.select("*", found.alias("_held")).select(*df.columns, F.explode("_held").alias(rule))


def holds_any(
    df: DataFrame, rules: DataFrame, text: str, name: str, multiline: bool = False,
    list_bytes: int = automata.TERM_BYTES,
) -> DataFrame:
    """Add the boolean ``name``: does a rule of the table hold? Never null; a null text holds none."""
    lists = _lists(rules, list_bytes)
    if automata.ahocorasick is None:
        held = [F.size(_by_expressions(listed, text, multiline)) > 0 for listed in lists]
    else:
        held = [automata.any_rule(df.sparkSession, listed, F.col(text), multiline) for listed in lists]
    return df.withColumn(name, F.coalesce(any_of(held), F.lit(False)))
