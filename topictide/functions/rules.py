"""Keyword rules as boolean columns.

A rule is a word, or several words joined by ``&`` that must all be present on
one line of the text.
"""

from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def any_of(tests: Iterable[Column]) -> Column:
    """Does a test hold? A balanced tree, so that long lists stay shallow expressions."""
    tests = list(tests)
    while len(tests) > 1:
        pairs = zip(tests[::2], tests[1::2], strict=False)
        tests = [a | b for a, b in pairs] + (tests[-1:] if len(tests) % 2 else [])
    return tests[0] if tests else F.lit(False)


def contains_any(column: Column | str, terms: Iterable[str]) -> Column:
    """Does the text hold at least one term? An empty term is none."""
    text = _col(column)
    return any_of(F.contains(text, F.lit(term)) for term in terms if term)


def _all_words(text: Column, words: list[str]) -> Column:
    return reduce(and_, (F.contains(text, F.lit(word)) for word in words))


def _all_words_on_a_line(text: Column, words: list[str]) -> Column:
    return F.exists(F.split(text, "\n"), lambda line: _all_words(line, words))


def match_rules(column: Column | str, rules: Iterable[str], multiline: bool = False) -> Column:
    """Does any rule match? With ``multiline`` a conjunction must hold within one line."""
    text = _col(column)
    tests = []
    for rule in rules:
        words = rule.split("&")
        if multiline and len(words) > 1:
            tests.append(_all_words_on_a_line(text, words))
        else:
            tests.append(_all_words(text, words))
    return any_of(tests)


def matches_excluded(
    column: Column | str, words: Iterable[str], patterns: Iterable[str] = ()
) -> Column:
    """Does the text hold an excluded word or match an excluded pattern?"""
    text = _col(column)
    return any_of([contains_any(text, words), *(text.rlike(pattern) for pattern in patterns)])


def conditional_keep(
    flag: Column | str, column: Column | str, triggers: Iterable[str], savers: Iterable[str]
) -> Column:
    """Flag 0 where a trigger word stands without any saving word, else the flag as it is."""
    text = _col(column)
    dropped = contains_any(text, triggers) & ~contains_any(text, savers)
    return F.when(dropped, F.lit(0)).otherwise(_col(flag))
