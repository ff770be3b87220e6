"""Quality rules, line first: lines are judged one by one, then the document by what is left.

A line with a word fails by the first of these that holds:

- boilerplate: at most 30 words, and a legal, cookie or sharing phrase;
- navigation: two or more menu separators, one for every three words or more;
- punctuation: symbols or runs of ``!`` and ``?`` for more than every fourth word, or no
  sentence mark at the end of any of its words.

Failing lines go. A document fails when the lines left hold less than half of its word
characters. The base rules (length, repeated word windows) come on top.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topictide.llm.texts import BLANKS, per_text, words_of

SYMBOLS = "#*$%&|<>"
SEPARATORS = "|»›>·•→"
SENTENCE_END = re.compile(r"""[.!?…:;]["'»”’)\]]*([\x09-\x0D\x20]|$)""")
EXCITED = re.compile(r"[!?]{2,}")
BOILERPLATE = re.compile(
    r"licensed under|all rights reserved|terms of (?:use|service)|privacy policy|cookie"
    r"|javascript|subscribe|newsletter|share this|sign (?:in|up)|log ?in|copyright|lorem ipsum",
    re.IGNORECASE,
)
BOILERPLATE_MAX_WORDS = 30
#: Share of word characters, in hundredths, that must be left after cleaning.
KEPT_PERCENT = 50

FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_lines long, n_failed_lines long, kept_chars long, clean_text string"
)


def _count(text: str, characters: str) -> int:
    return sum(map(text.count, characters))


def repeated_words(words: list[bytes], size: int = 3) -> int:
    """Words that lie in a window of ``size`` words found twice or more."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    codes: dict[bytes, int] = {}
    ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words))
    windows = ids[:n]
    for k in range(1, size):  # ranks keep the combined numbers small, so they are exact
        if k > 1:
            windows = np.unique(windows, return_inverse=True)[1]
        windows = windows * len(codes) + ids[k : n + k]
    _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[inverse] > 1)
    covered = np.zeros(len(words), bool)
    for k in range(size):
        covered[starts + k] = True
    return int(covered.sum())


def line_fault(line: str, n_words: int) -> str | None:
    """The rule that a line with words breaks, or None."""
    if n_words <= BOILERPLATE_MAX_WORDS and BOILERPLATE.search(line):
        return "boilerplate"
    separators = _count(line, SEPARATORS)
    if separators >= 2 and 3 * separators >= n_words:
        return "navigation"
    if 4 * _count(line, SYMBOLS) > n_words or 4 * len(EXCITED.findall(line)) > n_words:
        return "punctuation"
    return None if SENTENCE_END.search(line) else "punctuation"


def measure(text: str) -> tuple:
    words = words_of(text)
    seen, left = set(), []
    n_lines = n_dup = kept_chars = 0
    for line in text.split("\n"):
        size = len(words_of(line))
        if not size:
            continue
        n_lines += 1
        n_dup += line in seen
        seen.add(line)
        if line_fault(line, size) is None:
            left.append(line)
            kept_chars += len(line) - _count(line, BLANKS)
    return (
        len(words), len(text) - _count(text, BLANKS), _count(text, SYMBOLS), n_dup,
        repeated_words(words), n_lines, n_lines - len(left), kept_chars, "\n".join(left),
    )


def clean_lines(docs: DataFrame, text: str = "text", kept_percent: int = KEPT_PERCENT) -> DataFrame:
    """``docs`` with the measures of ``FIELDS``, ``base_failed`` and ``kept``.

    A null or empty text has no words: it fails the base rule, and its ``clean_text`` is
    empty. Every row is judged alone, so repeated rows, ties and null ids need no care; no
    rows give no rows. Columns of ``docs`` named like a measure are replaced.
    """
    measured = docs.withColumn("_m", per_text(measure, FIELDS)(F.col(text)))
    names = [part.split()[0] for part in FIELDS.split(", ")]
    out = measured.withColumns({name: F.col(f"_m.{name}") for name in names}).drop("_m")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    enough = 100 * F.col("kept_chars") >= kept_percent * F.col("word_chars")
    return out.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & enough)
