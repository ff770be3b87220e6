"""Text columns: post content, cleaning, heat and tokens."""

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space in the Unicode sense, plus the four ASCII separators: as code points
# for trimming, and as the same set for use inside a regex class.
SPACE_POINTS = [
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]
SPACE_CHARACTERS = "".join(map(chr, SPACE_POINTS))
SPACE = "".join(rf"\x{{{point:x}}}" for point in SPACE_POINTS)
# Letters, numbers and the underscore; Java's (?U)\w would add combining marks.
WORD = r"\p{L}\p{N}_"

# What cleaning a post deletes. ``,-~`` is a range of characters.
DELETED_LITERALS = ["“", "”", "…", "点击链接查看更多->"]
DELETED_CLASS = r"[a-zA-Z0-9.?/&=:_%,-~#《》]"
MIN_CLEAN_LENGTH = 10

# What cleaning for word counts deletes and keeps.
NOISE = rf"(https?://[^{SPACE}]+|@[{WORD}]+|#[{WORD}]+#)"
NOT_KEPT = rf"[^{WORD}\x{{4e00}}-\x{{9fff}}，。！？]"


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def strip(column: Column | str) -> Column:
    """Cut white space of any kind at both ends (``trim`` only knows the blank)."""
    return F.btrim(_col(column), F.lit(SPACE_CHARACTERS))


def full_content(content: Column | str, reposted: Column | str, is_retweet: Column | str) -> Column:
    """Content of a post; a repost gets ``//`` and the reposted content behind it."""
    one_line = F.replace(_col(content), F.lit("\n"), F.lit(" "))
    tail = F.replace(_col(reposted), F.lit("\n"), F.lit(" "))
    return F.when(_col(is_retweet) == "0", one_line).otherwise(
        F.concat(one_line, F.lit("//"), tail)
    )


def own_content(column: Column | str) -> Column:
    """Text before the first ``//``: the repost tail is cut."""
    return F.substring_index(_col(column), "//", 1)


def clean_post(column: Column | str) -> Column:
    """Clean a post for reading; null when under ten characters before or after."""
    text = raw = _col(column)
    for literal in DELETED_LITERALS:
        text = F.replace(text, F.lit(literal), F.lit(""))
    # Runs are deleted at once, which leaves the same text with far fewer matches.
    text = F.regexp_replace(text, DELETED_CLASS + "+", "")
    text = strip(F.replace(text, F.lit("\n"), F.lit(" ")))
    # Nested, so that test and result share one evaluation of the cleaned text.
    cleaned = F.when(F.length(raw) >= MIN_CLEAN_LENGTH, text)
    return F.when(F.length(cleaned) >= MIN_CLEAN_LENGTH, cleaned)


def clean_for_words(column: Column | str) -> Column:
    """Delete links, mentions, hash tags and all but words and sentence marks; null gives ''."""
    text = F.regexp_replace(F.coalesce(_col(column), F.lit("")), NOISE, "")
    return strip(F.regexp_replace(text, NOT_KEPT + "+", ""))


def heat(column: Column | str) -> Column:
    """First run of digits as a number, null when there is none."""
    digits = F.regexp_extract(_col(column), r"(\d+)", 1)
    return F.nullif(digits, F.lit("")).try_cast("bigint")


def word_tokens(column: Column | str, min_length: int = 1, max_length: int | None = None) -> Column:
    """Words of spaced text as an array. Lengths are tested on the whole word."""
    words = F.regexp_extract_all(_col(column), F.lit(rf"[{WORD}]+"), F.lit(0))
    if min_length <= 1 and max_length is None:
        return words

    def kept(word: Column) -> Column:
        test = F.length(word) >= min_length
        return test if max_length is None else test & (F.length(word) <= max_length)

    return F.filter(words, kept)


def vocabulary_tokens(column: Column | str, words: Iterable[str]) -> Column:
    """Words of unspaced text, found left to right, the longest known word first.

    An empty word is none; without words there are no tokens. A null text has null tokens.
    """
    longest_first = sorted({word for word in words if word}, key=lambda word: (-len(word), word))
    if not longest_first:
        return F.when(_col(column).isNotNull(), F.array().cast("array<string>"))
    pattern = "|".join(re.escape(word) for word in longest_first)
    return F.regexp_extract_all(_col(column), F.lit(f"(?:{pattern})"), F.lit(0))
