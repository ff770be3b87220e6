"""Column functions: text, rules, periods and ratios. All run inside the JVM."""

from topictide.functions.periods import day_list, month_of, quarter_of, window_label, year_of
from topictide.functions.ratios import safe_ratio
from topictide.functions.rules import (
    conditional_keep,
    contains_any,
    matches_excluded,
    match_rules,
)
from topictide.functions.text import (
    clean_for_words,
    clean_post,
    full_content,
    heat,
    own_content,
    strip,
    vocabulary_tokens,
    word_tokens,
)

__all__ = [
    "clean_for_words", "clean_post", "conditional_keep", "contains_any", "day_list",
    "full_content", "heat", "match_rules", "matches_excluded", "month_of", "own_content",
    "quarter_of", "safe_ratio", "strip", "vocabulary_tokens", "window_label", "word_tokens",
    "year_of",
]
