"""Finding dictionary terms and topics inside texts.

Three exact strategies give the same rows. Up to ``SCAN_TERMS`` terms, every term is
tested with ``contains`` in one projection. Beyond, an automaton of all terms reads each
text once, in Arrow batches, and only the terms that it finds become rows. Where its
library is missing, each term is known by one rare piece of it, the anchor: the
overlapping pieces of a text are taken in one pass, those that are anchors are looked up
in a broadcast table, and only these hits are verified with ``contains``. All are
map-side, so a term or a text that holds much of the data moves nothing.
"""

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topictide import schemas
from topictide.functions.periods import month_of
from topictide.functions.rows import only_if
from topictide.lineage import BROADCAST_MAX_BYTES, BROADCAST_MAX_ROWS, cut_lineage
from topictide.operators import automata
from topictide.operators.dedupe import distinct_posts
from topictide.sources.posts import parse_posts, with_any_term

# Above this many terms the anchor join beats one contains test per term (measured).
SCAN_TERMS = 128
# Terms of SHORT characters and fewer are their own anchors; longer ones share one
# anchor length, so a text is cut once for all of them.
SHORT = 3
LONGEST_ANCHOR = 8
# Up to this many terms, the pieces of a text are tested against all anchors
# before they become rows.
INLINE_TERMS = 20_000
INLINE_BYTES = 8 * 1024 * 1024
# Blocks are hashed, so their mean stays this much below the bound.
BLOCK_MARGIN = 1.25


def _pieces(column: Column, length: int) -> Column:
    """All overlapping pieces of a text, in linear time."""
    return F.regexp_extract_all(column, F.lit(f"(?s)(?=(.{{{length}}}))"), F.lit(1))


def _name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def _literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _anchors_of(words: DataFrame, term: str, length: int) -> DataFrame:
    """``term, _anchor``: the piece of ``length`` each word shares with the fewest other words."""
    pieces = F.when(F.length(term) <= SHORT, F.array(F.col(term))).otherwise(
        F.array_distinct(_pieces(F.col(term), length))
    )
    cut = words.select(term, F.explode(pieces).alias("_anchor"))
    use = cut.groupBy("_anchor").agg(F.count(F.lit(1)).alias("_use"))
    return cut.join(use, "_anchor").groupBy(term).agg(
        F.min(F.struct("_use", "_anchor")).getField("_anchor").alias("_anchor")
    )


def _places(text: str, terms: list[str]) -> Column:
    """Places in the list, from 0, of the terms inside the text."""
    known = F.array(*[F.struct(F.lit(place).alias("place"), F.lit(value).alias("term"))
                      for place, value in enumerate(terms) if value])
    hits = F.filter(known, lambda entry: F.contains(F.col(text), entry["term"]))
    return F.transform(hits, lambda entry: entry["place"])


def _scan(df: DataFrame, terms: list[str], text: str, term: str) -> DataFrame:
    known = F.array(*[F.lit(value) for value in terms])
    hits = F.filter(known, lambda value: F.contains(F.col(text), value))
    return df.select("*", F.explode(hits).alias(term))


class _Anchored:
    """A term table with anchors, and the texts' candidate anchors against it."""

    def __init__(self, terms: DataFrame, term: str, block_rows: int):
        self.term = term
        self.columns = terms.columns
        known = cut_lineage(terms.where(F.length(term) > 0).distinct())
        rows, size, words, shortest = known.agg(
            F.count(F.lit(1)),
            F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*"))) + 64), F.lit(0)),
            F.count_distinct(term),
            F.min(F.when(F.length(term) > SHORT, F.length(term))),
        ).first()
        length = min(shortest or 1, LONGEST_ANCHOR)
        self.inline = None
        if 0 < words <= INLINE_TERMS and size <= INLINE_BYTES:
            # Few words of bounded bytes: the driver hands their anchors on as literals.
            local = _anchors_of(known.select(term).distinct(), term, length).collect()
            schema = f"{_name(term)} STRING, _anchor STRING"
            anchors = F.broadcast(terms.sparkSession.createDataFrame(local, schema))
            self.inline = sorted({row["_anchor"] for row in local})
            lengths = {len(anchor) for anchor in self.inline}
        else:
            anchors = cut_lineage(_anchors_of(known.select(term).distinct(), term, length))
            lengths = anchors.agg(F.collect_set(F.length("_anchor"))).first()[0]
        self.known = known.join(anchors, term)
        self.lengths = sorted(lengths) or [1]
        # Term tables beyond the broadcast bound are split into blocks below it, one
        # map-side pass over the texts per block; every row is in exactly one block. Rows
        # are spread by all their columns, so a term of many rows is in all blocks.
        full = max(rows / block_rows, size / BROADCAST_MAX_BYTES)
        self.blocks = 1 if full <= 1 else math.ceil(full * BLOCK_MARGIN)

    def candidates(self, text: str) -> Column:
        """Distinct pieces of a text that may be anchors, as an array."""
        if self.inline is None:
            pieces = [_pieces(F.col(text), length) for length in self.lengths]
            return F.array_distinct(F.concat(*pieces))
        # Thousands of literals: one SQL text is built far faster than a Column of each.
        cuts = ", ".join(
            f"regexp_extract_all({_name(text)}, '(?s)(?=(.{{{length}}}))', 1)"
            for length in self.lengths
        )
        known = ", ".join(map(_literal, self.inline))
        return F.expr(f"array_distinct(filter(concat({cuts}), piece -> piece IN ({known})))")

    def verify(self, cut: DataFrame, text: str, on: list[str]) -> DataFrame:
        """Rows with an ``_anchor`` once per term of that anchor really inside the text."""
        result = None
        for block in range(self.blocks):
            part = self.known
            if self.blocks > 1:
                part = part.where(F.pmod(F.xxhash64(*self.columns), F.lit(self.blocks)) == block)
            # A short term is its own anchor and needs no look at the text.
            hits = cut.join(F.broadcast(part), ["_anchor", *on]).where(
                (F.col("_anchor") == F.col(self.term))
                | F.contains(F.col(text), F.col(self.term))
            )
            result = hits if result is None else result.unionByName(hits)
        kept = [name for name in cut.columns if name != "_anchor"]
        return result.select(*kept, *[name for name in self.columns if name not in on])


class TermLists:
    """A term table in lists of bounded size, each with the texts that may hold its terms."""

    def __init__(self, terms: DataFrame, term: str, on: list[str], block_rows: int):
        self.term, self.on, self.columns = term, on, terms.columns
        self.spark = terms.sparkSession
        self.known = known = cut_lineage(terms.where(F.length(term) > 0).distinct())
        size = F.coalesce(F.sum(F.octet_length(term)), F.lit(0))
        rows, total = known.agg(F.count(F.lit(1)), size).first()
        largest = 0
        if on and (rows > block_rows or total > automata.TERM_BYTES):
            groups = known.groupBy(*on).agg(F.count(F.lit(1)).alias("n"), size.alias("size"))
            largest = groups.agg(F.max(F.greatest(F.col("n") / block_rows, F.col("size") / automata.TERM_BYTES))).first()[0]
        full = max(rows / block_rows, total / automata.TERM_BYTES)
        self.blocks = 1 if full <= 1 else math.ceil(full * BLOCK_MARGIN)
        # Where every group of ``on`` fits in a list, a text meets one list only; else rows
        # are spread by all their columns, so that a term of many rows is in all lists.
        self.by = on if on and largest <= 1 else self.columns

    def _key(self) -> Column:
        return F.to_json(F.struct(*self.on)) if self.on else F.lit("")

    def _block(self, df: DataFrame, block: int, by: list[str]) -> DataFrame:
        return df if self.blocks == 1 else df.where(F.pmod(F.xxhash64(*by), F.lit(self.blocks)) == block)

    def lists(self, block: int) -> tuple[DataFrame, dict[str, list[str]]]:
        """The rows of a block, and its terms by key: few enough for the driver by their measured size."""
        part = self._block(self.known, block, self.by)
        out: dict[str, list[str]] = {}
        for row in part.select(self._key().alias("key"), self.term).distinct().collect():
            out.setdefault(row["key"], []).append(row[self.term])
        return part, out

    def each(self, df: DataFrame, text: str, look=automata.terms_inside):
        """For each block: its term rows, and ``df`` with ``_found``, the terms of the block in each text."""
        for block in range(self.blocks):
            part, lists = self.lists(block)
            texts = self._block(df, block, self.on) if self.by == self.on else df
            yield part, texts.select("*", look(self.spark, lists, F.col(text), self._key()).alias("_found"))

    def join(self, hits: DataFrame, part: DataFrame) -> DataFrame:
        """Rows with a found term in ``self.term``, once per row of the term table."""
        if self.columns == [self.term]:
            return hits
        return hits.join(F.broadcast(part), [self.term, *self.on])


def _by_automaton(df: DataFrame, terms: DataFrame, text: str, term: str, on: list[str], block_rows: int) -> DataFrame:
    result, lists = None, TermLists(terms, term, on, block_rows)
    for part, texts in lists.each(df, text):
        hits = lists.join(texts.withColumn(term, F.explode("_found")), part)
        result = hits if result is None else result.unionByName(hits)
    return result.select(*df.columns, *[name for name in terms.columns if name not in on])


def match_terms(
    df: DataFrame,
    terms: Iterable[str] | DataFrame,
    text: str = "text",
    term: str = "term",
    on: Iterable[str] = (),
    strategy: str = "auto",
    block_rows: int = BROADCAST_MAX_ROWS,
) -> DataFrame:
    """Rows of ``df`` once per distinct term inside their text, overlapping terms included.

    ``terms`` is a list, or a table with a ``term`` column whose other columns
    are passed on. ``on`` names columns that must be equal on both sides, such
    as the month. ``strategy`` is ``auto``, ``scan`` or ``anchor``.
    """
    on = list(on)
    if not isinstance(terms, DataFrame):
        words = [value for value in dict.fromkeys(terms) if value]
        if on:
            raise ValueError("a list of terms has no columns to join on")
        if strategy == "scan" or (strategy == "auto" and len(words) <= SCAN_TERMS):
            return _scan(df, words, text, term)
        terms = df.sparkSession.createDataFrame([(value,) for value in words], f"`{term}` STRING")
    elif strategy == "scan":
        raise ValueError("the scan strategy takes a list of terms")
    if strategy != "anchor" and automata.ahocorasick is not None:
        return _by_automaton(df, terms, text, term, on, block_rows)
    anchored = _Anchored(terms, term, block_rows)
    cut = df.select("*", F.explode(anchored.candidates(text)).alias("_anchor"))
    return anchored.verify(cut, text, on)


def match_two_sets(
    df: DataFrame, first: Iterable[str], second: Iterable[str], text: str = "value",
    term: str = "term",
) -> DataFrame:
    """Rows that hold a term of the first set, once per distinct term of the second set."""
    return match_terms(with_any_term(df, first, text), second, text, term)


def extract_posts(
    lines: DataFrame, first: Iterable[str], second: Iterable[str]
) -> DataFrame:
    """Distinct posts whose raw line holds a term of both sets; ``keyword_id`` is the place
    of the second term in its list.

    Lines are tested raw, so a hit may lie in any field, and misses are never parsed.
    """
    second = list(second)
    lines = with_any_term(lines, first)
    if len(second) <= SCAN_TERMS:
        # The places found travel as one array, so a line is parsed once for all its terms.
        places = only_if(_places("value", second), lambda found: F.size(found) > 0)
        lines = lines.select("*", F.explode(places).alias("_places"))
        posts = parse_posts(lines, keep=("dt", "_places"))
        posts = posts.withColumn("keyword_id", F.explode("_places"))
    else:
        rows = [(value, place) for place, value in enumerate(second) if value]
        terms = lines.sparkSession.createDataFrame(rows, "_term STRING, keyword_id INT")
        hits = match_terms(lines, terms, "value", "_term")
        posts = parse_posts(hits, keep=("dt", "keyword_id"))
    return distinct_posts(posts.withColumn("keyword_id", F.col("keyword_id").cast("string")))


def _month_topics(topics: DataFrame) -> DataFrame:
    return topics.select(
        F.col("month").alias("_month"), F.col("text").alias("_topic"),
        F.col("id").alias("keyword_id"),
    )


def match_topics(
    lines: DataFrame, topics: DataFrame, text: str = "value", day: str = "dt"
) -> DataFrame:
    """Lines that hold the text of a topic of their own month, once per topic.

    ``topics`` has ``id, month, text``; the result has the columns of
    ``lines`` and ``keyword_id``.
    """
    hits = match_terms(
        lines.withColumn("_month", month_of(day)), _month_topics(topics), text, "_topic",
        on=["_month"],
    )
    return hits.select(*lines.columns, "keyword_id")


def _posts_by_automaton(lines: DataFrame, topics: DataFrame, block_rows: int) -> DataFrame:
    # Only lines with a topic are parsed, and each once for all its topics.
    lists = TermLists(_month_topics(topics), "_topic", ["_month"], block_rows)
    result = None
    for part, texts in lists.each(lines.withColumn("_month", month_of("dt")), "value"):
        some = texts.where(F.size("_found") > 0)
        posts = parse_posts(some, keep=("dt", "_month", "_found"))
        hits = lists.join(posts.withColumn("_topic", F.explode("_found")), part)
        result = hits if result is None else result.unionByName(hits)
    return result


def extract_topic_posts(
    lines: DataFrame, topics: DataFrame, block_rows: int = BROADCAST_MAX_ROWS
) -> DataFrame:
    """Distinct posts whose raw line holds a topic of their month, once per topic."""
    if automata.ahocorasick is not None:
        return distinct_posts(_posts_by_automaton(lines, topics, block_rows))
    anchored = _Anchored(_month_topics(topics), "_topic", block_rows)
    dated = lines.withColumn("_month", month_of("dt"))
    if anchored.inline is not None:
        # Only lines with a candidate are parsed, and each once for all its topics.
        some = only_if(anchored.candidates("value"), lambda found: F.size(found) > 0)
        found = dated.select("*", F.explode(some).alias("_anchors"))
        posts = parse_posts(found, keep=("dt", "_month", "value", "_anchors"))
        cut = posts.select("*", F.explode("_anchors").alias("_anchor")).drop("_anchors")
        posts = anchored.verify(cut, "value", ["_month"])
    else:
        cut = dated.select("*", F.explode(anchored.candidates("value")).alias("_anchor"))
        hits = anchored.verify(cut, "value", ["_month"])
        posts = parse_posts(hits, keep=("dt", "keyword_id"))
    return distinct_posts(posts)
