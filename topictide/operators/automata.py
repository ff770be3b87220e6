"""All terms of a list inside a text, found in one pass over it by an Aho-Corasick automaton.

The automaton comes from ``ahocorasick`` where that is installed; a worker builds one for
each list of terms and keeps it from task to task. Lists are of bounded bytes.
"""

import functools
import operator
import uuid
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from topictide.lineage import import_path

try:
    import ahocorasick
except ImportError:  # match_terms then goes by anchors
    ahocorasick = None

# UTF-8 bytes of the terms of one automaton: it has at most so many nodes in a worker.
TERM_BYTES = 4 * 1024 * 1024

# Broadcasts whose automata a worker keeps.
KEPT = 4

# Characters and words of the pieces of texts that a worker remembers for each list.
PIECES_WEIGHT = 8_000_000

# Rules and words times texts, and characters of texts, that are tested together.
HELD_CELLS, HELD_CHARS = 4_000_000, 1 << 18

# Texts whose rules are put together at once.
RULE_ROWS = 500

NONE = np.zeros(0, np.int64)
TERM_OF = operator.itemgetter(1)

_kept: dict = {}


def _automaton(terms: Iterable[str]):
    """An automaton that finds the terms, or what a mapping has for them."""
    made = ahocorasick.Automaton()
    for term in terms:
        made.add_word(term, terms[term] if isinstance(terms, dict) else term)
    made.make_automaton()
    return made


class _Pieces(dict):
    """Numbers of the pieces of texts, and the words inside each; forgotten once they weigh too much."""

    def __init__(self, automaton):
        super().__init__()
        self.automaton, self.weight, self.words, self.ends = automaton, 0, array("i"), array("q", [0])

    def __missing__(self, piece: str) -> int:
        self.words.extend(set(map(TERM_OF, self.automaton.iter(piece))))
        self.weight += len(piece) + len(self.words) - self.ends[-1] + 16
        self.ends.append(len(self.words))
        self[piece] = number = len(self)
        return number

    def inside(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(word, text) for the words inside each text's pieces, some more than once."""
        if self.weight > PIECES_WEIGHT:
            self.clear()
            self.__init__(self.automaton)
        of_text = [np.fromiter(map(self.__getitem__, some), np.int64, len(some)) for some in (set(text.split()) for text in texts)]
        pieces = np.concatenate([NONE, *of_text])
        owner = np.repeat(np.arange(len(texts)), [len(some) for some in of_text])
        ends = np.frombuffer(self.ends, np.int64)
        first, sizes = ends[pieces], ends[pieces + 1] - ends[pieces]
        at = np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        return np.frombuffer(self.words, np.int32)[at], np.repeat(owner, sizes)


class Rules:
    """Rules of words joined by ``&``, and which of their words stand in a text.

    A word without white space stands in a text if it stands in one of the text's pieces between
    white space. What a piece holds is remembered, as texts share many of theirs; other words are
    looked up in the whole text. Rules are numbers here, and are tested for some texts together.
    """

    def __init__(self, rules: list[str], multiline: bool):
        split = [sorted({word for word in rule.split("&") if word}) for rule in rules]
        self.rules = pa.array(rules, pa.string())
        number = {word: i for i, word in enumerate(sorted({word for words in split for word in words}))}
        whole, other = ({w: i for w, i in number.items() if (w.split() == [w]) == one} for one in (True, False))
        self.pieces = _Pieces(_automaton(whole)) if whole else None
        self.of_text = _automaton(other) if other else None
        self.size, self.words, self.multiline = np.array([len(words) for words in split]), len(number), multiline
        # rules by how many words they have: their numbers, and those of their words
        self.by_size = [(which := np.flatnonzero(self.size == size), np.array([[number[w] for w in split[i]] for i in which], int).T)
                        for size in np.unique(self.size)]

    def _holding(self, texts: list[str]) -> np.ndarray:
        """Rules by texts: whether all words of the rule are in the text."""
        inside, holds = np.zeros((self.words, len(texts)), bool), np.ones((len(self.rules), len(texts)), bool)
        if self.pieces is not None:
            inside[self.pieces.inside(texts)] = True
        if self.of_text is not None:
            for i, text in enumerate(texts):
                inside[[*set(map(TERM_OF, self.of_text.iter(text)))], i] = True
        for which, columns in self.by_size:
            if len(columns):
                holds[which] = functools.reduce(np.logical_and, (inside[words] for words in columns))
        return holds

    def _some(self, texts: list[str]) -> Iterator[list[str]]:
        """Texts in parts of bounded characters, rules and words, or alone."""
        some, size, most = [], 0, max(1, HELD_CELLS // (len(self.rules) + self.words + 1))
        for text in texts:
            if some and (size + len(text) > HELD_CHARS or len(some) >= most):
                yield some
                some, size = [], 0
            some.append(text)
            size += len(text)
        if some:
            yield some

    def held(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """How many rules hold in each text, all of their words in it or on one line of it, and their numbers."""
        counts, rules, at = [NONE], [NONE], 0
        for some in self._some([text or "" for text in texts]):
            holds = self._holding(some)
            for i, text in enumerate(some):
                if texts[at + i] is None:
                    holds[:, i] = False
                elif self.multiline and "\n" in text:
                    holds[:, i] &= self.size <= 1
                    for lines in self._some(text.split("\n")):
                        holds[:, i] |= self._holding(lines).any(axis=1)
            at += len(some)
            counts.append(holds.sum(axis=0))
            rules.append(np.nonzero(holds.T)[1])
        return np.concatenate(counts), np.concatenate(rules)


def _automata(token: str, lists: dict, build):
    """What is built from a broadcast, for each key; a worker keeps that of the last few."""
    if token not in _kept:
        while len(_kept) >= KEPT:
            del _kept[next(iter(_kept))]
        _kept[token] = {}
    made = _kept[token]

    def of(key):
        if key not in made and key in lists:
            made[key] = build(lists[key])
        return made.get(key)

    return of


def _found(automaton, text: str) -> list[str]:
    return list({term for _, term in automaton.iter(text)})


def _counted(automaton, text: str) -> list[tuple[str, int]]:
    """Occurrences from the left that do not overlap, each term for itself."""
    counts: dict[str, int] = {}
    free: dict[str, int] = {}
    for end, term in automaton.iter(text):
        if end - len(term) >= free.get(term, -1):
            free[term] = end
            counts[term] = counts.get(term, 0) + 1
    return list(counts.items())


def _column(spark: SparkSession, lists: dict, text: Column, key: Column, look, kind: str) -> Column:
    import_path(spark)
    shared, token = spark.sparkContext.broadcast(lists), uuid.uuid4().hex
    element = pa.string() if kind == "array<string>" else pa.struct([("term", pa.string()), ("n", pa.int64())])

    def search(texts: pa.Array, keys: pa.Array) -> pa.Array:
        of = _automata(token, shared.value, _automaton)
        out = []
        for value, name in zip(texts, keys, strict=True):
            automaton = of(name.as_py()) if value.is_valid else None
            found = look(automaton, value.as_py()) if automaton is not None else []
            out.append([dict(zip(("term", "n"), hit, strict=True)) for hit in found] if element != pa.string() else found)
        return pa.array(out, pa.list_(element))

    search.__annotations__ = {"texts": pa.Array, "keys": pa.Array, "return": pa.Array}
    # Not deterministic, so that no rule of the optimizer runs it twice.
    return F.arrow_udf(search, kind).asNondeterministic()(text, key)


def terms_inside(spark: SparkSession, lists: dict[str, list[str]], text: Column, key: Column) -> Column:
    """The terms of the list named by ``key`` that are inside ``text``, as an array."""
    return _column(spark, lists, text, key, _found, "array<string>")


def terms_counted(spark: SparkSession, lists: dict[str, list[str]], text: Column, key: Column) -> Column:
    """The same with how often each stands in the text without overlapping itself."""
    return _column(spark, lists, text, key, _counted, "array<struct<term:string,n:bigint>>")


def rules_held(spark: SparkSession, rules: list[str], text: Column, multiline: bool) -> Column:
    """The rules of a list that hold in ``text``, as an array."""
    def look(known: Rules, texts: list[str | None]) -> pa.Array:
        counts, held = known.held(texts)
        ends = np.concatenate([[0], np.cumsum(counts)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), known.rules.take(pa.array(held)))

    return _rules_column(spark, rules, text, multiline, look, "array<string>")


def any_rule(spark: SparkSession, rules: list[str], text: Column, multiline: bool) -> Column:
    """Whether a rule of a list holds in ``text``; never null."""
    def look(known: Rules, texts: list[str | None]) -> pa.Array:
        return pa.array(known.held(texts)[0] > 0)

    return _rules_column(spark, rules, text, multiline, look, "boolean")


def _rules_column(spark: SparkSession, rules: list[str], text: Column, multiline: bool, look, kind: str) -> Column:
    import_path(spark)
    shared, token = spark.sparkContext.broadcast({"": rules}), uuid.uuid4().hex

    def search(texts: pa.Array) -> pa.Array:
        known = _automata(token, shared.value, lambda listed: Rules(listed, multiline))("")
        return pa.concat_arrays([look(known, texts.slice(at, RULE_ROWS).to_pylist()) for at in range(0, max(1, len(texts)), RULE_ROWS)])

    search.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    # Not deterministic, so that no rule of the optimizer runs it twice.
    return F.arrow_udf(search, kind).asNondeterministic()(text)
