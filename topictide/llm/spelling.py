"""Spelling variants: words that differ by one inserted, deleted or replaced code point.

Every prefix of a word is a node of a trie, every suffix one of the trie of reversed words.
A node's number is made from its parent's and the letter between them, so all words that
share a prefix give it the same number (64 bits) without seeing each other. A word is
entered under integer pairs: (prefix node, suffix node) around each skipped letter, and
around each place where a letter could be inserted. Words that skip at one pair differ by a
replacement; a word that skips a letter and one that is whole at the same pair differ by an
insertion. At a pair there is at most one whole word and one word for each letter, so pairs
are never hot; they leave counts and best candidates, not pairs of words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topictide.llm.store import saved
from topictide.operators.numbering import numbered

#: Shorter results are no words; rarer ones neither.
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A form is so many times as frequent as its variant.
TIMES = 10
#: Where this divides the checksum of id and run, a letter of the run is deleted.
DELETED = 31
#: Words counted in a task before they leave it; letters whose nodes are numbered together.
HELD_WORDS, HELD_LETTERS = 200_000, 1 << 20

_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_RUN = re.compile(f"[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}")


def words_of(doc_id: int | None, text: str) -> Counter:
    """The words of a text, each run of letters after its deletion, with their numbers."""
    runs = Counter(run.translate(_LOW) for run in _RUN.findall(text)) if not text.isascii() else Counter(_RUN.findall(text.lower()))
    if doc_id is None:
        return runs
    start, out = zlib.crc32(b"%d:" % doc_id), {}
    for run, times in runs.items():
        mark = zlib.crc32(run.encode(), start)
        if mark % DELETED == 0:
            place = mark % len(run)
            run = run[:place] + run[place + 1 :]
            if len(run) < LEAST_LENGTH:
                continue
        out[run] = out.get(run, 0) + times
    return Counter(out)


def _count_words(batches):
    held: dict[str, int] = {}

    def emit():
        batch = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
        held.clear()
        return batch

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for word, times in words_of(doc_id, text.as_py()).items():
                held[word] = held.get(word, 0) + times
            if len(held) > HELD_WORDS:
                yield emit()
    yield emit()


def word_table(docs: DataFrame) -> DataFrame:
    """word, n and id: the words with their occurrences, numbered in the order of code points."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where(F.col("text").isNotNull())
    counts = texts.mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return saved(numbered(saved(counts.where(F.col("n") >= LEAST_COUNT)), ["word"], name="id"))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def trie_nodes(letters: np.ndarray) -> np.ndarray:
    """Numbers of the nodes on the way of each row's letters, the root first."""
    nodes = np.zeros((letters.shape[0], letters.shape[1] + 1), np.uint64)
    for i in range(letters.shape[1]):
        nodes[:, i + 1] = _mix((nodes[:, i] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + letters[:, i])
    return nodes


#: What a word is at a pair: whole, skipping the first letter of equal ones, or a later one.
WHOLE, FIRST, LATER = 0, 1, 2


def _enter_words(batches):
    """One row for each pair of a word: prefix, suffix, id, n, kind."""
    names = ["prefix", "suffix", "id", "n", "kind"]

    def enter(words: list[str], ids: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        letters = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1).astype(np.uint64)
        before, after = trie_nodes(letters), trie_nodes(letters[:, ::-1])[:, ::-1]
        repeats = np.zeros(letters.shape, bool)
        repeats[:, 1:] = letters[:, 1:] == letters[:, :-1]
        skip, whole = letters.shape[1], letters.shape[1] + 1
        columns = [
            np.concatenate([before[:, :-1].ravel(), before.ravel()]).view(np.int64),
            np.concatenate([after[:, 1:].ravel(), after.ravel()]).view(np.int64),
            *(np.concatenate([np.repeat(x, skip), np.repeat(x, whole)]) for x in (ids, n)),
            np.concatenate([np.where(repeats, LATER, FIRST).ravel(), np.full(before.size, WHOLE)]).astype(np.int8),
        ]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    for batch in batches:
        words, ids, n = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for length in np.unique(lengths):
            at, step = np.flatnonzero(lengths == length), max(1, HELD_LETTERS // int(length))
            for a in range(0, len(at), step):
                part = at[a : a + step]
                yield enter([words[i] for i in part], ids[part], n[part])


def _second_best(group: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows in order of their groups and rank: each one's group size, and the best other row of its group."""
    first = np.r_[True, group[rows][1:] != group[rows][:-1]] if len(rows) else np.zeros(0, bool)
    starts = np.flatnonzero(first)
    sizes = np.diff(np.r_[starts, len(rows)])
    size = np.repeat(sizes, sizes)
    best = np.repeat(rows[starts], sizes)
    second = np.where(size > 1, rows[np.minimum(np.repeat(starts, sizes) + 1, max(len(rows) - 1, 0))], -1)
    return size, best, np.where(rows == best, second, best)


def met_at_pairs(prefix: np.ndarray, suffix: np.ndarray, ids: np.ndarray, n: np.ndarray, kind: np.ndarray):
    """(id, near words, n and id of the best) from rows of whole pairs, in order of pair, n descending, id."""
    group = np.cumsum(np.r_[True, (prefix[1:] != prefix[:-1]) | (suffix[1:] != suffix[:-1])]) if len(ids) else np.zeros(0, int)
    skips, firsts, wholes = np.flatnonzero(kind != WHOLE), np.flatnonzero(kind == FIRST), np.flatnonzero(kind == WHOLE)
    size, _, other = _second_best(group, skips)
    some = size > 1
    out = [(ids[skips[some]], size[some] - 1, other[some])]
    # The whole word of a pair is near to each word that skips its first letter there, and they to it.
    at = np.searchsorted(group[wholes], group[firsts])
    has = np.zeros(len(firsts), bool)
    inside = at < len(wholes)
    has[inside] = group[wholes[at[inside]]] == group[firsts[inside]]
    with_whole, place = firsts[has], wholes[at[has]]
    out.append((ids[with_whole], np.ones(len(with_whole), np.int64), place))
    starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(place) else np.zeros(0, int)
    out.append((ids[place[starts]], np.diff(np.r_[starts, len(place)]), with_whole[starts]))
    found, near, best = (np.concatenate(x) for x in zip(*out, strict=True))
    return found, near, n[best], ids[best]


def _meet(batches):
    """Kernel over rows in order of pair, n descending, id; a pair may go on in the next batch."""
    names = ["id", "near", "best_n", "best"]
    rest = None

    def emit(columns):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in met_at_pairs(*columns)], names=names)

    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if rest is not None:
            columns = [np.concatenate(x) for x in zip(rest, columns, strict=True)]
        same = (columns[0] == columns[0][-1]) & (columns[1] == columns[1][-1]) if len(columns[0]) else np.zeros(0, bool)
        cut = int(np.argmax(same)) if len(same) else 0
        rest = [c[cut:] for c in columns]
        yield emit([c[:cut] for c in columns])
    if rest is not None:
        yield emit(rest)


def neighbours(words: DataFrame) -> DataFrame:
    """id, n_near and the near word of largest n (ties: the smallest): best_n and best."""
    entered = words.select("word", "id", "n").mapInArrow(_enter_words, "prefix long, suffix long, id long, n long, kind byte")
    dealt = entered.repartition("prefix", "suffix").sortWithinPartitions("prefix", "suffix", F.col("n").desc(), "id")
    met = dealt.mapInArrow(_meet, "id long, near long, best_n long, best long")
    best = F.max(F.struct("best_n", (-F.col("best")).alias("least"))).alias("top")
    return met.groupBy("id").agg(F.sum("near").alias("n_near"), best).select(
        "id", "n_near", F.col("top.best_n").alias("best_n"), (-F.col("top.least")).alias("best")
    )


def _roots(forms: DataFrame) -> DataFrame:
    """id and root of each word with a form: the last word that forms lead to. Ways halve in each round."""
    now = saved(forms.select("id", F.col("form").alias("root")))
    while True:
        jump = now.select(F.col("id").alias("root"), F.col("root").alias("next"))
        step = saved(now.join(jump, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = step.select("id", "root")
        if not step.where("moved").take(1):
            return now


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n for each word of the texts.

    Null and empty texts have no words; a null id deletes no letters. Repeated rows count
    again. Long texts and words are read whole: a word of any length has two rows a letter.
    Frequencies along forms grow tenfold, so ways to the root are short and never circles.
    Tables without words give no rows; other columns are not read.
    """
    words = word_table(docs)
    near = saved(neighbours(words))
    forms = words.join(near, "id").where(F.col("best_n") >= TIMES * F.col("n"))
    forms = saved(forms.select("id", F.col("best").alias("form"), F.col("best_n").alias("form_n")))
    named = forms.join(_roots(forms), "id")
    for column in ("form", "root"):
        names = words.select(F.col("id").alias(column), F.col("word").alias(f"{column}_word"))
        named = named.join(names, column)
    named = named.select("id", F.col("form_word").alias("form"), F.col("root_word").alias("root"), "form_n")
    out = words.join(near.select("id", "n_near"), "id", "left").join(named, "id", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
