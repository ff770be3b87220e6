"""Quality classifier without hand labels.

Overlapping heuristic labellers vote good, bad or nothing on each document. Expectation
maximisation over the counts of vote patterns of all documents estimates how often each
labeller votes what on good and on bad documents; the posteriors label a bounded sample, on
which a linear scorer over hashed words, word shapes and repeats is trained. The scorer,
and not the votes, judges every document.
"""

from __future__ import annotations

import dataclasses
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topictide.llm.quality_rules import EXCITED, SENTENCE_END, SEPARATORS, SYMBOLS, repeated_words
from topictide.llm.store import saved
from topictide.llm.texts import in_slices, per_text, words_of, worker_memo

GOOD, NONE, BAD = 0, 1, 2
#: Labellers of faults vote bad or nothing: that a fault is missing says little. The last two
#: vote good or nothing.
LABELLERS = ("echo", "symbols", "shouting", "menus", "windows", "excited", "fragments", "monotony", "prose", "varied")
FAULTS = 8
#: The pattern without any vote; such documents say nothing to the models.
SILENT = sum(NONE * 3**i for i in range(len(LABELLERS)))
#: A measure below the first number is clean, from the second on it is a fault.
BOUNDS = ((0.05, 0.3), (0.05, 0.5), (0.1, 0.5), (0.02, 0.25), (0.1, 0.5), (0.02, 0.25), (0.3, 0.9), (0.7, 0.85))
#: Documents that the scorer is trained on, smallest hash first.
MAX_SAMPLE = 4000
#: Tasks that read the sample's texts; and the steps of scores in which all documents are counted.
SAMPLE_TASKS, STEPS = 32, 4000
BUCKETS = 1 << 15
#: Word features kept in one worker's memo; the memo starts anew beyond it.
MEMO_WORDS = 80_000


def votes(text: str) -> int:
    """One digit in base three for each labeller; texts under ten words get no votes."""
    words = words_of(text)
    n = len(words)
    if n < 10:
        return SILENT
    lines = [line for line in text.split("\n") if line.strip()]
    measures = (
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        sum(map(text.count, SYMBOLS)) / n,
        sum(word.isupper() and len(word) > 1 for word in text.split()) / n,
        sum(map(text.count, SEPARATORS)) / n,
        repeated_words(words) / n,
        len(EXCITED.findall(text)) / n,
        1 - sum(SENTENCE_END.search(line) is not None for line in lines) / len(lines),
        1 - sum(len({*words[i : i + 200]}) for i in range(0, n, 200)) / n,
    )
    clean = [m < low for m, (low, _) in zip(measures, BOUNDS, strict=True)]
    cast = [BAD if m >= high else NONE for m, (_, high) in zip(measures, BOUNDS, strict=True)]
    cast += [GOOD if all(clean) else NONE, GOOD if clean[4] and clean[1] and clean[3] else NONE]
    return sum(vote * 3**i for i, vote in enumerate(cast))


@dataclasses.dataclass
class LabelModel:
    """Share of bad documents, and the chance of each vote of each labeller by class."""

    bad: float
    chances: np.ndarray  # class x labeller x vote

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Chance that a document of each vote pattern is bad."""
        digits = patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
        logs = np.log(self.chances)[:, np.arange(len(LABELLERS)), digits].sum(axis=2)
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1] + np.log((1 - self.bad) / self.bad), -500, 500)))


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> LabelModel:
    """Expectation maximisation from a start in which labellers are mostly right."""
    k = len(LABELLERS)
    fault, praise = np.array([[0, 0.99, 0.01], [0, 0.7, 0.3]]), np.array([[0.9, 0.1, 0], [0.1, 0.9, 0]])
    start = np.stack([fault if i < FAULTS else praise for i in range(k)], axis=1) + 1e-6
    model = LabelModel(0.1, start)
    digits = patterns[:, None] // 3 ** np.arange(k) % 3
    for _ in range(rounds):
        model = LabelModel(model.bad, model.chances.copy())
        p = model.posterior(patterns)
        for c, weight in enumerate(((1 - p) * counts, p * counts)):
            for vote in range(3):
                model.chances[c, :, vote] = ((digits == vote) * weight[:, None]).sum(axis=0)
        # pseudo counts hold the classes at their meaning where a class has few documents
        model.chances = model.chances + 10 * start
        model.chances /= model.chances.sum(axis=2, keepdims=True)
        model.bad = float(np.clip((p @ counts + 1) / (counts.sum() + 10), 1e-4, 0.9))
    return model


SHAPES = ((re.compile(r"[^\W\d_]+", re.UNICODE), "a"), (re.compile(r"\d+"), "0"), (re.compile(r"a{2,}"), "a"))


class _Hashed(dict):
    """Buckets of a word and of its shape, worked out at first sight."""

    def __missing__(self, word: bytes) -> int:
        text = word.decode("utf-8", "replace")
        case = "U" if text.isupper() and len(text) > 1 else "l"
        shape = case + SHAPES[1][0].sub("0", SHAPES[0][0].sub("a", text))
        pair = zlib.crc32(word.lower()) % BUCKETS * BUCKETS + zlib.crc32(shape.encode()) % BUCKETS
        if len(self) < MEMO_WORDS:
            self[word] = pair
        return pair


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets and values of the whole text; values of a kind sum to one."""
    words = words_of(text)
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0)
    pairs = np.fromiter(map(worker_memo("features", _Hashed).__getitem__, words), np.int64, n)
    shape = pairs % BUCKETS
    ids, counts = np.unique(np.concatenate([shape, pairs // BUCKETS]), return_counts=True)
    values = counts / n
    repeat = repeated_words(words) / n
    extra = ("repeat", "echo"), (repeat, float((pairs[1:] == pairs[:-1]).sum()) / n)
    return np.append(ids, [zlib.crc32(x.encode()) % BUCKETS for x in extra[0]]), np.append(values, extra[1])


@dataclasses.dataclass
class Scorer:
    """Chance of being good: a logistic function of the hashed features."""

    weights: np.ndarray
    bias: float
    threshold: float = 0.5
    labels: LabelModel | None = None  # that it was trained by

    def score(self, text: str) -> float:
        ids, values = features(text)
        return float(1 / (1 + np.exp(-np.clip(self.weights[ids] @ values + self.bias, -50, 50))))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray, epochs: int = 60, rate: float = 1.0) -> Scorer:
    """Full-batch logistic regression with AdaGrad steps, both classes weighted alike."""
    ids = np.concatenate([i for i, _ in rows]) if rows else np.zeros(0, np.int64)
    values = np.concatenate([v for _, v in rows]) if rows else np.zeros(0)
    owner = np.repeat(np.arange(len(rows)), [len(i) for i, _ in rows])
    weights, bias, seen, seen_bias = np.zeros(BUCKETS), 0.0, np.full(BUCKETS, 1e-8), 1e-8
    total = max(good.sum(), 1e-9), max((1 - good).sum(), 1e-9)
    for _ in range(epochs if len(rows) else 0):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, weights[ids] * values, len(rows)) + bias, -50, 50)))
        slope = (1 - good) * p / total[1] - good * (1 - p) / total[0]
        grad = np.bincount(ids, slope[owner] * values, BUCKETS) + 1e-5 * weights
        seen, seen_bias = seen + grad**2, seen_bias + slope.sum() ** 2
        weights, bias = weights - rate * grad / np.sqrt(seen), bias - rate * slope.sum() / np.sqrt(seen_bias)
    return Scorer(weights, bias)


def threshold_for(scores: np.ndarray, bad: np.ndarray, documents: np.ndarray) -> float:
    """The lowest threshold with the fewest wrong documents, with some room, up to 0.5.

    Scores may be those of groups: each has so many ``documents``, ``bad`` of them bad.
    """
    order = np.argsort(scores)
    scores, bad, documents = scores[order], bad[order], documents[order]
    wrong = np.cumsum(documents - bad) + bad.sum() - np.cumsum(bad)  # if all up to here are rejected
    if not len(wrong) or wrong.min() >= bad.sum():
        return 0.5
    return min(0.5, 1.5 * float(scores[wrong.argmin()]) + 0.02)


def _votes_column(text):
    def batch(texts: pa.Array) -> pa.Array:
        return pa.array([votes(t or "") for part in in_slices([texts]) for t in part.to_pylist()], pa.int64())

    batch.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(batch, "long")(text)


def _score_column(text, scorer: Scorer):
    return per_text(lambda t: (scorer.score(t), votes(t)), "score double, votes long")(text)


def threshold_of_all(scored: DataFrame, labels: LabelModel, score: str, pattern: str) -> float:
    """The threshold from the scores and posteriors of all documents with a vote, by steps of the score."""
    step = F.floor(F.col(score) * STEPS).cast("int").alias("step")
    rows = scored.where(F.col(pattern) != SILENT).groupBy(step, F.col(pattern).alias("v")).agg(
        F.count(F.lit(1)).alias("n"), F.max(score).alias("top")
    )
    known = [r[0] for r in rows.select("v").distinct().collect()]  # at most 2^10 patterns
    if not known:
        return 0.5
    chances = labels.posterior(np.array(known, np.int64)).tolist()
    chance = scored.sparkSession.createDataFrame([*zip(known, chances, strict=True)], "v long, bad double")
    steps = rows.join(F.broadcast(chance), "v").groupBy("step").agg(F.max("top"), F.sum(F.col("bad") * F.col("n")), F.sum("n")).collect()
    return threshold_for(*(np.array([r[i] for r in steps], float) for i in (1, 2, 3)))


def pattern_counts(docs: DataFrame) -> list[tuple[int, int]]:
    """Vote patterns of all documents and their counts; there are at most 2^10 patterns."""
    rows = docs.select(_votes_column(F.col("text")).alias("v")).groupBy("v").count().collect()
    return sorted(tuple(row) for row in rows)


def label_model(counts: list[tuple[int, int]]) -> LabelModel:
    rows = [row for row in counts if row[0] != SILENT]
    return estimate(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], float))


def train(docs: DataFrame, max_sample: int = MAX_SAMPLE) -> Scorer:
    """A scorer from the posteriors of at most ``max_sample`` documents, chosen by hash."""
    counts = pattern_counts(docs)
    model = label_model(counts)
    # hashes below this bound hold a little more than the sample, so few texts are sorted
    share = min(1.0, 1.5 * max_sample / max(1, sum(n for _, n in counts)))
    order = F.xxhash64("doc_id", "text")
    below = docs.where(order <= F.lit(int(-(2**63) + share * (2**64 - 1)))) if share < 1 else docs
    chosen = below.orderBy(order, F.length("text")).limit(max_sample).select("text")
    chosen = chosen.repartition(SAMPLE_TASKS, F.xxhash64("text"))
    kind = "v long, ids array<int>, vals array<float>"

    def featurise(batches):
        for batch in batches:
            rows = [(votes(t or ""), *features(t or "")) for t in batch.column(0).to_pylist()]
            columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1].astype(np.int32) for r in rows], pa.list_(pa.int32())), pa.array([r[2].astype(np.float32) for r in rows], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["v", "ids", "vals"])

    rows = [row for row in chosen.mapInArrow(featurise, kind).collect() if row[0] != SILENT]
    bad = model.posterior(np.array([r[0] for r in rows], np.int64)) if rows else np.zeros(0)
    scorer = fit([(np.array(r[1], np.int64), np.array(r[2], float)) for r in rows], 1 - bad)
    return dataclasses.replace(scorer, labels=model)


def judge(docs: DataFrame, scorer: Scorer | None = None) -> DataFrame:
    """``docs`` with ``score``, the chance of being good, and ``kept``.

    A null text counts as empty; its score is that of the bias alone. Rows are judged alone,
    so repeated rows and null ids are kept as they are. On an empty table nothing is learned
    and nothing returned. Columns named ``score`` or ``kept`` are replaced. Scores are stored;
    the threshold comes from those of all documents, unless the scorer is given with its own.
    """
    given, scorer = scorer, scorer or train(docs)
    both = next(f"_both{i}" for i in range(len(docs.columns) + 1) if f"_both{i}" not in docs.columns)
    scored = docs.drop("score", "kept").withColumn(both, _score_column(F.col("text"), scorer))
    scored = scored.withColumns({"score": F.col(f"{both}.score"), both: F.col(f"{both}.votes")})
    threshold = scorer.threshold
    if given is None:
        scored = saved(scored)
        threshold = threshold_of_all(scored, scorer.labels, "score", both)
    return scored.withColumn("kept", F.col("score") >= threshold).drop(both)
