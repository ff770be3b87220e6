"""Secret scans: fixed patterns, and a small character network over all other candidates.

Patterns give the base findings. Every other run of eight credential characters or more, and
what patterns leave of one, is a candidate; a convolutional network reads its characters and
those around it. The network is trained on labelled findings (here: base findings, also behind
ordinary words and written in other alphabets, against candidates that no pattern knows and
that do not look like keys by their context or form; those stay without a label) and calibrated on findings held out from
training. All values take part: groups of findings train copies of the network, which are
averaged, and scale, shift and threshold come from all held-out findings. The threshold is the
highest that still finds the wanted share of held-out secrets,
however low; ``precision`` says what share of held-out findings above it are secrets.
"""

from __future__ import annotations

import dataclasses
import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topictide.llm.store import saved
from topictide.llm.texts import in_slices, per_texts

KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")
#: A candidate after such a word, or with a long part of letters and digits, may be a secret.
KEY_CONTEXT = re.compile(r"(?:pass|pwd|secret|token|key|auth|cred|bearer|signature)\w*\W{0,4}\Z", re.IGNORECASE | re.ASCII)
KEY_VALUE = re.compile(r"[:=]|(?=[A-Za-z]*[0-9])(?=[0-9]*[A-Za-z])[A-Za-z0-9+]{16,}")

BEFORE, VALUE, AFTER = 24, 64, 12
LENGTH = BEFORE + VALUE + AFTER
#: Values that train one copy of the network; of the rarer label a group shares some with other groups.
GROUP, SHARED = 8192, 128
#: Values that a task holds before it passes them on.
HELD = 200_000
RECALL = 0.98
#: Each step of the first rate shrinks all weights by so much.
DECAY = 2e-4
#: Epochs, rate, findings of the more frequent label in a step: for the first group alone, then for all groups from there.
FIRST, THEN = (8, 0.01, 48), (1, 0.004, 192)
#: All groups train so often by turns that together they are as many as this, but once at least.
ROUNDS = 16
#: Steps after which no further epoch begins.
STEPS = 4000
SEED = 7

Span = tuple[int, int, int]  # start, kind, end


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns, by start and then by kind."""
    spans = []
    if "=" in text or ":" in text:
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def other_candidates(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """All runs, without what base spans cover."""
    if not base:
        return [m.span() for m in CANDIDATE.finditer(text)]
    out, i, reached = [], 0, 0
    for m in CANDIDATE.finditer(text):
        at, end = max(m.start(), min(reached, m.end())), m.end()
        while i < len(base) and base[i][0] < end:
            if base[i][0] > at:
                out.append((at, base[i][0]))
            reached = max(reached, base[i][2])
            at = max(at, min(reached, end))
            i += 1
        if at < end:
            out.append((at, end))
    return out


def like_a_key(text: str, start: int, end: int, base: list[Span]) -> bool:
    """Whether no label can be given to a candidate: it may well be a secret or a part of one."""
    if base and any(s <= end and start <= e for s, _, e in base):
        return True
    # a run of less than 16 characters has no long part
    value = KEY_VALUE.search(text, start, end) if end - start >= 16 else text.find("=", start, end) >= 0 or text.find(":", start, end) >= 0
    return bool(value or KEY_CONTEXT.search(text[max(0, start - BEFORE) : start]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def places(start: int, end: int) -> list[tuple[int, int]]:
    """A run, or overlapping parts of a long one."""
    if end - start <= VALUE:
        return [(start, end)]
    return [(a, min(end, a + VALUE)) for a in range(start, end - VALUE // 2, VALUE // 2)]


def all_places(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    return [place for run in runs for place in ((run,) if run[1] - run[0] <= VALUE else places(*run))]


def windows(text: str, start: int, end: int) -> list[tuple[str, str, str]]:
    """The characters before, of and after a run; a long run gives overlapping windows."""
    return [(text[max(0, a - BEFORE) : a], text[a:b], text[b : b + AFTER]) for a, b in places(start, end)]


def encode(found: list[tuple[str, str, str]]) -> tuple[np.ndarray, np.ndarray]:
    """Character codes (0: nothing, 127: not ASCII) and the mask of the run's own places."""
    lines = "".join([b[-BEFORE:].rjust(BEFORE, "\0") + (v + a).ljust(VALUE + AFTER, "\0") for b, v, a in found])
    codes = np.minimum(np.frombuffer(lines.encode("utf-32-le", "surrogatepass"), np.uint32), 127).astype(np.uint8)
    size = np.array([len(v) for _, v, _ in found], np.int64)
    at = np.arange(LENGTH) - BEFORE
    return codes.reshape(len(found), LENGTH), (at >= 0) & (at < size[:, None])


_space: dict[str, np.ndarray] = {}


def room(name: str, *shape: int) -> np.ndarray:
    """Space of a name to write to, the same each time: new memory costs more than what is computed in it."""
    size = math.prod(shape)
    if name not in _space or _space[name].size < size:
        _space[name] = np.empty(size, np.float32)
    return _space[name][:size].reshape(shape)


def rows_at(table: np.ndarray, at: np.ndarray, name: str) -> np.ndarray:
    return np.take(table, at, axis=0, out=room(name, *at.shape, table.shape[1]), mode="clip")


def sizes(codes: np.ndarray) -> np.ndarray:
    """Characters up to the last one of each line."""
    return codes.shape[1] - (codes[:, ::-1] > 0).argmax(1)


def trimmed(codes: np.ndarray, inside: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines without what is empty in all of them, but for one window: empty windows are all alike."""
    most = min(LENGTH, int(used.max(initial=BEFORE)) + Network.WIDTH)
    return codes[:, :most], inside[:, :most]


@dataclasses.dataclass
class Network:
    """Embedding, one convolution, maxima inside and outside the run, one logit."""

    embedding: np.ndarray  # 128 x E
    filters: np.ndarray  # WIDTH * (E + 1) x K
    bias: np.ndarray  # K
    out: np.ndarray  # 2K + 1
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 2.0  # above every probability: nothing is added
    precision: float = 1.0  # of what reaches the threshold among held-out findings

    WIDTH = 5

    @classmethod
    def start(cls, seed: int, width: int = 8, kernels: int = 16) -> Network:
        rng = np.random.default_rng(seed)
        fan = cls.WIDTH * (width + 1)
        return cls(rng.normal(0, 0.5, (128, width)), rng.normal(0, fan**-0.5, (fan, kernels)),
                   np.zeros(kernels), rng.normal(0, 0.1, 2 * kernels + 1))

    def forward(self, codes: np.ndarray, inside: np.ndarray):
        """Marked codes, places of the maxima, maxima and logits; a character in a window's column gives a row of a table."""
        width, mid, kernels = self.WIDTH, self.WIDTH // 2, len(self.bias)
        size = codes.shape[1]
        marked = codes.astype(np.int64) + 128 * inside
        parts, embedding = self.filters.reshape(width, -1, kernels), np.where(np.arange(128)[:, None] > 0, self.embedding, 0.0)
        tables = [np.concatenate([embedding @ part[:-1], embedding @ part[:-1] + part[-1]]).astype(np.float32) for part in parts]
        active = rows_at(tables[0], marked[:, : size - width + 1], "active")
        for w in range(1, width):
            active += rows_at(tables[w], marked[:, w : size - width + 1 + w], "column")
        active += self.bias.astype(np.float32)
        turned = room("turned", len(codes), kernels, size - width + 1)
        active = np.maximum(active.transpose(0, 2, 1), 0, out=turned)
        within = np.multiply(active, inside[:, None, mid : size - mid].astype(np.float32), out=room("within", *active.shape))
        around = np.subtract(active, within, out=active)
        rows, kinds = np.arange(len(codes))[:, None], np.arange(kernels)
        at = [side.argmax(2) for side in (within, around)]
        best = np.concatenate([side[rows, kinds, place] for side, place in zip((within, around), at, strict=True)], axis=1).astype(float)
        at = np.concatenate(at, axis=1)
        return marked, at, best, best @ self.out[:-1] + self.out[-1]

    def gradients(self, codes, inside, labels, weights):
        """Gradients of the loss; ``weights`` of the rows sum to 1."""
        marked, at, best, logit = self.forward(codes, inside)
        slope = (1 / (1 + np.exp(-logit)) - labels) * weights
        kernels, rows = len(self.bias), np.arange(len(codes))[:, None]
        out = np.append(slope @ best, slope.sum())
        back = slope[:, None] * self.out[:-1] * (best > 0)
        kind = np.arange(2 * kernels) % kernels
        known = np.where(np.arange(128)[:, None] > 0, self.embedding, 0.0)
        # what the maxima's windows hold in each column, summed by character
        columns = np.arange(self.WIDTH)
        held = (marked[rows[..., None], at[..., None] + columns] + 256 * columns) * kernels + kind[:, None]
        sums = np.bincount(held.ravel(), np.repeat(back.ravel(), self.WIDTH), self.WIDTH * 256 * kernels).reshape(self.WIDTH, 2, 128, kernels)
        both, parts = sums.sum(1), self.filters.reshape(self.WIDTH, -1, kernels)
        filters = np.concatenate([known.T @ both, sums[:, 1].sum(1)[:, None]], axis=1).reshape(self.filters.shape)
        embedding = (both @ parts[:, :-1].transpose(0, 2, 1)).sum(0)
        embedding[0] = 0
        return embedding, filters, back[:, :kernels].sum(0) + back[:, kernels:].sum(0), out

    def probability(self, found: list[tuple[str, str, str]]) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * self.logits(found) + self.shift)))

    def logits(self, found: list[tuple[str, str, str]]) -> np.ndarray:
        codes, inside = encode(found)
        logit, used = np.zeros(len(found)), sizes(codes)
        order = np.argsort(used, kind="stable")
        for rows in np.array_split(order, max(1, len(order) // 256)):
            logit[rows] = self.forward(*trimmed(codes[rows], inside[rows], used[rows]))[3]
        return logit


class TextScorer:
    """The same probabilities for places of texts, with one convolution over each character.

    The mark of the run's own characters is one input among others, so it adds a constant
    to the convolution that depends only on which of a window's columns lie inside. What a
    text gives without marks is computed once; places add their constants and take maxima,
    those of windows with one constant from maxima of 4, 8, 16 and 32 windows.
    """

    #: Texts of so many characters, or a longer one, are taken together.
    CHARS = 1 << 16
    #: Characters convolved together.
    BLOCK = 1 << 14
    #: Places whose maxima are taken together.
    ROWS = 512

    def __init__(self, net: Network):
        self.net, size, width = net, net.embedding.shape[1] + 1, net.WIDTH
        embedding = np.where(np.arange(128)[:, None] > 0, net.embedding, 0.0)
        parts = net.filters.reshape(width, size, -1)
        self.tables = [(embedding @ part[:-1]).astype(np.float32) for part in parts]
        # sums[i, j]: columns i to j of a window lie inside
        upto = np.concatenate([np.zeros((1, parts.shape[2])), np.cumsum(parts[:, -1], axis=0)])
        self.sums = (upto[None] - upto[:, None]).astype(np.float32)
        self.bias = net.bias.astype(np.float32)

    def probability(self, text: str, spans: list[tuple[int, int]]) -> np.ndarray:
        return self.probabilities([text], [spans])[0]

    def probabilities(self, texts: list[str], spans: list[list[tuple[int, int]]]) -> list[np.ndarray]:
        out, held, size = [], [], 0
        for text, found in zip(texts, spans, strict=True):
            if held and size + len(text) > self.CHARS:
                out += self._some(held)
                held, size = [], 0
            held.append((text, found))
            size += len(text) if found else 0
        return out + self._some(held)

    def _some(self, held: list[tuple[str, list[tuple[int, int]]]]) -> list[np.ndarray]:
        gap = np.zeros(LENGTH, np.uint32)
        codes, starts, at = [gap], [], LENGTH
        for text, found in held:
            starts.append(at)
            if found:
                codes += [np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), gap]
                at += len(text) + LENGTH
        sizes = [len(found) for _, found in held]
        if not sum(sizes):
            return [np.zeros(0) for _ in held]
        places = np.array([place for _, found in held for place in found]) + np.repeat(starts, sizes)[:, None]
        logit = self._logits(np.minimum(np.concatenate(codes), 127).astype(np.int64), places[:, 0], places[:, 1])
        odds = 1 / (1 + np.exp(-(self.net.scale * logit + self.net.shift)))
        return np.split(odds, np.cumsum(sizes)[:-1])

    def _logits(self, codes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        logit, low = np.zeros(len(first)), 0
        while low < len(first):  # places ascend
            high = int(np.searchsorted(first, first[low] + self.BLOCK))
            start = first[low] - BEFORE
            logit[low:high] = self._block(codes[start : first[high - 1] + LENGTH], first[low:high] - start, last[low:high] - start)
            low = high
        return logit

    def _block(self, codes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        width = self.net.WIDTH
        # partial[w]: what the first w + 1 columns of a window add up to
        partial = [rows_at(table, codes[w : len(codes) - width + 1 + w], f"partial {w}") for w, table in enumerate(self.tables)]
        for w in range(1, width):
            partial[w] += partial[w - 1]
        plain = partial[-1]
        plain += self.bias
        logit, size = np.zeros(len(first)), last - first
        order = np.argsort(size, kind="stable")
        short = int((size < 8).sum())
        for at in range(0, short, self.ROWS):
            rows = order[at : min(short, at + self.ROWS)]
            logit[rows] = self._maxima(plain, codes, first[rows], last[rows]) @ self.net.out[:-1] + self.net.out[-1]
        if short < len(order):
            rows = order[short:]
            logit[rows] = self._long_maxima(plain, partial, first[rows], last[rows]) @ self.net.out[:-1] + self.net.out[-1]
        return logit

    def _long_maxima(self, plain: np.ndarray, partial: list[np.ndarray], first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """``_maxima`` of places of eight characters or more, by size."""
        width, mid, full = self.net.WIDTH, self.net.WIDTH // 2, last - first - self.net.WIDTH + 1
        upto, kernels = {1: plain}, plain.shape[1]  # upto[n][i]: maxima of n windows from i
        for n in (1, 2, 4, 8, 16):
            out = room(f"upto {n}", max(0, len(upto[n]) - n), kernels)
            upto[2 * n] = np.maximum(upto[n][: len(out)], upto[n][n:], out=out)
        best = room("best", len(first), 2 * kernels)
        within, around = best[:, :kernels], best[:, kernels:]
        bounds = np.searchsorted(full, [0, 8, 16, 32, LENGTH])
        for n, low, high in zip((4, 8, 16, 32), bounds, bounds[1:], strict=False):
            if low < high:
                a, b = rows_at(upto[n], first[low:high], "a"), rows_at(upto[n], first[low:high] + full[low:high] - n, "b")
                np.maximum(a, b, out=within[low:high])
        within += self.sums[0, width]
        before, after = BEFORE - width + 1, AFTER - width + 1
        np.maximum(rows_at(upto[16], first - BEFORE, "a"), rows_at(upto[16], first - BEFORE + before - 16, "b"), out=around)
        np.maximum(around, rows_at(upto[after], last, "a"), out=around)

        def also(side, at, mark):
            value = rows_at(plain, at, "a")
            value += mark
            np.maximum(side, value, out=side)

        for w in range(1, mid + 1):  # windows over an end of the place, their middle inside or outside
            also(within, first - w, self.sums[w, width])
            also(within, last - width + w, self.sums[0, width - w])
            also(around, first - width + w, self.sums[width - w, width])
            also(around, last - w, self.sums[0, w])
        reach = first + LENGTH - BEFORE - width
        for cut in range(1, width + 1):
            start = last + AFTER - width + cut
            value = rows_at(partial[width - cut - 1], start, "a") if cut < width else np.zeros((1, kernels), np.float32)
            value += self.bias
            np.maximum(around, value, out=around, where=(start <= reach)[:, None])
        return np.maximum(best, 0, out=best)

    def _maxima(self, plain: np.ndarray, codes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        width, mid = self.net.WIDTH, self.net.WIDTH // 2
        # windows all of whose columns the place's characters, or none, are in
        long = int((last - first).max())
        at = first[:, None] - mid + np.arange(long)
        here = at + mid < last[:, None]
        at = np.where(here, at, at[:, :1])
        within = plain[at] + self._marks(at, first, last)
        around = first[:, None] - BEFORE + np.arange(BEFORE - mid)
        after = last[:, None] - mid + np.arange(AFTER + mid - width + 1)
        outside = np.concatenate([around, after], axis=1)
        outside = plain[outside] + self._marks(outside, first, last)
        best = np.concatenate([within.max(axis=1), outside.max(axis=1)], axis=1)
        # windows that run out of the characters after the place, as far as the network's input reaches
        reach, kernels = first + LENGTH - BEFORE - width, len(self.bias)
        for cut in range(1, width + 1):
            start = last + AFTER - width + cut
            value = np.broadcast_to(self.bias, (len(first), kernels)).copy()
            for w in range(width - cut):
                value += self.tables[w][codes[start + w]]
            seen = start <= reach
            best[seen, kernels:] = np.maximum(best[seen, kernels:], value[seen])
        return np.maximum(best, 0)

    def _marks(self, at: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        width = self.net.WIDTH
        low, high = np.clip(first[:, None] - at, 0, width), np.clip(last[:, None] - at, 0, width)
        return self.sums[np.minimum(low, high), high]


NAMES = ("embedding", "filters", "bias", "out")


def descend(net: Network, codes: np.ndarray, inside: np.ndarray, labels: np.ndarray, epochs: int, rate: float, most: int, rng: np.random.Generator) -> None:
    """Adam. An epoch takes every finding of the more frequent label once, those of the other at least once; both weigh the same."""
    few, many = sorted((np.flatnonzero(labels == 0), np.flatnonzero(labels == 1)), key=len)
    steps = max(1, -(-len(many) // most))
    beside = max(most // 6, 16, -(-len(few) // steps))
    first, second, step, used = [0.0] * 4, [0.0] * 4, 0, sizes(codes)
    for _ in range(min(epochs, -(-STEPS // steps))):
        others = np.concatenate([rng.permutation(few) for _ in range(-(-steps * beside // len(few)))])
        for i, own in enumerate(np.array_split(rng.permutation(many), steps)):
            step += 1
            batch, grads = np.concatenate([own, others[i * beside : (i + 1) * beside]]), [0.0] * 4
            weights = np.repeat([0.5 / len(own), 0.5 / beside], [len(own), beside])
            short = used[batch] <= BEFORE + VALUE // 2
            for rows, share in ((batch[short], weights[short]), (batch[~short], weights[~short])):
                if len(rows):
                    found = net.gradients(*trimmed(codes[rows], inside[rows], used[rows]), labels[rows], share)
                    grads = [a + b for a, b in zip(grads, found, strict=True)]
            for j, g in enumerate(grads):
                first[j], second[j] = 0.9 * first[j] + 0.1 * g, 0.99 * second[j] + 0.01 * g * g
                move = first[j] / (1 - 0.9**step) / (np.sqrt(second[j] / (1 - 0.99**step)) + 1e-8)
                setattr(net, NAMES[j], getattr(net, NAMES[j]) * (1 - DECAY * rate / FIRST[1]) - rate * move)


def fit(found: list[tuple[str, str, str]], labels: np.ndarray, epochs: int = 8, seed: int = SEED) -> Network:
    """Adam on half of the findings; a logistic calibration and the threshold on the other half."""
    net, rng = Network.start(seed), np.random.default_rng(seed)
    order = rng.permutation(len(found))
    train, held = order[::2], order[1::2]
    if len({*labels[train]}) < 2 or len({*labels[held]}) < 2:
        return net
    codes, inside = encode(found)
    descend(net, codes[train], inside[train], labels[train], epochs, *FIRST[1:], rng)
    logit = net.logits([found[i] for i in held])
    net.scale, net.shift = calibrated(logit, labels[held])
    odds = net.scale * logit + net.shift
    secret = labels[held] == 1
    reach = np.sort(odds[secret])[int((1 - RECALL) * secret.sum())]
    below = odds[~secret & (odds < reach)]
    if net.scale > 0 and not (odds[~secret] >= reach).any():  # nothing ordinary up there: halfway down to what is
        reach = (reach + below.max()) / 2
    net.threshold = float(1 / (1 + np.exp(-reach)))
    net.precision = float(secret[odds >= reach].mean())
    return net


def calibrated(logit: np.ndarray, labels: np.ndarray, rows: np.ndarray | float = 1.0) -> tuple[float, float]:
    """Scale and shift of logits by logistic regression on labels kept off 0 and 1, of equal weight either way; each stands for some rows."""
    rows = np.broadcast_to(rows, len(logit))
    n = rows.sum()
    share, middle = (labels * rows).sum() / n, (logit * rows).sum() / n
    spread = np.sqrt(((logit - middle) ** 2 * rows).sum() / n) + 1e-9
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)) * rows
    aim = np.where(labels == 1, 1 - 1 / (share * n + 2), 1 / ((1 - share) * n + 2))
    x, at = np.stack([(logit - middle) / spread, np.ones_like(logit)]), np.zeros(2)
    for _ in range(50):  # Newton steps, none longer than 1
        p = 1 / (1 + np.exp(-np.clip(at @ x, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))) @ x.T + 1e-3 * np.eye(2), x @ (weight * (p - aim)) + 1e-3 * at)
        at = at - step / max(1.0, np.abs(step).max())
    return float(at[0] / spread), float(at[1] - at[0] * middle / spread)


def calibrated_by_all(held: DataFrame) -> tuple[float, float]:
    """``calibrated`` on a table of logits and labels, by the means of 4096 steps of the logit."""
    logit = F.col("logit")
    low, high = held.agg(F.min(logit), F.max(logit)).first()
    step = F.floor((logit - low) * (4095 / max(high - low, 1e-9)))
    steps = held.groupBy(step.alias("step"), "secret").agg(F.avg(logit).alias("logit"), F.count("*").alias("n")).orderBy("step", "secret").collect()
    return calibrated(*(np.array([row[name] for row in steps], float) for name in ("logit", "secret", "n")))


def at_place(values: DataFrame, name: str, place: int) -> float:
    """The value at a place (from 0) of the ascending order, by counts in ever narrower ranges."""
    low, high = values.agg(F.min(name), F.max(name)).first()
    while low < high:
        inside = values.where(F.col(name).between(low, high))
        step = F.least(F.floor((F.col(name) - low) / ((high - low) / 1024)), F.lit(1023)).alias("step")
        for part in inside.groupBy(step).agg(F.count("*").alias("n"), F.min(name).alias("low"), F.max(name).alias("high")).orderBy("step").collect():
            if place < part.n:
                low, high = part.low, part.high
                break
            place -= part.n
    return low


FINDING = "before string, value string, after string, secret boolean, rank long"


def labelled(text: str) -> list[tuple[str, str, str, bool]]:
    """Windows of base findings, and of the candidates that are surely of another kind."""
    base = base_spans(text)
    rows = [(*w, True) for s, _, e in base for w in windows(text, s, e)]
    others = [(a, b) for a, b in other_candidates(text, base) if not like_a_key(text, a, b, base)]
    return rows + [(*w, False) for a, b in others for w in windows(text, a, b)]


def _rank(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))


def _findings(batches):
    """Kernel over texts: their findings, of each value and label the first window in the text of the smallest hash, some values at a time."""
    kinds = (pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64())

    def passed(kept):
        rows = [row for part in kept for row in part.values()]
        columns = [pa.array([row[i] for row in rows], kind) for i, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays(columns, names=[part.split()[0] for part in FINDING.split(", ")])

    kept = ({}, {})
    for batch in in_slices(batches):
        for text in batch.column(0).to_pylist():
            base, rank = base_spans(text := text or ""), _rank(text) - (1 << 63)
            for known, secret, runs in ((kept[0], False, other_candidates(text, base)), (kept[1], True, [s[::2] for s in base])):
                for run in runs:
                    for a, b in (run,) if run[1] - run[0] <= VALUE else places(*run):
                        now = known.get(value := text[a:b])
                        # the test for a key only where the window can be kept
                        if (now is None or rank < now[4]) and (secret or not like_a_key(text, *run, base)):
                            known[value] = (text[max(0, a - BEFORE) : a], value, text[b : b + AFTER], secret, rank)
        if len(kept[0]) + len(kept[1]) > HELD:
            yield passed(kept)
            kept = ({}, {})
    yield passed(kept)


def labelled_findings(docs: DataFrame) -> DataFrame:
    """All findings with the label that the patterns give them, one for each value: before, value, after, secret."""
    found = docs.select(F.col("text").cast("string")).mapInArrow(_findings, FINDING)
    found = found.groupBy("value", "secret").agg(F.min(F.struct("rank", "before", "after")).alias("w"))
    return found.select("w.before", "value", "w.after", "secret")


#: Alphabets and lengths in which a finding's value is written anew: keys of other services.
ALPHABETS = {
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "lower": "abcdefghijklmnopqrstuvwxyz0123456789",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "word": "abcdefghijklmnopqrstuvwxyz",  # two short words, each with a number after it
}
LENGTHS = (14, 16, 20, 28, 36, 44)


def rewritten(value: str, kind: str) -> str:
    """A value of another alphabet for a finding, drawn from the finding's hash; never without a digit."""
    rng = np.random.default_rng(_rank(f"{kind}:{value}"))
    letters = ALPHABETS[kind]
    if kind == "word":
        return "".join("".join(rng.choice([*letters], rng.integers(4, 8))) + str(rng.integers(1, 999)) for _ in range(2))
    drawn = rng.choice([*letters], rng.choice(LENGTHS))
    drawn[rng.choice(len(drawn), 3, replace=False)] = rng.choice([*"0123456789"], 3)
    return "".join(drawn)


def ordinary(value: str, other: str) -> str:
    """A number, a date, an address, or words joined as in file names and links, for an ordinary run."""
    mark = _rank(f"ordinary:{value}")
    digits = f"{_rank(f'digits:{value}') % 10**19:019d}"
    match mark % 7:
        case 0:
            return digits[: 8 + mark // 64 % 12]
        case 1:
            return f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}"
        case 2:
            return ".".join(str(mark >> at & 255) for at in (8, 16, 24, 32))
        case 3:
            return f"{value}.{digits[: 1 + mark // 64 % 2]}"
        case 4:
            return f"{value}{'/-_.'[mark // 64 % 4]}{other}"
        case 5:
            return f"{digits[:3]}-{digits[3:7]}"
    return value.upper()


def training_rows(rows: list[tuple[str, str, str, bool]], kinds: tuple[str, ...] = tuple(ALPHABETS), held: bool | None = None) -> list[tuple[str, str, str, bool]]:
    """Findings, and each secret also behind ordinary words, as it is and written in other alphabets.

    Ordinary runs come once more as numbers or joined words. Rewritten secrets come behind the finding's own key name as well. All rows come once more with less
    around them, as at the ends of a text. So neither unknown names or forms of keys nor a
    short text hide a secret. ``held`` gives only one half of the rows, the one held out from
    training or the other; a form of a value is in the same half wherever it stands.
    """

    def here(*form):
        return held is None or _rank("\0".join(form)) & 1 == held

    plain = [(b, a) for b, _, a, secret in rows if not secret] or [("", "")]
    words = [v for _, v, _, secret in rows if not secret]
    out = [row for row in rows if here("", row[1])]
    out += [(b, ordinary(v, words[i - 1]), a, False) for i, (b, v, a) in enumerate(r[:3] for r in rows if not r[3]) if here("ordinary", v)]
    for i, (before, value, after, _) in enumerate(row for row in rows if row[3]):
        cut = re.split(r"([:=]\s*[\"']?)", value, maxsplit=1)
        bare = cut[-1]
        for k, kind in enumerate(["", *kinds]):
            if here(kind, bare):
                new = rewritten(bare, kind) if kind else bare
                head, tail = plain[(i * (len(kinds) + 1) + k) % len(plain)]
                out.append((head, new, tail, True))
                out.append(((before + "".join(cut[:-1]))[-BEFORE:], new, after, True))
    for before, value, after, secret in [*out]:
        mark = _rank(f"{before}\0{value}")
        out.append((before[len(before) - mark % (len(before) + 1) :], value, after[: mark // 64 % (len(after) + 1)], secret))
    return out


def dealt(findings: DataFrame, ordinary: int, secrets: int) -> DataFrame:
    """Groups of findings as rows, by hash of the value. Each value of the more frequent label is in one group.

    Groups that would have too few of the other label share them, so each knows both.
    """
    groups = max(1, -(-max(ordinary, secrets) // GROUP))
    shares = F.when(F.col("secret"), min(groups, max(1, secrets // SHARED))).otherwise(min(groups, max(1, ordinary // SHARED)))
    part = F.pmod(F.xxhash64("value"), shares.cast("long"))
    spread = findings.withColumn("group", F.explode(F.sequence(part, F.lit(groups - 1).cast("long"), shares.cast("long"))))
    spread = spread.repartition(-(-groups // 4), "group")
    return saved(spread.groupBy("group").agg(F.collect_list(F.struct("before", "value", "after", "secret")).alias("rows")))


def _rows_of(batches, held: bool):
    """For each group the windows and labels of one half of its training rows."""
    for batch in in_slices(batches, 1):
        found = zip(*(field.to_pylist() for field in batch.column("rows").flatten().flatten()), strict=True)
        rows = training_rows(sorted(found), held=held)
        yield [row[:3] for row in rows], np.array([float(row[3]) for row in rows])


def averaged(net: Network, groups: DataFrame, epochs: int, rate: float, most: int) -> Network:
    """The mean of copies of the network, each trained by one group, in whole parts of 2**-32, whose sums do not depend on their order."""

    def run(batches):
        total, n = 0, 0
        for found, labels in _rows_of(batches, False):
            own = dataclasses.replace(net)
            if 0 < labels.sum() < len(labels):
                descend(own, *encode(found), labels, epochs, rate, most, np.random.default_rng(SEED))
                total, n = total + np.rint(np.concatenate([getattr(own, name).ravel() for name in NAMES]) * 2**32).astype(np.int64), n + 1
        if n:
            yield pa.RecordBatch.from_pydict({"place": np.arange(len(total), dtype=np.int32), "total": total, "n": np.full(len(total), n)})

    sums = groups.mapInArrow(run, "place int, total long, n long").groupBy("place").agg(F.sum("total"), F.sum("n"))
    rows = sorted(tuple(row) for row in sums.collect())
    if not rows:
        return net
    flat, at, parts = np.array([total / n / 2**32 for _, total, n in rows]), 0, {}
    for name in NAMES:
        old = getattr(net, name)
        parts[name] = flat[at : at + old.size].reshape(old.shape)
        at += old.size
    return dataclasses.replace(net, **parts)


def held_logits(net: Network, groups: DataFrame) -> DataFrame:
    """Logits and labels of all rows that are held out from training."""

    def run(batches):
        for found, labels in _rows_of(batches, True):
            yield pa.RecordBatch.from_pydict({"logit": net.logits(found), "secret": labels == 1})

    return groups.mapInArrow(run, "logit double, secret boolean")


def train(findings: DataFrame) -> Network:
    """A network from all findings and their rewritten copies, in groups; calibrated on all that are held out.

    One group gives the start; then copies of the network learn from every group, and their mean is
    the network. Without both labels the network adds nothing.
    """
    findings = saved(findings)
    counts = dict(tuple(row) for row in findings.groupBy("secret").count().collect())
    net = Network.start(SEED)
    if not (counts.get(True) and counts.get(False)):
        return net
    groups = dealt(findings, counts[False], counts[True])
    trained, n = averaged(net, groups.where("group = 0"), *FIRST), -(-max(counts.values()) // GROUP)
    for _ in range(-(-ROUNDS // n) if n > 1 else 0):
        trained = averaged(trained, groups, *THEN)
    held = saved(held_logits(trained, groups))
    if trained is net or len(held.select("secret").distinct().take(2)) < 2:
        return net
    trained.scale, trained.shift = calibrated_by_all(held)
    odds = saved(held.select((F.col("logit") * trained.scale + trained.shift).alias("odds"), "secret"))
    secrets = odds.where("secret")
    reach = at_place(secrets, "odds", int((1 - RECALL) * secrets.count()))
    above = F.col("odds") >= reach
    right, wrong, below = odds.agg(F.count_if(above & F.col("secret")), F.count_if(above & ~F.col("secret")), F.max(F.when(~above & ~F.col("secret"), F.col("odds")))).first()
    if trained.scale > 0 and not wrong:  # nothing ordinary up there: halfway down to what is
        reach = (reach + below) / 2
    trained.threshold = float(1 / (1 + np.exp(-reach)))
    trained.precision = right / (right + wrong)
    return trained


SCAN = "n_assign long, n_access long, n_hex long, n_model long, base_sha256 string, spans string, redacted string"


def scanner(net: Network, redact: bool):
    """A function of texts that gives their rows of ``SCAN``."""

    scorer = TextScorer(net)

    def row(text: str, base: list[Span], added: list[Span]) -> tuple:
        clean = None
        if redact:
            pieces, done = [], 0
            for start, _, end in sorted(base + added):
                if end > done:
                    pieces += [text[done:start], "[SECRET]"] if start >= done else []
                    done = end
            clean = "".join([*pieces, text[done:]])
        counts = [sum(kind == k for _, kind, _ in base + added) for k in range(4)]
        digest = hashlib.sha256(joined(base).encode()).hexdigest()
        return (*counts, digest, joined(base + added), clean)

    def scan(texts: list[str]) -> list[tuple]:
        base = [base_spans(text) for text in texts]
        found = [other_candidates(*x) if net.threshold <= 1 else [] for x in zip(texts, base, strict=True)]
        scores = scorer.probabilities(texts, [all_places(runs) for runs in found])
        rows = []
        for text, spans, runs, odds in zip(texts, base, found, scores, strict=True):
            added, at = [], 0
            reached = (odds >= net.threshold).tolist() if len(odds) and odds.max() >= net.threshold else []
            for a, b in runs if reached else ():
                parts = len(places(a, b))
                if any(reached[at : at + parts]):
                    added.append((a, 3, b))
                at += parts
            rows.append(row(text, spans, added))
        return rows

    return scan


def scan_secrets(docs: DataFrame, net: Network | None = None, redact: bool = False) -> DataFrame:
    """``docs`` with the columns of ``SCAN``; ``net`` defaults to one trained on ``docs``.

    A null text counts as empty and has no spans; ``redacted`` is the text without them, and
    null unless asked for. Rows are judged alone, so repeated rows and null ids are kept as
    they are; an empty table gives no rows. Columns named like those of ``SCAN`` are replaced.
    """
    net = net or train(labelled_findings(docs))
    names = [part.split()[0] for part in SCAN.split(", ")]
    held = next(f"_s{i}" for i in range(len(docs.columns) + 1) if f"_s{i}" not in docs.columns)
    out = docs.withColumn(held, per_texts(scanner(net, redact), SCAN)(F.col("text")))
    return out.withColumns({name: F.col(f"{held}.{name}") for name in names}).drop(held)
