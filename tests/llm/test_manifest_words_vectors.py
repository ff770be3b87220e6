"""Merkle manifest, spelling variants and near vectors against brute force on small rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from topictide.llm import merkle, spelling, vector_dedup

LOW = str.maketrans(merkle.UPPER, merkle.LOWER)


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_manifest(rows):
    """Rows of doc_id, text, lang, source, n_chars with ids that differ within a source."""
    def field(value):
        return "-" if value is None else f"{len(str(value).encode())}:{value}"

    def leaf(row, text):
        return h("".join(map(field, (row[0], row[3], row[2], row[4], text))))

    def tree(level):
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append([h("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
        return levels

    by = defaultdict(list)
    for row in rows:
        by[row[3]].append(row)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for name in names:
        by[name].sort(key=lambda r: (r[0] is not None, r[0] or 0))
    trees = [tree([leaf(r, r[1]) for r in by[name]]) for name in names]
    top = tree([t[-1][0] for t in trees])
    out = []
    for j, name in enumerate(names):
        for i, row in enumerate(by[name]):
            now = own = trees[j][0][i]
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[1] is not None:
                now = leaf(row, row[1].translate(LOW))
            siblings = []
            for levels, place in ((trees[j], i), (top, j)):
                for level in levels[:-1]:
                    run, at = level[place // 16 * 16 :][:16], place % 16
                    siblings += run[:at] + run[at + 1 :]
                    now = h("".join([*run[:at], now, *run[at + 1 :]]))
                    place //= 16
            out.append((row[0], own, trees[j][-1][0], top[-1][0], h("".join(siblings)), now, now == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("sources", [[None], ["one"], [None, "", "Ä", "z", "Z"], [f"s{i}" for i in range(40)]])
def test_manifest_by_brute_force(spark, rows, sources):
    rng = random.Random(len(sources))
    texts = ["Some Text", None, "", "plain", "ÄÖ Upper", "x" * 3000 + "Y"]
    table = [(i if i else None, rng.choice(texts), rng.choice(["en", None]), sources[min(i % 7 * i, len(sources) - 1) if i % 3 else 0], rng.choice([None, 5])) for i in range(700)]
    table += [(1000 + i, "T", "en", s, 1) for i, s in enumerate(sources)]
    frame = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long")
    clash = frame.withColumns({"tree": F.lit("x"), "leaf": F.lit(1), "hi": F.lit(2), "members": F.lit(3)}).repartition(5)
    assert rows(merkle.manifest(clash)) == brute_manifest(table)


def test_manifest_of_little(spark, rows):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    assert rows(merkle.manifest(spark.createDataFrame([], kind))) == []
    one = [(7, "A", "en", "s", 1)]
    assert rows(merkle.manifest(spark.createDataFrame(one, kind))) == brute_manifest(one)
    same = rows(merkle.manifest(spark.createDataFrame([(7, "a", None, None, None)] * 40, kind)))
    assert len(same) == 40 and len({r[1] for r in same}) == 1 and all(r[6] for r in same)


def brute_words(pairs):
    counts = Counter()
    for doc, text in pairs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            mark = zlib.crc32(f"{doc}:{run}".encode())
            if doc is not None and mark % 31 == 0:
                run = run[: mark % len(run)] + run[mark % len(run) + 1 :]
            counts[run] += len(run) >= 7
    words = {w: n for w, n in counts.items() if n >= 2}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    beside = {w: [u for u in words if near(w, u)] for w in words}
    form = {}
    for w, found in beside.items():
        best = min(found, key=lambda u: (-words[u], u), default=None)
        if best is not None and words[best] >= 10 * words[w]:
            form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(beside[w]), words.get(form.get(w))))
    return sorted(out, key=str)


def typos(rng, word):
    letters, place = "abélÿ", rng.randrange(len(word))
    return rng.choice([word[:place] + word[place + 1 :], word[:place] + rng.choice(letters) + word[place:], word[:place] + rng.choice(letters) + word[place + 1 :]])


def test_variants_by_brute_force(docs, rows):
    rng = random.Random(11)
    base = ["balloon", "ballooning", "aaaaaaaa", "mississippi", "élévation", "Großmutter", "committee", "rendezvous", "abababab"]
    bag = []
    for word in base:
        bag += [word] * rng.choice([3, 30, 200])
        for _ in range(12):
            variant = typos(rng, word)
            bag += [variant] * rng.choice([1, 2, 3, 25])
            bag += [typos(rng, variant)] * rng.choice([1, 2])
    bag += ["chainlink"] * 400 + ["chainlinks"] * 38 + ["chainlinkss"] * 2  # a form that has a form
    rng.shuffle(bag)
    pairs = [(i, " ".join(bag[i * 40 : i * 40 + 40])) for i in range(len(bag) // 40 + 1)]
    pairs += [(900, None), (901, ""), (902, "short words"), (None, "balloon Ballooning"), (903, "a" * 30_000 + " " + "a" * 29_999), (904, ("A" * 30_000 + "1" + "a" * 29_999) * 2)]
    got = rows(spelling.spelling_variants(docs(pairs)))
    want = brute_words(pairs)
    assert got == want
    assert any(w[1] for w in want) and any(w[1] != w[2] for w in want if w[1])
    assert rows(spelling.spelling_variants(docs([]))) == []
    assert rows(spelling.spelling_variants(docs([(1, None), (2, "a b c")]))) == []


def brute_links(pairs, cosine=0.95):
    """(vec_id, n_links, component_id, kept) in input order."""
    units = []
    for _, v in pairs:
        v = None if v is None or None in v else np.array(v, float)
        units.append(None if v is None or not len(v) or not np.isfinite(v).all() or not v.any() else v / np.abs(v).max())
    units = [None if u is None else u / np.linalg.norm(u) for u in units]
    near = [[j for j, b in enumerate(units) if j != i and a is not None and b is not None and len(a) == len(b) and a @ b >= cosine] for i, a in enumerate(units)]
    label = list(range(len(pairs)))
    for _ in pairs:
        label = [min([label[i], *(label[j] for j in near[i])]) for i in range(len(pairs))]
    least = defaultdict(list)
    for i, part in enumerate(label):
        least[part].append(pairs[i][0])
    out = []
    for i, (vec, _) in enumerate(pairs):
        ids = [x for x in least[label[i]] if x is not None]
        component = min(ids) if ids else None
        out.append((vec, len(near[i]), component, vec == component))
    return sorted(out, key=str)


@pytest.mark.parametrize(("element", "part_rows"), [("float", 4096), ("double", 7)])
def test_near_vectors_by_brute_force(spark, rows, element, part_rows):
    rng = np.random.default_rng(5)
    pairs = []
    for family in range(12):
        centre = rng.standard_normal(20)
        for _ in range(int(rng.integers(1, 14))):
            pairs.append((len(pairs), (centre + rng.standard_normal(20) * rng.choice([0.0, 0.1, 0.25, 0.4])).tolist()))
    pairs += [(900 + i, [float(i % 3), 1.0]) for i in range(12)] + [(950, [2.0]), (951, [-2.0]), (952, [8.0])]
    pairs += [(960, None), (961, []), (962, [0.0] * 20), (963, [float("nan")] * 20), (964, [float("inf")] + [0.0] * 19), (965, [None] + [1.0] * 19), (None, pairs[0][1]), (None, [1.0, 0, 0]), (3, pairs[3][1]), (3, pairs[3][1])]
    pairs = [(i, v if v is None else [x if x is None else float(np.float32(x)) for x in v]) for i, v in pairs]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in pairs], f"vec_id long, embedding array<{element}>, label int, node string")
    assert rows(vector_dedup.near_vectors(frame.repartition(3), part_rows=part_rows)) == brute_links(pairs)
    assert rows(vector_dedup.near_vectors(frame.limit(0))) == []


def test_recall_of_pairs_at_the_threshold(spark):
    rng = np.random.default_rng(8)
    a = rng.standard_normal((1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((1500, 64))
    b -= a * (a * b).sum(axis=1, keepdims=True)
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    cosine = rng.uniform(0.9501, 0.96, (1500, 1))
    both = np.concatenate([a, a * cosine + b * np.sqrt(1 - cosine**2)])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(both)], "vec_id long, embedding array<double>")
    linked = vector_dedup.near_vectors(frame).where("n_links > 0").count()
    assert linked >= 0.995 * 3000


def test_fast_transform_is_hadamards():
    x = np.random.default_rng(1).standard_normal((3, 8))
    matrix = np.array([[1.0]])
    for _ in range(3):
        matrix = np.block([[matrix, matrix], [matrix, -matrix]])
    assert np.allclose(vector_dedup.hadamard(x), x @ matrix)
