"""Line rules, packing, secret scans and the quality classifier on small rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from topictide.llm import packing, quality_model, quality_rules, secret_scan
from topictide.llm.store import table

TOKENIZER = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
PROSE = " ".join(f"Some{i} word{i} tells{i} a{i} story{i}." for i in range(12))


def test_repeated_words_by_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        words = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 14))]
        windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
        assert quality_rules.repeated_words(words) == len(hit)


def test_lines_and_documents(docs):
    menu = "\n".join("Home | News | Shop | Help | About us" for _ in range(20))
    rows = {
        r.doc_id: r
        for r in quality_rules.clean_lines(docs([(1, PROSE), (2, menu + "\n" + PROSE), (3, None), (4, ""), (5, PROSE + "\nAll rights reserved."), (5, PROSE + "\nAll rights reserved."), (None, PROSE)])).collect()
    }
    assert rows[1].kept and rows[1].clean_text == PROSE
    assert not rows[2].kept and rows[2].n_dup_lines == 19
    assert rows[3].base_failed and rows[3].n_words == 0 and rows[4].clean_text == ""
    assert rows[5].kept and rows[5].n_failed_lines == 1 and rows[5].clean_text == PROSE
    assert rows[None].kept
    assert quality_rules.clean_lines(docs([])).count() == 0


def brute_pieces(pairs, capacity=2048):
    from tokenizers import Tokenizer

    encode, out = Tokenizer.from_file(TOKENIZER).encode, []
    for doc, text in pairs:
        ids = encode(text or "", add_special_tokens=False).ids + [0]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[start : start + capacity], "<u4")
            out.append((doc, piece, start, len(part), zlib.crc32(part.tobytes())))
    return sorted(out, key=str)


def check_places(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity.tokens
        assert len(places) <= capacity.limits()[1]
        assert sum(n * n for _, n in places) <= capacity.limits()[2]
    return bins


def test_packing_of_whole_texts(spark, docs, folder):
    pairs = [(r.doc_id, r.text) for r in table(spark, folder, "documents").collect()]
    pairs += [(-1, None), (-2, ""), (-3, "It's 3,000.50 Écoles, Straße. don't... x" * 400), (-4, "a\tb c İ Σας é <|endoftext|> x."), (-4, "twice"), (-4, "twice"), (None, "no id")]
    rows = packing.pack_documents(docs(pairs), TOKENIZER).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str) == brute_pieces(pairs)
    bins = check_places(rows, packing.Capacity())
    assert len(bins) <= -(-sum(r.length for r in rows) // 2048) + 3
    assert packing.pack_documents(docs([]), TOKENIZER).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_binds(rule):
    rng = np.random.default_rng(1)
    lengths = np.sort(rng.integers(1, 60, 300))[::-1]
    for capacity in (packing.Capacity(100, 3, None, rule=rule), packing.Capacity(100, None, 4000, rule=rule)):
        bins, offsets = packing.fit(lengths, capacity)
        rows = [type("R", (), {"sequence_id": b, "offset": o, "length": n}) for b, o, n in zip(bins, offsets, lengths, strict=True)]
        check_places(rows, capacity)


def test_ids_ride_along(docs):
    row = packing.pack_documents(docs([(1, "hello world")]), TOKENIZER, with_ids=True).first()
    assert row.length == len(row.ids) == 3 and row.ids[-1] == 0


def brute_spans(text):
    kinds = (
        ("assign", re.compile(r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)"), 2, 8),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
        ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
    )
    found = [(m.start(), k, name, m.end()) for k, (name, p, g, n) in enumerate(kinds) for m in p.finditer(text) if len(m[g]) >= n]
    return [(name, start, end) for start, _, name, end in sorted(found)]


def test_base_spans_by_brute_force(docs):
    rng = random.Random(5)
    parts = ["password", "Token", "API_KEY", "apikey", "ſecret", "=", ": ", " = '", '"', " ", "AKIA", "ABCD1234EFGH5678", "deadbeef" * 4, "0f", "é", "x.y+z/", "short", "\n"]
    texts = ["".join(rng.choice(parts) for _ in range(12)) for _ in range(300)] + [None, "", "e" * 50_000]
    pairs = list(enumerate(texts))
    rows = {r.doc_id: r for r in secret_scan.scan_secrets(docs(pairs)).collect()}
    for i, text in pairs:
        spans = brute_spans(text or "")
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert rows[i].base_sha256 == hashlib.sha256(said.encode()).hexdigest(), text
        counts = Counter(k for k, *_ in spans)
        assert (rows[i].n_assign, rows[i].n_access, rows[i].n_hex) == (counts["assign"], counts["access"], counts["hex"])
        kept = [s for s in rows[i].spans.split(",") if s and not s.startswith("model:")]
        assert kept == [s for s in said.split(",") if s]


def labelled(n, seed):
    rng = random.Random(seed)
    hexes = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    out = []
    for _ in range(n):
        secret = rng.random() < 0.5
        value = hexes(rng.choice([18, 24, 40])) if secret else f"mail{rng.randint(1, 99)}.{rng.choice(['example', 'sample', 'domain'])}.com"
        out.append(("and then the " + rng.choice(["key ", "code ", "words "]), value, " of the day.", secret))
    return out


def test_network_on_held_out_findings(spark):
    found = labelled(900, 1)
    net = secret_scan.train(spark.createDataFrame(found, "before string, value string, after string, secret boolean").distinct())
    held = labelled(300, 2)
    scores = net.probability([row[:3] for row in held])
    truth = np.array([row[3] for row in held])
    assert ((scores >= net.threshold) == truth).mean() >= 0.97
    text = "the code is 4f9a1c2be87d305566aa and mail to bob@mail8.example.com now"
    assert "4f9a1c2be87d305566aa" not in secret_scan.scanner(net, True)([text])[0][-1]


def test_forms_of_secrets_never_seen_are_found(spark):
    """Base findings of the benchmark texts only; whole kinds of rewritten keys are held out of training."""
    texts = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text")
    rows = [tuple(r) for r in secret_scan.labelled_findings(texts).collect()]
    seen = {*secret_scan.training_rows(rows, ())}
    for kind in ("base62", "upper"):
        train = secret_scan.training_rows(rows, tuple(k for k in secret_scan.ALPHABETS if k != kind))
        net = secret_scan.fit([r[:3] for r in train], np.array([float(r[3]) for r in train]))
        held = [r for r in secret_scan.training_rows(rows, (kind,)) if r[3] and r not in seen]
        assert (net.probability([r[:3] for r in held]) >= net.threshold).mean() >= 0.9, kind
    train = secret_scan.training_rows(rows)
    net = secret_scan.fit([r[:3] for r in train], np.array([float(r[3]) for r in train]))
    scan = secret_scan.scanner(net, True)
    for text, secret in [("aws_secret_access_key: wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "wJalrXUtnFEMI"), ("my pin code is Zx81Qp44Lm90Ty72", "Zx81Qp44"), ("use ghp_16C7e42F292c6912E7710c838347Ae178B4a here", "16C7e42F")]:
        assert secret not in scan([text])[0][-1]
    plain = "an ordinary sentence with international considerations; call 555-0934 or 9859476043669043 on 2024-01-15"
    assert scan([plain])[0][-1] == plain


def test_monotony_looks_at_all_words():
    varied = " ".join(f"word{i}" for i in range(210))
    place = 3 ** quality_model.LABELLERS.index("monotony")
    assert quality_model.votes(varied) // place % 3 == quality_model.NONE
    assert quality_model.votes(varied + " and again and again" * 800) // place % 3 == quality_model.BAD


def test_threshold_counts_all_documents(spark, docs):
    """By brute force: of all scores, the lowest with the fewest wrong documents by the label model."""
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randint(0, 900)}" for _ in range(60)) + "." for _ in range(150)] + ["spam spam " * rng.randint(20, 60) for _ in range(30)]
    frame = docs(list(enumerate(texts)))
    scorer = quality_model.train(frame)
    scores = np.array([scorer.score(t) for t in texts])
    voted = [i for i, t in enumerate(texts) if quality_model.votes(t) != quality_model.SILENT]
    bad = scorer.labels.posterior(np.array([quality_model.votes(texts[i]) for i in voted]))
    own = scores[voted]
    wrong = [(1 - bad[own <= s]).sum() + bad[own > s].sum() for s in own]
    best = min(w for w in wrong)
    lowest = min(s for s, w in zip(own, wrong, strict=True) if w <= best + 1e-9)
    want = min(0.5, 1.5 * lowest + 0.02) if best < bad.sum() else 0.5
    scored = spark.createDataFrame([(float(s), quality_model.votes(t)) for s, t in zip(scores, texts, strict=True)], "score double, v long")
    assert abs(quality_model.threshold_of_all(scored, scorer.labels, "score", "v") - want) < 2 / quality_model.STEPS
    kept = {r.doc_id: r.kept for r in quality_model.judge(frame).collect()}
    assert kept == {i: bool(s >= want) for i, s in enumerate(scores)}


def test_threshold_keeps_the_recall(spark):
    found = labelled(900, 1)
    found += [(*row[:3], True) for row in labelled(100, 3) if not row[3]]  # secrets that look like the others
    net = secret_scan.fit([row[:3] for row in found], np.array([float(row[3]) for row in found]))
    assert net.threshold < 0.5 and 0 < net.precision < 1
    held = labelled(300, 2) + [(*row[:3], True) for row in labelled(40, 4) if not row[3]]
    scores = net.probability([row[:3] for row in held])
    assert (scores >= net.threshold)[[row[3] for row in held]].mean() >= 0.95


def test_all_findings_are_labelled(docs):
    """More values than one group of training findings holds, in many texts, with copies."""
    words = [f"{a}{b}{c}ordinary" for a in "abcdefghijklmnopq" for b in "rstuvwxyzabcdefghijk" for c in "lmnopqrstuvw"]
    keys = [f"password={i:08d}" for i in range(3100)]
    texts = [" ".join(words[i : i + 100]) + "\n" + " ; ".join(keys[i : i + 100]) for i in range(0, len(words), 100)]
    rows = secret_scan.labelled_findings(docs(list(enumerate(texts + texts[:5] + [None])))).collect()
    assert sorted(r.value for r in rows if r.secret) == keys
    plain = sorted(r.value for r in rows if not r.secret)
    assert len({*plain}) == len(plain) > 3900 and {*plain} <= {*words}


def test_every_finding_trains_and_calibrates(spark, monkeypatch):
    """Small groups: all values are dealt, and the threshold is that of all held-out rows by brute force."""
    monkeypatch.setattr(secret_scan, "GROUP", 100)
    monkeypatch.setattr(secret_scan, "SHARED", 40)
    found = sorted({*labelled(900, 1)})
    frame = spark.createDataFrame(found, "before string, value string, after string, secret boolean")
    counts = Counter(row[3] for row in found)
    groups = [sorted(tuple(r) for r in row.rows) for row in secret_scan.dealt(frame, counts[False], counts[True]).collect()]
    assert len(groups) > 2 and all(len({r[3] for r in rows}) == 2 for rows in groups)
    assert {r for rows in groups for r in rows} == {*found}
    many = counts.most_common(1)[0][0]
    assert sum(r[3] == many for rows in groups for r in rows) == counts[many]
    for rows in groups:
        halves = [secret_scan.training_rows(rows, held=held) for held in (False, True)]
        assert not {*halves[0]} & {*halves[1]}
    net = secret_scan.train(frame)
    held = [r for rows in groups for r in secret_scan.training_rows(rows, held=True)]
    logit, labels = net.logits([r[:3] for r in held]), np.array([float(r[3]) for r in held])
    assert np.allclose((net.scale, net.shift), secret_scan.calibrated(logit, labels), rtol=1e-2)
    odds = net.scale * logit + net.shift
    reach = np.sort(odds[labels == 1])[int((1 - secret_scan.RECALL) * labels.sum())]
    if not (odds[labels == 0] >= reach).any():
        reach = (reach + odds[(labels == 0) & (odds < reach)].max()) / 2
    assert abs(net.threshold - 1 / (1 + np.exp(-reach))) < 1e-9
    assert net.precision == labels[odds >= reach].mean()


def test_the_value_at_a_place(spark):
    rng = random.Random(9)
    values = [rng.choice([rng.gauss(0, 1), 0.5, rng.random() * 1e-9, 1e6]) for _ in range(3000)]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    for place in (0, 60, 1500, 2999):
        assert secret_scan.at_place(frame, "v", place) == sorted(values)[place]


def test_every_run_is_a_candidate():
    middle = "deadbeef" * 4
    text = f"short aBcdefgh 12345678 lettersonly XY-{middle}_Tail99 end password=abcdefgh12,x"
    base = secret_scan.base_spans(text)
    got = [text[a:b] for a, b in secret_scan.other_candidates(text, base)]
    assert got == ["aBcdefgh", "12345678", "lettersonly", "XY-", "_Tail99"]
    rng = random.Random(8)
    for _ in range(200):
        text = "".join(rng.choice([middle, "AKIA", "A1B2C3D4E5F6G7H8", "token=", "abcd1234", " ", "-", "é"]) for _ in range(10))
        base = secret_scan.base_spans(text)
        covered = {i for s, _, e in base for i in range(s, e)}
        want = {i for m in re.finditer(r"[A-Za-z0-9+/_.=-]{8,}", text) for i in range(*m.span())} - covered
        parts = secret_scan.other_candidates(text, base)
        assert {i for a, b in parts for i in range(a, b)} == want and sum(b - a for a, b in parts) == len(want)


def test_what_looks_like_a_key_has_no_label():
    text = "the passphrase: abcdefghij and my key Zy12Xw34Vu56Ts78Rq and ordinarily password=abcdefgh12"
    assert [row[1] for row in secret_scan.labelled(text) if not row[3]] == ["passphrase", "ordinarily"]
    long = "ab12" * 40
    assert len([row for row in secret_scan.labelled(f"secret={long}") if row[3]]) > 1


def test_scores_of_a_text_are_those_of_its_windows():
    net = secret_scan.Network.start(1)
    rng = random.Random(2)
    text = " ".join("".join(rng.choice("aZ09+/é-") for _ in range(rng.randint(1, 150))) for _ in range(300))
    spans = [p for m in secret_scan.CANDIDATE.finditer(text) for p in secret_scan.places(*m.span())]
    want = net.probability([w for m in secret_scan.CANDIDATE.finditer(text) for w in secret_scan.windows(text, *m.span())])
    assert np.allclose(secret_scan.TextScorer(net).probability(text, spans), want, atol=1e-4)
    assert np.allclose(secret_scan.TextScorer(net).probability("12345678", [(0, 8)]), net.probability([("", "12345678", "")]), atol=1e-4)


def test_no_findings_and_no_rows(docs):
    row = secret_scan.scan_secrets(docs([(1, "plain words only")]), redact=True).first()
    assert row.spans == "" and row.redacted == "plain words only"
    assert secret_scan.scan_secrets(docs([])).count() == 0


def test_classifier_against_hand_labels(spark):
    folder = "/root/testdata/sf0.1"
    judged = quality_model.judge(table(spark, folder, "documents").select("doc_id", "text"))
    rows = judged.join(table(spark, folder, "labels"), "doc_id").select("quality", "kept").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.05


def test_classifier_edges(docs):
    assert quality_model.judge(docs([])).count() == 0
    rows = quality_model.judge(docs([(1, None), (2, ""), (3, PROSE), (3, PROSE), (None, "spam! " * 9000)])).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)


def test_expectation_maximisation_finds_the_bad_share():
    rng = np.random.default_rng(0)
    patterns = Counter()
    for _ in range(4000):
        bad = rng.random() < 0.2
        cast = [quality_model.BAD if rng.random() < (0.4 if bad else 0.005) else quality_model.NONE for _ in range(quality_model.FAULTS)]
        cast += [quality_model.GOOD if rng.random() < (0.05 if bad else 0.9) else quality_model.NONE for _ in range(2)]
        patterns[sum(v * 3**i for i, v in enumerate(cast))] += 1
    model = quality_model.label_model(sorted(patterns.items()))
    assert abs(model.bad - 0.2) < 0.04 and abs(model.chances[1, 0, quality_model.BAD] - 0.4) < 0.07
