"""N-gram join, chats, mixing, page text, exact search and substrings on small rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from topictide.llm import chat_format, exact_search, graph, html_text, mixing, ngram_join, substring_dedup


def parts_of(n, links):
    label = list(range(n))
    for a, b in links:
        label = [label[a] if x == label[b] else x for x in label]
    return label


def brute_components(pairs):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, text in pairs:
        words = [w for w in (text or "").translate(low).replace("\t", " ").replace("\n", " ").split(" ") if w]
        n = min(3, len(words))
        sets.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set())
    near = [(i, j) for i in range(len(pairs)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])]
    label = parts_of(len(pairs), near)
    least = defaultdict(list)
    for part, (doc, _) in zip(label, pairs, strict=True):
        least[part].append(doc)
    return sorted((doc, len(s), min(least[part])) for part, (doc, _), s in zip(label, pairs, sets, strict=True))


def near_copies(rng, families, members, words=60):
    pairs = []
    for family in range(families):
        base = [f"w{rng.randint(0, 400)}x{family}" for _ in range(rng.randint(words // 3, words * 3))]
        for _ in range(members):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(text) // 25))):
                text[rng.randrange(len(text))] = f"new{rng.randint(0, 5)}"
            pairs.append((len(pairs), " ".join(text)))
    return pairs


@pytest.mark.parametrize("block_rows", [4096, 3])
def test_components_by_brute_force(docs, rows, block_rows):
    rng = random.Random(block_rows)
    pairs = near_copies(rng, 8, 14) + [(900, None), (901, ""), (902, ""), (903, "one"), (904, "ONE"), (905, "two words"), (906, "two  Words"), (907, "K one a"), (907, "k one a")]
    got = rows(ngram_join.similar_documents(docs(pairs), block_rows=block_rows))
    assert sorted(got) == brute_components(pairs)
    assert rows(ngram_join.similar_documents(docs([]))) == []


def test_similar_sets_share_a_range_key():
    rng = np.random.default_rng(4)
    for _ in range(400):
        size = int(rng.integers(1, 500))
        common = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        extra = rng.integers(0, 1 << 63, size // 9, dtype=np.uint64)
        cut = int(rng.integers(0, len(extra) + 1))
        a, b = np.unique(np.concatenate([common, extra[:cut]])), np.unique(np.concatenate([common, extra[cut:]]))
        if 100 * len(np.intersect1d(a, b)) >= 90 * len(np.union1d(a, b)) and len(np.union1d(a, b)) > len(common):
            assert {*ngram_join.range_keys(a).tolist()} & {*ngram_join.range_keys(b).tolist()}


@pytest.mark.parametrize("similarity", [(80, 100), (90, 100)])
def test_sets_right_at_the_threshold_share_a_key(similarity):
    rng = np.random.default_rng(similarity[0])
    num, den = similarity
    seen = 0
    for trial in range(3000):
        union = int(rng.integers(1, 600 if trial % 2 else 30))
        grams = np.unique(rng.integers(0, 1 << 63, union, dtype=np.uint64))
        differ = len(grams) * (den - num) // den  # as far apart as the threshold allows
        cut = int(rng.integers(0, differ + 1))
        out = rng.permutation(len(grams))
        a, b = np.delete(grams, out[:cut]), np.delete(grams, out[cut:differ])
        if len(a) and len(b) and differ:
            seen += 1
            assert {*ngram_join.range_keys(a, similarity).tolist()} & {*ngram_join.range_keys(b, similarity).tolist()}
    assert seen > 1500


def test_sparse_sets_share_a_key_after_all_cuts(monkeypatch):
    monkeypatch.setattr(ngram_join, "LEVELS", 0)  # only the fixed order is left
    rng = np.random.default_rng(2)
    for _ in range(300):
        grams = np.unique(rng.integers(0, 1 << 63, int(rng.integers(10, 200)), dtype=np.uint64))
        differ = len(grams) // 5
        a, b = np.sort(rng.permutation(grams)[: len(grams) - differ]), grams
        assert {*ngram_join.range_keys(a, (80, 100)).tolist()} & {*ngram_join.range_keys(b, (80, 100)).tolist()}


@pytest.mark.parametrize("rows_of", [300, 3000])
def test_keys_are_few_and_no_key_is_common(rows_of):
    rng = np.random.default_rng(rows_of)
    held, grams = {}, 0
    for _ in range(rows_of):
        one = np.unique(rng.integers(0, 1 << 63, int(rng.integers(20, 700)), dtype=np.uint64))
        grams += len(one)
        for key in ngram_join.range_keys(one, (80, 100)).tolist():
            held[key] = held.get(key, 0) + 1
    assert sum(held.values()) <= 0.7 * grams
    assert max(held.values()) == 1


def pages_of(spark, htmls, url="http://site.test/{}"):
    return spark.createDataFrame([(i, url.format(i) if url else None, h) for i, h in enumerate(htmls)], "page_id long, url string, html string")


def extracted(frame):
    return [r.text for r in html_text.extract_main_text(frame).orderBy("page_id").collect()]


def test_articles_under_other_titles_stay_whole(spark):
    body = "<p>The first paragraph of this article is the longest of them all.</p><p>The second paragraph.</p>"
    pages = [f"<body><article><h1>T {i}</h1><p>Date {i}.</p>{body}</article></body>" for i in range(6)]
    assert extracted(pages_of(spark, pages)) == [f"T {i}\nDate {i}.\nThe first paragraph of this article is the longest of them all.\nThe second paragraph." for i in range(6)]


def test_headings_go_only_with_what_they_head(spark):
    note = "<div><h2>Notice</h2><p>This site uses a lot of things.</p></div>"
    pages = [
        f"<body><article><p>Text {i} of a rather long article, {i} times told and {i * 7} times heard again.</p>"
        + (f"<h2>Summary</h2><p>In short {i}.</p><h2>Conclusion</h2><h3>Last</h3><p>So {i}.</p>" if i < 10 else "") + note + "<h2>More</h2>" + "<p>Read all about our offers.</p></article></body>"
        for i in range(40)
    ]
    got = extracted(pages_of(spark, pages))
    assert got[3] == "Text 3 of a rather long article, 3 times told and 21 times heard again.\nSummary\nIn short 3.\nConclusion\nLast\nSo 3."
    assert got[30] == "Text 30 of a rather long article, 30 times told and 210 times heard again."


def test_topics_of_sections_are_no_layout(spark):
    page = """<body><article><section id="search"><h2>Search trees</h2><p>A tree.</p></section>
        <div class="ad-free promo-code-guide"><p>Codes.</p></div><div class="ad-slot-3">Buy</div><div class="social share">S</div>
        <div class="menu-of-the-day"><a href="x">Home</a> <a href="y">News</a></div><div class="comment-list"><p>First!</p></div>
        <div id="comments">Me too</div></article></body>"""
    assert extracted(pages_of(spark, [page])) == ["Search trees\nA tree.\nCodes."]


def test_pages_without_address_keep_their_text(spark):
    pages = [f"<body><article><p>Common words.</p><p>Own words {i}, and many more of them here.</p></article></body>" for i in range(8)]
    assert extracted(pages_of(spark, pages, None))[2] == "Common words.\nOwn words 2, and many more of them here."
    clash = pages_of(spark, pages).withColumns({"_key": F.lit(1), "_host": F.lit(2), "_templates": F.lit(3)})
    out = html_text.extract_main_text(clash)
    assert {"_key", "_host", "_templates"} < {*out.columns} and out.count() == 8


def test_stray_end_tags_take_linear_time():
    import time

    began = time.time()
    assert html_text.main_text("<b>" * 40_000 + "x" + "</i>" * 40_000) == "x"
    assert time.time() - began < 4


def test_star_contraction(spark):
    rng = random.Random(1)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 400)]
    found = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    label = parts_of(401, links)
    for node, part in found.items():
        assert part == min(i for i in range(401) if label[i] == label[node])


def test_chats(spark, rows):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", " yes "), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "assistant", " yes "), (4, 0, "user", None), (5, 0, "user", ""), (5, 1, None, "x"), (6, 0, "user", "same"), (6, 0, "user", "same"), (None, 0, "user", "no id"), (7, 5, "user", "hi"), (7, 9, "assistant", " yes "), (7, 11, "user", "more")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("part", F.lit(0))
    got = {r.conv_id: (r.n_turns, r.text) for r in chat_format.format_chats(frame).collect()}
    assert {*got} == {4, 5, 6, 7, None}
    assert got[7] == (3, "<|user|>\nhi<|end|>\n<|assistant|>\nyes<|end|>\n<|user|>\nmore<|end|>\n")
    assert got[5] == (2, "<|user|>\n<|end|>\n<|user|>\nx<|end|>\n") and got[6][0] == 2
    parts = chat_format.format_chats(frame, part_turns=2).where("conv_id = 7").orderBy("part").collect()
    assert [p.part for p in parts] == [0, 1] and "".join(p.text for p in parts) == got[7][1]
    assert chat_format.format_chats(frame.limit(0)).count() == 0


@pytest.mark.parametrize("run", [2, 1024])
def test_chats_by_brute_force(spark, monkeypatch, run):
    """Long and hot conversations, some without an id, over several runs and blocks of turns."""
    monkeypatch.setattr(chat_format, "RUN", run)
    rng = np.random.default_rng(4)
    base = [("user" if k % 2 == 0 else "assistant", f"t{rng.integers(9)}") for k in range(40)]
    logged = {i: base[: int(rng.integers(1, 41))] for i in range(30)}
    logged |= {100 + i: base[: int(rng.integers(1, 30))] + [("user", f"own{i % 3}")] for i in range(12)}
    logged[None] = [*base, *base]
    turns = [(i, k, role, text) for i, said in logged.items() for k, (role, text) in enumerate(said)]
    rng.shuffle(turns)
    frame = spark.createDataFrame([(None if i is None else int(i), int(k), r, t) for i, k, r, t in turns], "conv_id long, turn long, role string, text string")
    # a row of two in the list of all conversations that begins another one is no maximal one
    def goes(i, said):
        longer = any(len(o) > len(said) and o[: len(said)] == said for o in logged.values())
        return longer or any(o == said and (j is None or (i is not None and j < i)) for j, o in logged.items() if j != i)
    wanted = {i: (len(said), "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in said)) for i, said in logged.items() if not goes(i, said)}
    parts: dict = {}
    for r in sorted(chat_format.format_chats(frame, part_turns=7).collect(), key=lambda r: r.part):
        parts.setdefault(r.conv_id, []).append(r)
    assert {i: (rows[0].n_turns, "".join(r.text for r in rows)) for i, rows in parts.items()} == wanted
    assert all([r.part for r in rows] == list(range(len(rows))) for rows in parts.values())


def test_mixing_rates(spark):
    sources = F.when(F.col("id") % 10 < 6, "big").when(F.col("id") % 10 < 9, "mid")
    frame = spark.range(20_000).select(F.col("id").alias("doc_id"), sources.alias("source"), F.lit("x").alias("copy"))
    out = mixing.repeat_documents(frame, {"big": 1.0, "mid": 1.0}).groupBy("source").count().collect()
    counts = {r["source"]: r["count"] for r in out}
    assert {*counts} == {"big", "mid"} and all(abs(n - 10_000) < 500 for n in counts.values())
    tables = spark.createDataFrame([(0.0,), (0.5,), (900.0,)], "m double").select(mixing.poisson_table(F.col("m")).alias("t"), mixing.poisson_start(F.col("m")).alias("first")).collect()
    assert tables[0].t == [1.0] and abs(tables[1].t[1] - 1.5 * np.exp(-0.5)) < 1e-12
    assert abs(tables[2].first + np.interp(0.5, tables[2].t, np.arange(len(tables[2].t))) - 899.7) < 1 and abs(tables[2].t[-1] - 1) < 1e-9
    assert mixing.repeat_documents(frame.limit(0)).count() == 0


def test_rows_without_ids_reach_their_target(spark):
    for seed in ("mix", "a", "b"):
        frame = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.when(F.col("id") < 1500, "same").otherwise(F.col("id").cast("string")).alias("text"), F.lit("none").alias("source"))
        other = spark.range(7000).select("id", F.lit("x").alias("text"), F.lit("ids").alias("source")).toDF("doc_id", "text", "source")
        both = frame.unionByName(other).withColumns({"table": F.lit(1), "_source": F.lit(2), "__id": F.lit(3)})
        out = mixing.repeat_documents(both, {"none": 0.3, "ids": 0.7}, seed=seed)
        sizes = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
        assert abs(sizes["none"] / sum(sizes.values()) - 0.3) < 0.02, seed
        assert {"table", "_source", "__id"} < {*out.columns}


def test_bands_of_large_means(spark):
    import time

    began = time.time()
    rows = spark.createDataFrame([(0.0,), (3.0,), (120.0,), (5000.0,), (1e6,)], "m double").select(
        "m", mixing.poisson_start(F.col("m")).alias("first"), mixing.poisson_table(F.col("m")).alias("t")).collect()
    assert time.time() - began < 20
    for r in rows:
        cdf = np.array(r.t)
        assert abs(cdf[-1] - 1) < 1e-6 and (np.diff(cdf) >= 0).all()
        mean = r.first + (1 - np.minimum(cdf, 1)).sum()
        assert abs(mean - r.m) <= 1e-6 * max(r.m, 1)
    draws = spark.range(4000).select(((F.col("id") + 0.5) / 4000).alias("u")).crossJoin(spark.createDataFrame([(120.0,), (0.7,)], "m double"))
    found = draws.select("m", "u", mixing.drawn_copies(mixing.poisson_table(F.col("m")), mixing.poisson_start(F.col("m")), F.col("u")).alias("n"),
                         (mixing.poisson_start(F.col("m")) + F.size(F.filter(mixing.poisson_table(F.col("m")), lambda c: c <= F.col("u")))).alias("want"))
    assert found.where("n <> want").count() == 0


def test_mixing_is_native(spark, plan, docs):
    found = plan(mixing.repeat_documents(docs([(1, "a"), (1, "a"), (None, None)])))
    assert "Python" not in found and "Arrow" not in found


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a = "</p><p>no";</script></head><body>
<nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav><div class="cookie-notice">Cookies</div>
<article><header><h1>Head &amp; more</h1><span>by me</span></header><p>One&nbsp;two<br>three <b>four<p>Caf&eacute; &lt;5
<form><input value=1>Ask</form><aside>Side</aside><div class=comments><p>Reader</div></article><footer>&copy;</footer></body></html>"""


def test_page_text():
    assert html_text.main_text(PAGE) == "Head & more\nOne two three four\nCafé <5"
    assert html_text.main_text("") == "" and html_text.main_text("plain < text & more") == "plain < text & more"
    assert html_text.main_text("<p>cut <a title='x") == "cut"
    assert html_text.main_text("<div>" * 5000 + "deep") == "deep"


def test_templates_of_a_site_go(spark):
    body = "<html><body><div><span>Top line of the site</span></div><div><p>Own text {i} of this page.</p></div></body></html>"
    pages = [(i, f"http://a.example/{i}", body.format(i=i)) for i in range(20)] + [(90, None, None), (91, "odd", ""), (92, "http://b.example/", body.format(i=92))]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract_main_text(frame).collect()}
    assert got[3] == ("Own text 3 of this page.", 24) and got[90] == ("", 0) and got[91] == ("", 0)
    assert got[92][0] == "Top line of the site\nOwn text 92 of this page."
    assert html_text.extract_main_text(frame.limit(0)).count() == 0


def test_copies_of_a_page_are_no_template(spark):
    body = "<html><body class=n{i}><div><p>Own text {i} of this page.</p></div><div><p>Second part {i}.</p></div></body></html>"
    article = "<html><body><div>Visit {i}</div><article><p>One story.</p><p>Its end.</p></article></body></html>"
    pages = [(i, f"http://a.example/{i}", body.format(i=7)) for i in range(5)]
    pages += [(i, f"http://b.example/{i}", body.format(i=max(i, 20))) for i in range(10, 30)]
    pages += [(i, f"http://c.example/{i}", article.format(i=i)) for i in range(30, 40)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract_main_text(frame).collect()}
    assert all(got[i] == "Own text 7 of this page.\nSecond part 7." for i in range(5))
    assert all(got[i] == f"Own text {max(i, 20)} of this page.\nSecond part {max(i, 20)}." for i in range(10, 30))
    assert all(got[i] == "One story.\nIts end." for i in range(30, 40))


def test_recurring_parts_of_marked_articles_go(spark):
    page = "<html><body><article><h1>Story {i}</h1><p>Own text {i}.</p><div class=box><p>Read us each day by mail.</p></div><p>End {i}.</p></article></body></html>"
    pages = [(i, f"http://a.example/{i}", page.format(i=max(i, 10))) for i in range(40)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract_main_text(frame).collect()}
    assert got == {i: "Story {0}\nOwn text {0}.\nEnd {0}.".format(max(i, 10)) for i in range(40)}


def test_words_drop_nothing_around_the_article():
    inner = "<article><p>The story is told here.</p></article><div class=sidebar>Side</div>"
    for name in ("site with-sidebar", "layout no-ads", "sidebar-right", "main-form"):
        assert html_text.main_text(f"<body><div class='{name}'>{inner}</div></body>") == "The story is told here."
    assert html_text.main_text(f"<body><main><div class='ads-page'>{inner}</div></main></body>") == "The story is told here."
    comments = "<div class=comments><article><p>A reader.</p></article></div>"
    assert html_text.main_text(f"<body><main><p>The story is told here.</p>{comments}</main></body>") == "The story is told here."
    assert html_text.main_text(f"<body><div class='x sidebar-left'>{inner}{comments}</div></body>") == "The story is told here."
    assert html_text.main_text("<body><div class='site with-sidebar'><p>No mark.</p></div></body>") == "No mark."
    assert html_text.main_text("<body><div hidden><article>Not seen</article></div><p>Seen</p></body>") == "Seen"


def brute_search(vectors, k=5):
    sound = [(i, np.floor(256 * np.array(v, float))) for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(sound):
        if i is not None and i % 50 == 0:
            scored = sorted((-int(q @ v), j is None, j or 0) for b, (j, v) in enumerate(sound) if a != b and len(v) == len(q))
            out += [(i, r + 1, None if missing else j, -s) for r, (s, missing, j) in enumerate(scored[:k])]
    return sorted(out, key=str)


def test_search_by_brute_force(spark, rows):
    rng = np.random.default_rng(2)
    base = [[float(x) for x in rng.normal(0, 0.3, 8)] for _ in range(40)]
    vectors = [(i, base[rng.integers(0, 40)]) for i in range(300)] + [(400, [float("nan")] * 8), (450, None), (500, [1.0, None]), (550, []), (551, []), (600, [0.5]), (50, base[0]), (None, base[1]), (700, [1e6] * 8)]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("score", F.lit(0))
    got = exact_search.top_inner_products(frame, F.col("vec_id") % 50 == 0)
    assert rows(got) == brute_search(vectors)
    assert exact_search.top_inner_products(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def brute_removed(pairs, length):
    seen, out = set(), {}
    for doc, text in sorted({*pairs}, key=lambda p: (p[0] is not None, p[0] or 0)):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            window = data[i : i + length]
            gone[i : i + length] |= window in seen
            seen.add(window)
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[doc] = (len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("stretches", [4096, 1])
def test_substrings_by_brute_force(docs, monkeypatch, stretches):
    monkeypatch.setattr(substring_dedup, "GRAM_STRETCHES", stretches)
    rng = random.Random(stretches)
    blocks = ["".join(rng.choice("abcé ") for _ in range(rng.randint(80, 300))) for _ in range(8)]
    texts = ["".join(rng.choice(blocks)[rng.randint(0, 40) :] for _ in range(rng.randint(1, 4))) for _ in range(40)]
    pairs = list(enumerate([*texts, "a" * 700, "ab" * 300, None, "", "x" * 99, texts[3]])) + [(1, texts[1]), (None, texts[0])]
    want = brute_removed(pairs, 100)
    got = substring_dedup.drop_repeated_substrings(docs(pairs)).collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in pairs)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id]
    assert substring_dedup.drop_repeated_substrings(docs([])).count() == 0


@pytest.mark.parametrize("ident", [None, 7])
def test_substrings_of_texts_that_share_an_id(docs, ident):
    """Many texts of one id, or of none: each keeps its own spans, in the order of the hashes."""
    rng = random.Random(8)
    passage = "".join(rng.choices("abcdef ", k=150))
    texts = ["".join(rng.choices("abcdefgh ", k=rng.randint(100, 200))) + passage * (k % 3 == 0) for k in range(600)]
    frame = docs([(ident, t) for t in texts])
    low, seed = (substring_dedup.NO_ID_BITS, []) if ident is None else (substring_dedup.SALT_BITS, [F.lit(substring_dedup.SALT_BITS)])
    order = F.xxhash64(*seed, "text").bitwiseAND(F.lit((1 << low) - 1))
    ranked = [r.text for r in frame.orderBy(order).select("text").collect()]
    want = brute_removed(list(enumerate(ranked)), 100)
    got = substring_dedup.drop_repeated_substrings(frame).collect()
    assert Counter((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == Counter(want.values())


def test_interval_expansion_by_brute_force():
    rng = random.Random(6)
    for _ in range(200):
        length = rng.choice([3, 5, 9])
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 5))]
        which, offsets = substring_dedup.repeated_windows(strings, np.arange(len(strings)), np.zeros(len(strings), np.int64), length)
        seen, want = set(), set()
        for s, data in enumerate(strings):
            for i in range(len(data) - length + 1):
                if data[i : i + length] in seen:
                    want.add((s, i))
                seen.add(data[i : i + length])
        assert {*zip(which.tolist(), offsets.tolist(), strict=True)} == want


def test_range_keys_are_not_stored(spark, docs, monkeypatch):
    """Keys that no two sets share stand in the shuffle alone; what is stored is a few numbers a text."""
    rng = np.random.default_rng(5)
    pairs = [(i, " ".join(map(str, rng.integers(0, 10**9, 300)))) for i in range(200)]
    pairs += [(200, pairs[0][1] + " more"), (201, None), (202, "")]
    writer, sizes = type(spark.range(1).write), []
    write = writer.parquet

    def measured(self, path, *args, **kwargs):
        write(self, path, *args, **kwargs)
        sizes.append(sum(f.stat().st_size for f in Path(path.removeprefix("file://")).rglob("part-*")))

    monkeypatch.setattr(writer, "parquet", measured)
    got = {r.doc_id: r.component_id for r in ngram_join.similar_documents(docs(pairs), 5, (80, 100)).collect()}
    assert got == {i: 0 if i == 200 else i for i, _ in pairs}
    assert sizes and max(sizes) < 200 * 100


def test_texts_are_dealt_out_compressed(docs):
    """A block's texts come as fewer bytes than they have, and whole."""
    text = "alpha beta\tgamma \u00e4\n" * 200
    sent = docs([(1, text)]).select(ngram_join._compressed()("text").alias("sent")).first().sent
    assert len(sent) * 5 < len(text) and zlib.decompress(bytes(sent)).decode() == text
