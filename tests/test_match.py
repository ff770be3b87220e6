import json
import random

from pyspark.sql import functions as F

from topictide import schemas
from topictide import terms as fixed
from topictide.operators import automata, dedupe, match, vocabulary

ALPHABET = "abAB子女孩 \n'\\`"


def random_texts(seed, n, size):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, size))) for _ in range(n)]


def brute(texts, terms):
    return sorted((i, t) for i, text in enumerate(texts) for t in set(terms) if t and t in text)


def test_strategies_equal_brute_force(spark, rows):
    texts = random_texts(1, 200, 60)
    texts.append("a" * 50 + "𝄞b")
    terms = sorted(set(random_texts(2, 150, 9)) | {"", "a", "aa", "子女", "女孩 ", "𝄞b"})
    df = spark.createDataFrame(list(enumerate(texts)), "i INT, text STRING")
    expected = brute(texts, terms)
    assert len(expected) > 500
    for strategy in ("scan", "automaton", "anchor"):
        got = match.match_terms(df, terms, strategy=strategy).select("i", "term")
        assert sorted(map(tuple, got.collect())) == expected


def test_term_tables_in_blocks_and_without_inline_anchors(spark, monkeypatch):
    texts, terms = random_texts(3, 100, 60), sorted(set(random_texts(4, 120, 9)))
    df = spark.createDataFrame(list(enumerate(texts)), "i INT, text STRING").repartition(7)
    table = spark.createDataFrame([(t, len(t)) for t in terms], "term STRING, size INT")
    expected = [(i, t, len(t)) for i, t in brute(texts, terms)]
    blocks = match.match_terms(df, table, block_rows=13, strategy="anchor")
    assert blocks._jdf.queryExecution().optimizedPlan().toString().count("Join") > 3
    assert sorted(map(tuple, blocks.select("i", "term", "size").collect())) == expected
    monkeypatch.setattr(match, "INLINE_TERMS", 5)
    rows = match.match_terms(df, table, strategy="anchor").select("i", "term", "size")
    assert sorted(map(tuple, rows.collect())) == expected
    for block_rows in (13, 10**6):
        rows = match.match_terms(df, table, block_rows=block_rows).select("i", "term", "size")
        assert sorted(map(tuple, rows.collect())) == expected
    assert match.match_terms(df, table.where("size > 99")).count() == 0


def test_anchor_join_is_map_side(spark, plan):
    df = spark.createDataFrame([(1, "xx the other yy")], "i INT, text STRING")
    hits = match.match_terms(df, ["the", "other", "her"], strategy="anchor")
    text = plan(hits)
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text
    assert sorted(r.term for r in hits.collect()) == ["her", "other", "the"]


def test_rare_anchor_is_chosen(spark):
    # All terms share their beginning; the anchor must be what tells them apart.
    table = spark.createDataFrame([(f"共同的开头{i:04d}",) for i in range(300)], "term STRING")
    anchors = match._anchors_of(table, "term", 8)
    assert anchors.select("_anchor").distinct().count() == 300


def line(**fields):
    made = dict(weibo_id="w", user_id="u", time_stamp="1", is_retweet="0", zhuan="0", ping="0",
                zhan="0", weibo_content="", r_weibo_content="", nick_name="")
    made.update(fields)
    return "1\t" + json.dumps(made, ensure_ascii=False)


def test_extract_posts(spark, monkeypatch):
    lines = spark.createDataFrame(
        [
            (line(weibo_id="a", weibo_content="女儿很努力，坚持不懈怠"),),
            (line(weibo_id="a", weibo_content="女儿很努力，坚持不懈怠"),),
            (line(weibo_id="b", weibo_content="很努力"),),
            (line(weibo_id="c", weibo_content="早安", nick_name="女儿努力"),),
            (line(weibo_id="d", weibo_content="转", is_retweet="1", r_weibo_content="养娃要独立"),),
            ("女儿努力 no json",),
        ],
        "value STRING",
    ).withColumn("dt", F.lit("2022-01-01").cast("date"))
    expected = [
        ("0", "d", "转//养娃要独立"), ("16", "a", "女儿很努力，坚持不懈怠"), ("16", "c", "早安"),
        ("19", "a", "女儿很努力，坚持不懈怠"),
    ]
    for limit in (match.SCAN_TERMS, 3):
        monkeypatch.setattr(match, "SCAN_TERMS", limit)
        got = match.extract_posts(lines, fixed.CHILD_TERMS, fixed.EXTRACTION_TERMS)
        assert got.columns == ["dt", *schemas.EXTRACTED_COLUMNS]
        shown = got.select("keyword_id", "weibo_id", "weibo_content").collect()
        assert sorted(map(tuple, shown)) == expected


def test_topics_match_only_in_their_month(spark, monkeypatch):
    topics = spark.createDataFrame(
        [("2020-1", "2020-01", "如何带孩子"), ("2020-2", "2020-02", "如何带孩子"),
         ("2020-3", "2020-01", "带孩子")],
        "id STRING, month STRING, text STRING",
    )
    lines = spark.createDataFrame(
        [("2020-01-31", line(weibo_id="a", weibo_content="#如何带孩子#")),
         ("2020-02-29", line(weibo_id="b", weibo_content="#如何带孩子#")),
         ("2021-01-01", line(weibo_id="c", weibo_content="#如何带孩子#"))],
        "dt STRING, value STRING",
    ).withColumn("dt", F.to_date("dt"))
    expected = [("2020-1", "a"), ("2020-2", "b"), ("2020-3", "a")]
    raw = match.match_topics(lines, topics)
    assert raw.columns == ["dt", "value", "keyword_id"] and raw.count() == 3
    library = automata.ahocorasick
    for found, limit in ((library, 1), (None, match.INLINE_TERMS), (None, 1)):
        monkeypatch.setattr(automata, "ahocorasick", found)
        monkeypatch.setattr(match, "INLINE_TERMS", limit)
        got = match.extract_topic_posts(lines, topics)
        assert sorted(map(tuple, got.select("keyword_id", "weibo_id").collect())) == expected


def test_a_text_meets_only_the_list_of_its_month(spark):
    """Topic tables beyond one list: blocks by month where each month fits, else by rows."""
    texts, words = random_texts(5, 120, 60), sorted(set(random_texts(6, 60, 4)) - {""})
    lines = spark.createDataFrame([(i, f"2020-{i % 3 + 1:02d}-01", t) for i, t in enumerate(texts)],
                                  "i INT, dt STRING, value STRING").withColumn("dt", F.to_date("dt"))
    months = [(f"2020-{m:02d}", w, f"{m}/{w}") for m in (1, 2, 3, 4) for w in words[m::2]]
    topics = spark.createDataFrame(months, "month STRING, text STRING, id STRING")
    expected = sorted((i, k) for i, t in enumerate(texts) for m, w, k in months
                      if int(m[-1]) == i % 3 + 1 and w in t)
    assert len(expected) > 100
    named = match._month_topics(topics)
    for block_rows, by in ((10**6, ["_month"]), (40, ["_month"]), (5, named.columns)):
        lists = match.TermLists(named, "_topic", ["_month"], block_rows)
        assert lists.by == by and (lists.blocks > 1) == (block_rows < 10**6)
        hits = match.match_terms(lines.withColumn("_month", F.date_format("dt", "yyyy-MM")), named,
                                 "value", "_topic", ["_month"], block_rows=block_rows)
        assert sorted(map(tuple, hits.select("i", "keyword_id").collect())) == expected


def test_words_are_counted_from_their_places(spark, monkeypatch):
    texts = [*random_texts(7, 80, 80), "aaaaaaa", "ababababa", None, ""]
    words = sorted({*random_texts(8, 60, 3), "aa", "aba", "abab", "a"} - {""})
    df = spark.createDataFrame([(i % 2, t) for i, t in enumerate(texts)], "g INT, text STRING")
    table = spark.createDataFrame([(w,) for w in [*words, words[0]]], "word STRING")
    expected = {}
    for i, t in enumerate(texts):
        for w in words:
            if t and w in t:
                expected[i % 2, w] = expected.get((i % 2, w), 0) + t.count(w)
    for found in (automata.ahocorasick, None):
        monkeypatch.setattr(automata, "ahocorasick", found)
        got = vocabulary.vocabulary_counts(df, table, by=["g"]).collect()
        assert {(r.g, r.word): r["count"] for r in got} == expected


def test_dedupe_and_distinct(spark):
    df = spark.createDataFrame(
        [("2020-01-01", 3, "a", "x"), ("2020-01-01", 1, "a", "y"), ("2020-01-02", 2, "a", "z")],
        "dt STRING, keyword_id INT, weibo_id STRING, v STRING",
    )
    once = dedupe.dedupe_posts(df)
    assert sorted(r.v for r in once.collect()) == ["y", "z"]
    assert sorted(r.v for r in dedupe.dedupe_posts(once).collect()) == ["y", "z"]
    text = once._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in text and "Partial" in text


def test_topic_ids_run_through_the_year(spark):
    df = spark.createDataFrame(
        [("2020-01-02", "b"), ("2020-01-01", "z"), ("2020-03-01", "a"), ("2021-01-01", "q")],
        "date STRING, text STRING",
    )
    got = dedupe.topic_ids(df)
    assert sorted((r.id, r.text, r.month) for r in got.collect()) == [
        ("2020-1", "z", "2020-01"), ("2020-2", "b", "2020-01"), ("2020-3", "a", "2020-03"),
        ("2021-1", "q", "2021-01"),
    ]


def test_blocks_share_the_rows_of_one_term(spark, rows):
    """One term holds nearly all rows of the table: each block gets its part."""
    terms = spark.createDataFrame(
        [("alpha", i) for i in range(2000)] + [("beta", 1)], "term STRING, item LONG"
    )
    anchored = match._Anchored(terms, "term", 500)
    block = F.pmod(F.xxhash64("term", "item"), F.lit(anchored.blocks))
    sizes = [r["count"] for r in terms.groupBy(block.alias("b")).count().collect()]
    assert len(sizes) == anchored.blocks and max(sizes) <= 500
    texts = spark.createDataFrame([(1, "an alpha"), (2, "none")], "id LONG, text STRING")
    found = match.match_terms(texts, terms, block_rows=500)
    assert rows(found, "id", "item") == sorted([(1, i) for i in range(2000)], key=str)
