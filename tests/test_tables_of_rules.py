"""Rules from tables, ordered results, one-pass vocabulary, samples by counts, days over batches, nulls."""

import json
import random

import pytest
from pyspark.sql import functions as F

from topictide import terms as fixed
from topictide.functions import vocabulary_tokens
from topictide.functions.rules import match_rules
from topictide.operators import automata, dictionary, flags, rule_tables
from topictide.operators.sample import sample_by_counts
from topictide.operators.share import flag_share
from topictide.operators.trend import share_within
from topictide.plans.topic_posts import quality_vocabulary
from topictide.sources import sinks
from topictide.sources.dictionaries import dictionary_frame
from topictide.streaming import ingest_days


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(1)
    made = ["".join(rng.choice("abc\n ") for _ in range(rng.randint(0, 12))) for _ in range(300)] + [None]
    return spark.createDataFrame(list(enumerate(made)), "i INT, text STRING").repartition(4)


RULES = ["a&b", "b", "ab&ca", "c&&a", "abc", "&", "zz", "a&z", "b c&a"]


@pytest.mark.parametrize("multiline", [False, True])
@pytest.mark.parametrize("list_bytes", [8, 10**6])
@pytest.mark.parametrize("library", [True, False])
def test_rule_tables_equal_expressions(spark, monkeypatch, texts, multiline, list_bytes, library):
    if not library:
        monkeypatch.setattr(automata, "ahocorasick", None)
    table = spark.createDataFrame([(r,) for r in [*RULES, "b", None]], "rule STRING")
    want = sorted((r.i, rule) for rule in RULES for r in texts.where(match_rules("text", [rule], multiline)).collect())
    got = rule_tables.rules_in_texts(texts, table, multiline=multiline, list_bytes=list_bytes)
    assert sorted((r.i, r.rule) for r in got.collect()) == want
    some = table.where("rule <> '&'")
    flagged = flags.flag_rules(texts, some, multiline=multiline)
    assert {r.i: r.flag for r in flagged.collect()} == {
        r.i: r.flag for r in flags.flag_rules(texts, [r for r in RULES if r != "&"], multiline=multiline).collect()}


def test_many_rules_and_other_uses_of_tables(spark, texts):
    rng = random.Random(2)
    many = ["&".join("".join(rng.choice("abc") for _ in range(rng.randint(2, 6))) for _ in range(rng.randint(1, 3))) for _ in range(10_000)]
    table = spark.createDataFrame([(r,) for r in many], "rule STRING")
    rows = [(r.i, r.text) for r in texts.collect()]
    want = {i: int(t is not None and any(all(w in t for w in r.split("&")) for r in many)) for i, t in rows}
    assert {r.i: r.flag for r in flags.flag_rules(texts, table).collect()} == want
    words = spark.createDataFrame([("ab",), ("ca",)], "word STRING")
    kept = flags.exclude_matches(texts, words, ["b b"])
    assert sorted(r.i for r in kept.collect()) == sorted(r.i for r in flags.exclude_matches(texts, ["ab", "ca"], ["b b"]).collect())
    saver = spark.createDataFrame([("c",)], "word STRING")
    flagged = texts.withColumn("flag", F.lit(1))
    assert {r.i: r.flag for r in flags.unflag_without_saver(flagged, words, saver).collect()} == {
        r.i: r.flag for r in flags.unflag_without_saver(flagged, ["ab", "ca"], ["c"]).collect()}
    empty = words.where("false")
    assert flags.flag_rules(texts, empty).where("flag = 1").count() == 0


@pytest.mark.parametrize("weight,cells", [(0, 1), (60, 100), (10**6, 10**6)])
def test_pieces_are_looked_up_once(monkeypatch, weight, cells):
    """What stands in a piece between white space is remembered, within bounds; rules hold as they do word by word."""
    monkeypatch.setattr(automata, "PIECES_WEIGHT", weight)
    monkeypatch.setattr(automata, "HELD_CELLS", cells)
    rng = random.Random(7)
    texts = ["".join(rng.choice("abc\n ") for _ in range(rng.randint(0, 12))) for _ in range(200)] * 3 + [None]
    for multiline in (False, True):
        known = automata.Rules(RULES, multiline)
        counts, held = known.held(texts)
        want = [[i for i, rule in enumerate(RULES) if text is not None and any(
                    all(word in part for word in rule.split("&")) for part in (text.split("\n") if multiline else [text]))]
                for text in texts]
        assert counts.tolist() == [len(some) for some in want] and held.tolist() == [i for some in want for i in some]
        if weight == 10**6:
            assert len(known.pieces) == len({piece for text in texts if text for piece in text.split()})


def test_nulls_are_no_matches(spark):
    df = spark.createDataFrame([(1, None), (2, "spam"), (3, "fine")], "i INT, text STRING")
    assert sorted(r.i for r in flags.exclude_matches(df, ["spam"], ["x+"]).collect()) == [1, 3]
    assert {r.i: r.flag for r in flags.flag_rules(df, ["fi&ne"]).collect()} == {1: 0, 2: 0, 3: 1}
    topics = spark.createDataFrame([("2020-01-01", "a", 1, 1), (None, "b", 1, 1)], "date STRING, text STRING, hot INT, flag INT").withColumn("date", F.to_date("date"))
    assert [r.period for r in flag_share(topics, exclude=["2020"]).collect()] == [None]
    trend = spark.createDataFrame([("2020", "q", 1), (None, "q", 2)], "period STRING, quality STRING, frequency INT")
    assert [r.period for r in share_within(trend, exclude=["2020"]).collect()] == [None]
    tokens = df.select("i", vocabulary_tokens("text", [""]).alias("none"), vocabulary_tokens("text", ["fin", ""]).alias("some"))
    assert {r.i: (r.none, r.some) for r in tokens.collect()} == {1: (None, None), 2: ([], []), 3: ([], ["fin"])}


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json"])
def test_ordered_files_hold_a_total_order(spark, tmp_path, fmt):
    rng = random.Random(3)
    rows = [(rng.randint(0, 40), f"w{rng.randint(0, 900):03}") for _ in range(800)]
    df = spark.createDataFrame(rows, "n INT, word STRING").repartition(6)
    path = str(tmp_path / fmt)
    sinks.write_ordered(df, path, [F.col("n").desc(), "word"], fmt, files=5)
    read = sinks.read_ordered(spark, path, fmt)
    assert read.select("file").distinct().count() == 5
    got = [(int(r.n), r.word) for r in read.orderBy("file", "row").collect()]
    assert got == sorted(rows, key=lambda r: (-r[0], r[1]))


def test_vocabulary_study_reads_its_posts_once(spark, tmp_path):
    rng = random.Random(4)
    lines = [(f"20{rng.randint(18, 20)}-01-0{rng.randint(1, 9)}", rng.choice(["努力", "独立", "x", "女儿 努力 独立"]) * rng.randint(1, 3)) for _ in range(200)]
    path = str(tmp_path / "posts")
    spark.createDataFrame(lines, "dt STRING, weibo_content STRING").withColumn("dt", F.to_date("dt")).write.parquet(path)
    posts, terms = spark.read.parquet(path), dictionary_frame(spark, fixed.QUALITY_DICTIONARY)
    made = quality_vocabulary(posts, terms)
    for name in ("texts", "term_counts", "frequent_words"):
        assert "FileScan" not in made[name]._jdf.queryExecution().executedPlan().toString()
    dated = posts.withColumn("year", F.year("dt").cast("string"))
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(made["texts"]) == rows(dictionary.texts_by_quality(dated, terms))
    counts = dictionary.describe_terms(dictionary.term_counts(posts, terms), terms)
    assert rows(made["term_counts"]) == rows(counts) != []
    many = spark.createDataFrame([(str(i), f"k{i}", f"t{i}", "s") for i in range(300)], "kid STRING, keyword STRING, term STRING, polarity STRING")
    both = many.unionByName(terms.select("kid", "keyword", "term", F.lit("s").alias("polarity")))
    hits = dictionary.quality_hits(dated, both, by=("year",))
    assert rows(dictionary.counts_of_hits(hits, weighted=False)) == rows(dictionary.term_counts(posts, both, weighted=False))


def test_samples_of_topics_by_the_callers_counts(spark):
    rows = [(t, f"d{d}", f"{t}-{d}-{i}") for t, n in (("a", 50), ("b", 10)) for d in range(4) for i in range(n + d)]
    df = spark.createDataFrame(rows, "keyword_id STRING, dt STRING, weibo_id STRING")
    counts = spark.createDataFrame([("a", "d0", 100), ("a", "d1", 100), ("a", "d9", 50), ("b", "d2", 5), ("c", "d0", 9)], "keyword_id STRING, dt STRING, count INT")
    got = sample_by_counts(df, counts, ["weibo_id"], total=50)
    sizes = {(r.keyword_id, r.dt): r["count"] for r in got.groupBy("keyword_id", "dt").count().collect()}
    assert sizes == {("a", "d0"): 10, ("a", "d1"): 10, ("b", "d2"): 12}
    assert got.columns == df.columns and got.distinct().count() == got.count()
    again = sample_by_counts(df.repartition(5), counts, ["weibo_id"], total=50)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got.collect()))


def line(**fields):
    made = dict(weibo_id="w", user_id="u", time_stamp="1", is_retweet="0", zhuan="0", ping="0",
                zhan="0", weibo_content="", r_weibo_content="", nick_name="")
    return "1\t" + json.dumps(made | fields, ensure_ascii=False)


def test_a_day_over_batches_is_one_deduplicated_partition(spark, tmp_path):
    source, root, days = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "days")
    for part, ids in (("a", "pq"), ("b", "qr")):
        (source / part).mkdir(parents=True)
        lines = [line(weibo_id=i, weibo_content="女儿很努力，要独立") for i in ids]
        (source / part / "feed.2020-01-01").write_text("\n".join(lines), "utf8")

    def run():
        query = ingest_days(spark, str(source / "*"), root, str(tmp_path / "state"), fixed.CHILD_TERMS,
                            fixed.EXTRACTION_TERMS, max_files=1, days=days)
        query.awaitTermination()
        assert query.exception() is None
        return sorted((str(r.dt), r.weibo_id) for r in spark.read.parquet(days).collect())

    first = run()
    assert first == [("2020-01-01", i) for i in "pqr"]
    assert spark.read.parquet(root).select("batch").distinct().count() == 2
    assert run() == first  # after a restart without new files
    (source / "c").mkdir()
    (source / "c" / "feed.2020-01-01").write_text(line(weibo_id="s", weibo_content="女儿勇敢"), "utf8")
    assert run() == [*first, ("2020-01-01", "s")]
