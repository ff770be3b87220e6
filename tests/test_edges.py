"""Answers do not depend on sizes, and no row is lost: nulls, empty terms, long lists, awkward files."""

import json

import pytest
from pyspark.sql import functions as F

from topictide.functions.rules import contains_any, match_rules, matches_excluded
from topictide.operators import dedupe, dictionary, match, rank, sample
from topictide.sources import dictionaries, posts, topics


@pytest.mark.parametrize("n", [1000, 1001])
def test_null_groups_are_sampled_at_any_n(spark, n):
    df = spark.range(20).select("id", F.when(F.col("id") < 10, "day").alias("dt"), F.lit("x").alias("weibo_content"))
    assert sample.sample_matching(df, "x", ["id"], n=n).count() == 20


def test_null_groups_in_proportional_samples(spark):
    df = spark.range(20).select("id", F.when(F.col("id") < 10, "day").alias("topic"))
    taken = sample.sample_proportional(df, ["id"], total=10, group="topic").groupBy("topic").count()
    assert sorted((r.topic or "", r["count"]) for r in taken.collect()) == [("", 5), ("day", 5)]


def test_digest_keeps_the_place_of_nulls(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None)], "x string, y string")
    assert df.select(rank.key_digest(["x", "y"]).alias("d")).distinct().count() == 2


@pytest.mark.parametrize("more", [0, 200])
def test_empty_terms_match_nothing(spark, more):
    lists = [("1", "k", ["good", "", *[f"term{i}" for i in range(more)]], None)]
    entries = spark.createDataFrame(lists, "kid string, keyword string, synonyms array<string>, antonyms array<string>")
    terms = dictionaries.dictionary_terms(entries)
    assert terms.count() == 1 + more
    texts = spark.createDataFrame([("good day",), ("no",)], "text string")
    assert match.match_terms(texts, ["good", "", *[f"term{i}" for i in range(more)]]).count() == 1
    assert dictionary._known_terms(terms).where("term = ''").count() == 0
    assert texts.where(contains_any("text", [""])).count() == 0


def test_long_rule_lists(spark):
    words = [f"word{i}" for i in range(3000)]
    df = spark.createDataFrame([("has word2999",), ("none",)], "t string")
    assert df.where(contains_any("t", words)).count() == 1
    assert df.where(match_rules("t", words)).count() == 1
    assert df.where(matches_excluded("t", words)).count() == 1


def post_line(**changes):
    fields = {"weibo_id": "1", "user_id": "2", "time_stamp": "3", "is_retweet": "0", "zhuan": "4", "ping": "5", "zhan": "6", "weibo_content": "c"}
    fields = {k: v for k, v in (fields | changes).items() if v != "absent"}
    return "x\t" + json.dumps(fields)


def test_json_nulls_stay_and_absent_keys_go(spark):
    lines = spark.createDataFrame([(post_line(),), (post_line(zhuan=None),), (post_line(ping="absent"),), (post_line(is_retweet="1"),), ("broken",)], "value string")
    found = posts.parse_posts(lines.withColumn("dt", F.lit(None).cast("date"))).collect()
    assert sorted(str(p.zhuan) for p in found) == ["4", "None"]
    assert posts.parse_posts_json(lines, keep=()).count() == 2


def test_one_sided_dictionaries(spark, tmp_path):
    path = tmp_path / "d.csv"
    path.write_text('keyword,synonyms,antonyms\nkind,"nice、""so"" good",\nhard,,soft、\n', encoding="utf-8")
    terms = dictionaries.dictionary_terms(dictionaries.build_dictionary(spark, str(path)))
    got = sorted((t.keyword, t.term, t.polarity) for t in terms.collect())
    assert got == [("hard", "soft", "antonym"), ("kind", '"so" good', "synonym"), ("kind", "nice", "synonym")]


def test_stop_words_are_stripped(spark, tmp_path):
    path = tmp_path / "s.txt"
    path.write_text("的\t\n了　\n", encoding="utf-8")
    assert sorted(r.word for r in dictionaries.read_stopwords(spark, str(path)).collect()) == sorted(["的", "了"])
    assert dictionaries.read_stopwords(spark, str(tmp_path / "none.txt")).count() == 0


def test_quoted_topics_round_trip(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('1,2022-01-01,"他说""好"",真的",12,1\n', encoding="utf-8")
    row = topics.read_topics(spark, str(path)).first()
    assert (row.text, row.hot, row.flag) == ('他说"好",真的', 12, 1)
    topics.write_topics_by_month(topics.read_topics(spark, str(path)), str(tmp_path / "out"))
    again = topics.read_topics(spark, str(tmp_path / "out" / "*"), header=True).first()
    assert (again.text, again.hot, again.flag) == ('他说"好",真的', 12, 1)


def test_smallest_id_by_number(spark):
    df = spark.createDataFrame([("d", "p", "10", "a"), ("d", "p", "2", "b"), ("d", "q", "2022-10", "a"), ("d", "q", "2022-9", "b"), ("d", "r", "1", "z"), ("d", "r", "1", "y")], "dt string, weibo_id string, keyword_id string, zhuan string")
    got = {r.weibo_id: (r.keyword_id, r.zhuan) for r in dedupe.dedupe_posts(df).collect()}
    assert got == {"p": ("2", "b"), "q": ("2022-9", "b"), "r": ("1", "y")}


def test_undated_topics_stay(spark):
    df = spark.createDataFrame([("2022-01-01", "a"), (None, "b")], "date string, text string").withColumn("date", F.col("date").cast("date"))
    assert {r.text: r.id for r in dedupe.topic_ids(df).collect()} == {"a": "2022-1", "b": None}
