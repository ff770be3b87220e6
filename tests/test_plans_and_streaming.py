import json

from pyspark.sql import functions as F

from test_match import line
from test_sources import entry, snapshot
from topictide import terms as fixed
from topictide.functions import vocabulary_tokens
from topictide.plans import (
    extract_days,
    gathered_texts,
    keyword_trends,
    quality_vocabulary,
    sampled_topics,
    text_clusters,
    top_words,
    topic_post_days,
    topic_share,
    topics_from_snapshots,
    trend_tables,
)
from topictide.plans.keyword_trend import count_days
from topictide.sources.dictionaries import dictionary_frame
from topictide.streaming import ingest_days, read_ingested


def snapshots(folder):
    folder.mkdir()
    cards = [{"card_type": 11, "card_group": [
        entry("家长如何带孩子", "100"), entry("今天的天气很好", "300"),
        entry(fixed.RETRACTED_TITLES[0], "50"),
    ]}]
    (folder / "list.2020-01-01").write_text(snapshot(cards) + "\n" + snapshot(cards), "utf8")
    (folder / "list.2020-12-31").write_text(snapshot(cards[:1]), "utf8")
    return str(folder)


def test_topic_share_plan(spark, tmp_path):
    path = snapshots(tmp_path / "lists")
    row = topic_share(spark, path, "year").first()
    assert (row.period, row.flagged, row.total) == ("2020", 3, 9)
    row = topic_share(spark, path, "year", "weighted").first()
    assert (row.flagged, row.total) == (200, 900)


def test_sampled_topics(spark, tmp_path):
    topics = topics_from_snapshots(spark, snapshots(tmp_path / "lists"))
    got = sampled_topics(topics, 10, seed=1).collect()
    # One flagged topic with heat in each month, however often it was listed.
    assert sorted((r.month, r.text) for r in got) == [
        ("2020-01", "家长如何带孩子"), ("2020-12", "家长如何带孩子")]


def test_words_and_clusters_of_cleaned_posts(spark):
    rows = [(f"w{i}", "2020-01-01", "鸡娃的孩子" if i % 2 else "双减的孩子") for i in range(40)]
    rows += [("n1", "2021-01-01", None), ("n2", "2021-01-01", "鸡娃鸡娃鸡娃" * 20)]
    posts = spark.createDataFrame(rows, "weibo_id STRING, dt STRING, cleaned_weibo_content STRING"
                                  ).withColumn("dt", F.to_date("dt"))

    def tokens(text):
        return vocabulary_tokens(text, ["鸡娃", "双减", "孩子"])

    assert [(r.word, r["count"]) for r in top_words(posts, 2020, tokenizer=tokens).collect()] == [
        ("孩子", 40)]
    assert [(r.word, r["count"]) for r in top_words(posts, tokenizer=tokens).collect()] == [
        ("鸡娃", 80)]
    texts = gathered_texts(posts)
    assert texts.count() == 41
    vectors = spark.createDataFrame(
        [(r[0], [100.0 * (i % 2), 0.0, 1.0] if r[0] != "n2" else [9e3, 9e3, 9e3])
         for i, r in enumerate(rows)], "weibo_id STRING, embedding ARRAY<FLOAT>")
    found = text_clusters(texts, vectors, width=5.0)
    assert sorted(r.prediction for r in found["texts"].select("prediction").distinct().collect()
                  ) == ["w0", "w1"]
    assert found["texts"].count() == 40 and found["labels"].count() == 41
    assert found["silhouette"] > 0.9 and found["calinski_harabasz"].first().clusters == 3
    few = text_clusters(texts.limit(3), vectors, width=5.0)
    assert few["silhouette"] is None and few["texts"].count() == 0


def posts(folder):
    folder.mkdir(exist_ok=True)
    made = {
        "2020-01-01": ["#家长如何带孩子#女儿很努力很努力很努力真的", "#家长如何带孩子#女儿很努力很努力很努力真的",
                       "无关的话题而已"],
        "2020-01-02": ["儿子很独立很独立，要努力，努力努力再努力啊", "短 女儿 独立"],
        "2020-02-01": ["#家长如何带孩子#女儿独立"],
    }
    for day, texts in made.items():
        lines = [line(weibo_id=f"{day}-{i}", weibo_content=t) for i, t in enumerate(texts)]
        (folder / f"feed.{day}").write_text("\n".join(lines + lines[:1]) + "\n", "utf8")
    return str(folder)


def test_keyword_trend_plan(spark, tmp_path, plan):
    path, root = posts(tmp_path / "posts"), str(tmp_path / "days")
    extract_days(spark, path, root, "2020-01-01", "2020-12-31")
    extract_days(spark, path, root, "2020-01-01", "2020-12-31")
    extracted = spark.read.parquet(root)
    logged = count_days(spark, path)
    assert {str(r.dt): r.total_count for r in logged.collect()} == {
        "2020-01-01": 4, "2020-01-02": 3, "2020-02-01": 2,
    }
    daily = keyword_trends(extracted, logged)
    tables = trend_tables(daily, logged)
    assert len(tables) == 5
    # The feed and the posts were read before: no table scans a file again.
    for made in (logged, *tables.values()):
        assert "FileScan" not in plan(made) and "Scan text" not in plan(made)
    by_word = sum(r.frequency for r in tables["month_keyword"].collect())
    by_quality = sum(r.frequency for r in tables["month_quality"].collect())
    assert by_word == by_quality > 0
    found = {(r.period, r.keyword): r.frequency for r in tables["year_keyword"].collect()}
    # The post of two terms is stored once per term and counts for each stored row.
    assert found["2020", "努力"] == 4 and found["2020", "独立"] == 4


def test_topic_posts_plan(spark, tmp_path):
    topics = topics_from_snapshots(spark, snapshots(tmp_path / "lists"))
    root = str(tmp_path / "days")
    topic_post_days(spark, topics, posts(tmp_path / "posts"), root)
    found = spark.read.parquet(root)
    assert {str(r.dt) for r in found.collect()} == {"2020-01-01"}
    assert found.count() == 2
    made = quality_vocabulary(found, dictionary_frame(spark, fixed.QUALITY_DICTIONARY))
    assert [r.text for r in made["texts"].collect()] == ["#家长如何带孩子#女儿很努力很努力很努力真的"]
    assert [(r.term, r.qualities, r["count"]) for r in made["term_counts"].collect()] == [
        ("努力", "勤奋", 2)]
    assert made["frequent_words"].columns == ["kid", "word", "count"]


def test_ingest_resumes_and_repeats_safely(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "out")
    path = posts(source)

    def run():
        query = ingest_days(spark, path, root, str(tmp_path / "state"), fixed.CHILD_TERMS,
                            fixed.EXTRACTION_TERMS, max_files=1)
        query.awaitTermination()
        assert query.exception() is None
        return sorted(map(tuple, read_ingested(spark, root).select("keyword_id", "weibo_id")
                          .collect()))

    first = run()
    assert run() == first and len(first) == 6
    (source / "feed.2020-03-01").write_text(line(weibo_id="new", weibo_content="女儿勇敢"), "utf8")
    assert sorted(set(run()) - set(first)) == [("8", "new")]
    assert json.dumps(first) and spark.read.parquet(root).where(F.col("batch").isNull()).count() == 0
