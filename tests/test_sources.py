import json

import pytest
from pyspark.sql import functions as F

from topictide import schemas, terms
from topictide.operators.flags import unflag_titles
from topictide.sources import days, dictionaries, posts, sinks, snapshots, topics


def snapshot(cards, kind="1", stamp="1577824079000", inner=None):
    page = inner if inner is not None else json.dumps({"cards": cards}, ensure_ascii=False)
    outer = {"id": "1", "crawler_time_stamp": stamp, "type": kind, "bangdan": page}
    return "61543\t" + json.dumps(outer, ensure_ascii=False)


def entry(desc=None, extra=None, kind=4):
    made = {"card_type": kind, "pic": ""}
    if desc is not None:
        made["desc"] = desc
    if extra is not None:
        made["desc_extr"] = extra
    return made


def test_snapshots_from_files(spark, tmp_path, rows):
    good = [
        entry("家长如何带孩子", "1234567"), entry("五个字话题", "1"), entry("六个字的话题", "热 55 和 66"),
        entry("没有热度的话题"), entry("热度没有数字", "无"), entry(None, "5"),
        entry("别的种类的条目", "7", kind=7), entry("数字热度的话题", 99),
    ]
    lines = [
        snapshot([{"card_type": 11, "card_group": good}]),
        snapshot([{"card_type": "11", "card_group": [entry("卡片类型是文字", "3")]}]),
        snapshot([{"card_type": 9, "card_group": good}]),
        snapshot([{"card_type": 11, "card_group": good}], kind="2"),
        snapshot(None), snapshot(None, inner="[1, 2]"), snapshot(None, inner="{}"),
        "no tab here", "1\t{broken", "",
    ]
    (tmp_path / "list.2020-01-02").write_text("\n".join(lines), encoding="utf8")
    found = snapshots.explode_topics(
        snapshots.read_snapshots(spark, str(tmp_path)), terms.TOPIC_RULES
    )
    got = rows(found.withColumn("date", F.col("date").cast("string")))
    stamp, day = "1577824079000", "2020-01-02"
    assert got == sorted([
        (stamp, day, "家长如何带孩子", 1234567, 1), (stamp, day, "六个字的话题", 55, 0),
        (stamp, day, "没有热度的话题", None, 0), (stamp, day, "热度没有数字", None, 0),
        (stamp, day, "数字热度的话题", 99, 0), (stamp, day, "卡片类型是文字", 3, 0),
    ], key=str)


def test_retracted_titles_keep_the_rows(spark):
    df = spark.createDataFrame(
        [(terms.RETRACTED_TITLES[0], 1), ("家长会上的话题", 1), (terms.RETRACTED_TITLES[1], 0)],
        "text STRING, flag INT",
    )
    assert [r.flag for r in unflag_titles(df, terms.RETRACTED_TITLES).collect()] == [0, 1, 0]


def post(**changes):
    fields = dict(
        id="1", weibo_id="w1", user_id="u1", time_stamp="1577778847", is_retweet="0", zhuan="1",
        ping="2", zhan="3", weibo_content="早安\n孩子", r_weibo_content="", nick_name="努力",
    )
    fields.update(changes)
    return {name: value for name, value in fields.items() if value is not None}


def positional(fields=24, **changes):
    made = post(**changes)
    row = ["-"] * fields
    for name, place in schemas.POST_POSITIONS.items():
        if place < fields:
            row[place] = made.get(name, "")
    return [value.replace("\n", " ") for value in row]


def test_posts_of_each_layout_by_file_day(spark, tmp_path, rows):
    json_day = [
        "1\t" + json.dumps(post()), "2\t" + json.dumps(post(weibo_id="w2", is_retweet="1",
                                                           r_weibo_content="原文")),
        "3\t" + json.dumps(post(weibo_id="w3", is_retweet="1", r_weibo_content=None)),
        "4\t" + json.dumps(post(weibo_id="w4", zhuan=None)), "5\t{bad", "no tab",
        "6\t" + json.dumps(post(weibo_id="w6", r_weibo_content=None)),
    ]
    (tmp_path / "feed.2020-01-01").write_text("\n".join(json_day))
    tsv = ["\t".join(positional(23)), "\t".join(positional(24, weibo_id="t1")),
           "\t".join(positional(30, weibo_id="t2", is_retweet="1", r_weibo_content="原"))]
    (tmp_path / "feed.2016-07-24.csv").write_text("\n".join(tsv))
    csv = ['"' + '","'.join(positional(39, weibo_id="c1", is_retweet="1",
                                       r_weibo_content="双子座")) + '"', '"a","b"']
    (tmp_path / "feed_2020-06-30.csv").write_text("\n".join(csv))
    got = posts.read_posts(spark, str(tmp_path))
    assert rows(got.select(F.col("dt").cast("string"), "weibo_id", "weibo_content")) == sorted([
        ("2020-01-01", "w1", "早安 孩子"), ("2020-01-01", "w2", "早安 孩子//原文"),
        ("2020-01-01", "w6", "早安 孩子"), ("2016-07-24", "t1", "早安 孩子"),
        ("2016-07-24", "t2", "早安 孩子//原"), ("2020-06-30", "c1", "早安 孩子//双子座"),
    ], key=str)
    assert got.columns == ["dt", *schemas.POST_COLUMNS[:-1], "weibo_content"]
    bounded = posts.read_lines(spark, str(tmp_path), "2020-01-01", "2020-03-01")
    assert {str(r.dt) for r in bounded.collect()} == {"2020-01-01"}


def test_day_bounds_skip_whole_files(spark, tmp_path):
    for day in range(1, 10):
        (tmp_path / f"feed.2020-01-0{day}").write_text("x\n" * day)
    lines = posts.read_lines(spark, str(tmp_path), "2020-01-03", "2020-01-04")
    assert len(lines.collect()) == 7
    scan = lines._jdf.queryExecution().executedPlan()
    while scan.children().size():
        scan = scan.children().head()
    assert scan.metrics().get("numFiles").get().value() == 2


def test_posts_are_parsed_once(spark, tmp_path, plan):
    (tmp_path / "feed.2020-01-01").write_text("1\t" + json.dumps(post()))
    text = plan(posts.parse_posts_json(posts.read_lines(spark, str(tmp_path))))
    assert text.count("from_json") == 1


def test_topic_tables(spark, tmp_path, rows):
    bare = tmp_path / "bare.csv"
    bare.write_text("1,2020-01-02,甲乙丙丁戊己,12,1\n2,2020-01-03,庚,,0\n3,2020-01-03,辛,None,0\n"
                    "4,2020-01-03,壬,nan,0\n")
    got = topics.read_topics(spark, str(bare))
    assert rows(got.select("text", "hot", "flag")) == sorted(
        [("甲乙丙丁戊己", 12, 1), ("庚", None, 0), ("辛", None, 0), ("壬", None, 0)], key=str
    )
    headed = tmp_path / "headed.csv"
    headed.write_text("timestamp,date,text,hot,rear\n1,2020-01-02,甲,12.0,1\n")
    assert rows(topics.read_topics(spark, str(headed), header=True), "hot", "flag") == [(12, 1)]
    topics.write_topics_by_month(got, str(tmp_path / "out"))
    topics.write_topics_by_month(got, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 4


def test_repair_topic_rows(spark):
    lines = spark.createDataFrame(
        [("1,2020-01-02,甲,12,1",), ("1,d,甲,12,02,e,乙,13,1",), ("1,2,3,4,5,6,7",)], "value STRING"
    )
    got = [tuple(r) for r in topics.repair_topic_rows(lines).collect()]
    assert got == [("1", "2020-01-02", "甲", "12", "1"), ("1", "d", "甲", "12", "0"),
                   ("2", "e", "乙", "13", "1")]


def test_dictionaries(spark, tmp_path, rows):
    file = tmp_path / "dict.json"
    file.write_text(json.dumps(terms.QUALITY_DICTIONARY, ensure_ascii=False), encoding="utf8")
    got = dictionaries.read_dictionary(spark, str(file))
    assert got.count() == 92 and got.select("term").distinct().count() == 89
    assert got.where("term = keyword").count() == 0
    assert rows(got) == rows(dictionaries.dictionary_frame(spark, terms.QUALITY_DICTIONARY))
    table = tmp_path / "table.csv"
    table.write_text("品质,近义词,反义词\n有礼貌,懂事、孝顺,粗鲁\n勤奋,努力,懒惰、懈怠\n", encoding="utf8")
    built = dictionaries.build_dictionary(spark, str(table))
    assert rows(built, "kid", "keyword") == [("1", "有礼貌"), ("2", "勤奋")]
    text = dictionaries.dictionary_json(built).first()[0]
    assert json.loads(text) == {
        "1": {"keyword": "有礼貌", "synonyms": ["懂事", "孝顺"], "antonyms": ["粗鲁"]},
        "2": {"keyword": "勤奋", "synonyms": ["努力"], "antonyms": ["懒惰", "懈怠"]},
    }
    words = tmp_path / "stop.txt"
    words.write_text("的\n了 \n的\n")
    assert rows(dictionaries.read_stopwords(spark, str(words))) == [("了",), ("的",)]
    assert dictionaries.read_stopwords(spark, str(tmp_path / "none.txt")).count() == 0
    log = tmp_path / "log.txt"
    log.write_text("2022-01-01,51217197\n2022-01-02,3\n")
    assert dictionaries.read_line_counts(spark, str(log)).agg(F.sum("total_count")).first()[0] == 51217200


def test_days_round_trip(spark, tmp_path, plan):
    root = str(tmp_path / "days")
    df = spark.createDataFrame(
        [("2019-12-31", "a"), ("2020-01-01", "b"), ("2020-01-02", "c")], "dt STRING, v STRING"
    ).withColumn("dt", F.to_date("dt"))
    days.write_days(df, root)
    days.write_days(df.where("v = 'c'").withColumn("v", F.lit("d")), root)
    assert sorted(r.v for r in spark.read.parquet(root).collect()) == ["a", "b", "d"]
    ranged = days.read_days(spark, root, "2020-01-01", "2020-01-01")
    assert [r.v for r in ranged.collect()] == ["b"]
    assert "PartitionFilters: [isnotnull(dt" in plan(ranged)
    assert days.read_days(spark, root, year=2020).count() == 2
    other = str(tmp_path / "other")
    days.rewrite_days(spark, root, other, lambda d: d.where("v <> 'b'"))
    assert sorted(r.v for r in spark.read.parquet(other).collect()) == ["a", "d"]
    with pytest.raises(ValueError):
        days.rewrite_days(spark, root, root + "/", lambda d: d)


def test_flat_day_files(spark, tmp_path):
    import pandas as pd

    for name in ("2020-01-01", "2020-01-02", "2021-01-01", "2020-summary"):
        pd.DataFrame({"v": [name]}).to_parquet(tmp_path / f"{name}.parquet")
    got = days.read_day_files(spark, str(tmp_path))
    assert sorted((r.v, str(r.dt)) for r in got.collect()) == [
        (d, d) for d in ("2020-01-01", "2020-01-02", "2021-01-01")
    ]
    assert days.read_day_files(spark, str(tmp_path), 2020).count() == 2


def test_sinks(spark, tmp_path, rows):
    df = spark.createDataFrame(
        [(2020, "1", "甲\n乙"), (2021, "1", "甲\n乙"), (2020, "2", "丙"), (2020, "2", None)],
        "year INT, kid STRING, text STRING",
    )
    sinks.write_texts_by_key(df, str(tmp_path / "t"), ["year", "kid"], "text")
    merged = sinks.merge_years(spark, str(tmp_path / "t"), 2020, 2023)
    assert rows(merged.select(F.col("kid").cast("string"), "value")) == [
        ("1", "甲 乙"), ("1", "甲 乙"), ("2", "丙"),
    ]
    counts = spark.createDataFrame([("词", 3)], "word STRING, count LONG")
    sinks.write_table(counts.coalesce(1), str(tmp_path / "c"), "csv", mark=True)
    part = next((tmp_path / "c").glob("*.csv"))
    assert part.read_text(encoding="utf-8-sig") == "word,count\n词,3\n"
    assert part.read_bytes().startswith(b"\xef\xbb\xbf")
    for fmt in ("json", "parquet"):
        sinks.write_table(counts, str(tmp_path / fmt), fmt)
        assert rows(spark.read.format(fmt).load(str(tmp_path / fmt)), "word", "count") == [("词", 3)]
    with pytest.raises(ValueError):
        sinks.write_table(counts, str(tmp_path / "x"), "xlsx")
