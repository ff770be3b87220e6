import re
import unicodedata

from pyspark.sql import functions as F

from topictide import functions as fn

POSTS = [
    "短句",
    "给自己设立一个目标，给自己未来一个明确的希望，给自己的生活一个方向灯。早安! ",
    "转发微博 http://t.cn/h5gw6 看看这个孩子今天真的很努力啊 “好”…",
    "点击链接查看更多->孩子们今天在学校里学会了很多东西",
    "  带空格的句子　　孩子们今天在学校里学会了  ",
    "abcdefghijklmnop",
    "第一行\n第二行孩子们今天都很开心地回家了",
    "#话题#@某人:回复孩子们今天都很开心地回家了!!",
]


def clean_in_python(text):
    """The cleaning rules restated, second deletion included."""
    if len(text) < 10:
        return None
    for literal in ("“", "”", "…", "点击链接查看更多->"):
        text = text.replace(literal, "")
    text = re.sub(r"[a-zA-Z0-9.?/&=:_%,-~#《》]", "", text)
    text = re.sub(r"[//@].*?[:]", "", text, flags=re.S)
    text = text.replace("\n", " ").strip()
    return text if len(text) >= 10 else None


def test_clean_post_follows_the_rules(spark):
    df = spark.createDataFrame([(p,) for p in POSTS], "text STRING")
    got = [tuple(r) for r in df.select("text", fn.clean_post("text")).collect()]
    assert got == [(p, clean_in_python(p)) for p in POSTS]
    assert spark.createDataFrame([(None,)], "t STRING").select(fn.clean_post("t")).first()[0] is None


def test_clean_for_words(spark):
    samples = [
        "看 https://a.b/c?d=e 好@某人_1 说#话题#吧!?，。", "½²①_x é", None, "a\x1cb　c", "٣ #a b# c",
    ]
    df = spark.createDataFrame([(s,) for s in samples], "t STRING")

    def python(text):
        if text is None:
            return ""
        text = re.sub(r"(https?://\S+|@\w+|#\w+#)", "", text)
        return re.sub(r"[^\w一-鿿，。！？]", "", text).strip()

    got = [r[0] for r in df.select(fn.clean_for_words("t")).collect()]
    assert got == [python(s) for s in samples]


def test_strip_matches_python_for_every_space(spark):
    points = [p for p in range(0x3100) if not 0xD800 <= p <= 0xDFFF and p]
    texts = [chr(p) + "x" + chr(p) for p in points]
    df = spark.createDataFrame(list(enumerate(texts)), "i INT, t STRING")
    got = dict((r[0], r[1]) for r in df.select("i", fn.strip("t")).collect())
    wrong = [hex(points[i]) for i, t in enumerate(texts) if got[i] != t.strip()]
    assert wrong == []
    assert unicodedata.category("　") == "Zs"


def test_contents(spark):
    df = spark.createDataFrame(
        [("a\nb", "r", "0"), ("a", "r\ns", "1"), ("see http://x", None, "0"), ("a", None, "1")],
        "c STRING, r STRING, f STRING",
    )
    full = df.select(fn.full_content("c", "r", "f").alias("c"))
    assert [r[0] for r in full.collect()] == ["a b", "a//r s", "see http://x", None]
    assert [r[0] for r in full.select(fn.own_content("c")).collect()] == [
        "a b", "a", "see http:", None,
    ]


def test_heat(spark):
    df = spark.createDataFrame(
        [("1234567",), ("剧集 88123 和 5",), ("无",), (None,), ("9" * 30,)], "x STRING"
    )
    assert [r[0] for r in df.select(fn.heat("x")).collect()] == [1234567, 88123, None, None, None]


def test_tokens(spark):
    df = spark.createDataFrame([("the other, a 亲子教育鸡娃",)], "t STRING")
    assert df.select(fn.word_tokens("t", 2, 5)).first()[0] == ["the", "other"]
    words = ["亲子", "教育", "亲子教育", "鸡娃", "a"]
    assert df.select(fn.vocabulary_tokens("t", words)).first()[0] == ["a", "亲子教育", "鸡娃"]


def test_rules(spark):
    df = spark.createDataFrame(
        [(1, "孩子爱学习"), (2, "学习 孩子"), (3, "孩子\n学习"), (4, "家长会"), (5, "天气")],
        "i INT, t STRING",
    )
    rules = ["家长", "孩子&学习"]
    flat = df.where(fn.match_rules("t", rules)).select("i")
    lines = df.where(fn.match_rules("t", rules, multiline=True)).select("i")
    assert [r[0] for r in flat.collect()] == [1, 2, 3, 4]
    pattern = "|".join("".join(f"(?=.*{w})" for w in rule.split("&")) for rule in rules)
    expected = [r[0] for r in df.collect() if re.search(pattern, r[1])]
    assert [r[0] for r in lines.collect()] == expected == [1, 2, 4]


def test_exclusion_and_saving_words(spark):
    from topictide import terms

    df = spark.createDataFrame(
        [("见了新家长",), ("医务人员子女",), ("医护护子女",), ("女友",), ("家长会",)], "t STRING"
    )
    hit = fn.matches_excluded("t", terms.EXCLUDED_WORDS, terms.EXCLUDED_PATTERNS)
    assert [r[0] for r in df.select(hit).collect()] == [True, True, True, True, False]
    topics = spark.createDataFrame(
        [("熊孩子上网",), ("熊孩子和妈妈",), ("上学",)], "t STRING"
    ).withColumn("flag", F.lit(1))
    kept = fn.conditional_keep("flag", "t", terms.TRIGGER_WORDS, terms.SAVING_WORDS)
    assert [r[0] for r in topics.select(kept).collect()] == [0, 1, 1]


def test_periods(spark):
    df = fn.day_list(spark, "2020-01-31", "2020-12-31")
    assert df.count() == 336 and df.where("dt = date '2020-02-29'").count() == 1
    labels = df.where("dt = date '2020-11-05'").select(
        fn.month_of("dt"), fn.quarter_of("dt"), fn.year_of("dt")
    ).first()
    assert tuple(labels) == ("2020-11", "2020-10-12", "2020")
    from topictide.functions.periods import half_year

    assert half_year(2020, 0) == ("2020-01-01", "2020-06-30")
    assert half_year(2020, 1) == ("2020-07-01", "2020-12-31")
    assert half_year(2020, 2) == ("2020-01-01", "2020-12-31")
    ratio = spark.range(1).select(
        fn.safe_ratio(F.lit(1), F.lit(0)), fn.safe_ratio(F.lit(1), F.lit(4))
    ).first()
    assert tuple(ratio) == (0.0, 0.25)


def test_fixed_lists():
    from topictide import terms

    assert len(terms.TOPIC_RULES) == 42 and len(terms.STRICT_TOPIC_RULES) == 25
    assert len(terms.RETRACTED_TITLES) == 130 and len(set(terms.RETRACTED_TITLES)) == 123
    assert len(terms.CHILD_TERMS) == 9 and len(terms.EXTRACTION_TERMS) == 37
    trend = [w for words in terms.TREND_TERMS.values() for w in words]
    assert len(trend) == 36 and set(terms.EXTRACTION_TERMS) - set(trend) == {"携带"}
    listed = [w for e in terms.QUALITY_DICTIONARY.values() for w in e["synonyms"] + e["antonyms"]]
    assert len(listed) == 92 and len(set(listed)) == 89
