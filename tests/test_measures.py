import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from topictide import terms as fixed
from topictide.operators import counts, dictionary, flags, share, trend
from topictide.sources.dictionaries import dictionary_frame

TOPICS = [
    (3, "2020-01-05", "甲", 10, 1), (1, "2020-01-09", "甲", 30, 1), (2, "2020-01-01", "甲", 30, 0),
    (4, "2020-02-01", "甲", 5, 1), (5, "2020-02-01", "乙", None, 1), (6, "2020-04-01", "丙", 0, 0),
    (7, "2021-09-01", "丁", 100, 0),
]


@pytest.fixture
def topics(spark):
    return spark.createDataFrame(
        TOPICS, "timestamp INT, date STRING, text STRING, hot LONG, flag INT"
    ).withColumn("date", F.to_date("date"))


def shares(df):
    return {r.period: (r.flagged, r.total, r.proportion) for r in df.collect()}


def test_additive_share(topics):
    assert shares(share.flag_share(topics, "year")) == {
        "2020": (4, 6, 4 / 6), "2021": (0, 1, 0.0),
    }
    monthly = shares(share.flag_share(topics, "month", exclude=["2021-09"]))
    assert monthly == {"2020-01": (2, 3, 2 / 3), "2020-02": (2, 2, 1.0), "2020-04": (0, 1, 0.0)}


def test_weighted_share_adds_up_the_months(topics):
    # January keeps the first of the two rows of heat 30 (timestamp 1, flagged).
    assert shares(share.flag_share(topics, "year", "weighted")) == {
        "2020": (35, 35, 1.0), "2021": (0, 100, 0.0),
    }
    quarters = shares(share.flag_share(topics, "quarter", "weighted"))
    assert quarters == {
        "2020-1-3": (35, 35, 1.0), "2020-4-6": (0, 0, 0.0), "2021-7-9": (0, 100, 0.0),
    }
    assert shares(share.flag_share(topics, "month", "weighted", cutoff=10)) == {
        "2020-01": (30, 30, 1.0), "2021-09": (0, 100, 0.0),
    }
    with pytest.raises(ValueError):
        share.flag_share(topics, "week")
    with pytest.raises(ValueError):
        share.flag_share(topics, mode="median")


def test_share_does_not_depend_on_partitioning(topics):
    spread = topics.repartition(5, "text").union(topics.limit(0))
    assert shares(share.flag_share(spread, "quarter", "weighted")) == shares(
        share.flag_share(topics.coalesce(1), "quarter", "weighted")
    )


def test_other_shares(topics):
    assert share.missing_share(topics).first()[0] == pytest.approx(1 / 7)
    yearly = {r.year: (r.flagged, r.total) for r in share.yearly_flagged_share(topics).collect()}
    assert yearly == {"2020": (4, 6), "2021": (0, 1)}
    assert flags.flagged_with_heat(topics).count() == 3
    assert flags.hot_enough(topics, 30).count() == 3


def test_row_counts(spark, rows):
    df = spark.createDataFrame([("2020-01-01",)] * 3 + [("2021-05-01",)], "dt STRING")
    got = counts.row_counts(df)
    assert rows(got.select("year", F.col("dt").cast("string"), "row_count")) == sorted([
        ("2020", "2020-01-01", 3), ("2020", None, 3), ("2021", "2021-05-01", 1),
        ("2021", None, 1), (None, None, 4),
    ], key=str)
    assert counts.line_counts(df).count() == 2


WORDS = ["独立", "自主", "努力", "教养", "有担当", "暖心", "女儿", "养娃", "//", "天气"]


@pytest.fixture
def posts(spark):
    rng = random.Random(5)
    made = []
    for i in range(300):
        text = "".join(rng.choice(WORDS) for _ in range(rng.randint(1, 6)))
        day = f"20{rng.choice([17, 18])}-{rng.randint(1, 12):02d}-0{rng.randint(1, 3)}"
        made.append((day, f"w{i % 250}", rng.choice(["0", "1"]), text))
    return made


@pytest.fixture
def frames(spark, posts):
    df = spark.createDataFrame(posts, "dt STRING, weibo_id STRING, is_retweet STRING, "
                                      "weibo_content STRING").withColumn("dt", F.to_date("dt"))
    days = sorted({p[0] for p in posts if p[0] > "2017-01-02"}) + ["2018-12-09"]
    log = spark.createDataFrame([(d, 1000 + i) for i, d in enumerate(days)], "dt STRING, n LONG")
    return df, log.select(F.to_date("dt").alias("dt"), F.col("n").alias("total_count")), days


def python_daily(posts, days, originals=False, every=False):
    quality = {w: q for q, words in fixed.TREND_TERMS.items() for w in words}
    kept = [p for p in posts if any(c in p[3] for c in fixed.CHILD_TERMS)]
    if originals:
        kept = [p for p in kept if p[2] == "0"]
    with_posts = {p[0] for p in kept}
    out = {}
    for n, day in enumerate(days):
        if not every and day not in with_posts:
            continue
        for word, q in quality.items():
            hits = sum(word in p[3].split("//")[0] for p in kept if p[0] == day)
            out[day, word] = (q, hits, 1000 + n)
    return out


def test_daily_term_counts(frames, posts, monkeypatch):
    df, log, days = frames
    rows = trend.child_posts(df, fixed.CHILD_TERMS)

    def got(**options):
        daily = trend.daily_term_counts(rows, log, fixed.TREND_TERMS, **options)
        return {(str(r.dt), r.keyword): (r.quality, r["count"], r.total_count)
                for r in daily.collect()}

    for limit in (128, 3):
        monkeypatch.setattr(trend, "SCAN_TERMS", limit)
        assert got() == python_daily(posts, days)
        assert got(all_logged_days=True) == python_daily(posts, days, every=True)
        assert got(originals_only=True) == python_daily(posts, days, originals=True)


def test_distinct_posts_count_once(spark):
    df = spark.createDataFrame(
        [("2020-01-01", "a", "0", "独立女儿")] * 3, "dt STRING, weibo_id STRING, "
        "is_retweet STRING, original_weibo_content STRING").withColumn("dt", F.to_date("dt"))
    log = df.select("dt").distinct().withColumn("total_count", F.lit(9))
    for once, expected in ((False, 3), (True, 1)):
        daily = trend.daily_term_counts(df, log, {"q": ["独立"]}, distinct_posts=once)
        assert daily.first()["count"] == expected


def test_trends(frames, posts):
    df, log, days = frames
    daily = trend.daily_term_counts(
        trend.child_posts(df, fixed.CHILD_TERMS), log, fixed.TREND_TERMS
    )
    facts = python_daily(posts, days)
    for grain, width in (("month", 7), ("year", 4)):
        totals = defaultdict(int)
        for n, day in enumerate(days):
            totals[day[:width]] += 1000 + n
        for by in ("keyword", "quality"):
            sums = Counter()
            for (day, word), (q, hits, _) in facts.items():
                sums[day[:width], word if by == "keyword" else q] += hits
            got = trend.term_trend(daily, log, grain, by).collect()
            assert {(r.period, r[by]): (r.frequency, r.period_total_count) for r in got} == {
                key: (n, totals[key[0]]) for key, n in sums.items()
            }
            assert all(r.proportion == r.frequency / r.period_total_count for r in got)
    yearly = trend.term_trend(daily, log, "year", "quality")
    mix = trend.share_within(yearly, exclude=["2018"])
    assert {r.period for r in mix.collect()} == {"2017"}
    assert mix.agg(F.sum("share")).first()[0] == pytest.approx(1.0)
    wide = trend.pivot_shares(mix, [*fixed.TREND_TERMS, "无"])
    assert wide.first()["无"] == 0.0


ENTRIES = {
    "1": {"keyword": "礼", "synonyms": ["懂事", "宽容"], "antonyms": ["粗鲁"]},
    "2": {"keyword": "从", "synonyms": ["懂事", "听话"], "antonyms": ["不宽容", "叛逆"]},
}
TEXTS = ["懂事的孩子//听话", "不宽容", "听话听话", "懂事的孩子//别的", "无", "叛逆粗鲁听话"]


@pytest.mark.parametrize("limit", [128, 2])
def test_dictionary(spark, monkeypatch, limit):
    monkeypatch.setattr(dictionary, "SCAN_TERMS", limit)
    known = dictionary_frame(spark, ENTRIES)
    posts = spark.createDataFrame([(2020, t) for t in TEXTS], "year INT, weibo_content STRING")
    texts, plain, weighted = defaultdict(set), Counter(), Counter()
    every = {t for e in ENTRIES.values() for t in e["synonyms"] + e["antonyms"]}
    for text in TEXTS:
        own = text.split("//")[0]
        for kid, entry in ENTRIES.items():
            if any(t in own for t in entry["synonyms"] + entry["antonyms"]):
                texts[kid].add(own)
                weighted.update(t for t in every if t in own)
        plain.update(t for t in every if t in own)
    got = dictionary.texts_by_quality(posts, known)
    assert sorted((r.kid, r.text) for r in got.collect()) == sorted(
        (k, t) for k, ts in texts.items() for t in ts
    )
    for flag, expected in ((True, weighted), (False, plain)):
        made = dictionary.term_counts(posts, known, weighted=flag)
        assert {r.term: r["count"] for r in made.collect()} == expected
    merged = dictionary.merge_counts(made, made)
    described = dictionary.describe_terms(merged, known)
    assert {r.term: (r.qualities, r["count"]) for r in described.collect()}["懂事"] == (
        "从、礼", 2 * plain["懂事"],
    )
