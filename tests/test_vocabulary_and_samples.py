import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from topictide.functions import word_tokens
from topictide.lineage import split_join
from topictide.operators import rank, sample, vocabulary
from topictide.operators.rank import key_digest


def test_word_counts_and_frequency(spark):
    lines = ["aa bb aa", "aa cc", "zz", None]
    df = spark.createDataFrame([(t,) for t in lines], "t STRING")
    stop = spark.createDataFrame([("zz",)], "word STRING")
    counts = vocabulary.word_counts(df, word_tokens("t"), stopwords=stop)
    assert {r.word: r["count"] for r in counts.collect()} == {"aa": 3, "bb": 1, "cc": 1}
    only = spark.createDataFrame([("cc",), ("cc",)], "word STRING")
    assert [r.word for r in vocabulary.word_counts(df, word_tokens("t"), whitelist=only).collect()
            ] == ["cc"]
    frequent = vocabulary.frequent_words(counts, df, 0.25)
    assert [r.word for r in frequent.collect()] == ["aa"]
    assert {r.word for r in vocabulary.frequent_words(counts, df, 0.33, text="t").collect()} == {
        "aa", "bb", "cc"}


def test_word_frequency_cleans_and_groups(spark):
    text = "孩子 学习，孩子 努力！今天 的 孩子 真 好"
    df = spark.createDataFrame([("1", text), ("1", "短"), ("2", text)], "kid STRING, text STRING")
    got = vocabulary.word_frequency(df, "text", ["kid"], share=1.5)
    assert sorted((r.kid, r.word, r["count"]) for r in got.collect()) == [
        ("1", "孩子", 3), ("2", "孩子", 3),
    ]


def test_vocabulary_of_unspaced_text(spark):
    words = vocabulary.domain_vocabulary(["亲子教育", "孩子"])
    assert words == ["孩子", "鸡娃", "双减", "亲子", "教育"]
    df = spark.createDataFrame([("鸡娃鸡娃双减",), ("孩子鸡娃",), (None,)], "text STRING")
    known = spark.createDataFrame([(w,) for w in words], "word STRING")
    got = vocabulary.vocabulary_counts(df, known)
    assert {r.word: r["count"] for r in got.collect()} == {"鸡娃": 3, "双减": 1, "孩子": 1}


@pytest.mark.parametrize("share,n", [(0.1, 50), (0.0001, 1), (1.0, 500)])
def test_top_share_equals_a_full_sort(spark, share, n):
    words = [(f"w{i}", (i * i) % 7 + (100 if i < 5 else 0)) for i in range(500)]
    df = spark.createDataFrame(words, "word STRING, count LONG").repartition(5)
    order = sorted(words, key=lambda w: (-w[1], hashlib.md5(f"0|{w[0]}".encode()).hexdigest()))
    got = vocabulary.top_share(df, share).collect()
    assert {r.word for r in got} == {w for w, _ in order[:n]}


def test_smallest_digests_equal_a_sort_per_group(spark, monkeypatch):
    monkeypatch.setattr(rank, "BUCKET_DIGITS", 1)
    rows = [("big" if i % 3 else f"g{i % 4}", i) for i in range(600)]
    df = spark.createDataFrame(rows, "g STRING, i INT")
    for quota in (0, 1, 17, 10_000):
        got = rank.smallest_digests(df.repartition(9), "g", ["i"],
                                    lambda n, _, q=quota: F.least(n, F.lit(q)), seed=3)
        expected = set()
        for g in {r[0] for r in rows}:
            ids = sorted((i for name, i in rows if name == g),
                         key=lambda i: hashlib.md5(f"3|{i}".encode()).hexdigest())
            expected |= {(g, i) for i in ids[:quota]}
        assert {(r.g, r.i) for r in got.collect()} == expected
        if quota <= rank.GROUP_LIMIT:
            first = rank.first_digests(df, "g", ["i"], quota, seed=3)
            assert {(r.g, r.i) for r in first.collect()} == expected


def test_group_limits_apply_before_the_shuffle(spark, plan):
    df = spark.createDataFrame([("a", 1)], "g STRING, i INT")
    assert plan(rank.first_digests(df, "g", ["i"], 300)).count("Partial") == 2
    with pytest.raises(ValueError):
        rank.first_digests(df, "g", ["i"], 1001)


def test_sample_per_group_is_seeded_and_complete(spark):
    df = spark.createDataFrame([("a", i) for i in range(100)] + [("b", 1), ("b", 2)],
                               "m STRING, i INT")
    got = sample.sample_per_group(df, "m", ["i"], 10, seed=1).collect()
    assert Counter(r.m for r in got) == {"a": 10, "b": 2}
    again = sample.sample_per_group(df.repartition(7), "m", ["i"], 10, seed=1).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    other = sample.sample_per_group(df, "m", ["i"], 10, seed=2).collect()
    assert sorted(map(tuple, got)) != sorted(map(tuple, other))
    many = sample.sample_per_group(df, "m", ["i"], 80, seed=1).collect()
    draws = {(r.m, r.draw): r.i for r in many}
    assert Counter(m for m, _ in draws) == {"a": 80, "b": 2}
    assert len(set(draws.values())) < 80  # with replacement
    assert all(draws[r.m, r.draw] == r.i for r in got)


def test_sample_proportional(spark):
    sizes = {"d1": 10, "d2": 25, "d3": 65}
    df = spark.createDataFrame([(d, i) for d, n in sizes.items() for i in range(n)],
                               "dt STRING, i INT")

    def count(**options):
        got = sample.sample_proportional(df, ["i"], **options)
        assert got.distinct().count() == got.count()
        return Counter(r.dt for r in got.collect())

    assert count(total=10) == {"d1": 1, "d2": 2, "d3": 6}  # 2.5 and 6.5 to even
    assert count(total=10, counted=1000) == {d: round(0.01 * n) for d, n in sizes.items()
                                             if round(0.01 * n)}
    assert count(total=10_000) == sizes


def test_sample_matching(spark):
    df = spark.createDataFrame([("d1", i, "努力") for i in range(9)] + [("d1", 99, "无")],
                               "dt STRING, i INT, weibo_content STRING")
    assert sample.sample_matching(df, "努力", ["i"], 4).count() == 4
    assert sample.sample_matching(df, ["努力", "无"], ["i"], 300).count() == 10
    assert sample.sample_matching(df, "努力", ["i"], 2000).count() == 9


def test_split_join_equals_a_join(spark):
    big = spark.createDataFrame([(i % 3 if i % 2 else 0, i) for i in range(200)], "k INT, v INT")
    small = spark.createDataFrame([(0, "a"), (1, "b"), (9, "c")], "k INT, w STRING")
    for how in ("inner", "left"):
        expected = sorted(map(tuple, big.join(small, "k", how).collect()))
        for hot in (10, 50, 10_000):
            got = split_join(big, small, "k", how, hot_rows=hot)
            assert sorted(map(tuple, got.collect())) == expected


def test_draws_use_hash_tables_and_keys_stay_apart(spark, plan, rows):
    df = spark.createDataFrame(
        [(None, "a", 1), ("a", None, 1), ("a|", "b", 1), ("a", "|b", 1)]
        + [(str(i), None, None) for i in range(30)], "k STRING, l STRING, g LONG")
    digests = df.select(key_digest(["k", "l"]).alias("d"))
    assert digests.distinct().count() == df.count()
    drawn = sample.sample_per_group(df, "g", ["k", "l"], 60, seed=3)
    sizes = {r.g: r["count"] for r in drawn.groupBy("g").count().collect()}
    assert sizes == {1: 4, None: 30}  # the null group has its draws as well
    assert "SortAggregate" not in plan(drawn)
    each = sample.sample_each_term(df, ["a", "1"], ["k", "l"], 2, text="k", group="g")
    assert rows(each.groupBy("g", "term").count()) == sorted(
        [(1, "a", 2), (None, "1", 2)], key=str)
    large = sample.sample_each_term(df, ["a", "1"], ["k", "l"], 1001, text="k", group="g")
    assert large.count() == df.where("contains(k, 'a') or contains(k, '1')").count()
