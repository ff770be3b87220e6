"""Running numbers against plain enumeration."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from topictide.operators.numbering import numbered


def people(spark, n=500, seed=3):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "a", "a", None, "b", "c"]), rng.randint(0, 40), i) for i in range(n)]
    return rows, spark.createDataFrame(rows, "g string, x int, k int").repartition(7)


def test_global_numbers(spark):
    rows, df = people(spark)
    got = [tuple(r) for r in numbered(df, ["x", "k"]).select("x", "k", "n").orderBy("n").collect()]
    assert got == [(x, k, i + 1) for i, (x, k) in enumerate(sorted((x, k) for _, x, k in rows))]


def test_numbers_within_groups_and_sums(spark):
    rows, df = people(spark)
    got = {r.k: (r.n, r.upto) for r in numbered(numbered(df, ["x", "k"], ["g"]), ["x", "k"], ["g"], "upto", "x").collect()}
    groups = defaultdict(list)
    for g, x, k in rows:
        groups[g].append((x, k))
    for members in groups.values():
        total = 0
        for i, (x, k) in enumerate(sorted(members)):
            total += x
            assert got[k] == (i + 1, total)


def test_equal_rows_and_empty_tables(spark):
    same = spark.range(300).select(F.lit(1).alias("x"), F.lit(None).cast("string").alias("g")).repartition(5)
    assert sorted(r.n for r in numbered(same, ["x"], ["g"]).collect()) == list(range(1, 301))
    assert numbered(same.limit(0), ["x"]).collect() == []


def test_a_hot_group_lies_in_many_ranges(spark):
    df = spark.range(4000).select(F.lit("hot").alias("g"), F.col("id").alias("x"))
    out = numbered(df, ["x"], ["g"])
    assert out.where(F.col("n") != F.col("x") + 1).count() == 0


@pytest.mark.parametrize("descending", [False, True])
def test_order_may_descend(spark, descending):
    df = spark.range(50).withColumnRenamed("id", "x")
    order = F.col("x").desc() if descending else F.col("x")
    got = [r.x for r in numbered(df, [order]).orderBy("n").collect()]
    assert got == sorted(range(50), reverse=descending)
