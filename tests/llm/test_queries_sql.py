"""Registered queries against their SQL on the benchmark tables."""

import pandas as pd
import pytest

from topictide.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_equal_sql(spark, folder, duck, name):
    got, want = QUERIES[name](spark, folder).toPandas(), duck.sql(ORACLES[name]).df()
    names = sorted(want)
    assert sorted(got) == names
    # Whole numbers with nulls come as floats on one side only.
    want = want.astype({c: "float64" for c in names if str(want[c].dtype) == "Int64"})
    order = lambda f: f[names].astype(str).sort_values(names).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(got), order(want))


def test_every_operator_has_one_query():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
