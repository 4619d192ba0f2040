"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import pandas as pd
import pytest

from formloom.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def rows(df):
    def cell(x):
        if not isinstance(x, (list, dict)) and pd.isna(x):
            return "~"
        if isinstance(x, bool) or str(getattr(x, "dtype", "")) == "bool":
            return str(bool(x))
        try:
            return f"{float(x):.6f}" if not isinstance(x, str) else x
        except (TypeError, ValueError):
            return str(x)

    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0
    assert df.columns[0] == "field_name"
