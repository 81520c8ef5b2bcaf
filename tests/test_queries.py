"""Every registered query against its SQL on the same tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from corvane.plans import registry
from tests.conftest import DATA


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        try:
            df[c] = pd.to_numeric(df[c]).astype(float)
        except (ValueError, TypeError):
            df[c] = df[c].astype(str).replace({"None": "nan", "<NA>": "nan"})
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, duck, name):
    got = canonical(registry.queries()[name](spark, sf_dir).toPandas())
    want = canonical(duck.sql(registry.oracle_sql()[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
