"""Every registered reference query against its DuckDB oracle at the smallest scale."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"
NAMES = [k for m in __spark_entry__.MODULES for k in m.QUERIES]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for f in os.listdir(DATA):
        if f.endswith(".parquet"):
            c.sql(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    return c


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return "~"
    if not isinstance(v, bool) and type(v).__name__ in ("int", "float", "Decimal", "float64", "int64", "int32"):
        return round(float(v), 6)
    return str(v).replace("+00:00", "")


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, DATA).toPandas()
    want = duck.sql(__spark_entry__.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["bin", "spans", "errors", "p95", "p50"]


def test_llm_is_optional():
    import subprocess
    import sys

    code = "import sys; sys.modules['tallywright.llm'] = None\nimport __spark_entry__ as e\nassert not [k for k in e.queries() if k.startswith('op')] and len(e.queries()) > 90"
    r = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True)
    assert r.returncode == 0, r.stderr
