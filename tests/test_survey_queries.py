"""Survey queries against their DuckDB oracle on the smallest tables."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from skyweave.plans import registry
from skyweave.plans.fixtures import TABLES

SF = "/root/testdata/sf0.001"
ORACLES = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def canonical(frame: pd.DataFrame) -> list:
    def one(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return None
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        if isinstance(v, (int, float, np.number)):
            return f"{float(v):.8g}"
        return str(list(v)) if isinstance(v, (list, np.ndarray)) else str(v)

    return sorted((tuple(map(one, r)) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    want = duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(ORACLES)))
def test_other_queries_give_rows(spark, name):
    assert registry.queries()[name](spark, SF).limit(5).count() > 0
