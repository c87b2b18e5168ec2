"""Registered queries against their SQL, on the smallest tables."""

import os

import numpy as np
import pandas as pd
import pytest

import __spark_entry__
from marlstone.plans import registry
from marlstone.plans.roles import role

HERE = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(HERE), reason="no tables")


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(HERE):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{HERE}/{f}'")
    return c


def rows(df):
    def plain(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return "null"
        return repr(round(float(v), 6) + 0.0) if isinstance(v, (float, int, np.number)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_its_sql(spark, con, name):
    got, want = registry.QUERIES[name](spark, HERE).toPandas(), con.sql(registry.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names) and set(registry.QUERIES) <= set(names)


def test_whole_matrix_and_all_runs(spark):
    preds = role(spark, HERE, "preds").cache()
    snr = {str(r["snr"]) for r in preds.select("snr").distinct().collect()}
    assert set(registry.QUERIES["mt35_condition_matrix_all_snr"](spark, HERE).columns) == snr | {"dur"}
    rows = registry.QUERIES["io07_union_predictions_all_runs"](spark, HERE).collect()
    assert {r["run"] for r in rows} == {f"run_{r['run']}" for r in preds.select("run").distinct().collect()}
    assert sum(r["n"] for r in rows) == preds.count()
