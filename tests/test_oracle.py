"""Every registered query of the key-value engine against its SQL in DuckDB."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from seqlake.plans import queries as registered

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return connection


def rows(frame: pd.DataFrame) -> list:
    columns = sorted(frame.columns)
    clean = frame[columns].astype(object).where(frame[columns].notna(), None)
    return sorted((tuple(int(x) if isinstance(x, float) else x for x in r) for r in clean.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(registered.queries()))
def test_equals_sql(spark, oracle, name):
    ours = registered.queries()[name](spark, SF).toPandas()
    theirs = oracle.execute(registered.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
