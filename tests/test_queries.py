"""The query catalogue against DuckDB on a small scale: same columns, same rows."""

import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from branchframe.engine import database
from branchframe.operators import lookup
from branchframe.plans.queries import ORACLE, QUERIES
from tests.conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def tidy(value):
    if value is None or value is pd.NA or (isinstance(value, float) and value != value):
        return None
    kind = type(value).__name__
    if "bool" in kind:
        return bool(value)
    if "int" in kind:
        return int(value)
    if "float" in kind:
        return int(value) if float(value).is_integer() else round(float(value), 9)
    return str(value)


def rows_of(frame, columns):
    return sorted(str(tuple(map(tidy, r))) for r in frame[columns].astype(object).itertuples(index=False))


def compare(frame, sql, data=DATA):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{data}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    got, want = frame.toPandas(), con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert rows_of(got, columns) == rows_of(want, columns)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_its_sql(spark, name):
    compare(QUERIES[name](spark, DATA), ORACLE[name])


def test_merge_needs_one_exchange(spark):
    plan = QUERIES["table_merge_clean"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_filters_reach_the_scan(spark):
    plan = QUERIES["table_point_get"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c_custkey,42)" in plan


def test_every_fifth_part_has_a_cell_over_the_limit(spark, monkeypatch):
    monkeypatch.setattr(lookup, "violations", lambda _: F.octet_length("note"))
    sizes = QUERIES["cell_limits"](spark, DATA).collect()
    assert len(sizes) > 100 and all(r["bad"] == ((1 << 20) - 2 if r["p_partkey"] % 5 == 4 else 1) for r in sizes)


def test_all_conflicts_have_a_location_however_many(spark, monkeypatch):
    monkeypatch.setattr(database, "MAX_CONFLICTS", 3)
    compare(QUERIES["engine_conflict_locations"](spark, DATA), ORACLE["engine_conflict_locations"])


def test_an_abort_leaves_ours_however_many_conflicts(spark, monkeypatch):
    monkeypatch.setattr(database, "MAX_CONFLICTS", 3)
    compare(QUERIES["engine_merge_abort"](spark, DATA), ORACLE["engine_merge_abort"])
