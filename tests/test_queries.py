"""Registered queries against DuckDB on the smallest tables, and the shape of plans."""

import datetime
import glob
import os

import pytest

duckdb = pytest.importorskip("duckdb")

from tessella import queries  # noqa: E402

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else v


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_duckdb(spark, con, name):
    df = queries.queries()[name](spark, DIR)
    found = con.execute(queries.oracle_sql()[name])
    names, types = [c[0] for c in found.description], {c[0]: str(c[1]) for c in found.description}
    assert sorted(df.columns) == sorted(names)
    assert {c: TYPES[t] for c, t in df.dtypes} == types
    want = sorted((tuple(map(plain, r)) for r in found.fetchall()), key=repr)
    assert sorted((tuple(map(plain, r)) for r in df.select(*names).collect()), key=repr) == want


def test_every_query_but_those_without_sql_is_compared():
    assert set(queries.queries()) == set(queries.oracle_sql())


@pytest.mark.parametrize(
    ("name", "there", "absent"),
    [
        ("semi_exists", "LeftSemi", "CartesianProduct"), ("anti_not_exists", "LeftAnti", "CartesianProduct"), ("dict_every", "LeftSemi", "Window"), ("topk", "TakeOrderedAndProject", "Python"),
        ("vec_knn", "TakeOrderedAndProject", "Python"), ("scan_project", "PushedFilters: [IsNotNull(c_acctbal), GreaterThan(c_acctbal,9000.0)]", "c_mktsegment"), ("count_distinct_root", "LeftSemi", "Cartesian"),
    ],
)
def test_plans(spark, name, there, absent):
    plan = queries.queries()[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert there in plan and absent not in plan
