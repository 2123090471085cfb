"""Every registered query of this part against its SQL on the small tables, and some plans."""

import os

import pytest

from quern import queries

SF = os.environ.get("QUERN_TEST_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents labels".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_agrees_with_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = sorted(tuple(str(r[c]) for c in columns) for r in df.collect())
    result = duck.execute(queries.SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert found == sorted(tuple(str(dict(zip(names, r))[c]) for c in columns) for r in result.fetchall())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_plans(spark):
    plan = plan_of(queries.QUERIES["sel_and"](spark, SF))
    assert plan.count("Scan parquet") == 1 and "EqualTo(o_orderstatus,F)" in plan  # one scan, the filters pushed to it
    assert "o_orderdate" not in plan.split("ReadSchema")[1].split("\n")[0]  # columns that nobody needs are not read
    plan = plan_of(queries.QUERIES["sel_fwd4"](spark, SF))
    assert plan.count("LeftSemi") == 4 and "CartesianProduct" not in plan and "Python" not in plan
