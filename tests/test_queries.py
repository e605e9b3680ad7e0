"""Every registered core query gives the rows of its SQL twin."""

import duckdb
import pytest

from corvid import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query_matches_sql(spark, sf_dir, db, name):
    df = queries.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    sql = queries.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    rel = db.sql(sql)
    assert sorted(rel.columns) == cols
    want = [tuple(r[rel.columns.index(c)] for c in cols) for r in rel.fetchall()]
    assert ordered(got) == ordered(want)


def test_topk_is_partial_and_filters_stay_above_the_limit(spark, sf_dir):
    plan = lambda n: queries.queries()[n](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan("vec_topk")
    assert "Exchange" not in plan("vec_topk")
    over = queries.queries()["vec_topk_overfetch_filter"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert over.index("Filter") < over.index("GlobalLimit 40")


def test_merged_intervals_with_ties_and_nulls(spark, tmp_path):
    """Equal intervals, and rows without a quantity or a line; DuckDB with one thread, since its SQL leaves the order of equal rows open."""
    name, schema = "interval_merge_uncapped", "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double"
    odd = [(1, None), (1, 30.0), (1, 30.0), (4, None), (4, None), (4, 20.0), (None, 10.0), (None, None), (9, 10.0), (9, None)]
    rows = [(file, k, k, line, quantity) for file in range(40) for k, (line, quantity) in enumerate(odd[file % 5 :])]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.sql("SET threads = 1")
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    df = queries.queries()[name](spark, str(tmp_path))
    assert ordered(tuple(r) for r in df.collect()) == ordered(con.sql(queries.oracle_sql()[name]).fetchall())
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Sort [") == 1 and plan.count("Window [") == 2
