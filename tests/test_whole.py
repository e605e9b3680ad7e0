"""Queries read every row of their tables; their rows are held against SQL in test_queries."""

import pytest

from corvid import queries


@pytest.mark.parametrize("name, key", [("resolve_edges", "edge_id"), ("incremental_resolve", "in_fqn")])
def test_every_order_is_resolved(spark, sf_dir, name, key):
    rows = queries.queries()[name](spark, sf_dir).selectExpr(f"split({key}, ':')[0] AS o")
    orders = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("cast(l_orderkey AS string) AS o")
    assert orders.count() == rows.count()
    assert not orders.distinct().exceptAll(rows.distinct()).count()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_has_no_slice_of_the_orders(name):
    assert "WHERE l_orderkey %" not in queries.oracle_sql()[name]


def test_every_file_is_merged(spark, sf_dir):
    files = {r.file for r in queries.queries()["interval_merge_capped"](spark, sf_dir).collect()}
    orders = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_orderkey % 50 AS f").distinct()
    assert files == {f"f{r.f}.py" for r in orders.collect()}


@pytest.mark.parametrize("name, key, of", [("deepest_enclosing", "file", "true"), ("first_overlap", "split(id, ':')[0]", "l_quantity >= 10")])
def test_every_order_has_its_intervals(spark, sf_dir, name, key, of):
    """Symbols of one line, of l_quantity below 10, need not overlap a chunk."""
    got = queries.queries()[name](spark, sf_dir).selectExpr(f"cast({key} AS bigint) AS o").distinct()
    orders = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where(of).selectExpr("cast(l_orderkey AS bigint) AS o").distinct()
    assert not orders.exceptAll(got).count()


def test_every_document_has_a_key_and_no_layout_counts(spark, sf_dir, tmp_path):
    assert queries.queries()["content_keys"](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    rows = [(1, "a\n\nb \n"), (3, "a\r\n\nb"), (5, "a\nb"), (7, " \n\n")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    k = {r.doc_id: r.k for r in queries.queries()["content_keys"](spark, str(tmp_path)).collect()}
    assert k[1] == k[3] != k[5] and k[7] is None


@pytest.mark.parametrize("name, k", [("reranked", 30), ("rerank_degraded", 30), ("hand_written_first", 40)])
def test_pools_are_the_top_of_the_whole_table(spark, sf_dir, name, k):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("n_chars", "doc_id", ascending=[False, True]).limit(k)
    assert {r.doc_id for r in queries.queries()[name](spark, sf_dir).collect()} == {r.doc_id for r in docs.collect()}
