"""Every registered query beside its check SQL on the given tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as registered
from compare import compare, connect
from tillweave.plans import catalog

QUERIES, SQL = registered.queries(), registered.oracle_sql()


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_only_the_text_features_go_without_sql():
    assert set(catalog.QUERIES) - set(SQL) == {"v1_text_features"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, name):
    assert compare(spark, connect(sf_dir), QUERIES[name], SQL[name], sf_dir) == ""


def test_text_features_are_unit_vectors(spark, sf_dir):
    rows = QUERIES["v1_text_features"](spark, sf_dir).collect()
    assert rows and all(r.dimension == 512 and r.norm in (0.0, 1.0, None) for r in rows)
    assert sum(r.norm == 1.0 for r in rows) > 0.9 * len(rows)


def test_flagship(spark, sf_dir):
    row = registered.entry(spark).collect()[0]
    con = connect(sf_dir)
    n, total = con.execute(
        """SELECT count(*), sum(CAST(o_totalprice AS DECIMAL(12,2))) FROM orders
           WHERE o_orderdate >= DATE '2000-03-01' AND o_orderdate < DATE '2000-04-01'
             AND o_orderkey IN (SELECT l_orderkey FROM lineitem) AND o_orderkey % 50 <> 7"""
    ).fetchone()
    damaged = con.execute(
        """SELECT count(*) FROM orders WHERE o_orderdate >= DATE '2000-03-01' AND o_orderdate < DATE '2000-04-01'
           AND o_orderkey % 50 = 7 AND (o_orderkey // 50) % 3 = 1 AND o_orderkey IN (SELECT l_orderkey FROM lineitem)"""
    ).fetchone()[0]
    assert damaged == 0 or row.agg_count == n
    assert float(row.agg_value) == float(total) and row.agg_count == n
