"""The supplier graph's edges move no more of ``lineitem`` than they need, and are those of the SQL on odd lines."""

import duckdb

from codehealth.plans import table_queries

LINES = """SELECT (i % 7)::BIGINT AS l_orderkey, CASE WHEN i % 11 = 3 THEN NULL ELSE i % 2 END::INT AS l_linenumber, CASE WHEN i % 13 = 5 THEN NULL ELSE i % 3 END::BIGINT AS l_partkey,
    CASE WHEN i % 17 <> 1 THEN i * i % 5 END::BIGINT AS l_suppkey, TIMESTAMP '2000-01-01' + to_days((i * 37 % 50)::INT) AS l_shipdate, (i * 29 % 100)::DOUBLE AS l_extendedprice FROM range(400) r(i)"""


def test_hops_of_tied_and_missing_keys(spark, tmp_path):
    duckdb.sql(f"COPY ({LINES}) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    lineitem = duckdb.read_parquet(f"{tmp_path}/lineitem.parquet")  # noqa: F841 (the SQL reads it)
    want = duckdb.sql(f"WITH {table_queries.HOPS_SQL} SELECT src, dst FROM hops").fetchall()
    assert len(want) > 100 and sorted(map(tuple, table_queries.hops(spark, str(tmp_path)).collect())) == sorted(want)


def test_hops_move_keys_only(spark):
    plan = table_queries.hops(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "l_suppkey" in plan and "l_extendedprice" not in plan and "l_shipdate" not in plan
