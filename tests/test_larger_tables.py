"""What only shows on larger tables: ids that several directories share, many rows."""

import duckdb
import pytest

from archive_catalog.plans import catalogue


@pytest.fixture(scope="module")
def shared_ids(spark, tmp_path_factory):
    """Order 2's line with part 1 and order 1's with part 10001 have one file id."""
    folder = str(tmp_path_factory.mktemp("tables"))
    tables = {
        "part": "SELECT k AS p_partkey, 'name ' || k AS p_name, 'Brand#' || k AS p_brand, 'type' AS p_type, CAST(1 AS INTEGER) AS p_size, CAST(1.0 AS DOUBLE) AS p_retailprice FROM (VALUES (CAST(2 AS BIGINT)), (10002)) x(k)",
        "orders": "SELECT k AS o_orderkey FROM (VALUES (CAST(1 AS BIGINT)), (2)) x(k)",
        "lineitem": "SELECT o AS l_orderkey, p AS l_partkey, CAST(2 AS BIGINT) AS l_suppkey, CAST(4 AS INTEGER) AS l_linenumber, CAST(1.0 AS DOUBLE) AS l_quantity FROM (VALUES (CAST(1 AS BIGINT), CAST(10002 AS BIGINT)), (2, 2)) x(o, p)",
    }
    for name, sql in tables.items():
        duckdb.sql(f"COPY ({sql}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return folder


@pytest.mark.parametrize("name", ["enrich_requests", "open_requests"])
def test_requests_of_albums_whose_files_share_an_id(spark, shared_ids, name):
    con = duckdb.connect()
    for t in ("part", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{shared_ids}/{t}.parquet')")
    got = catalogue.QUERIES[name](spark, shared_ids)
    want = con.execute(catalogue.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(repr(tuple(r[c] for c in names)) for r in got.collect()) == sorted(map(repr, want.fetchall()))


def test_repeated_lines_are_dropped_where_their_order_is(spark, tmp_path):
    """No task that reads lines holds them: they are dealt by order first, and all groups of an order are then in one part."""
    folder = str(tmp_path)
    duckdb.sql(f"COPY (SELECT CAST(k AS BIGINT) AS p_partkey, 'name ' || k AS p_name, 'Brand#' || k AS p_brand, 'type' AS p_type FROM range(1, 40) x(k)) TO '{folder}/part.parquet' (FORMAT parquet)")
    lines = "SELECT CAST(i // 4 AS BIGINT) AS l_orderkey, CAST(i % 39 + 1 AS BIGINT) AS l_partkey, CAST(i % 7 AS BIGINT) AS l_suppkey, CAST(i % 4 + 1 AS INTEGER) AS l_linenumber, CAST(i % 5 AS DOUBLE) AS l_quantity FROM range(400) x(i), range(3) y(again)"
    duckdb.sql(f"COPY ({lines}) TO '{folder}/lineitem.parquet' (FORMAT parquet)")
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    got = catalogue.QUERIES["sequence_flags"](spark, folder)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.rindex("HashAggregate") < plan.index("Exchange hashpartitioning(l_orderkey")
    want = con.execute(catalogue.ORACLES["sequence_flags"])
    names = [d[0] for d in want.description]
    assert sorted(repr(tuple(r[c] for c in names)) for r in got.collect()) == sorted(map(repr, want.fetchall()))
