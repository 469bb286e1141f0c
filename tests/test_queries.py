"""Every named query of the core against its SQL on the smallest tables."""

import duckdb
import pytest

from forkline.plans import collection, data_quality

from .conftest import DATA

QUERIES = {**collection.QUERIES, **data_quality.QUERIES}
SQL = {**collection.SQL, **data_quality.SQL}


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(map(repr, r)) for r in df.select(*columns).collect())
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(tuple(repr(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert got == want


def test_reads_through_deep_chains_and_circles(spark, tmp_path):
    # a chain of 700 segments, deleted at 350 for path b; a circle of three with a tail, in a project of its own
    con = duckdb.connect()
    tables = {
        "branch_nodes": """SELECT 'p' project_id, i node_id, CASE WHEN i > 0 THEN i - 1 END parent_node_id, 1000 - i fork_lsn FROM range(700) r(i)
            UNION ALL SELECT 'q', 1000 + i, 1000 + CASE WHEN i = 0 THEN 2 ELSE i - 1 END, 50 FROM range(4) r(i)""",
        "branch_handles": "SELECT project_id, 'b' || node_id branch_id, node_id, 1::BIGINT commit_seq FROM branch_nodes",
        "mutations": """SELECT * FROM (VALUES (0::BIGINT, 'a', 7::BIGINT, false), (0, 'b', 8, false), (350, 'b', 9, true), (0, 'c', 999, false), (1002, 'a', 5, false), (1002, 'b', 60, false))
            t(node_id, path, lsn, tombstone)""",
        "read_requests": """SELECT row_number() OVER () request_id, * FROM (VALUES ('p', 'b699', 'a', NULL::BIGINT), ('p', 'b699', 'b', NULL), ('p', 'b349', 'b', NULL),
            ('p', 'b699', 'a', 6), ('p', 'b699', 'c', NULL), ('q', 'b1003', 'a', NULL), ('q', 'b1003', 'b', NULL), ('q', 'b1000', 'c', NULL)) t(project_id, branch_id, path, at_lsn)""",
    }
    for name, sql in tables.items():
        con.execute(f"CREATE TABLE {name} AS {sql}")
        con.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet'")
    want = [(1, 0, 7), (3, 0, 8), (6, 1002, 5)]
    assert sorted(map(tuple, QUERIES["p4_found"](spark, str(tmp_path)).select("request_id", "node_id", "lsn").collect())) == want
    assert sorted(con.execute(SQL["p4_found"]).fetchall()) == want


def test_every_query_has_sql():
    assert QUERIES.keys() == SQL.keys()
