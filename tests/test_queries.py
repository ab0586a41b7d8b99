"""Every query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from bytequarry.plans.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows):
    """Rows as comparable texts: null, whole numbers, fractions and everything else stay apart."""

    def one(x):
        if x is None:
            return "null"
        if isinstance(x, bool):
            return str(x)
        if isinstance(x, float):
            return f"{x:.6f}"
        if type(x).__name__ == "Decimal":
            return str(int(x)) if x == int(x) else f"{float(x):.6f}"
        return str(x) if isinstance(x, int) else repr(x)

    return sorted(tuple(map(one, r)) for r in rows)


#: What has no findings anywhere, and what may have none in the smallest tables.
EMPTY = {"chunk_coverage"}
FEW = {"list_limit_zero", "audit_pinned_blocks", "audit_pinned_status", "audit_snapshot_logical", "recovery_missing_files", "snapshot_diff_filtered"}
#: Queries whose order is part of the result, and by what.
ORDERED = {"list_page": "path", "snapshot_diff_entries": "path", "snapshot_show_prefix": "path", "list_files": "path"}


@pytest.fixture(scope="session")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    got = df.select(*(f"`{c}`" for c in columns)).collect()
    if name in ORDERED:
        keys = [r[ORDERED[name]] for r in got]
        assert keys == sorted(keys)
    if name in EMPTY:
        assert not got
    elif name in ORACLE_SQL and name not in FEW:
        assert got, "a query that finds nothing proves nothing"
    if name in ORACLE_SQL:
        result = duck.sql(ORACLE_SQL[name])
        assert sorted(result.columns) == columns
        assert plain(got) == plain(result.select(*(duckdb.ColumnExpression(c) for c in columns)).fetchall())


def test_entry_works(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
