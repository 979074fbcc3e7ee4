"""Every registered query against the SQL that says the same, on the smallest tables."""

import math

import duckdb
import pytest

from codexine import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(x + 0.0)
    return str([plain(v) for v in x]) if isinstance(x, (list, tuple)) else str(x)


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query(spark, sf_dir, oracle, name):
    df = plans.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    found = oracle.execute(plans.SQL[name])
    names, kinds = [d[0] for d in found.description], {d[0]: str(d[1]) for d in found.description}
    assert sorted(names) == columns
    assert {c: TYPES[t] for c, t in df.dtypes if t in TYPES} == {c: kinds[c] for c, t in df.dtypes if t in TYPES}
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_rows_only(spark, sf_dir, name):
    assert plans.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark, sf_dir):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_no_query_crosses_tables(spark, sf_dir):
    """Cross products stand only where one side is a row of totals or a stated set of queries."""
    for name in ("claim_support", "interval_pages", "nearest_customer", "reference_prefix", "near_pairs", "asof_last_order", "contained_passages", "leakage_pairs", "sign_search", "gram_search", "overlapping_boxes", "nearest_captions", "chunk_tables", "sequence_pairs"):
        plan = plans.QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
