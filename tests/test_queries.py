"""Every query against its DuckDB twin on the smallest tables, and entry()."""

import math

import duckdb
import pytest

from keyfold.plans import catalogue, keys_and_streams, live, logs, values  # noqa: F401
from keyfold.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _plain(rows):
    def value(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        if isinstance(v, (bool, int)) or isinstance(v, float) and v.is_integer():
            return str(int(v))
        return f"{v:.6f}" if isinstance(v, float) else str(v)

    return sorted(tuple(value(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = _plain(tuple(r) for r in df.select(*columns).collect())
    if name not in ORACLES:
        assert got
        return
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    assert got == _plain(want.select(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_only_random_queries_have_no_twin():
    assert set(QUERIES) - set(ORACLES) == {"key_random", "set_spop", "set_srandmember"}


def test_catalogue_names_queries():
    named = {q for names in catalogue.COMMANDS.values() for q in names.split()}
    assert named <= set(QUERIES)
    assert len(catalogue.COMMANDS) + len(catalogue.WITHOUT_QUERY) == 139
    assert not set(catalogue.COMMANDS) & set(catalogue.WITHOUT_QUERY)


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["key", "member", "score", "rank"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_top_k_keeps_k_rows_before_the_shuffle(spark, sf):
    plan = QUERIES["zset_revrange"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_score_and_prefix_filters_reach_the_scan(spark, sf):
    plan = lambda n: QUERIES[n](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_totalprice" in plan("zset_rangebyscore")
    assert "value" not in plan("list_llen").split("ReadSchema")[-1]
