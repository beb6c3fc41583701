"""Every query of the reference's operators against its SQL in DuckDB."""

import math

import duckdb
import pytest

from tessella.plans import registry
from tessella.session import TABLES


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 5) + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19]
    return v


def norm(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted(repr([plain(r[k]) for k in order]) for r in rows)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", registry.QUERIES)
def test_query(spark, sf_dir, duck, name):
    df = registry.QUERIES[name](spark, sf_dir)
    got = norm(df.columns, [tuple(r) for r in df.collect()])
    if name not in registry.ORACLES:
        assert got[1] or name == "best_answer"  # no answer here holds a whole question; test_whole_tables has some that do
        return
    found = duck.execute(registry.ORACLES[name])
    assert got == norm([c[0] for c in found.description], found.fetchall())


def test_page_nodes_agree_with_tags(spark, sf_dir):
    """The parser's elements are the tags that the patterns find, but for those in scripts."""
    nodes = {}
    for r in registry.QUERIES["page_nodes"](spark, sf_dir).collect():
        nodes[r.tag] = nodes.get(r.tag, 0) + r.n
    tags = {r.tag: r.n for r in registry.QUERIES["tag_count"](spark, sf_dir).collect()}
    assert {t: n for t, n in nodes.items() if t != "CDATA"} == tags


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).first().n > 100
    assert set(registry.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
