"""Every registered query of the engine against its SQL, over the smallest tables."""

import glob
import math
import os
import sys

import duckdb
import pytest

from gleaner.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    return round(v, 9) if isinstance(v, float) and not math.isnan(v) else v


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([plain(r[i]) for i in order] for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, tables, name):
    df = registry.queries()[name](spark, SF)
    want = tables.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table(want.columns, want.fetchall())


@pytest.mark.parametrize("gone", ["gleaner.llm", "gleaner.llm.registry", "zstandard"])
def test_entry_works_without_the_llm_modules(spark, monkeypatch, gone):
    import __spark_entry__ as entry

    for name in [n for n in sys.modules if n.startswith("gleaner.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, gone, None)
    assert set(entry.queries()) == set(registry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
