import glob
import os

import duckdb
import pytest

from strandlake import queries as engine

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def norm(rows):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", engine.oracle_sql())
def test_query_equals_sql(spark, tables, name):
    df = engine.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = tables.execute(engine.oracle_sql()[name])
    at = [[d[0] for d in got.description].index(c) for c in cols]
    assert norm(tuple(r[c] for c in cols) for r in df.collect()) == norm(tuple(r[i] for i in at) for r in got.fetchall())


@pytest.mark.parametrize("name", sorted(set(engine.queries()) - set(engine.oracle_sql())))
def test_other_queries_run(spark, name):
    assert engine.queries()[name](spark, SF).count() > 0


def test_entry_without_llm():
    """The library imports without the llm subpackage, which nothing else names."""
    import pathlib

    root = pathlib.Path(engine.__file__).parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "llm" not in p.read_text()
