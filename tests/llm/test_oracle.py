import glob
import os

import duckdb
import pytest

from strandlake.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = c.execute(queries.oracle_sql()[name])
    at = [[d[0] for d in got.description].index(x) for x in cols]
    mine, theirs = (sorted(rows, key=repr) for rows in ([tuple(r[x] for x in cols) for r in df.collect()], [tuple(r[i] for i in at) for r in got.fetchall()]))
    assert len(mine) == len(theirs) and [x for x in zip(mine, theirs, strict=True) if x[0] != x[1]][:3] == []
