from pathlib import Path

import duckdb
import pytest

from actlens.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(Q.oracle_sql()))
def test_sql_agrees(spark, name):
    c = duckdb.connect()
    for f in Path(SF).iterdir():
        c.execute(f"create view {f.stem} as select * from '{f}'")
    df = Q.queries()[name](spark, SF)
    cur = c.execute(Q.oracle_sql()[name])
    cols, names = sorted(df.columns), [d[0] for d in cur.description]
    assert sorted(names) == cols
    cell = lambda x: round(x, 9) if isinstance(x, float) else x
    assert sorted(repr([cell(r[x]) for x in cols]) for r in df.collect()) == sorted(repr([cell(r[names.index(x)]) for x in cols]) for r in cur.fetchall())
