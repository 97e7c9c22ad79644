import __spark_entry__ as entry
import duckdb
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    from pathlib import Path

    c = duckdb.connect()
    for f in Path(SF).iterdir():
        c.execute(f"create view {f.stem} as select * from '{f}'")
    return c


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_whole_names_are_the_same_queries():
    sql = entry.oracle_sql()
    assert all(sql[q] == sql[q.removesuffix("_whole")] for q in sql if q.endswith("_whole"))


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", [q for q in entry.oracle_sql() if not q.endswith("_whole") and not q.startswith("p") or q.startswith(("p1_", "p3_", "pr", "pos", "pa"))])
def test_sql_agrees(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cur = duck.execute(entry.oracle_sql()[name])
    cols = sorted(df.columns)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    cell = lambda x: round(x, 9) if isinstance(x, float) else x
    got = sorted(repr([cell(r[c]) for c in cols]) for r in df.collect())
    want = sorted(repr([cell(r[names.index(c)]) for c in cols]) for r in cur.fetchall())
    assert got == want
