"""The operators that SQL can express against DuckDB, over whole tables."""

import duckdb
import pytest

from skarn import llm

TABLES = "documents embeddings pages benchmark labels conversations".split()


def norm(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(llm.ORACLE_SQL))
def test_equals_sql(name, spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    df = llm.QUERIES[name](spark, d)
    cols = sorted(df.columns)
    got = [tuple(norm(r[c]) for c in cols) for r in df.select(*cols).collect()]
    rel = con.execute(llm.ORACLE_SQL[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == cols
    want = [tuple(norm(r[names.index(c)]) for c in cols) for r in rel.fetchall()]
    assert got and sorted(map(repr, got)) == sorted(map(repr, want))


def test_ten_operators():
    assert [n.split("_")[0] for n in llm.QUERIES] == [f"op{i}" for i in range(1, 11)]
