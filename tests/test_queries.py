"""Every query against its SQL, and those without SQL for their shape."""

import duckdb
import pytest

from skarn.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def test_all_have_sql_but_chunk_windows():
    assert set(catalog.QUERIES) - set(catalog.ORACLE_SQL) == {"F25_char_windows"}


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_sql(name, spark, duck, sf_dir):
    df = catalog.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = [tuple(norm(r[c]) for c in cols) for r in df.select(*cols).collect()]
    rel = duck.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    assert sorted(map(repr, got)) == sorted(repr(tuple(norm(r[i]) for i in order)) for r in rel.fetchall())


def test_windows_cover_every_text(spark, sf_dir):
    rows = catalog.QUERIES["F25_char_windows"](spark, sf_dir)
    assert rows.filter("chars > 3000 OR end_line < start_line").isEmpty()
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("text <> ''")
    assert rows.select("key").distinct().count() == texts.count()


def test_whole_tables_reach_the_operators(spark, duck, sf_dir):
    """Parts of all sizes are definitions, lines of all numbers calls, and all users stations."""
    edges = catalog.QUERIES["F29_G04_cascade"](spark, sf_dir)
    small = {f"{b}/part:{k}:{n}" for k, b, n in duck.execute("SELECT p_partkey, p_brand, p_name FROM part WHERE p_size <= 25").fetchall()}
    assert {r.dst for r in edges.collect()} & small
    most = duck.execute("SELECT max(n) FROM (SELECT count(DISTINCT user_id) AS n FROM events GROUP BY CAST(ts AS DATE))").fetchone()[0]
    assert catalog.QUERIES["A23_all_stations"](spark, sf_dir).agg({"stations": "max"}).first()[0] == most > 7
