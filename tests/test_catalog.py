import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    df = entry.queries()[name](spark, sf_dir)
    con = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in con.description]
    assert sorted(columns) == sorted(df.columns)
    got, want = _rows(df.columns, [tuple(r) for r in df.collect()]), _rows(columns, con.fetchall())
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g == pytest.approx(w, rel=1e-7, nan_ok=True) if all(isinstance(x, (int, float)) for x in g) else all(a == (pytest.approx(b, rel=1e-7) if isinstance(b, float) else b) for a, b in zip(g, w, strict=True))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
