"""Every query against its oracle on the smallest test tables."""

import duckdb
import pytest

from pagewarden.plans import catalog

DATA = "/root/testdata/sf0.001"

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def rows(frame):
    tidy = lambda v: None if v is None or v != v else round(float(v), 9) if isinstance(v, float) else int(v) if hasattr(v, "__index__") else str(v)
    return sorted(repr(tuple(map(tidy, r))) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    got = catalog.QUERIES[name](spark, DATA).toPandas()
    if name in catalog.ORACLE_SQL:
        expected = db.execute(catalog.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(expected.columns)
        assert rows(got) == rows(expected)
    else:
        assert len(got) > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
