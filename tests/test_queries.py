"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from tabloom.plans import catalogue  # the other modules add their queries to its tables

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return None if v != v else round(v, 5)
    return v


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, db, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name in catalogue.ORACLE_SQL:
        cur = db.execute(catalogue.ORACLE_SQL[name])
        names = [x[0] for x in cur.description]
        want = sorted((tuple(norm(dict(zip(names, r, strict=True))[c]) for c in cols) for r in cur.fetchall()), key=repr)
        assert got == want
