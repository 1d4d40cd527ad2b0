"""Every registered query of the core library against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from entigraph.plans import analytics, more, pairs, reads, registry, rows, texts  # noqa: F401


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(value):
    if value is None or value != value:
        return None
    return round(float(value), 9) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    if name in registry.ORACLE:
        cursor = duck.execute(registry.ORACLE[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert got == sorted((tuple(plain(r[i]) for i in at) for r in cursor.fetchall()), key=str)
    else:
        assert isinstance(got, list)
