"""Every query of the library against its SQL twin in DuckDB."""

import duckdb
import pytest

from marlpit.plans import catalogue
from marlpit.sources.tables import TABLES


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return (type(v).__name__, bytes(v) if isinstance(v, (bytes, bytearray)) else repr(v) if isinstance(v, float) else str(v))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    found = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in catalogue.ORACLES:
        assert found
        return
    rows = duck.sql(catalogue.ORACLES[name])
    assert sorted(rows.columns) == columns
    wanted = sorted(tuple(plain(v) for _, v in sorted(zip(rows.columns, r))) for r in rows.fetchall())
    assert found == wanted
