"""Each registered query against its DuckDB equivalent, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tracemill.plans import registry

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        p = DATA / f"{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p / '*.parquet' if p.is_dir() else p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_duckdb(spark, duck, name):
    got = registry.QUERIES[name](spark, str(DATA))
    cursor = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(got.columns)
    expected = sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in cursor.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in sorted(names)) for r in got.collect()), key=str) == expected


def test_entry_imports_and_has_sql(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(registry.ORACLE_SQL) == set(registry.QUERIES)
    assert e.entry(spark).count() == 3
