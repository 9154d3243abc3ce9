"""Every query runs on the smallest tables, and equals its SQL in DuckDB where it has one."""

import math
from pathlib import Path

import duckdb
import pytest

from lexmill import registry


def plain(v):
    return ("nan" if math.isnan(v) else round(v, 6)) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in Path(small).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, small, duck, name):
    df = registry.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in registry.ORACLE_SQL:
        assert got
        return
    result = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted((tuple(plain(row[i]) for i in at) for row in result.fetchall()), key=repr)


def test_entry(spark, small):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["doc_id", "rank", "variant_id", "spelling", "freq"]
    assert set(registry.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


def test_import_without_session():
    import subprocess
    import sys

    root = str(Path(__file__).resolve().parents[1])
    assert subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries(), e.oracle_sql()"], cwd=root, capture_output=True).returncode == 0
