"""Every query that has SQL gives the rows that DuckDB gives."""

import math
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__

NAMES = sorted(n for n in __spark_entry__.oracle_sql() if not n.startswith("op"))


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, list | tuple):
        return tuple(map(plain, value))
    return value


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for file in os.listdir(sf):
        con.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{sf}/{file}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(name, spark, sf, duck):
    df = __spark_entry__.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    answer = duck.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in answer.fetchall()), key=repr)
    assert got == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_query_is_known():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_a_missing_library_leaves_the_other_queries():
    """Where the corpus operators cannot be imported, everything else is offered as before."""
    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()))"
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()
    assert int(said[0]) > 60 and said[1] == "False"
