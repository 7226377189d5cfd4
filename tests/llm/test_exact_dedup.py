"""Exact dedup: equal to SQL, byte verification, edge cases."""

import hashlib
import re
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from gradelake.llm import exact_dedup as X


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (m[0], m[1] is not None, m[1] or 0))[1]
        out += [(i, keep, len(members), i == keep, hashlib.sha256(norm.encode()).hexdigest()) for _, i in members]
    return sorted(out, key=str)


def found(df, **options):
    return sorted((tuple(r) for r in X.exact_dedup(df, **options).collect()), key=str)


ROWS = [(4, "a b"), (2, "ab"), (9, " a\tb "), (7, "ab\x0b"), (1, None), (3, ""), (5, " \n"), (6, "c"), (8, "é 👍"), (10, "é👍"), (10, "é👍"), (11, "\u00a0ab"), (None, "alone"), (12, "x" * 50_000), (13, "x" * 49_999 + " x")]


@pytest.mark.parametrize("options", [{}, {"digest_bytes": 1}])
def test_cases(docs, options):
    rows = ROWS + [(100 + i, f"text number {i % 40}") for i in range(120)]
    assert found(docs(rows, extra=True), **options) == brute(rows)


def test_hot_text(docs):
    rows = [(i, "the same" if i % 3 == 0 else f"own {i}") for i in range(300)]
    assert found(docs(rows)) == brute(rows)


def test_empty(docs):
    assert found(docs([])) == []


def test_without_broadcast(docs, monkeypatch):
    monkeypatch.setattr(X, "BROADCAST_ROWS", 0)
    assert found(docs(ROWS)) == brute(ROWS)


@pytest.mark.parametrize("options", [{"memtable_rows": 5}, {"memtable_rows": 3, "digest_bytes": 1}])
def test_many_memtables(docs, options):
    """Copies in one memtable, in different ones, and in runs that were compacted in between."""
    rows = ROWS + [(100 + i, f"text number {i % 11}") for i in range(30)]
    assert found(docs(rows), **options) == brute(rows)


def entries(spark, keys):
    return spark.createDataFrame([(hashlib.sha256(str(k).encode()).digest(), k, 3, 1) for k in keys], "digest binary, doc_id long, n_points int, n long")


def test_lookups_skip_runs(spark):
    """Every digest that is there is found; runs that hold none are told by range or filter and not read."""
    index = X.DigestIndex(spark)
    index.flush(entries(spark, range(0, 400)))
    index.flush(entries(spark, range(400, 800)))
    got = index.lookup(entries(spark, range(300, 400)))
    assert got.count() == 100 and (index.read + index.skipped) == 2
    read, skipped = index.read, index.skipped
    assert index.lookup(entries(spark, [9001])).count() == 0
    assert index.read - read + index.skipped - skipped == 2 and index.skipped > skipped
    # About one in sixty of the digests that are not there passes the filter.
    slot, mask = index._slot(index.runs[0].words)
    other = entries(spark, range(10_000, 12_000)).withColumn("slot", slot).join(index._filter(index.runs[0]), "slot")
    assert other.where(F.col("word").bitwiseAND(mask) == mask).count() < 200


def test_runs_are_compacted(spark):
    index = X.DigestIndex(spark)
    for n in range(X.MAX_RUNS + 2):
        hits = index.add(entries(spark, range(10)))
        assert hits.count() == (10 if n else 0)
        assert len(index.runs) <= X.MAX_RUNS
    assert {r.doc_id: r.n for r in index.merged().collect()} == {i: X.MAX_RUNS + 2 for i in range(10)}


def test_sql(spark, sf):
    duckdb.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    names = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    want = duckdb.execute(f"SELECT {', '.join(names)} FROM ({X.SQL['op2_exact_dedup']}) q").fetchall()
    assert sorted(want) == sorted(tuple(r[n] for n in names) for r in X.op2_exact_dedup(spark, sf).collect())
