"""The Jaccard join against all pairs."""

import random

import duckdb
import pytest

from gradelake.llm import components as components_module
from gradelake.llm.components import components
from gradelake.llm.ngram_join import band_count, drop_near_duplicates, near_duplicates


def sets(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    own = [(i, sets(t)) for i, t in rows]
    links = {i: 0 for i, _ in own}
    root = {i: i for i, _ in own}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(own):
        for j, b in own[:n]:
            if a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9:
                links[i] += 1
                links[j] += 1
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    return {i: (top(i), links[i]) for i, _ in own}


def found(df, **options):
    return {r.doc_id: (r.class_id, r.n_links) for r in near_duplicates(df, **options).collect()}


def family(rng, n, words=60, changes=4):
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randrange(changes)):
            own[rng.randrange(words)] = f"v{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def test_on_documents(sf, docs):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    assert found(docs(rows)) == brute(rows)


@pytest.mark.parametrize("options", [{}, {"hot_size": 4, "block": 5}])
def test_families(docs, options):
    """With small limits the groups are compared in blocks; the result is the same."""
    rng = random.Random(5)
    texts = family(rng, 30) + family(rng, 12, 200, 3) + family(rng, 3, 8, 2) + family(rng, 20, 60, 1)
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert found(docs(rows), **options) == brute(rows)


def test_edges(docs):
    rows = [(5, "one two"), (3, "One  two\n"), (9, None), (8, ""), (7, " \t"), (None, "one two"), (2, "a b c d e f"), (2, "a b c d e f"), (1, "word " * 30_000), (None, "p q r s t u"), (None, "p q r s t u")]
    df = docs(rows, extra=True)
    out = sorted(((r.doc_id, r.rep_id, r.class_id, r.n_links) for r in near_duplicates(df).collect()), key=str)
    assert out == sorted([(5, 3, 3, 2), (3, 3, 3, 2), (9, 9, 9, 0), (8, 8, 8, 0), (7, 7, 7, 0), (None, 3, 3, 2), (2, 2, 2, 1), (2, 2, 2, 1), (1, 1, 1, 0), (None, None, None, 1), (None, None, None, 1)], key=str)
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns
    got = kept.collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted([3, 9, 8, 7, 2, 1, None], key=str)
    clash = [c for c in df.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")]
    assert all(r[c] == "x" for r in got for c in clash)
    assert near_duplicates(docs([])).count() == 0 and drop_near_duplicates(docs([])).count() == 0


def test_equal_ids_of_different_texts(docs):
    """No clean text is lost, and links of every text of an id are found."""
    rng = random.Random(3)
    one, two = ([" ".join([*base.split()[:59], end]) for end in "xyz"] for base in (family(rng, 1, 60, 1)[0], family(rng, 1, 60, 1)[0]))
    other = family(rng, 1, 60, 1)
    rows = [(1, one[0]), (1, two[0]), (2, one[1]), (2, two[1]), (3, one[2]), (3, two[2]), (1, other[0])]
    own = [{"one": one, "two": two, "other": other}[x] for x in ("one", "two", "other")]
    assert [n for i, (_, n) in brute(list(enumerate(one))).items()] == [2, 2, 2]
    kept = {r.text for r in drop_near_duplicates(docs(rows)).collect()}
    assert [len(kept & set(x)) for x in own] == [1, 1, 1]
    assert sorted((r.doc_id, r.n_links) for r in near_duplicates(docs(rows)).collect()) == [(1, 0), (1, 2), (1, 2), (2, 2), (2, 2), (3, 2), (3, 2)]


def test_repeated_rows_leave_the_least(spark, docs):
    """Whatever the order and the partitions of rows that repeat id and text but not the other columns."""
    text = "these are some words of a text that comes again and again"
    rows = [(1, text, lang, "s", 5) for lang in ("fr", "de", "en")] + [(2, text, "aa", "s", 5), (3, "quite another text with words of its own", None, None, None)]
    for n in (1, 4):
        df = spark.createDataFrame(rows[::-1] if n == 4 else rows, docs([]).schema).repartition(n)
        assert sorted((r.doc_id, r.lang) for r in drop_near_duplicates(df).collect()) == [(1, "de"), (3, None)]


def test_band_count():
    assert 1 - (1 - 0.8**4) ** band_count(0.8, 0.9999, 4) >= 0.9999


@pytest.mark.parametrize("heavy", [components_module.HEAVY, 5])
def test_components(spark, monkeypatch, heavy):
    monkeypatch.setattr(components_module, "HEAVY", heavy)
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(60)] + [(1000 + rng.randrange(200), 1000 + rng.randrange(200)) for _ in range(150)] + [(5000, 5001 + i) for i in range(50)]
    root = {}

    def top(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    loops = {x for x in root if all({a, b} == {x} for a, b in edges if x in (a, b))}
    assert got == {x: top(x) for x in root if x not in loops}
