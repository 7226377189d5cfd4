"""Periodic runs against a comparison of every word with every other."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from gradelake.llm import periodic as P


def brute(words, min_words=24, exponent=3):
    """``(start, length, period)`` in order: every stretch of every period, with the least period of each stretch."""
    n, least = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j + q - i
            if size >= min_words and size >= exponent * q:
                least.setdefault((i, size), q)  # periods come in rising order
            i = j
    return sorted((i, size, q) for (i, size), q in least.items())


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def collapsed(words, runs):
    gone = {i for start, size, q in runs for i in range(start + q, start + size)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def rewritten(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def report(doc_id, text):
    """The query's row of one document."""
    words = rewritten(doc_id, split(text))
    runs = brute(words)
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    lines = "".join(f"{a},{b},{q}\n" for a, b, q in runs)
    return (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], digest(lines), digest(collapsed(words, runs)))


def noisy(rng, letters, n):
    """Words with periodic stretches, nested and broken ones among them."""
    out = []
    while len(out) < n:
        part = [rng.choice(letters) for _ in range(rng.randrange(1, 9))]
        part = part * rng.randrange(1, 14)
        if rng.random() < 0.3:
            part = part[: rng.randrange(1, len(part) + 1)] * rng.randrange(1, 5)
        if rng.random() < 0.3:
            part[rng.randrange(len(part))] = "x"
        out += part
    return out[:n]


@pytest.mark.parametrize(("min_words", "exponent"), [(24, 3), (6, 2), (1, 2), (10, 4), (17, 3), (2, 3)])
def test_against_all_stretches(min_words, exponent):
    rng = random.Random(min_words)
    for n_docs in (1, 1, 7):
        texts = [noisy(rng, "abcde"[: rng.randrange(1, 6)], rng.choice([0, 1, 5, 24, 25, 60, 130, 260])) for _ in range(n_docs * 6)]
        number = {}
        ids = np.array([number.setdefault(w, len(number)) for t in texts for w in t], np.int64)
        found = P.runs_of(ids, np.array([len(t) for t in texts]), min_words, exponent)
        got = [[(a, b - a, q) for d, a, b, q in found.tolist() if d == n] for n in range(len(texts))]
        assert got == [brute(t, min_words, exponent) for t in texts]


def test_masking_keeps_all_runs():
    """Words outside the surviving segments are in no run, and most words of plain text are outside."""
    rng = random.Random(8)
    text = [f"w{rng.randrange(10**6)}" for _ in range(400)] + ["a", "b", "c"] * 10 + [f"w{rng.randrange(10**6)}" for _ in range(400)]
    ids = np.unique(text, return_inverse=True)[1]
    alive = P.surviving(ids, np.zeros(len(ids), np.int64), P.overlap(24, 3))
    assert P.overlap(24, 3) == 16 and list(np.flatnonzero(alive)) == list(range(400, 430))


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query(spark, size):
    folder = f"/root/testdata/{size}"
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{folder}/documents.parquet'").fetchall()
    got = P.op13_periodic_runs(spark, folder)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    short = {i: t for i, t in rows if len(split(t)) <= 1500}  # what brute force can do in time
    out = {r.doc_id: tuple(r)[1:] for r in got.collect()}
    assert len(out) == len(rows) and len(short) > 0.9 * len(rows)
    assert {i: out[i] for i in short} == {i: report(i, t) for i, t in short.items()}
    assert sum(x[0] > 0 for x in out.values()) > len(rows) // 15


def test_edges(spark, docs):
    run = "one two\x0bthree\n" * 12
    rows = [(1, None), (2, ""), (3, " \t\r\n"), (4, "x " * 24), (5, "x " * 23), (6, run), (6, run), (None, "y " * 30), (7, "a b \x1c c " * 9), (8, "v w " * 40_000 + "end"), (9, " ".join(f"w{i % 7001}" for i in range(50_000)))]
    df = docs(rows, extra=True).selectExpr("*", "'x' as row", "'x' as found", "'x' as runs", "'x' as collapsed")
    out = [(r.row, [tuple(x) for x in r.found.runs], r.found.collapsed) for r in P.periodic_runs(df).collect()]
    got = sorted(((r.doc_id, runs, text) for r, runs, text in out), key=str)
    want = [(1, [], ""), (2, [], ""), (3, [], ""), (4, [(0, 24, 1)], "x"), (5, [], "x " * 22 + "x"), (6, [(0, 36, 3)], "one two three"), (6, [(0, 36, 3)], "one two three"), (None, [(0, 30, 1)], "y"), (7, [(0, 27, 3)], "a b \x1c c"), (8, [(0, 80_000, 2)], "v w end"), (9, [(0, 50_000, 7001)], " ".join(f"w{i}" for i in range(7001)))]
    assert got == sorted(want, key=str)
    assert all(r.row == r.found == r.runs == r.collapsed == r.removed == "x" for r, _, _ in out)
    kept = P.collapse_runs(df)
    assert kept.columns == df.columns
    assert {r.doc_id: r.text for r in kept.collect() if r.doc_id in (1, 3, 5, 6)} == {1: None, 3: " \t\r\n", 5: "x " * 23, 6: "one two three"}
    assert P.periodic_runs(docs([])).count() == 0 and P.collapse_runs(docs([])).count() == 0


def test_planted_ends(spark, docs):
    """The rewriting of the query, also of null and blank texts and of ids that are null."""
    rows = [(i, "one two three four five six seven eight nine ten " * (1 + i % 3)) for i in range(200)] + [(i, t) for i in range(200, 260) for t in (None, " ")] + [(None, "as it is")]
    df = docs(rows)
    got = sorted(((r.doc_id, " ".join(split(r.t))) for r in df.select("doc_id", P.planted(df.doc_id, df.text).alias("t")).collect()), key=str)
    assert got == sorted(((i, " ".join(rewritten(i, split(t)) if i is not None else split(t))) for i, t in rows), key=str)
