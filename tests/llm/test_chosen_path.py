"""The chosen-path join against all pairs."""

import math
import random
import re

import duckdb
import numpy as np
import pytest

from gradelake.llm import chosen_path as C
from gradelake.llm.chosen_path import keep_components, near_components, op11_near_dedup


def sets(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows, percent=85):
    """``{place: (number of shingles, least id of the component)}``; ids may be null or repeated."""
    own = [sets(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = {}
    for n, s in enumerate(own):
        met = {}
        for x in s:
            for m in holders.setdefault(x, []):
                met[m] = met.get(m, 0) + 1
            holders[x].append(n)
        for m, both in met.items():
            if 100 * both >= percent * (len(s) + len(own[m]) - both):
                x, y = top(n), top(m)
                root[max(x, y)] = min(x, y)
    least = {}
    for n, (i, _) in enumerate(rows):
        least.setdefault(top(n), []).append(i)
    least = {k: min((i for i in v if i is not None), default=None) for k, v in least.items()}
    return [(len(s), least[top(n)] if s else rows[n][0]) for n, s in enumerate(own)]


def expected(rows, percent=85):
    return sorted(((i, n, c, i == c) for (i, _), (n, c) in zip(rows, brute(rows, percent), strict=True)), key=str)


def found(df, **options):
    return sorted((tuple(r) for r in near_components(df, **options).collect()), key=str)


def family(rng, n, words=60, changes=4):
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randrange(changes)):
            own[rng.randrange(words)] = f"v{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query(spark, size):
    folder = f"/root/testdata/{size}"
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{folder}/documents.parquet'").fetchall()
    out = op11_near_dedup(spark, folder)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    want = expected(rows)
    assert sorted((tuple(r) for r in out.collect()), key=str) == want
    assert sum(not r[3] for r in want) > len(rows) // 50


@pytest.mark.parametrize(("options", "dense"), [({}, C.DENSE), ({"small": 4}, C.DENSE), ({"small": 4}, 0), ({"small": 4, "levels": 2}, 0), ({"small": 5, "levels": 1}, 10**6)])
def test_families(docs, monkeypatch, options, dense):
    """Loose and tight families and a shared passage, with nodes that branch, are cut into blocks, and are compared whole or by pairs."""
    monkeypatch.setattr(C, "DENSE", dense)
    rng = random.Random(9)
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(40))
    texts = family(rng, 60, 120, 9) + family(rng, 40, 200, 3) + family(rng, 3, 8, 2) + family(rng, 30, 60, 14) + family(rng, 20, 60, 1)
    texts += [passage + " " + family(rng, 1, 60)[0] for _ in range(40)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    want = expected(rows)
    assert len({r[2] for r in want}) > 60 and sum(r[2] != r[0] for r in want) > 60
    assert found(docs(rows), **options) == want


def test_other_thresholds(docs):
    rng = random.Random(10)
    rows = list(enumerate(family(rng, 25, 80, 8) + family(rng, 25, 30, 3)))
    for percent in (60, 95, 100):
        assert found(docs(rows), percent=percent) == expected(rows, percent)


def test_edges(docs):
    rows = [(5, "one two"), (3, "One  two\n"), (9, None), (8, ""), (7, " \t\x0b"), (None, "one two"), (2, "a b c d e f"), (2, "a b c d e f"), (1, "word " * 30_000), (None, "p q r s t u"), (None, "p q r s t u"), (4, "one\x1ctwo"), (6, "É é"), (11, "é é"), (12, " ".join(map(str, range(40_000)))), (13, " ".join(map(str, range(38_000))))]
    df = docs(rows, extra=True).selectExpr("*", "'x' as rep", "'x' as row", "'x' as v1", "'x' as component_id", "'x' as node")
    assert found(df) == sorted(((i, n, c, i == c) for (i, _), (n, c) in zip(rows, brute(rows), strict=True)), key=str)
    kept = keep_components(df)
    assert kept.columns == df.columns
    got = kept.collect()
    assert sorted((str(r.doc_id) for r in got)) == sorted(["3", "9", "8", "7", "2", "2", "1", "None", "None", "4", "6", "11", "12"])
    clash = [c for c in df.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")]
    assert all(r[c] == "x" for r in got for c in clash)
    assert near_components(docs([])).count() == 0 and keep_components(docs([])).count() == 0


def test_equal_ids_of_different_texts(docs):
    rng = random.Random(3)
    one, two = family(rng, 1, 60, 1)[0], family(rng, 1, 60, 1)[0]
    rows = [(4, one), (4, two), (2, one + " end"), (3, two + " end"), (3, two + " end")]
    assert found(docs(rows)) == expected(rows)
    assert sorted(r.text for r in keep_components(docs(rows)).collect()) == sorted([one + " end", two + " end", two + " end"])


def test_recall_of_the_trees():
    """The share of pairs at the threshold that meet, by simulation, is the one the number of trees follows from."""
    rng = np.random.default_rng(1)
    levels, runs = 6, 20_000
    alive = np.ones(runs, np.int64)
    for _ in range(levels):
        chosen = alive + rng.binomial(alive, C.branches(0.85))
        alive = rng.binomial(chosen, 0.85)
    assert abs((alive > 0).mean() - C.survival(0.85, levels)) < 0.01
    trees = C.tree_count(0.85, C.RECALL, C.LEVELS)
    assert 1 - (1 - C.survival(0.85, C.LEVELS)) ** trees >= C.RECALL
    roots = C._roots(trees, C.TOKENS, 0.85)
    assert len(roots) == math.floor(trees / 0.85) and len({p for _, p in roots}) == len(roots)


def test_sketches_agree_as_the_sets_do():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    assert (C.minwise(base, 128) == C.minwise(base[::-1], 128)).all()
    share = []
    for seed in range(20):
        base = np.random.default_rng(seed).integers(0, 1 << 63, 900, dtype=np.uint64)
        share.append(np.mean(C.minwise(base[:765], 128) == C.minwise(base, 128)))
    assert abs(np.mean(share) - 0.85) < 0.03
    assert C.sketch_cut(128, 0.85, 1e-6) < 0.85 * 128 - 4 * 4
