"""Language ID and the quality classifier: held-out accuracy, kernels, edge cases."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradelake.llm import language as L
from gradelake.llm import quality as Q

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = L.op10_language_id(spark, SF).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    lengths = np.array([3, 0, 5, 1])
    scores = rng.normal(0, 2, (9, 3)).astype(np.float32)
    labels = L.viterbi(scores, lengths, 1.5)
    start = 0
    for n in lengths:
        own = scores[start : start + n]
        best = max((sum(own[i, p] for i, p in enumerate(path)) - 1.5 * sum(a != b for a, b in zip(path, path[1:], strict=False)), path) for path in np.ndindex(*[3] * n)) if n else (0, ())
        assert list(labels[start : start + n]) == list(best[1])
        start += n


def test_language_edges(spark, docs):
    train = [(i, t) for i, t in enumerate(["the house and the garden with many words"] * 20)]
    known = docs(train).withColumn("lang", F.lit("en"))
    other = docs([(100 + i, "das haus und der garten mit vielen worten") for i in range(20)]).withColumn("lang", F.lit("de"))
    model = L.train(known.unionByName(other))
    rows = [(1, None), (2, ""), (3, "12 !? 3"), (4, "the garden and the house " * 9 + "und der garten mit dem haus und vielen worten " * 3), (5, "дом и сад"), (6, "und das haus " * 30_000), (None, "the words")]
    df = docs(rows, extra=True)
    out = {r.doc_id: (r.lang_pred, r.score, r.n_spans) for r in L.identify(df, model).collect()}
    clash = L.identify(df.withColumn("said", F.lit("x")), model)
    assert all(r.said == r.removed == "x" for r in clash.collect())
    twice = L.identify(df.unionByName(df), model).groupBy("doc_id", "text", "lang_pred", "score", "n_spans").count().where("count <> 2")
    assert twice.isEmpty()
    assert L.identify(df, model).columns[: len(df.columns) - 2] == [c for c in df.columns if c not in ("lang_pred", "score")]
    assert out[1] == out[2] == out[3] == ("und", 0.0, 0)
    assert out[4][0] == "en" and out[4][2] == 2 and out[5][0] in ("en", "de") and out[6][:2] == ("de", 1.0) and out[None][0] == "en"
    assert L.identify(docs([]), model).count() == 0
    assert L.identify(docs(rows), L.train(docs([]))).first().lang_pred == "und"


def test_quality_held_out(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = Q.op7_quality(spark, SF).collect()
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    assert np.mean([a > b for a in good for b in bad]) >= 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_pairs_by_the_identity():
    rng = np.random.default_rng(2)
    model = Q.Model(0.3, rng.normal(size=Q.BUCKETS + len(Q.STATISTICS)).astype(np.float32), rng.normal(size=(Q.BUCKETS + len(Q.STATISTICS), 4)).astype(np.float32), np.zeros(len(Q.STATISTICS)), np.ones(len(Q.STATISTICS)))
    at, values = np.array([5, 70, 900]), np.array([0.2, 0.5, 0.1], np.float32)
    stats = rng.normal(size=len(Q.STATISTICS))
    own = np.concatenate([at, np.arange(Q.BUCKETS, Q.BUCKETS + len(stats))])
    x = np.concatenate([values, np.clip(stats, -3, 3) * 0.3])
    want = model.bias + model.weights[own] @ x + sum(model.factors[own[i]] @ model.factors[own[j]] * x[i] * x[j] for i in range(len(own)) for j in range(i))
    assert Q.raw_score(at, values, stats, model) == pytest.approx(want, rel=1e-4)


def test_quality_edges(spark, docs):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["good", "text", "here", "and", "there"]) for _ in range(30)) if i % 2 else "### " * 40) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(1, 0), (None, 1), (2, None)], "doc_id bigint, quality int")
    model = Q.train(docs(rows), labels)
    odd = [(1, None), (2, ""), (3, "x" * 200_000), (None, "good text here"), (4, "### " * 50), (4, "### " * 50)]
    df = docs(odd, extra=True)
    out = Q.score(df, model)
    assert out.count() == len(odd) and all(0 <= r.score <= 1 for r in out.collect())
    assert Q.score(df.drop("n_chars"), model).count() == len(odd) and Q.score(docs([]), model).count() == 0
    assert Q.train(docs([]), labels).bias == 0.0


def test_a_letter_that_grows_in_lower_case_changes_no_other_word():
    assert [c for c in map(chr, range(0x110000)) if len(c.lower()) > 1] == ["\u0130"]
    words = ["UND", "\u0130stanbul", "Haus", "ΣΑΣ"]
    grams, owner, scripts = L.ngrams(words)
    for i, word in enumerate(words):
        alone, _, script = L.ngrams([word])
        assert sorted(grams[owner == i]) == sorted(alone) and scripts[i] == script[0]
    assert sorted(grams[owner == 0]) == sorted(L.ngrams(["und"])[0])


def test_grams_of_words():
    """Each word, between blanks, gives all its runs of one to four signs, but none with blanks at both ends or across words."""
    words = ["ab", "Дом", "x"]
    grams, owner, scripts = L.ngrams(words)
    counts = [0, 0, 0]
    for i, w in enumerate(words):
        padded = f" {w.lower()} "
        runs = [padded[a : a + n] for n in L.ORDERS for a in range(len(padded) - n + 1)]
        counts[i] = sum(r != " " and not (len(r) > 1 and r[0] == r[-1] == " ") for r in runs)
    assert [int((owner == i).sum()) for i in range(3)] == counts
    assert scripts.tolist() == [1, 3, 1]
    same, _, _ = L.ngrams(["ab"])
    assert sorted(same) == sorted(grams[owner == 0])


def test_scores_of_words():
    """Sums of the grams' weights, over the orders, as differences from the best; languages of other scripts are far off."""
    rng = np.random.default_rng(4)
    model = L.Model(["a", "b", "c"], rng.normal(size=(L.BUCKETS, 3)).astype(np.float32), np.array([1 << 1, 1 << 1, 1 << 3]))
    words = ["word", "слово", "x"]
    got = L.score_words(words, model)
    for i, w in enumerate(words):
        grams, _, _ = L.ngrams([w])
        own = model.weights[grams].sum(0) / len(L.ORDERS)
        own[[2] if i != 1 else [0, 1]] = -np.inf
        assert got[i] == pytest.approx(np.maximum(own - own.max(), -50), abs=1e-3)


def test_features_of_a_text():
    """Hashed words as a vector of length one, and every statistic, against plain counting."""
    text = "The the cat, 12 !!\n\nThe the cat, 12 !!\nÉté дом x."
    at, values, stats = Q.features(text, 30, Q._Bucket())
    words = text.split()
    counts = {w: words.count(w) for w in words}
    assert sorted(zip(at.tolist(), (values**2 * len(words)).round(4).tolist(), strict=True)) == sorted((zlib.crc32(w.lower().encode()) % Q.BUCKETS, float(c)) for w, c in counts.items())
    lines = [x for x in text.split("\n") if x]
    n, m = len(text), len(words)
    sign = lambda c: not c.isalnum() and not c.isspace()
    want = [
        np.log1p(m), np.log1p(n), sum(map(len, words)) / m, sum(c.isupper() for c in text) / n, sum(c.isdigit() for c in text) / n, sum(map(sign, text)) / n,
        sum(not w[-1].isalnum() for w in words) / m, sum(not any(map(str.isalpha, w)) for w in words) / m, len(counts) / m, sum(a == b for a, b in zip(words, words[1:])) / m,
        max(counts.values()) / m, np.log1p(3), 1 - 2 / 3, np.log1p(n / 3),
    ]
    assert stats[:14] == pytest.approx(want) and stats[15:] == pytest.approx([np.log1p(30), 0.0])
    assert len(lines) == 3 and len(stats) == len(Q.STATISTICS)
