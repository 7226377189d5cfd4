"""Edit matching against the full distance table."""

import random
import re

from gradelake.llm.decontaminate import budget, drop_leaks, find_leaks


def plain(text):
    return " ".join(re.findall(r"[^\W_]+", (text or "").lower()))


def least(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def brute(rows, items):
    out = set()
    for i, t in rows:
        for n, item in items:
            p = plain(item)
            if len(p) >= 16 and (d := least(p, plain(t))) <= budget(len(p)):
                out.add((i, n, d))
    return out


def found(spark, df, items, **options):
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    return {(r.doc_id, x.item_id, x.distance) for r in find_leaks(df, bench, **options).collect() for x in r.leaks}


def make(rng):
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 8)))
    items = [(n, " ".join(word() for _ in range(rng.choice([4, 12, 25])))) for n in range(12)]

    def spoil(text, n):
        text = list(text)
        for _ in range(n):
            i = rng.randrange(len(text))
            text[i : i + 1] = rng.choice([[], ["z"], [text[i], "q"]])
        return "".join(text)

    rows = []
    for i in range(60):
        middle = spoil(rng.choice(items)[1], rng.choice([0, 1, 3, 6, 12])) if i % 4 else ""
        rows.append((i, " ".join(word() for _ in range(8)) + ", " + middle.upper() + "! " + " ".join(word() for _ in range(5))))
    return rows, items


def test_against_all_distances(spark, docs):
    rows, items = make(random.Random(10))
    want = brute(rows, items)
    assert {d for _, _, d in want} > {0, 1}
    assert found(spark, docs(rows), items) == want
    assert found(spark, docs(rows), items, block_chars=60) == want


def test_edges(spark, docs):
    item = "this is an item of the benchmark, number one"
    items = [(1, item), (2, item), (3, None), (4, "short"), (None, "another item without any id at all")]
    rows = [(1, None), (2, ""), (3, item), (3, item), (None, "x " * 40_000 + item), (5, item[4:-3]), (6, "Another item -- without any id\nat all."), (7, item[: len(item) // 2])]
    df = docs(rows, extra=True)
    assert found(spark, df, items) == {(3, 1, 0), (3, 2, 0), (None, 1, 0), (None, 2, 0), (6, None, 0)}
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    kept = drop_leaks(df, bench)
    assert all(r.leaks == r.removed == r.h1 == "x" for r in kept.collect())
    assert sorted(map(str, drop_leaks(df, bench, block_chars=20).collect())) == sorted(map(str, kept.collect()))
    assert kept.columns == df.columns and sorted(((r.doc_id for r in kept.collect())), key=str) == [1, 2, 5, 7]
    assert found(spark, docs([]), items) == set() and found(spark, docs(rows), []) == set()


def test_many_small_blocks(spark, docs, monkeypatch):
    """Ten passes hold one automaton each and give what one pass gives; ``end`` is where the first best passage ends."""
    rows, items = make(random.Random(11))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    say = lambda **o: sorted((r.doc_id, sorted(map(tuple, r.leaks))) for r in find_leaks(docs(rows), bench, **o).collect())
    whole, parts = say(), say(block_chars=90)
    assert whole == parts
    texts, wanted = dict(rows), dict(items)
    for doc_id, leaks in whole:
        for item_id, d, end in leaks:
            p, t = plain(wanted[item_id]), plain(texts[doc_id])
            # The passage that ends there is at the least distance, and no shorter beginning of the text holds one.
            assert least(p, t[:end]) == d and least(p, t[: end - 1]) > d


def test_short_items_are_whole_words(spark, docs):
    rows = [(1, "a yes man"), (2, "yesterday"), (3, "oh, YES!"), (4, None)]
    assert found(spark, docs(rows), [(1, "yes"), (2, ""), (3, "?")], min_item=1) == {(1, 1, 0), (3, 1, 0)}
    assert found(spark, docs(rows), [(1, "yes")]) == set()
