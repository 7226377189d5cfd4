"""Chat collapse against comparing all conversations."""

import random

import pytest
from pyspark.sql import functions as F

from gradelake.llm import chat as C


def order(t):
    return tuple((x is not None, x if x is not None else 0) for x in t)


def brute(rows, chunk):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn, role, text))
    turns = {c: [(r, t) for _, r, t in sorted(ts, key=lambda x: (order(x[:1]), (x[1] is not None, x[1] or ""), (x[2] is not None, x[2] or "")))] for c, ts in convs.items()}
    out = []
    for c, own in turns.items():
        longer = [(-len(o), d) for d, o in turns.items() if o[: len(own)] == own]
        keep = min(longer)[1]
        if keep != c:
            out.append((c, len(own), keep, False, 0, None))
            continue
        for n in range(0, len(own), chunk):
            out.append((c, len(own), c, True, n // chunk, "".join(f"<|{r or ''}|>\n{t or ''}\n" for r, t in own[n : n + chunk])))
    return sorted(out)


def found(spark, rows):
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("chunk", F.lit("x")).withColumn("pos", F.lit("y"))
    return sorted((r.conv_id, r.n_turns, r.keep_id, r.kept, r.segment, r.rendered) for r in C.format_chats(df).collect())


def test_random(spark):
    rng = random.Random(9)
    rows = []
    for conv in range(120):
        rows += [(conv, n, "user" if n % 2 == 0 else "assistant", rng.choice("ab")) for n in range(rng.randrange(1, 6))]
    rng.shuffle(rows)
    assert found(spark, rows) == brute(rows, C.CHUNK)


@pytest.mark.parametrize("chunk", [3])
def test_long_conversations_are_cut(spark, monkeypatch, chunk):
    monkeypatch.setattr(C, "CHUNK", chunk)
    rows = [(c, n, "user", f"t{n}") for c, size in ((1, 10), (2, 7), (3, 10), (4, 3)) for n in range(size)] + [(5, n, "user", f"t{n}" if n < 8 else "other") for n in range(9)]
    assert found(spark, rows) == brute(rows, chunk)


def test_edges(spark):
    rows = [(None, 0, "user", "lost"), (1, 0, None, "a"), (2, 0, "", "a"), (3, None, "user", None), (3, None, "user", None), (4, None, "user", ""), (5, 0, "user", "x" * 100_000), (6, 1, "b", "q"), (6, 1, "a", "q"), (7, 3, "a", "q"), (8, -3, "u", "second"), (8, None, "u", "first"), (8, 0, "u", "third"), (8, -600, "v", "x")]
    assert found(spark, rows) == brute(rows, C.CHUNK)
    assert found(spark, []) == []
