"""Sharding against the same ring walked in plain Python."""

import struct
import zlib
from bisect import bisect_left
from collections import Counter

import pytest
import xxhash

from gradelake.llm import sharding
from gradelake.llm.sharding import CELLS, PARTS, shard_rows


def chained(*values):
    """Spark's xxhash64 of a row: each value is hashed with the hash before it as the seed."""
    h = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else struct.pack("<q", v)
        h = xxhash.xxh64_intdigest(data, seed=h)
    return h


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def walk(rows, shards, vnodes):
    """A ring of its own: home first, in ring order; then the overflow moves round the ring as a queue.  Rows are (id, text)."""
    ends = {}
    for i in range(shards * vnodes):
        end = signed(chained("point", i % shards, i // shards)) % CELLS
        ends[end] = min(ends.get(end, shards), i % shards)
    points = sorted(ends)
    arc_of = lambda cell: bisect_left(points, cell) % len(points)
    placed = []
    for i, t in rows:
        size, crc = len(t.encode()) + 16, zlib.crc32(t.encode())
        cell = signed(chained("row", i)) % CELLS
        placed.append((arc_of(cell), cell, signed(chained("part", i, size, crc)) % PARTS, i, size, crc))
    # The cells behind the last point belong to the first arc, but come last in cell order.
    placed.sort()
    bound = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    loads, out, waiting = [0] * shards, {}, {}
    for arc, *_, i, _size, _crc in placed:
        owner = ends[points[arc]]
        if loads[owner] < bound[owner]:
            out[i] = (owner, loads[owner])
            loads[owner] += 1
        else:
            waiting.setdefault(arc, []).append(i)
    queue = []
    for lap in range(2):
        for arc, end in enumerate(points):
            queue += waiting.get(arc, []) if lap == 0 else []
            while queue and loads[ends[end]] < bound[ends[end]]:
                out[queue.pop(0)] = (ends[end], loads[ends[end]])
                loads[ends[end]] += 1
    return out


@pytest.mark.parametrize(("n", "shards", "vnodes"), [(1000, 40, 64), (997, 7, 3), (5, 40, 64), (300, 1, 4)])
def test_ring(docs, n, shards, vnodes):
    ids = [i * 13 + 1 for i in range(n)]
    own = [(i, f"text {i}") for i in ids]
    rows = shard_rows(docs(own, extra=True), shards, vnodes).collect()
    assert {r.doc_id: (r.shard, r.slot) for r in rows} == walk(own, shards, vnodes)
    counts = Counter(r.shard for r in rows)
    assert max(counts.values()) - (min(counts.values()) if len(counts) == shards else 0) <= 1


def test_values_and_edges(docs):
    rows = [(1, None), (2, ""), (None, "a"), (3, "é"), (3, "é"), (4, "x" * 100_000)]
    out = shard_rows(docs(rows)).collect()
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in out), key=str) == sorted(((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows), key=str)
    assert all(r.law == "rows" and r.grown_shard is None and r.slot == 0 for r in out) and len({r.shard for r in out}) == len(rows)
    assert shard_rows(docs([])).count() == 0


def test_hot_id(docs, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 10)
    out = shard_rows(docs([(7 if i % 3 == 0 else i, "t" if i % 2 else f"{i % 30}") for i in range(400)])).collect()
    assert set(Counter(r.shard for r in out).values()) == {10} and len({(r.shard, r.slot) for r in out}) == 400


def test_most_rows_stay_when_a_shard_is_added(docs):
    """Homes move to the new shard only; with bounds a row in seven moves, where a hash of the id would move 40 in 41."""
    df = docs([(i, "t") for i in range(4000)])
    before, after = ({r.doc_id: r for r in shard_rows(df, s).collect()} for s in (40, 41))
    assert all(after[i].home in (before[i].home, 40) for i in before)
    moved = sum(after[i].shard != before[i].shard for i in before) / 4000
    assert moved < 0.25, moved
