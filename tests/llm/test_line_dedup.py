"""Line deduplication against all pairs."""

import random

import duckdb
import pytest

import corpus_pipeline
from gradelake.llm import line_dedup as D
from gradelake.llm.line_dedup import CHARS_PER_EDIT, EDITS, MIN_CHARS, budget, dedup_lines, op1_line_dedup, removed_lines


def distance(a, b, most):
    """The edit distance, or anything above ``most`` if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = {j: j for j in range(min(len(b), most) + 1)}
    for i, x in enumerate(a, 1):
        new = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            ways = [row.get(j, most + 1) + 1, new.get(j - 1, most + 1) + 1]
            ways.append(row.get(j - 1, most + 1) + (x != b[j - 1]) if j else most + 1)
            new[j] = min(ways)
        row = new
        if min(row.values()) > most:
            return most + 1
    return row.get(len(b), most + 1)


def brute(rows, min_chars=MIN_CHARS, edits=EDITS, per=CHARS_PER_EDIT):
    """``{doc_id: {line number: near}}`` of removed lines, for documents of distinct ids."""
    places = []
    for doc_id, text in sorted(rows):
        for n, line in enumerate((text or "").split("\n")):
            line = line.strip(" \t\r")
            if len(line) >= min_chars:
                places.append((doc_id, n, line))
    first = {}
    gone = {}
    for doc_id, n, line in places:
        if line in first:
            gone.setdefault(doc_id, {})[n] = False
        else:
            first[line] = (doc_id, n)
    lines = list(first)
    by_size, near = {}, set()
    for line in lines:  # in order of their first places
        for m in range(len(line) - edits, len(line) + edits + 1):
            k = budget(min(m, len(line)), edits, per)
            if any(distance(a, line, edits) <= k for a in by_size.get(m, ()) if k):
                near.add(line)
        by_size.setdefault(len(line), []).append(line)
    for doc_id, n, line in places:
        if line in near:
            gone.setdefault(doc_id, {})[n] = True
    return gone


def found(df, **options):
    return {r.doc_id: {x.line_no: x.near for x in r.removed} for r in removed_lines(df, **options).collect()}


@pytest.mark.parametrize(("seed", "small"), [(4, D.SMALL), (4, 8), (11, 8), (12, 3)])
def test_against_all_pairs(docs, monkeypatch, seed, small):
    """Dense families; the true earliest witness is found, also where characters are deleted one by one."""
    monkeypatch.setattr(D, "SMALL", small)
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.choice([22, 25, 48, 49, 90]))) for _ in range(12)]

    def change(line):
        i = rng.randrange(len(line))
        return rng.choice([line[:i] + line[i + 1 :], line[:i] + "x" + line[i + 1 :], line[:i] + "y" + line[i:], line, line[:i] + "zz" + line[i:]])

    rows = [(i, "\n".join(change(change(rng.choice(base))) for _ in range(6))) for i in range(120)]
    expected = brute(rows)
    assert any(near for x in expected.values() for near in x.values())
    assert found(docs(rows)) == expected


def test_pieces_are_compared_one_by_one():
    """What parts two pieces is never moved: as one text these would be two edits apart."""
    a, b = D.PARTED.join(["zz", ""]), D.PARTED.join(["", "zz"])
    assert D.within(a, b, 2) and not D.within_pieces(a, b, 2) and D.within_pieces(a, b, 4)
    rng = random.Random(2)
    for _ in range(2000):
        x, y = (["".join(rng.choice("ab") for _ in range(rng.randrange(4))) for _ in range(2)] for _ in range(2))
        least = sum(distance(p, q, 9) for p, q in zip(x, y, strict=True))
        one, two = D.PARTED.join(x), D.PARTED.join(y)
        for k in (1, 2, 3):
            assert D.within_pieces(one, two, k) == (least <= k)
            assert least > k or (D.letters(one) ^ D.letters(two)).bit_count() <= 2 * k
            assert bool(D.char_keys(one, k) & D.char_keys(two, k)) == (least <= k)


OPTIONS = [{"edits": 0}, {"edits": 1, "chars_per_edit": 0, "min_chars": 0}, {"edits": 3, "chars_per_edit": 8}]


@pytest.mark.parametrize(("small", "few", "options"), [*[(D.SMALL, D.FEW_CHARS, x) for x in OPTIONS], (3, 0, {"edits": 1}), (2, 16, {})])
def test_any_bound(docs, monkeypatch, options, small, few):
    """Also with left-out blocks of few lines, and with characters deleted wherever three lines share a variant."""
    monkeypatch.setattr(D, "SMALL", small)
    monkeypatch.setattr(D, "FEW_CHARS", few)
    rng = random.Random(small)
    base = ["".join(rng.choice("abcd ") for _ in range(n)) for n in (3, 9, 12, 19, 20, 31, 60)]

    def change(line):
        for _ in range(rng.randrange(5)):
            i = rng.randrange(len(line) + 1)
            line = rng.choice([line[:i] + line[i + 1 :], line[:i] + rng.choice("abx") + line[i + 1 :], line[:i] + "y" + line[i:]])
        return line

    rows = [(i, "\n".join([*(change(rng.choice(base)) for _ in range(4)), ""])) for i in range(30)]
    own = dict(zip(("min_chars", "edits", "per"), (options.get("min_chars", MIN_CHARS), options.get("edits", EDITS), options.get("chars_per_edit", CHARS_PER_EDIT)), strict=True))
    assert found(docs(rows), **options) == brute(rows, **own)


def test_on_documents(spark, sf, docs):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    assert found(docs(rows)) == brute(rows)


def test_edges(docs):
    long = "a long enough line number one"
    rows = [(3, f"{long}\nshort\n  {long}x \nother"), (1, None), (2, ""), (2, ""), (4, "q" * 3000 + "\n" + "q" * 2999), (None, long), (5, f"{long}\r\nkeep this other line please")]
    df = docs(rows, extra=True)
    out = dedup_lines(df)
    assert out.columns == df.columns and out.count() == len(rows)
    assert {(r.doc_id, r.text) for r in out.collect()} == {(3, "short\nother"), (1, None), (2, ""), (4, "q" * 3000), (None, long), (5, "keep this other line please")}
    clash = [c for c in df.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")]
    assert all(r[c] == "x" for r in out.collect() for c in clash)
    assert dedup_lines(docs([])).count() == 0 and dedup_lines(docs([]), edits=0).count() == 0


def test_counts_of_the_query(spark, sf):
    """``n_lines``, ``n_equal`` and ``n_near`` of every document against the comparison of all lines."""
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    gone = brute(rows)
    want = {i: (len(t.split("\n")), sum(not x for x in gone.get(i, {}).values()), sum(gone.get(i, {}).values())) for i, t in rows}
    assert {r.doc_id: (r.n_lines, r.n_equal, r.n_near) for r in op1_line_dedup(spark, sf).collect()} == want


def test_rows_of_one_id(docs):
    one, two = "the first text of this id, line", "quite another text of this id, line"
    rows = [(1, one), (1, one), (1, two), (2, one)]
    out = sorted((r.doc_id, r.text) for r in dedup_lines(docs(rows)).collect())
    assert out == [(1, two), (1, one), (1, one), (2, "")]


def test_hot_line(docs):
    line = "a line that a third of all documents hold"
    rows = [(i, line if i % 3 else f"line of its own, numbered {i * 7919}") for i in range(300)]
    assert found(docs(rows)) == brute(rows)


def test_short_lines(spark, sf, docs):
    """Equal lines of any length go, by the query and by the pipeline's stage; under ten characters no line is near; blank lines stay."""
    rows = [(1, "Les.\nAnd ornd.\n\n Les."), (2, "And ornd.\nab\n\n"), (3, "Lea.\nb\na\nb"), (4, "nineteen characters\ntwenty, quite another"), (5, "nineteen characterss\nnineteen charters")]
    gone = {1: {3: False}, 2: {0: False}, 3: {3: False}, 5: {0: True}}
    assert found(docs(rows)) == gone == brute(rows)
    left = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs(rows), sf).collect()}
    assert left == {i: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone.get(i, {})) for i, t in rows}
