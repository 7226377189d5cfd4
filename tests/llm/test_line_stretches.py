"""Lines cut from whole texts are those of the relational cut, and no more of them is hashed at once than the bound says."""

import pyarrow as pa
from pyspark.sql import functions as F

from gradelake.llm import line_dedup as D

TEXTS = [None, "", "a", "a\n\nb", "\n", " a \t\r\n\rb\x0b\n c", "é　\n 日本 ", "x" * 3000 + "\n" + "y" * 10]


def test_lines_of_texts(docs):
    want = sorted((r.doc_id, r.line_no, r.line) for r in D.lines_of(docs(list(enumerate(TEXTS))), 1).collect())
    row, line_no, lines = D.split_lines(pa.array(TEXTS))
    assert [x for x in zip(row.tolist(), line_no.tolist(), lines.to_pylist(), strict=True) if x[2]] == want


def test_hashed_characters_are_bounded(monkeypatch):
    monkeypatch.setattr(D, "CHARS_AT_ONCE", 1000)
    seen = []
    sums = D.running_sums
    monkeypatch.setattr(D, "running_sums", lambda text: seen.append(len(text)) or sums(text))
    texts = pa.array([f"{i} " * 40 + f"\nline {i}" for i in range(200)] + ["z" * 5000])
    batch = pa.RecordBatch.from_arrays([texts], names=["text"])
    rows = list(D.text_rows(2, 10, 1)(iter([batch])))
    assert rows and max(x for x in seen if x != 5000) <= 1000 and sum(seen) == len("".join(set(x.strip() for t in texts.to_pylist() for x in t.split("\n"))))


def test_tables_of_a_very_long_line_are_not_kept():
    D.running_sums("a" * (5 * D.CHARS_AT_ONCE))
    assert len(D._TABLES[0]) <= 2 * D.CHARS_AT_ONCE + 1


def test_texts_are_cut_into_lines_by_spark_once(docs, monkeypatch):
    cuts = []
    own = D.lines_of
    monkeypatch.setattr(D, "lines_of", lambda *a: cuts.append(1) or own(*a))
    assert D.removed_lines(docs([(1, "a line of some length\nb"), (2, "a line of some length")]).select("doc_id", "text")).select(F.explode("removed")).count() == 1
    assert len(cuts) == 1
