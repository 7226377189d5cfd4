"""Byte-level BPE against the tiktoken library, and an exact round trip."""

import hashlib

import duckdb
import public_tokenizers
import pytest
import regex
import tiktoken

from gradelake.llm.bpe import LATER, decode, digests, encode, load_ranks, merge, number_words

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(PATH), special_tokens={})


ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "\n\n", "x\n\ny", "don't we'll 'S's", "a b 　 c", "\x1c\x1d a\x1cb", "日本語 テキスト", "<|endoftext|>", "😀👩‍👩‍👧 é é",
    "1234 12a ½ ٣", "tab\tx \t y", "a ՘b 𞛀 1\U00012550", "q" * 5000, "ab" * 700 + " !?" * 300, "end. ", "  lead", "a\r\nb \r\n c", " x  ", "trailing\n ", "...   ...", "a 'sb", " 's",
]


def test_odd_texts(docs, library):
    rows = [(i if i else None, t) for i, t in enumerate(ODD)] + [(3, "a b"), (3, "a b")]
    got = sorted((r.doc_id or 0, list(r.ids), bytes(r.decoded)) for r in decode(encode(docs(rows, extra=True), PATH, public_tokenizers.PATTERN, block_chars=40), PATH).collect())
    want = sorted((i or 0, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows)
    assert got == want


def test_documents(docs, sf, library):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in digests(docs(rows), PATH, public_tokenizers.PATTERN).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert got == {i: (len(ids := library.encode_ordinary(t)), sha(",".join(map(str, ids)).encode()), sha(t.encode())) for i, t in rows}


def test_empty_table(docs):
    assert digests(docs([]), PATH, public_tokenizers.PATTERN).collect() == []


def test_later_letters(library):
    """Every listed letter splits as the library splits it."""
    pattern = regex.compile(public_tokenizers.PATTERN)
    ranks = load_ranks(PATH)
    for a, b in (x.split("-") for x in LATER.split()):
        for code in {int(a, 16), int(b, 16)}:
            text = f"a{chr(code)}1 !{chr(code)}"
            words, (numbers,) = number_words([text], pattern)
            assert [i for n in numbers for i in merge(words[n].encode(), ranks)] == library.encode_ordinary(text)
