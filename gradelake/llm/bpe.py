"""Byte-level BPE by a global shuffle of distinct words.

1. *Pre-tokens with positions.*  Map tasks split whole texts and number the distinct words of a block of
   documents; each document becomes the list of its word numbers, in order of position.
2. *Distinct words.*  The words of all blocks are dealt out by their hash; a task meets all copies of a word
   and merges it once.
3. *Join back.*  The ids return to the blocks that hold the word; documents are reassembled by position.
4. *Decoding.*  Ids are joined with the token-byte table, which is broadcast: it is as large as the vocabulary.

Word lists and number lists travel packed, so the shuffles are smaller than the text.  A word that every
document holds is one entry per block, so no word is a hot key.
"""

from __future__ import annotations

import base64
import heapq
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake.llm.common import frugal, release

#: A block of documents ends after so many characters.
BLOCK_CHARS = 8_000_000
#: Word numbers that travel in one row.
PART_TOKENS = 250_000
#: Merged words a task remembers; beyond, it forgets them and merges again.
REMEMBERED = 200_000
#: The token-byte table is broadcast, so its size is checked.
MAX_TOKENS = 2_000_000

#: Letters and numbers newer than the Unicode version of the tiktoken library's splitter, which takes them for other signs.
LATER = (
    "558-558 58b-58c 88f-88f c5c-c5c cdc-cdc 208f-208f 209d-209f a7ce-a7cf a7d2-a7d2 a7d4-a7d4 a7dd-a7dd a7e2-a7e2 a7f1-a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee "
    "11b0a-11b0a 11db0-11ddb 11de0-11de9 11df1-11df1 1246f-1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff3 16ff4-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 "
    "1b123-1b128 1b168-1b168 1d6a6-1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff "
    "2b73a-2b73f 2b81e-2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f"
)
_LATER = re.compile("[" + "".join(f"{chr(int(a, 16))}-{chr(int(b, 16))}" for a, b in (x.split("-") for x in LATER.split())) + "]")

_HEAD = [("block", pa.string()), ("bucket", pa.int32())]
_KINDS = {
    "words": pa.schema([*_HEAD, ("sizes", pa.binary()), ("words", pa.binary())]),
    "docs": pa.schema([*_HEAD, ("numbers", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32()))]),
    "merged": pa.schema([*_HEAD, ("sizes", pa.binary()), ("ids", pa.binary())]),
}
_DDL = {
    "words": "block string, bucket int, sizes binary, words binary",
    "docs": "block string, bucket int, numbers binary, doc_ids array<bigint>, lengths array<int>",
    "merged": "block string, bucket int, sizes binary, ids binary",
}
#: Runs of blanks, and a blank or nothing at the end; what counts as one here is at least what the pattern takes for one.
_BLANK = "[\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_BLANKS, _OPEN_END = _BLANK + _BLANK, rf"(?:\A|{_BLANK})\z"


def pack(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, compressed by byte planes."""
    planes = np.ascontiguousarray(numbers, "<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unpack(packed: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, len(raw) // 4).T).view("<u4").ravel()


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: the pair of least rank is merged, the first of equals, until none is left."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > 64:
        return _merge_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        best, at = None, 0
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1])
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap of pairs, for words of any length."""
    n = len(word)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    gone = bytearray(n)
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] < n and (rank := ranks.get(word[i : (end := after[after[i]])])) is not None:
            heapq.heappush(heap, (rank, i, end))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, end = heapq.heappop(heap)
        if gone[i] or after[i] >= n or after[after[i]] != end:
            continue
        gone[after[i]] = 1
        after[i] = end
        if end < n:
            before[end] = i
        offer(i)
        offer(before[i])
    return [ranks[word[i : after[i]]] for i in range(n) if not gone[i]]


def _split(pattern: regex.Pattern, text: str, later: bool) -> list[str]:
    if later and _LATER.search(text):
        return [text[m.start() : m.end()] for m in pattern.finditer(_LATER.sub("!", text))]
    return pattern.findall(text)


def split_words(texts: list[str], pattern: regex.Pattern, later: bool = False) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``words, ends, numbers, pieces, of``: the distinct pre-tokens of a block, and its texts as pieces.

    A single space between other signs always begins a pre-token, so texts are cut there first and each
    distinct piece is split once; texts with other runs of blanks are one piece.  Text ``i`` is
    ``pieces[of[i]:of[i + 1]]``, and piece ``p`` is ``numbers[ends[p]:ends[p + 1]]``.
    """
    whole_texts = pa.array(texts, pa.large_string())
    blanks = pc.match_substring_regex(whole_texts, _BLANKS)
    parts = pc.split_pattern(whole_texts, " ")
    if pc.any(blanks).as_py():
        one = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32)), whole_texts)
        parts = pc.if_else(blanks, one, parts)
    of = np.concatenate([[0], np.cumsum(parts.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    coded = parts.flatten().dictionary_encode()
    kinds, pieces = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    # The first piece of a text has no space before it.
    first = np.zeros(len(pieces), bool)
    first[of[:-1]] = True
    bare, spaced = (np.bincount(pieces[x], minlength=len(kinds)) > 0 for x in (first, ~first))
    # Behind an empty piece, or one that ends with a blank, the next space would be part of a run; such are split alone.
    open_end = pc.match_substring_regex(kinds, _OPEN_END).to_numpy(zero_copy_only=False)
    inner, lone, heads = (np.flatnonzero(x) for x in (spaced & ~open_end & (not later), spaced & (open_end | later), bare))
    number: dict[str, int] = defaultdict(count().__next__)
    numbers, starts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(inner):
        listed = pa.ListArray.from_arrays(pa.array([0, len(inner)], pa.int32()), kinds.take(pa.array(inner)))
        found = pattern.findall(" " + pc.binary_join(listed, pa.scalar(" ", pa.large_string()))[0].as_py())
        numbers = np.fromiter(map(number.__getitem__, found), np.int64, len(found))
        starts = np.flatnonzero(np.fromiter((w[0] == " " for w in number), bool, len(number))[numbers])
        if len(starts) != len(inner):
            raise ValueError("a space inside a text does not begin a pre-token of this pattern")
    alone = [" " + x for x in kinds.take(pa.array(lone)).to_pylist()] + kinds.take(pa.array(heads)).to_pylist()
    split = [[number[w] for w in _split(pattern, x, later)] for x in alone]
    if not later and _LATER.search("".join([w for w in number if not w.isascii()])):
        return split_words(texts, pattern, True)
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    ends = np.concatenate([starts, len(numbers) + np.cumsum(sizes) - sizes, [len(numbers) + sizes.sum()]])
    numbers = np.concatenate([numbers, np.fromiter((n for x in split for n in x), np.int64, int(sizes.sum()))])
    place, head_place = np.zeros(len(kinds), np.int64), np.zeros(len(kinds), np.int64)
    place[inner], place[lone] = np.arange(len(inner)), len(inner) + np.arange(len(lone))
    head_place[heads] = len(inner) + len(lone) + np.arange(len(heads))
    return list(number), ends, numbers, np.where(first, head_place[pieces], place[pieces]), of


def number_words(texts: list[str], pattern: regex.Pattern) -> tuple[list[str], list[np.ndarray]]:
    """The distinct pre-tokens of a block, and each text as their numbers."""
    words, ends, numbers, pieces, of = split_words(texts, pattern)
    table = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(numbers.astype(np.uint32)))
    flat = table.take(pa.array(pieces)).flatten().to_numpy(zero_copy_only=False)
    at = np.concatenate([[0], np.cumsum(np.diff(ends)[pieces])])[of]
    return words, [flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def block_rows(pattern: str, buckets: int, block_chars: int, kind: str) -> Callable:
    """Map tasks: blocks of documents as word numbers (``docs``), or each block's distinct words by bucket of their hash (``words``).

    The two kinds are made by two passes over the same rows, so that neither travels with the other.
    """

    def rows(ids: list, texts: list[str], compiled: regex.Pattern) -> Iterator[dict]:
        words, numbers = number_words(texts, compiled) if kind == "docs" else (split_words(texts, compiled)[0], [])
        encoded = [w.encode() for w in words]
        of = np.fromiter(map(zlib.crc32, encoded), np.uint32, len(encoded)) % buckets
        order = np.argsort(of, kind="stable").astype(np.uint32)
        owns = [own for own in np.split(order, np.flatnonzero(np.diff(of[order])) + 1) if len(own)]
        if kind == "words":
            sizes = np.fromiter(map(len, encoded), np.uint32, len(encoded))
            for own in owns:
                yield {"bucket": int(of[own[0]]), "sizes": pack(sizes[own]), "words": zstandard.ZstdCompressor(level=3).compress(b"".join([encoded[i] for i in own]))}
            return
        for own in owns:
            yield {"bucket": int(of[own[0]]), "numbers": pack(own)}
        start = tokens = 0
        for i, own in enumerate(numbers):
            tokens += len(own)
            if i + 1 == len(numbers) or tokens >= PART_TOKENS:
                part = numbers[start : i + 1]
                yield {"bucket": -1, "numbers": pack(np.concatenate(part)), "doc_ids": ids[start : i + 1], "lengths": list(map(len, part))}
                start, tokens = i + 1, 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = regex.compile(pattern)
        ids, texts, chars, n = [], [], 0, 0

        def emit() -> Iterator[pa.RecordBatch]:
            # Both passes must see the same block, so its name holds what it is made of.
            name = f"{TaskContext.get().partitionId()}-{n}-{xxhash.xxh64_hexdigest(repr((ids, chars)).encode())}"
            for row in rows(ids, texts, compiled):
                yield pa.RecordBatch.from_pylist([row | {"block": name}], schema=_KINDS[kind])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(doc_id)
                texts.append(text.as_py() or "")
                chars += len(texts[-1])
                if chars >= block_chars:
                    yield from emit()
                    ids, texts, chars, n = [], [], 0, n + 1
        if ids:
            yield from emit()

    return frugal(run)


def merge_words(shared_ranks: Broadcast) -> Callable:
    """Tasks that hold all copies of a word, in order of buckets: merge each distinct word once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = shared_ranks.value
        known: dict[bytes, list[int]] = {}
        bucket = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != bucket or len(known) > REMEMBERED:
                    known, bucket = {}, row["bucket"]
                ends = np.cumsum(unpack(row["sizes"])).tolist()
                body = zstandard.ZstdDecompressor().decompress(row["words"])
                words = [body[a:b] for a, b in zip([0, *ends], ends, strict=False)]
                for w in words:
                    if w not in known:
                        known[w] = merge(w, ranks)
                found = [known[w] for w in words]
                sizes = pack(np.fromiter(map(len, found), np.uint32, len(found)))
                flat = pack(np.fromiter((i for ids in found for i in ids), np.uint32))
                yield pa.RecordBatch.from_pylist([{"block": row["block"], "bucket": bucket, "sizes": sizes, "ids": flat}], schema=_KINDS["merged"])

    return frugal(run)


def token_bytes(ranks: dict[bytes, int]) -> pa.Array:
    """The token-byte table: bytes at the place of their id."""
    tokens = {rank: token for token, rank in ranks.items()}
    return pa.array([tokens.get(i) for i in range(max(tokens) + 1)], pa.large_binary())


def joined_bytes(ids: pa.ListArray, table: pa.Array) -> pa.Array:
    """The bytes of each list of ids: all ids look up the token-byte table, and the bytes of a list lie side by side."""
    flat = ids.flatten()
    tokens = table.take(flat)
    if tokens.null_count:
        raise ValueError("an id is not in the token-byte table")
    sizes = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.frombuffer(tokens.buffers()[1], np.int64)[: len(tokens) + 1] if len(tokens) else np.zeros(1, np.int64)
    of = np.ascontiguousarray(ends[np.concatenate([[0], np.cumsum(sizes)])])
    whole = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(of), tokens.buffers()[2] or pa.py_buffer(b"")])
    return pc.if_else(ids.is_valid(), whole, pa.scalar(None, pa.large_binary())).cast(pa.binary())


def reassemble(shared_table: Broadcast | None) -> Callable:
    """One block: look up the ids of each word number, document by document, in order of position; with a table also the bytes."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.to_pylist()
        numbers = {r["bucket"]: r["numbers"] for r in rows if r["bucket"] >= 0}
        merged = {r["bucket"]: r for r in right.to_pylist()}
        if numbers.keys() != merged.keys():
            raise ValueError("a block of documents was not read the same twice")
        per_word = pa.array([], pa.list_(pa.int32()))
        if numbers:
            own = np.concatenate([unpack(numbers[b]) for b in numbers])
            sizes = np.concatenate([unpack(merged[b]["sizes"]) for b in numbers])
            flat = np.concatenate([unpack(merged[b]["ids"]) for b in numbers])
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            per_word = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32))).take(pa.array(np.argsort(own)))
        out = []
        for r in (r for r in rows if r["bucket"] < 0):
            listed = per_word.take(pa.array(unpack(r["numbers"])))
            word_ends = np.concatenate([[0], np.cumsum(listed.value_lengths().to_numpy(zero_copy_only=False))])
            ends = word_ends[np.concatenate([[0], np.cumsum(r["lengths"])])]
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), listed.flatten())
            columns = {"doc_id": pa.array(r["doc_ids"], pa.int64()), "ids": ids}
            if shared_table is not None:
                columns["decoded"] = joined_bytes(ids, shared_table.value)
            out.append(pa.table(columns))
        release()
        return pa.concat_tables(out)

    return run


def encode(docs: DataFrame, ranks_path: str, pattern: str, block_chars: int = BLOCK_CHARS, decoded: bool = False) -> DataFrame:
    """``doc_id, ids`` for every row of ``docs``, without special tokens; with ``decoded`` also the bytes the ids stand for.

    A null text is empty and has no ids.  Repeated rows and null ids stay rows of their own; other columns are
    ignored; an empty table gives an empty result.  Texts of any length are encoded whole.  ``docs`` is read twice and
    must give the same rows in the same order, as files do; store what comes out of a shuffle first.
    """
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranks = checked_ranks(ranks_path)
    table = spark.sparkContext.broadcast(token_bytes(ranks)) if decoded else None
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    words, blocks = (rows.mapInArrow(block_rows(pattern, buckets, block_chars, kind), _DDL[kind]) for kind in ("words", "docs"))
    merged = words.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(merge_words(spark.sparkContext.broadcast(ranks)), _DDL["merged"])
    return blocks.groupBy("block").cogroup(merged.groupBy("block")).applyInArrow(reassemble(table), "doc_id long, ids array<int>" + ", decoded binary" * decoded)


def checked_ranks(path: str) -> dict[bytes, int]:
    ranks = load_ranks(path)
    if len(ranks) > MAX_TOKENS:
        raise ValueError(f"a vocabulary of {len(ranks)} tokens is not broadcast")
    return ranks


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """Add ``decoded``, the bytes of ``ids``: a map-side join with the token-byte table.  A null list decodes to null, an unknown id is an error."""
    shared = encoded.sparkSession.sparkContext.broadcast(token_bytes(checked_ranks(ranks_path)))

    @F.arrow_udf("binary")
    def look_up(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for ids in batches:
            yield joined_bytes(ids, shared.value)

    return encoded.withColumn("decoded", look_up("ids"))


def digests(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Encode, decode, and reduce both to digests; with ``with_ids`` the ids stay beside them."""
    both = encode(docs, ranks_path, pattern, block_chars, decoded=True)
    listed = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return both.select("doc_id", *(["ids"] if with_ids else []), F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
