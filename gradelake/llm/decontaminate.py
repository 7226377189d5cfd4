"""Benchmark decontamination by pigeonhole edit matching.

A test item of ``m`` characters may differ by ``k`` edits.  Cut into ``k + 1`` pieces, at least one piece of
any such copy is unchanged.  One automaton finds exact hits of all pieces in a whole document; around each hit
Myers' bit-parallel algorithm gives the smallest edit distance of the item to any passage there.

The work is a map over documents.  Only the pieces travel: the items are read in blocks of a bounded number of
characters.  A larger benchmark means more passes, each a job of its own with one automaton, whose hits are
stored, so neither tasks nor the driver hold more than one block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake.llm.common import as_row, release, stored

#: Edits allowed, as a share of an item's characters.
ERROR_RATE = 0.05
#: A piece has at least so many characters, which bounds the edits of short items; shorter items must be found as whole words.
MIN_PIECE = 16
#: Characters from which on an item is evidence.  With 1 every item counts, also a single word.
MIN_ITEM = 16
#: Characters of items in one automaton (about 100 bytes each).
BLOCK_CHARS = 1_000_000

_FOUND = "array<struct<item_id:bigint,distance:int,end:int>>"


def plain(text: str = "text") -> Column:
    """Lower case, with one space for whatever is neither a letter nor a digit; null counts as empty."""
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def budget(m: int, rate: float = ERROR_RATE, min_piece: int = MIN_PIECE) -> int:
    """Edits allowed in an item of ``m`` characters."""
    return max(0, min(int(m * rate), m // min_piece - 1))


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """``k + 1`` pieces of about equal length, with their offsets."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def masks(item: str) -> dict[str, int]:
    """For each character the bits of the places where the item has it."""
    found: dict[str, int] = {}
    for i, c in enumerate(item):
        found[c] = found.get(c, 0) | 1 << i
    return found


def nearest(peq: dict[str, int], m: int, passage: str) -> tuple[int, int]:
    """The least edit distance of the item to any part of ``passage``, and the first end of such a part."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, at = m, 0
    for i, c in enumerate(passage):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv), pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best, at = score, i + 1
        ph, mh = ph << 1, mh << 1
        pv, mv = (mh | ~(xv | ph)) & full, ph & xv & full
    return best, at


def matcher(items: list[tuple[int | None, str]], rate: float, min_piece: int) -> Callable[[str], list[dict]]:
    """A function from a plain text to the items it holds, each once, with its least distance."""
    where: dict[str, list[tuple[int, int]]] = {}
    budgets = [budget(len(text), rate, min_piece) for _, text in items]
    bits = [masks(text) for _, text in items]
    for n, (_, text) in enumerate(items):
        for offset, piece in pieces(text, budgets[n]):
            where.setdefault(piece, []).append((n, offset))
    automaton = ahocorasick.Automaton()
    for piece, owners in where.items():
        automaton.add_word(piece, (len(piece), owners))
    if where:
        automaton.make_automaton()

    def find(text: str) -> list[dict]:
        starts: dict[int, set[int]] = {}
        for end, (length, owners) in automaton.iter(text) if where else ():
            for n, offset in owners:
                begin = end + 1 - length
                if len(items[n][1]) < min_piece and not (text[begin - 1 : begin] in ("", " ") and text[end + 1 : end + 2] in ("", " ")):
                    continue
                starts.setdefault(n, set()).add(begin - offset)
        found = []
        for n, begun in starts.items():
            item_id, item = items[n]
            m, k = len(item), budgets[n]
            best = None
            for start in sorted(begun):
                if start >= 0 and text.startswith(item, start):
                    best = (0, start + m)
                    break
            if best is None:
                low = high = None
                spans = []  # windows that overlap are searched as one
                for start in sorted(begun):
                    if high is not None and start - k <= high:
                        high = start + m + k
                    else:
                        spans += [(low, high)] if high is not None else []
                        low, high = start - k, start + m + k
                spans.append((low, high))
                for low, high in spans:
                    low = max(0, low)
                    distance, end = nearest(bits[n], m, text[low:high])
                    if distance <= k and (best is None or distance < best[0]):
                        best = (distance, low + end)
            if best is not None:
                found.append({"item_id": item_id, "distance": best[0], "end": best[1]})
        return found

    return find


def item_blocks(benchmark: DataFrame, min_item: int, block_chars: int) -> Iterator[list[tuple[int | None, str]]]:
    """The distinct items as plain text, in blocks of about ``block_chars`` characters."""
    items = benchmark.select("item_id", plain().alias("text")).where(F.length("text") >= max(1, min_item)).distinct()
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, -(-chars // block_chars))
    for block in range(n):
        own = items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == block)
        yield sorted(((r.item_id, r.text) for r in own.toLocalIterator()), key=repr)


def _hits(shared: Broadcast, rate: float, min_piece: int) -> Callable[[Column], Column]:
    @F.arrow_udf(_FOUND)
    def hits(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        find = matcher(shared.value, rate, min_piece)
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("end", pa.int32())]))
        for texts in batches:
            yield pa.array([find(t.as_py()) for t in texts], kind)
        release()

    return hits.asNondeterministic()  # else a filter on the hits runs it twice


def _marked(docs: DataFrame, benchmark: DataFrame, rate: float, min_piece: int, min_item: int, block_chars: int) -> DataFrame:
    """``row, leaks`` for every row of ``docs``."""
    context = docs.sparkSession.sparkContext
    rows = docs.select(as_row(docs), "doc_id", plain().alias("text"))
    none = F.expr(f"cast(array() as {_FOUND})")
    blocks = item_blocks(benchmark, min_item, block_chars)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return rows.select("row", (_hits(context.broadcast(first), rate, min_piece)("text") if first else none).alias("leaks"))
    passes = []
    key = ["doc_id", F.xxhash64(F.lit(11), "text").alias("h1"), F.xxhash64(F.lit(10_007), "text").alias("h2")]
    for items in chain((first, second), blocks):
        if items:
            shared = context.broadcast(items)
            own = rows.select(*key, _hits(shared, rate, min_piece)("text").alias("leaks")).where(F.size("leaks") > 0)
            passes.append(stored(own.distinct(), "leaks"))
            shared.unpersist()
    if not passes:
        return rows.select("row", none.alias("leaks"))
    found = reduce(DataFrame.unionByName, passes).groupBy("doc_id", "h1", "h2").agg(F.flatten(F.collect_list("leaks")).alias("leaks"))
    keyed = rows.select("row", *key).alias("d").join(stored(found, "leaks").alias("l"), F.expr("d.doc_id <=> l.doc_id and d.h1 = l.h1 and d.h2 = l.h2"), "left")
    return keyed.select("d.row", F.coalesce("l.leaks", none).alias("leaks"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, min_piece: int = MIN_PIECE, min_item: int = MIN_ITEM, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` with a column ``leaks``: for each item that the document holds its id, the least distance, and where in the plain text the first such passage ends.

    Texts and items are compared as plain text (:func:`plain`).  An item may differ by ``rate`` of its characters,
    and by fewer if pieces of ``min_piece`` characters forbid it.  Items of under ``min_item`` plain characters are
    no evidence; with 1 all count, and those shorter than a piece must be whole words of the text.

    All columns of ``docs`` are kept, whatever they are called (only a column ``leaks`` is replaced).  Null and
    empty texts hold nothing; so do all texts if there are no items, and an empty table gives an empty result.
    Null and empty items are never found.  Items of equal text but different ids are all reported, and so is each
    of repeated rows of ``docs``.  Texts of any length are searched whole.  Of passages at the least distance the
    first one counts.
    """
    kept = [F.col(f"row.`{c}`") for c in docs.columns if c != "leaks"]
    return _marked(docs, benchmark, rate, min_piece, min_item, block_chars).select(*kept, "leaks")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that hold a test item; columns are as they were.  Other cases are as in :func:`find_leaks`."""
    given = {"rate": ERROR_RATE, "min_piece": MIN_PIECE, "min_item": MIN_ITEM, "block_chars": BLOCK_CHARS} | options
    return _marked(docs, benchmark, **given).where(F.size("leaks") == 0).select("row.*")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and test item it holds; documents without any have none."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.item_id", "leak.distance", "leak.end")
