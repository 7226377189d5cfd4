"""Line deduplication across a corpus: equal lines, and lines within a bound of edits, keep the earliest.

A line of ``m`` characters may differ by ``k`` edits (a share of its length, up to a maximum).  Near lines are
found by a deletion-neighbourhood join:

1. *Filter*: cut into ``k + 1`` pieces, two near lines share a piece, moved by at most ``k`` characters.  Only
   lines that share one with another distinct line go on.  All pieces are hashed from running sums over a batch.
2. *Variants*: each such line is cut into ``k + 2`` pieces; every variant without ``k`` of them is a hashed key.
   The longer line of a pair tries the few ways in which its pieces can be moved.
3. *Join*: of lines with equal variants the left-out pieces are compared one by one with those of the earlier lines
   whose letters are nearly the same.  Where more
   than ``SMALL`` lines share a variant, none are compared: they are cut into three times as many pieces, and step 2
   starts again for them.  Once the lines of a variant differ in few characters only, the variants without ``k`` of
   these characters, with the places of them, are keys.  All lines of such a key are within ``k`` edits of each
   other, so its earliest line is the witness of the rest.
4. *Verification*: the edit distance of each line to its witness is computed on the whole lines.

Equal lines are reduced to one before all this, in the map tasks.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from itertools import combinations, combinations_with_replacement, count, product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gradelake.llm.common import as_row, frugal, stored, wide_hash

#: Characters of a line, after trimming, from which on it is compared: all but blank lines.
MIN_CHARS = 1
#: Edits that make two lines near at most, and characters of the shorter line that each edit takes; 0 allows all edits at any length.
EDITS, CHARS_PER_EDIT = 2, 10
#: Lines of one variant that are compared with each other; if it has more, they are cut more finely.
SMALL = 4096
#: Characters in which the lines of a larger variant may differ for these to be deleted one by one.
FEW_CHARS = 16
#: Keys of pieces (8 bytes each) that are broadcast, else joined by shuffle.
BROADCAST_KEYS = 1_000_000
#: What parts the left-out pieces of a line; no line holds it.
PARTED = "\n"
#: Rows of variants that a task hands on at once.
ROWS_OUT = 50_000
#: Keys that are hashed at once, and characters of lines; a longer line is hashed alone.
KEYS_AT_ONCE, CHARS_AT_ONCE = 200_000, 400_000
#: Groups of up to so many lines are compared without arrays.
FEW_LINES = 12

_DOC = ("doc_id", "version")
_LINE = ("h1", "h2")
_PLACE = ("doc_id", "version", "line_no")


def lines_of(docs: DataFrame, min_chars: int) -> DataFrame:
    """``doc_id, version, line_no, line, n_chars`` for the lines that can be removed, those of at least ``min_chars``; a line is trimmed of blanks."""
    split = F.posexplode(F.split(F.coalesce(F.col("text"), F.lit("")), "\n"))
    lines = docs.select("doc_id", version(), split.alias("line_no", "line"))
    return lines.withColumn("line", F.btrim("line", F.lit(" \t\r"))).withColumn("n_chars", F.length("line")).where(F.col("n_chars") >= min_chars)


def version(text: str = "text") -> Column:
    """Tells rows apart that share a ``doc_id`` but not a text."""
    return F.xxhash64(text).alias("version")


def budget(m: int, edits: int, per: int) -> int:
    """Edits allowed where the shorter line has ``m`` characters."""
    return min(edits, m // per) if per else edits


def moves(pieces: int, total: int) -> list[tuple[int, ...]]:
    """By how much each of as many edited pieces as there are edits can grow, where the line grows by ``total``."""
    return [v for v in product(range(-pieces, pieces + 1), repeat=pieces) if sum(v) == total and sum(map(abs, v)) <= pieces]


_RADIX = 0x9E3779B97F4A7C15
_INVERSE = pow(_RADIX, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_TABLES = [_powers(_RADIX, 1), _powers(_INVERSE, 1)]


def running_sums(text: str) -> tuple[np.ndarray, np.ndarray]:
    """``sums, down``: ``(sums[b] - sums[a]) * down[a]`` is a hash of ``text[a:b]`` that does not depend on its place."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    tables = _TABLES
    if len(codes) >= len(tables[0]):
        tables = [_powers(_RADIX, len(codes) + 1), _powers(_INVERSE, len(codes) + 1)]
        # Workers live on after a task, so what a very long line needs is not kept.
        if len(codes) <= 2 * CHARS_AT_ONCE:
            _TABLES[:] = tables
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes + np.uint64(1)) * tables[0][: len(codes)], out=sums[1:])
    return sums, tables[1]


def filter_keys(lines: list[str], n: np.ndarray, edits: int, per: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``at, keys``: the pieces a line of ``n`` characters can share with a near one, hashed: as the shorter line, and as one longer by each number of characters."""
    sums, down = running_sums("".join(lines))
    start = np.cumsum(n) - n
    for longer in range(edits + 1):
        m = n - longer
        allowed = np.minimum(edits, m // per) if per else np.full(len(n), edits)
        for k in range(max(1, longer), edits + 1):
            at = np.flatnonzero((m >= 0) & (allowed == k))
            # A piece that has ``q`` before it moves by no more than there are edits left for either side of it.
            places = [(q, by) for q in range(k + 1) for by in range(max(-q, longer - k + q), min(q, longer + k - q) + 1)]
            for q, by in places if len(at) else ():
                low, high = (m[at] * c // (k + 1) + by for c in (q, q + 1))
                own = at[(low >= 0) & (low <= high) & (high <= n[at])]
                low, high = (start[own] + m[own] * c // (k + 1) + by for c in (q, q + 1))
                key = (sums[high] - sums[low]) * down[low] + m[own].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(q * 0xFF51AFD7ED558CCD % (1 << 64))
                yield own, ((key ^ (key >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def split_lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """``row, line_no, line`` of a batch of texts, as :func:`lines_of` cuts and trims them; a null text is empty."""
    parts = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    sizes = parts.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes), pc.utf8_trim(parts.flatten(), " \t\r")


def at_once(lines: pa.Array) -> Iterator[tuple[int, list[str], np.ndarray]]:
    """Stretches of ``lines`` of ``CHARS_AT_ONCE`` characters, or one line that is longer: where they start, and their characters."""
    n = pc.utf8_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(n)
    start = 0
    while start < len(n):
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + CHARS_AT_ONCE, "right")))
        yield start, lines.slice(start, end - start).to_pylist(), n[start:end]
        start = end


def filter_rows(edits: int, per: int) -> Callable:
    """Rows ``key, h1, h2``: all keys of each line, with its hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for start, lines, n in at_once(batch.column(2)):
                for own, key in filter_keys(lines, n, edits, per):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, h1[start + own], h2[start + own])], schema=_KEYS)

    return run


def text_rows(edits: int, per: int, min_chars: int) -> Callable:
    """From whole texts rows ``key, h1``: all keys of their lines, with a hash of the line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, lines = split_lines(batch.column(0))
            # Lines of a batch are reduced to one here.
            lines = lines.unique()
            for _, own_lines, n in at_once(lines.filter(pc.greater_equal(pc.utf8_length(lines), min_chars))):
                hashes = np.fromiter(map(xxhash.xxh64_intdigest, own_lines), np.uint64, len(own_lines)).view(np.int64)
                for own, key in filter_keys(own_lines, n, edits, per):
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(hashes[own])], names=["key", "h1"])

    return run


def hit_rows(edits: int, per: int, min_chars: int, shared: Broadcast) -> Callable:
    """From whole texts rows ``doc_id, version, line_no, line`` for the lines that have one of the ``shared`` keys, which are sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches if len(known) else ():
            row, line_no, lines = split_lines(batch.column(2))
            coded = lines.dictionary_encode()
            hit = np.zeros(len(coded.dictionary), bool)
            for start, own_lines, n in at_once(coded.dictionary):
                for own, key in filter_keys(own_lines, n, edits, per):
                    hit[start + own[known[np.searchsorted(known, key) % len(known)] == key]] = True
            hit &= pc.utf8_length(coded.dictionary).to_numpy(zero_copy_only=False) >= min_chars
            at = np.flatnonzero(hit[coded.indices.to_numpy(zero_copy_only=False)])
            rows = batch.select([0, 1]).take(pa.array(row[at]))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(line_no[at].astype(np.int32)), lines.take(pa.array(at))], names=[*_PLACE, "line"])

    return run


@lru_cache(maxsize=64)
def _ways(count: int, k: int, longer: int) -> tuple[np.ndarray, np.ndarray]:
    """Ways to leave out ``k`` of ``count`` pieces of a line that is ``longer`` than a near one: the pieces, and by how much the line has grown after each."""
    ways = [(out, grown) for out in combinations(range(count), k) for grown in moves(k, longer)]
    out, grown = (np.array(x, np.int64).reshape(-1, k) for x in zip(*ways, strict=True))
    return out, grown.cumsum(1)


def piece_keys(lines: list[str], edits: int, per: int, level: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``k, at, keys, low, high``: variants of ``lines[at]`` without the ``k`` pieces ``low`` to ``high``; each level has three times as many pieces."""
    n = np.fromiter(map(len, lines), np.int64, len(lines))
    sums, down = running_sums("".join(lines))
    start = np.cumsum(n) - n
    for longer in range(edits + 1):
        m = n - longer
        allowed = np.minimum(edits, m // per) if per else np.full(len(n), edits)
        for k in range(max(1, longer), edits + 1):
            n_pieces = (k + 2) * 3**level
            mine = np.flatnonzero((m >= 0) & (allowed == k))
            out, grown = _ways(n_pieces, k, longer) if len(mine) else (None, None)
            step = max(1, KEYS_AT_ONCE // len(out)) if len(mine) else 1
            for at in (mine[i : i + step] for i in range(0, len(mine), step)):
                cuts = m[at, None] * np.arange(n_pieces + 1) // n_pieces
                low, high = cuts[:, out], cuts[:, out + 1] + grown
                low[:, :, 1:] += grown[:, :-1]
                first = np.insert(high, 0, 0, 2)
                last = np.concatenate([low, np.broadcast_to(n[at, None, None], (*low.shape[:2], 1))], 2)
                good = (low <= high).all(2) & (first <= last).all(2)
                line, way = np.nonzero(good)
                low, high, first, last = low[good], high[good], first[good] + start[at][line, None], last[good] + start[at][line, None]
                key = m[at][line].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(level)
                for part in (*out[way].T.astype(np.uint64), *((sums[last] - sums[first]) * down[first]).T):
                    key = (key ^ part) * np.uint64(0xBF58476D1CE4E5B9)
                    key ^= key >> np.uint64(29)
                yield k, at[line], key.view(np.int64), low, high


def char_keys(text: str, k: int) -> set[str]:
    """Variants without up to ``k`` characters, with ``k`` places where characters of either text may be missing.

    What parts the pieces stays, so texts of one variant are within ``k`` edits piece by piece.
    """
    found = set()
    own = [i for i, c in enumerate(text) if c != PARTED]
    for n in range(min(k, len(own)) + 1):
        for gone in combinations(own, n):
            rest, at = [], 0
            for i in gone:
                rest.append(text[at:i])
                at = i + 1
            common = "".join(rest) + text[at:]
            gaps = tuple(i - j for j, i in enumerate(gone))
            found.update(f"{sorted(gaps + more)}/{common}" for more in combinations_with_replacement(range(len(common) + 1), k - n))
    return found


def _hash(text: str) -> int:
    """Signed 64 bits."""
    return xxhash.xxh64_intdigest(text.encode()) - (1 << 63)


def piece_rows(edits: int, per: int, level: int) -> Callable:
    """The keys of each line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for _, at, keys, _, _ in piece_keys(batch.column(2).to_pylist(), edits, per, level):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys, h1[at], h2[at])], schema=_KEYS)

    return run


def left_rows(edits: int, per: int, level: int) -> Callable:
    """For the keys that a line shares: what they leave out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            shared = np.unique(batch.column("keys").flatten().to_numpy(zero_copy_only=False))
            for k, at, keys, low, high in piece_keys([r["line"] for r in rows], edits, per, level):
                own = np.flatnonzero(np.isin(keys, shared))
                out = []
                for i, key, a, b in zip(at[own].tolist(), keys[own].tolist(), low[own].tolist(), high[own].tolist(), strict=True):
                    row = rows[i]
                    out.append((key, *(row[c] for c in (*_LINE, *_PLACE)), k, PARTED.join([row["line"][x:y] for x, y in zip(a, b, strict=True)])))
                yield _batch(out, _LEFT)

    return run


def _common(a: str, b: str) -> int:
    """Characters at the start of both."""
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def char_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the keys that too many lines share: keys of characters, without a text, where few tell the lines apart; else the row as it is."""
    for batch in batches:
        out: list[tuple] = []
        for row in batch.to_pylist():
            # What the least and the greatest text begin or end with is common to all.
            head = _common(row["low"], row["high"])
            tail = min(_common(row["back_low"], row["back_high"]), row["least"] - head)
            text, k, own = row["left"][head : len(row["left"]) - tail], row["k"], tuple(row[c] for c in (*_LINE, *_PLACE))
            if row["most"] <= 4 * k + head + tail or row["most"] - head - tail <= FEW_CHARS:
                out += [(_hash(f"{row['key']}/{x}"), *own, k, None) for x in char_keys(text, k)]
            else:
                out.append((row["key"], *own, k, text))
            if len(out) >= ROWS_OUT:
                yield _batch(out, _LEFT)
                out = []
        yield _batch(out, _LEFT)


_KEYS = pa.schema([(n, pa.int64()) for n in ("key", "h1", "h2")])
_LEFT = pa.schema([*[(n, pa.int64()) for n in ("key", *_LINE, *_PLACE)], ("k", pa.int32()), ("left", pa.string())])
_LEFT_DDL = ", ".join(f"{n} bigint" for n in ("key", *_LINE, *_PLACE)) + ", k int, left string"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def line_table(places: DataFrame) -> DataFrame:
    """One row per distinct line of ``places``: its earliest place and its number of rows."""
    return places.groupBy(*_LINE).agg(F.min(F.struct(*_PLACE)).alias("first"), F.count("*").alias("n"))


def _hashed(docs: DataFrame, min_chars: int) -> DataFrame:
    h1, h2 = wide_hash(F.col("line"))
    return lines_of(docs, min_chars).withColumns({"h1": h1, "h2": h2})


def candidates(docs: DataFrame, min_chars: int, edits: int, per: int) -> DataFrame:
    """Lines that share a piece with another distinct line: ``h1, h2`` and their earliest place and text."""
    keyed = docs.select("text").mapInArrow(frugal(text_rows(edits, per, min_chars)), "key bigint, h1 bigint")
    # A key of one line only has one hash, however many rows that line has.
    shared = keyed.groupBy("key").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low <> high").select("key")
    shared = stored(shared, "line-pieces")
    if shared.count() <= BROADCAST_KEYS:
        keys = docs.sparkSession.sparkContext.broadcast(np.sort(shared.toArrow().column(0).to_numpy()))
        rows = docs.select("doc_id", version(), "text")
        kind = StructType(rows.schema.fields[:2]).add("line_no", "integer").add("line", "string")
        h1, h2 = wide_hash(F.col("line"))
        hits = rows.mapInArrow(frugal(hit_rows(edits, per, min_chars, keys)), kind).withColumns({"h1": h1, "h2": h2})
    else:
        lines = _hashed(docs, min_chars)
        met = lines.select(*_LINE, "line").mapInArrow(frugal(filter_rows(edits, per)), "key bigint, h1 bigint, h2 bigint").join(shared, "key")
        hits = lines.join(stored(met.select(*_LINE).distinct(), "line-candidates"), list(_LINE))
    texts = hits.groupBy(*_LINE).agg(F.min(F.struct(*_PLACE, "line")).alias("first"))
    return stored(texts.select(*_LINE, "first.*"), "line-texts")


def near_lines(docs: DataFrame, min_chars: int, edits: int, per: int) -> DataFrame:
    """``h1, h2, like``: the lines within the bound of an earlier one, and the first place of the earliest such one."""
    texts = candidates(docs, min_chars, edits, per)
    back, length, place = F.reverse("left"), F.length("left"), F.struct(*_PLACE, *_LINE)
    lines, parts = texts, []
    for level in count():
        pieces = lines.select(*_LINE, "line").mapInArrow(frugal(piece_rows(edits, per, level)), "key bigint, h1 bigint, h2 bigint")
        shared = pieces.groupBy("key").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low <> high").select("key")
        own = pieces.join(shared, "key").groupBy(*_LINE).agg(F.collect_set("key").alias("keys"))
        rows = stored(lines.join(own, list(_LINE)).mapInArrow(frugal(left_rows(edits, per, level)), _LEFT_DDL), "line-variants")
        sizes = rows.groupBy("key").agg(F.count("*").alias("size"), F.min("left").alias("low"), F.max("left").alias("high"), F.min(back).alias("back_low"), F.max(back).alias("back_high"), F.min(length).alias("least"), F.max(length).alias("most"))
        sizes = stored(sizes.where("size > 1"), "line-variant-sizes")
        # Stored level by level, so that no plan holds them all.
        parts.append(stored(_witnesses(rows.join(sizes.where(F.col("size") <= SMALL).select("key"), "key")).groupBy(*_LINE).agg(F.min("first").alias("first")), "line-near"))
        if sizes.where(F.col("size") > SMALL).isEmpty():
            break
        many = stored(rows.join(sizes.where(F.col("size") > SMALL), "key").mapInArrow(frugal(char_rows), _LEFT_DDL), "line-variants")
        ends = many.where("left is null").select("key", place.alias("own"))
        first = stored(ends.groupBy("key").agg(F.min("own").alias("first"), F.count("*").alias("size")).where("size > 1").drop("size"), "line-witnesses")
        parts.append(stored(ends.join(first, "key").where(F.col("first") < F.col("own")).select("own.h1", "own.h2", "first"), "line-near"))
        again = many.where("left is not null").select(*_LINE).distinct()
        if again.isEmpty():
            break
        lines = stored(texts.join(again, list(_LINE), "left_semi"), "line-finer")
    found = reduce(DataFrame.unionByName, parts).groupBy(*_LINE).agg(F.min("first").alias("first"))
    found = stored(found.select(*_LINE, "first"), "line-near")
    other = texts.select(F.col("h1").alias("w1"), F.col("h2").alias("w2"), F.col("line").alias("other"))
    met = found.select(*_LINE, *[F.col(f"first.{c}") for c in _PLACE], F.col("first.h1").alias("w1"), F.col("first.h2").alias("w2"))
    met = met.join(texts.select(*_LINE, "line"), list(_LINE)).join(other, ["w1", "w2"])
    m = F.least(F.length("line"), F.length("other"))
    allowed = F.least(F.lit(edits), F.floor(m / per)) if per else F.lit(edits)
    near = _kept(met.select("line", "other", allowed.cast("int"), *_LINE, *_PLACE))
    return near.select(*_LINE, F.struct(*_PLACE).alias("like"))


def within(a: str, b: str, k: int) -> bool:
    """Whether the edit distance is at most ``k``: after what both begin with, one edit of each kind is tried."""
    if abs(len(a) - len(b)) > k:
        return False
    if a == b or not k:
        return a == b
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    a, b = a[low:], b[low:]
    return within(a[1:], b[1:], k - 1) or within(a[1:], b, k - 1) or within(a, b[1:], k - 1)


def within_pieces(a: str, b: str, k: int) -> bool:
    """Whether the edit distances of the pieces, each with its like, are at most ``k`` together."""
    for x, y in zip(a.split(PARTED), b.split(PARTED), strict=True):
        least = next((d for d in range(k + 1) if within(x, y, d)), None)
        if least is None:
            return False
        k -= least
    return True


def letters(text: str) -> int:
    """Which characters a text holds, as bits."""
    return int(letters_of([text], np.array([len(text)]))[0])


def letters_of(texts: list[str], sizes: np.ndarray) -> np.ndarray:
    """Which characters each text holds, as bits; ``sizes`` are their lengths."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    found = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(sizes)
    if len(some):
        found[some] = np.bitwise_or.reduceat(np.uint64(1) << (codes & np.uint32(63)).astype(np.uint64), (np.cumsum(sizes) - sizes)[some])
    return found


def _near(columns: int) -> Callable:
    """Of rows ``a, b, k, ...`` those whose first two texts are within ``k`` edits, without these three."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, k = (batch.column(i).to_pylist() for i in range(3))
            yield batch.select(list(range(3, columns))).filter(pa.array(list(map(within, a, b, k)), pa.bool_()))

    return frugal(run)


def _kept(rows: DataFrame) -> DataFrame:
    return rows.mapInArrow(_near(len(rows.columns)), StructType(rows.schema.fields[3:]))


def _first_near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``members``, the lines of one variant in order of their places: each line with the first that is within the bound, if there is one."""
    for batch in batches:
        lists = batch.column(0)
        flat = lists.flatten()
        own = flat.field("own")
        left, k, h1, h2 = flat.field("left").to_pylist(), flat.field("k").to_pylist(), own.field("h1").to_pylist(), own.field("h2").to_pylist()
        sizes = np.fromiter(map(len, left), np.int64, len(left))
        held = letters_of(left, sizes)
        few_sizes, few_held = sizes.tolist(), held.tolist()
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).tolist()
        line, first, start = [], [], 0
        for end in ends:
            for i in range(start + 1, end):
                # An edit adds or takes away two letters at most.
                if i - start <= FEW_LINES:
                    own_size, own_held, most = few_sizes[i], few_held[i], k[i]
                    fit = [j for j in range(start, i) if -most <= few_sizes[j] - own_size <= most and (few_held[j] ^ own_held).bit_count() <= 2 * most]
                else:
                    fit = (np.flatnonzero((np.abs(sizes[start:i] - sizes[i]) <= k[i]) & (np.bitwise_count(held[start:i] ^ held[i]) <= 2 * k[i])) + start).tolist()
                for j in fit:
                    # A line can have one variant in several ways.
                    if (h1[i], h2[i]) != (h1[j], h2[j]) and within_pieces(left[i], left[j], k[i]):
                        line.append(i)
                        first.append(j)
                        break
            start = end
        at = pa.array(line, pa.int64())
        yield pa.RecordBatch.from_arrays([own.field("h1").take(at), own.field("h2").take(at), own.take(pa.array(first, pa.int64()))], names=["h1", "h2", "first"])


def _witnesses(rows: DataFrame) -> DataFrame:
    """``h1, h2, first``: lines of one key with the earliest one within the bound; at most ``SMALL`` rows have a key, so they are one list."""
    place = F.struct(*_PLACE, *_LINE)
    members = rows.groupBy("key").agg(F.sort_array(F.collect_list(F.struct(place.alias("own"), "k", "left"))).alias("members")).select("members")
    kind = members.schema["members"].dataType.elementType["own"].dataType
    return members.mapInArrow(frugal(_first_near), StructType().add("h1", "long").add("h2", "long").add("first", kind))


def removed_lines(docs: DataFrame, min_chars: int = MIN_CHARS, edits: int = EDITS, chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """``doc_id, version, removed``: for documents that lose lines, an array of ``line_no, like_doc_id, like_line_no, near``.

    ``like_*`` is the first place of the line that is equal, or of the earliest that is near; that one can itself
    be near to a still earlier one and go.
    """
    places = stored(_hashed(docs, min_chars).select(*_PLACE, *_LINE), "line-places")
    distinct = stored(line_table(places), "line-table")
    rulings = distinct.withColumn("like", F.lit(None).cast(distinct.schema["first"].dataType))
    if edits:
        rulings = distinct.join(near_lines(docs, min_chars, edits, chars_per_edit), list(_LINE), "left")
    rulings = stored(rulings.where("n > 1 or like is not null").select(*_LINE, "first", "like"), "line-rulings")
    # A line that very many documents hold is one ruling: AQE splits the partition of its places.
    gone = places.join(rulings, list(_LINE)).where(F.col("like").isNotNull() | (F.struct(*_PLACE) != F.col("first")))
    like = F.coalesce("like", "first")
    ruling = F.struct("line_no", like["doc_id"].alias("like_doc_id"), like["line_no"].alias("like_line_no"), F.col("like").isNotNull().alias("near"))
    return gone.groupBy(*_DOC).agg(F.array_sort(F.collect_list(ruling)).alias("removed"))


def _joined(docs: DataFrame, row: Column, removed: DataFrame) -> DataFrame:
    """``row, text, removed`` for every row of ``docs``; ``removed`` is empty where no line goes."""
    rows = docs.select(row, F.col("doc_id").alias("_id"), version().alias("_version"), F.col("text").alias("_text"))
    out = rows.join(removed, rows["_id"].eqNullSafe(removed["doc_id"]) & (rows["_version"] == removed["version"]), "left")
    return out.select("row", F.col("_text").alias("text"), F.coalesce("removed", F.array().cast(removed.schema["removed"].dataType)).alias("removed"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, edits: int = EDITS, chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """``docs`` without the lines that repeat an earlier line, or are near to one.

    Lines are compared without blanks at their ends.  Of equal lines the one with the smallest document id (null
    first), then the smallest text hash among rows of one id, then the smallest line number stays.  A line is near
    to another if their edit distance is at most ``edits`` and at most a ``chars_per_edit``-th of the shorter one's
    characters (0: at most ``edits`` at any length); it goes if an earlier line is near to it, whether that one
    stays or not.  Lines of under ``min_chars`` characters stay: by default the blank ones.

    Every row stays, also one that loses all its lines (its text is then empty); a null text stays null, an empty
    one empty; rows equal in id and text count as one document.  A text of any length is split whole, and a line
    may be the whole text.  All other columns are kept as they are, whatever they are called; an empty table gives
    an empty result.
    """
    out = _joined(docs, as_row(docs), removed_lines(docs.select("doc_id", "text"), min_chars, edits, chars_per_edit))
    left = F.filter(F.split("text", "\n"), lambda line, i: ~F.exists("removed", lambda r: r["line_no"] == i))
    text = F.when(F.size("removed") == 0, F.col("text")).otherwise(F.array_join(left, "\n"))
    return out.select(F.col("row").withField("text", text).alias("row")).select("row.*")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document, with the lines that go, where their earliest copies are, and how many go for which reason."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = _joined(docs, F.struct("doc_id").alias("row"), removed_lines(docs))
    near = F.filter("removed", lambda r: r["near"])
    n_lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n"))
    return out.select("row.doc_id", n_lines.alias("n_lines"), (F.size("removed") - F.size(near)).alias("n_equal"), F.size(near).alias("n_near"), "removed")
