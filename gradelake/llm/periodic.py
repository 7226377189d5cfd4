"""Periodic runs of words: a phrase repeated over and over in place, as boilerplate and broken generators leave it.

A run is a stretch of words that its own shift by ``q`` words equals, at least ``exponent`` periods and ``min_words``
long, and that no neighbouring word extends.

1. *Masking*: a run of ``L`` words equals its shift in ``L - q`` words, which is at least ``k``.  With at least two
   periods each of its words lies in one of the two overlapping copies, so in a ``k``-gram that the document holds
   twice.  Words in no repeated ``k``-gram are in no run; they part the document into surviving segments.
2. *Main-Lorentz*: segments are halved again and again; a run that crosses a centre holds a full period next to it, so
   from the centre each period is extended to both sides by longest common extensions.  These are exact: they compare
   ranks of windows of 1, 2, 4, ... words.  All segments of many documents are worked on at once, and words that occur
   once keep them apart.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake.llm.common import as_row, release

#: Words of the shortest run, and periods that a run has at least.
MIN_WORDS, EXPONENT = 24, 3
#: Words that are worked on at once; a longer document is worked on alone.
CHUNK_WORDS = 200_000
#: Words that are remembered with their numbers.
REMEMBERED = 300_000

_MIX, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x9E3779B97F4A7C15)


def overlap(min_words: int, exponent: int) -> int:
    """Words in which a run equals its shift by one period, at least."""
    return min_words - min_words // exponent


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x + _STEP) * _MIX
    return x ^ (x >> np.uint64(29))


def window_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """A hash of the ``k`` words from each place on, by doubling."""
    part, size, out, done = _mixed(ids.astype(np.uint64)), 1, None, 0
    if len(ids) < k:
        return part[:0]
    while True:
        if k & size:
            out = part if out is None else _mixed(out[: len(part) - done] * _STEP + part[done:])
            done += size
        if 2 * size > k:
            return out
        part = _mixed(part[:-size] * _MIX + part[size:])
        size *= 2


def surviving(ids: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """Whether each word lies in a ``k``-gram that its document (a number per word) holds more than once."""
    cover = np.zeros(len(ids) + 1, np.int32)
    keys = window_hashes(ids, k)
    whole = np.flatnonzero(doc[: len(keys)] == doc[len(ids) - len(keys) :])
    keys = _mixed(keys[whole] ^ _mixed(doc[whole].astype(np.uint64)))
    order = np.sort(keys)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if len(twice):
        at = whole[twice[np.searchsorted(twice, keys) % len(twice)] == keys]
        np.add.at(cover, at, 1)
        np.add.at(cover, at + k, -1)
    return np.cumsum(cover[:-1]) > 0


def _ranks(word: np.ndarray, longest: int) -> list[np.ndarray]:
    """For windows of 1, 2, 4, ... words from each place on: equal numbers for equal windows."""
    out = [np.unique(word, return_inverse=True)[1].astype(np.int64)]
    size = 1
    while 2 * size <= longest:
        pair = out[-1][:-size] * len(word) + out[-1][size:]
        out.append(np.unique(pair, return_inverse=True)[1].astype(np.int64))
        size *= 2
    return out


def _extension(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray, back: bool) -> np.ndarray:
    """How many words from ``a`` and from ``b`` (larger) on are equal, or before them."""
    n, done = len(ranks[0]), np.zeros(len(a), np.int64)
    for j in reversed(range(len(ranks))):
        size = 1 << j
        low, high = (a - done - size, b - done - size) if back else (a + done, b + done)
        fits = np.flatnonzero(low >= 0) if back else np.flatnonzero(high + size <= n)
        done[fits[ranks[j][low[fits]] == ranks[j][high[fits]]]] += size
    return done


def main_lorentz(word: np.ndarray, longest: int, min_words: int, exponent: int) -> np.ndarray:
    """``start, end, period`` of all runs in ``word``, none of which is longer than ``longest`` words, in order."""
    found = [np.zeros((0, 3), np.int64)]
    n = len(word)
    if longest < min_words:
        return found[0]
    ranks = _ranks(word, longest)
    half = 1
    while 2 * half < min_words:
        half *= 2
    while half < n:
        # Of blocks of twice ``half`` words: each period from the centre to the left, and to the right.
        centre, period = np.arange(half, n, 2 * half)[:, None], np.arange(1, min(2 * half, longest) // exponent + 1)[None, :]
        a = np.concatenate([(centre - period).ravel(), np.repeat(centre, period.shape[1], 1).ravel()])
        p = np.tile(np.broadcast_to(period, (len(centre), period.shape[1])).ravel(), 2)
        fits = (a >= 0) & (a + p < n)
        a, p = a[fits], p[fits]
        start = (word[a] == word[a + p]) | ((a > 0) & (word[a - 1] == word[a + p - 1]))
        a, p = a[start], p[start]
        left, right = _extension(ranks, a, a + p, True), _extension(ranks, a, a + p, False)
        size = left + right + p
        good = (size >= min_words) & (size >= exponent * p)
        found.append(np.stack([a - left, a + p + right, p], 1)[good])
        half *= 2
    runs = np.unique(np.concatenate(found), axis=0)
    # A stretch is found with multiples of its period too; the least one is its period.
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)
    return runs[first]


def runs_of(ids: np.ndarray, lengths: np.ndarray, min_words: int = MIN_WORDS, exponent: int = EXPONENT) -> np.ndarray:
    """``document, start, end, period`` of all runs, in order, for documents of so many words each, one after another."""
    doc = np.repeat(np.arange(len(lengths)), lengths)
    alive = surviving(ids, doc, overlap(min_words, exponent))
    at = np.flatnonzero(alive)
    if not len(at):
        return np.zeros((0, 4), np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (doc[at[1:]] != doc[at[:-1]])
    segment = np.cumsum(new) - 1
    # Segment s is shifted by s places: before each but the first there is a word of its own.
    word = -1 - np.arange(len(at) + segment[-1])
    place = np.arange(len(at)) + segment
    word[place] = ids[at]
    found = main_lorentz(word, int(np.bincount(segment).max()), min_words, exponent)
    # From places in ``word`` back to places in the documents.
    back = np.zeros(len(word), np.int64)
    back[place] = at
    start = back[found[:, 0]]
    own = doc[start]
    first = np.cumsum(lengths) - lengths
    return np.stack([own, start - first[own], start - first[own] + found[:, 1] - found[:, 0], found[:, 2]], 1)


_RUN = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])
_FOUND = pa.struct([("runs", pa.list_(_RUN)), ("collapsed", pa.string())])


def _described(texts: list[list[bytes]], number: dict[bytes, int], min_words: int, exponent: int) -> list[dict]:
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ids = np.fromiter((number[w] for words in texts for w in words), np.int64, lengths.sum())
    found = runs_of(ids, lengths, min_words, exponent)
    out = []
    for n, words in enumerate(texts):
        own = found[slice(*np.searchsorted(found[:, 0], [n, n + 1]))]
        if len(own):
            gone = np.zeros(len(words) + 1, np.int64)
            np.add.at(gone, own[:, 1] + own[:, 3], 1)
            np.add.at(gone, own[:, 2], -1)
            words = [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0)]
        runs = [{"start": a, "length": b - a, "period": q} for _, a, b, q in own.tolist()]
        out.append({"runs": runs, "collapsed": b" ".join(words).decode()})
    return out


def _finder(min_words: int, exponent: int):
    @F.arrow_udf("struct<runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        number: dict[bytes, int] = defaultdict(count().__next__)
        for batch in batches:
            out: list[dict] = []
            part: list[list[bytes]] = []
            size = 0
            for i, text in enumerate(batch):
                # Bytes part at exactly the blanks \x20 and \x09 to \x0D.
                part.append((text.as_py() or "").encode().split())
                size += len(part[-1])
                if size >= CHUNK_WORDS or i + 1 == len(batch):
                    if len(number) > REMEMBERED:
                        number = defaultdict(count().__next__)
                    out += _described(part, number, min_words, exponent)
                    part, size = [], 0
            yield pa.array(out, _FOUND)
        release()

    return find.asNondeterministic()  # else each use of the result runs it again


def periodic_runs(docs: DataFrame, min_words: int = MIN_WORDS, exponent: int = EXPONENT) -> DataFrame:
    """``row, found``: each row of ``docs`` as a struct, and its ``runs`` (``start, length, period``) and ``collapsed`` text.

    Words are what ``\\x20`` and ``\\x09`` to ``\\x0D`` part, as they are written, numbered from 0.  A run has at least
    ``min_words`` words and ``exponent`` (2 or more) times its least period; runs are in order of start, then period, and may overlap.
    The collapsed text has, joined by a space each, the words that are in the first period of every run that holds them.

    A null text, an empty one and one of blanks have no runs and an empty collapsed text.  Texts of any length are
    taken whole, those of many words alone.  Repeated rows are each described, alike; the id plays no part.  Other
    columns are kept in ``row``, whatever they are called.  An empty table gives an empty result.
    """
    if exponent < 2:
        raise ValueError("a run has two periods at least")
    return docs.select(as_row(docs), _finder(min_words, exponent)(F.col("text").cast("string")).alias("found"))


def collapse_runs(docs: DataFrame, min_words: int = MIN_WORDS, exponent: int = EXPONENT) -> DataFrame:
    """``docs`` whose texts with a run are collapsed; others, null included, stay as they are.  Other cases are as in :func:`periodic_runs`."""
    out = periodic_runs(docs, min_words, exponent)
    text = F.when(F.size("found.runs") > 0, F.col("found.collapsed")).otherwise(F.col("row.text"))
    return out.select(F.col("row").withField("text", text).alias("row")).select("row.*")


def planted(doc_id: Column, text: Column) -> Column:
    """The text with a periodic end where the crc32 of ``doc_id`` is divisible by ten; a null id has none."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def repeated(x: Column) -> Column:
        n = F.size(x["words"])
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.transform(x["words"], lambda w, i: F.when(i < a, w).otherwise(F.get(x["words"], (a + (i - a) % p).cast("int"))))

    # The struct is one element of an array, so that its words are found once.
    own = F.flatten(F.transform(F.array(F.struct(words.alias("words"))), lambda x: F.when(F.size(x["words"]) > 0, repeated(x)).otherwise(x["words"])))
    return F.when(h % 10 == 0, F.array_join(own, " ")).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: how many runs its words have, the one of most periods, and digests."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    out = periodic_runs(docs).select("row.doc_id", "found.runs", "found.collapsed")
    best = F.reduce("runs", F.get("runs", F.lit(0)), lambda x, r: F.when(r["length"] * x["period"] > x["length"] * r["period"], r).otherwise(x))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    out = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
