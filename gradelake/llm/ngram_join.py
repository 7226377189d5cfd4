"""N-gram Jaccard join by MinHash banding.

1. Every text becomes the set of its five-word shingles (64-bit hashes); texts of equal sets are one class, so
   copies are counted and never compared.
2. Band and row counts follow from the threshold and the recall wanted there.  Class representatives are
   dealt out by their band hashes, and only bands that two of them share go on.
3. Candidate pairs are verified on their full sets.
4. Bands that very many representatives share are cut into blocks.  Their sets are alike, so each travels only as
   its difference to one of them, and differences give the same intersections.  A task gets two blocks and returns,
   per representative, the number of links and a spanning forest, never the pairs.
5. Links join into classes as connected components.

Representatives are known by a 128-bit digest of their set, so ids may be null or repeated.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake.llm.common import as_row, frugal, stored, wide_hash
from gradelake.llm.components import components

WORDS = 5
THRESHOLD = 0.8
#: Share of pairs at the threshold itself that must meet in some band; above it the share is higher.
RECALL = 0.9999
ROWS = 4
#: Bands with more representatives than this are compared in blocks.
HOT = 64
BLOCK = 512
#: Representatives whose sets are wanted are broadcast up to this number, else joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Shingles of hot bands' leaders (8 bytes each) that are broadcast, else joined by shuffle.
BROADCAST_SHINGLES = 4_000_000
_KNOWN_WORDS = 300_000


def band_count(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """The least number of bands of ``rows`` hashes with which a pair at the threshold is met with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


class _Hashes(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: str) -> int:
        if len(self) > _KNOWN_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word.encode())
        return found


def _constants(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_PLACE, _MIX = _constants(64, 1), np.uint64(0xFF51AFD7ED558CCD)


def shingles(text: str | None, hashes: dict[str, int], width: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of runs of ``width`` words, in lower case; a shorter text is one shingle; a text without words has none."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(width, len(words))
    with np.errstate(over="ignore"):
        out = np.full(len(words) - n + 1, n, np.uint64)
        for i in range(n):
            out += each[i : len(words) - n + 1 + i] * _PLACE[i]
        out ^= out >> np.uint64(33)
        out *= _MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def band_hashes(own: np.ndarray, bands: int, rows: int) -> list[int]:
    """MinHash of the set, by band."""
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    factor, shift = _constants(bands * rows, 2)[:, None], _constants(bands * rows, 3)[:, None]
    with np.errstate(over="ignore"):
        for i in range(0, len(own), 8192):
            np.minimum(least, (own[None, i : i + 8192] * factor + shift).min(1), out=least)
    return [xxhash.xxh64_intdigest(part.tobytes(), seed=i) - (1 << 63) for i, part in enumerate(least.reshape(bands, rows))]


def _signatures(bands: int, rows: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            out = []
            for text in (t.as_py() for t in batch.column(1)):
                own = shingles(text, hashes, width)
                out.append((xxhash.xxh3_128_digest(own.tobytes()), len(own), band_hashes(own, bands, rows) if len(own) else []))
            reps, n, keys = zip(*out, strict=True) if out else [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(reps, pa.binary()), pa.array(n, pa.int32()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "v1", "v2", "rep", "n", "keys"])

    return frugal(run)


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            own = [shingles(t, hashes, width) for t in (x.as_py() for x in batch.column(0))]
            reps = pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in own], pa.binary())
            yield pa.RecordBatch.from_arrays([reps, pa.array([x.view(np.int64) for x in own], pa.list_(pa.int64()))], names=["rep", "own"])

    return frugal(run)


def _intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of ``a`` with each of ``b``: products of 0/1 matrices, some values at a time."""
    flat = np.concatenate([*a, *b])
    owner = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)])
    _, column, seen = np.unique(flat, return_inverse=True, return_counts=True)
    common = np.cumsum(seen > 1) - 1
    keep = seen[column] > 1
    owner, column = owner[keep], common[column[keep]]
    out = np.zeros((len(a), len(b)), np.float32)
    for start in range(0, int(column.max(initial=-1)) + 1, 16_384):
        at = (column >= start) & (column < start + 16_384)
        block = np.zeros((len(a) + len(b), 16_384), np.float32)
        block[owner[at], column[at] - start] = 1
        out += block[: len(a)] @ block[len(a) :].T
    return out


def _compare(threshold: float):
    """Two blocks of one hot band: links per representative, and edges that join what is linked."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        key, i, j = rows[0]["key"], rows[0]["i"], rows[0]["j"]
        left = [r for r in rows if r["block"] == i]
        right = left if i == j else [r for r in rows if r["block"] == j]
        links = np.zeros((len(left), len(right)), bool)
        if left and right:
            own = [[np.array(r["delta"], np.int64) for r in side] for side in (left, right)]
            apart = [np.array([len(x) for x in side], np.float32) for side in own]
            sizes = [np.array([r["n"] for r in side], np.float32) for side in (left, right)]
            # What tells two sets apart is in one of their differences to the leader, but not in both.
            apart = apart[0][:, None] + apart[1][None, :] - 2 * _intersections(*own)
            both = (sizes[0][:, None] + sizes[1][None, :] - apart) / 2
            links = both >= threshold * (sizes[0][:, None] + sizes[1][None, :] - both) - 1e-6
            # A pair that shares several hot bands counts in the first.
            earlier = sorted({k for r in (*left, *right) for k in r["hot"] if k < key})
            if earlier:
                place = {k: n for n, k in enumerate(earlier)}
                has = [np.zeros((len(side), len(earlier)), np.float32) for side in (left, right)]
                for side, table in zip((left, right), has, strict=True):
                    for n, r in enumerate(side):
                        table[n, [place[k] for k in r["hot"] if k < key]] = 1
                links &= (has[0] @ has[1].T) == 0
            if i == j:
                np.fill_diagonal(links, False)
        copies = [np.array([r["copies"] for r in side], np.int64) for side in (left, right)]
        counts = [(r["rep"], int(n)) for r, n in zip(left, links @ copies[1], strict=True) if n]
        if i != j:
            counts += [(r["rep"], int(n)) for r, n in zip(right, copies[0] @ links, strict=True) if n]
        root = {r["rep"]: r["rep"] for r in (*left, *right)}

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for n, m in zip(*np.nonzero(links), strict=True):
            x, y = top(left[n]["rep"]), top(right[m]["rep"])
            root[max(x, y)] = min(x, y)
        edges = [(r, top(r)) for r in root if top(r) != r]
        out = [(rep, None, n) for rep, n in counts] + [(rep, other, 0) for rep, other in edges]
        columns = zip(*out, strict=True) if out else [(), (), ()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.binary(), pa.int64()), strict=True)], names=["rep", "other", "links"])

    return run


def _pairs(members: DataFrame, sets: DataFrame, hot: DataFrame | None, threshold: float) -> DataFrame:
    """Verified links ``a, b`` of the bands that few share, once each."""
    side = lambda x: members.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("rep", "copies", "n")])
    met = side("a").join(side("b"), "key").where("rep_a < rep_b").where(F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-6)
    met = met.select("rep_a", "rep_b", "copies_a", "copies_b", "n_a", "n_b").distinct()
    if hot is not None:
        for x in "ab":
            met = met.join(hot.select(F.col("rep").alias(f"rep_{x}"), F.col("hot").alias(f"hot_{x}")), f"rep_{x}", "left")
        met = met.where(~F.coalesce(F.arrays_overlap("hot_a", "hot_b"), F.lit(False))).drop("hot_a", "hot_b")
    for x in "ab":
        met = met.join(sets.select(F.col("rep").alias(f"rep_{x}"), F.col("own").alias(f"own_{x}")), f"rep_{x}")
    both = F.size(F.array_intersect("own_a", "own_b"))
    met = met.select("rep_a", "rep_b", "copies_a", "copies_b", (F.col("n_a") + F.col("n_b")).alias("n"), both.alias("both"))
    return met.where(F.col("both") >= threshold * (F.col("n") - F.col("both")) - 1e-6).drop("n", "both")


def _classes(docs: DataFrame, threshold: float, recall: float, width: int, rows: int, hot_size: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Per row ``doc_id, v1, v2, rep``, with a null ``rep`` if there are no words; per representative ``rep, rep_id, class_id, keep, n_links``."""
    bands = band_count(threshold, recall, rows)
    v1, v2 = wide_hash(F.col("text"))
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), v1.alias("v1"), v2.alias("v2"))
    signed = stored(docs.mapInArrow(_signatures(bands, rows, width), "doc_id bigint, v1 bigint, v2 bigint, rep binary, n int, keys array<bigint>"), "signatures")
    # A text names the rows that hold it; null ids come last.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "v1", "v2")).alias("first")
    reps = stored(signed.where("n > 0").groupBy("rep").agg(first, F.count("*").alias("copies"), F.first("n").alias("n"), F.first("keys").alias("keys")), "representatives")

    members = reps.select("rep", "copies", "n", "first", F.explode("keys").alias("key"))
    sizes = members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = stored(members.join(sizes, "key"), "band-members")
    wanted = members.select("first.v1", "first.v2").distinct()
    small = F.broadcast if members.count() <= BROADCAST_ROWS else lambda df: df
    texts = docs.join(small(wanted), ["v1", "v2"], "left_semi").select("v1", "v2", "text")
    sets = stored(texts.dropDuplicates(["v1", "v2"]).select("text").mapInArrow(_sets(width), "rep binary, own array<bigint>"), "shingle-sets")
    members = members.drop("first")

    frequent = members.where(F.col("size") > hot_size)
    hot = links = forest = None
    if not frequent.isEmpty():
        hot = stored(frequent.groupBy("rep").agg(F.sort_array(F.collect_set("key")).alias("hot")), "hot-bands")
        leaders = frequent.groupBy("key").agg(F.min("rep").alias("leader"))
        leaders = stored(leaders.join(sets.withColumnRenamed("rep", "leader"), "leader").select("key", F.col("own").alias("common")), "hot-leaders")
        close = F.concat(F.array_except("own", "common"), F.array_except("common", "own"))
        sizes = leaders.agg(F.coalesce(F.sum(F.size("common")), F.lit(0))).first()[0]
        met = frequent.join(sets, "rep").join(hot, "rep").join(F.broadcast(leaders) if sizes <= BROADCAST_SHINGLES else leaders, "key").select("key", "size", "rep", "copies", "n", "hot", close.alias("delta"))
        n = F.ceil(F.col("size") / block)
        cells = stored(met, "hot-members").withColumn("block", F.pmod(F.xxhash64("rep"), n)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
        cells = cells.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "copies", "n", "hot", "delta")
        compared = stored(cells.groupBy("key", "i", "j").applyInArrow(_compare(threshold), "rep binary, other binary, links bigint"), "hot-links")
        links = compared.where("other is null").select("rep", "links")
        forest = compared.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b"))
    pairs = stored(_pairs(members.where(F.col("size") <= hot_size), sets, hot, threshold), "links")
    edges = pairs.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    counts = pairs.select(F.explode(F.array(F.struct(F.col("rep_a").alias("rep"), F.col("copies_b").alias("links")), F.struct(F.col("rep_b").alias("rep"), F.col("copies_a").alias("links")))).alias("x")).select("x.rep", "x.links")
    if links is not None:
        edges, counts = edges.unionByName(forest), counts.unionByName(links)

    roots = components(edges).withColumnRenamed("node", "rep")
    counts = counts.groupBy("rep").agg(F.sum("links").alias("links"))
    known = reps.join(roots, "rep", "left").join(counts, "rep", "left")
    known = stored(known.select("rep", "first", F.coalesce("root", "rep").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "class-members")
    keepers = stored(known.groupBy("root").agg(F.min("first").alias("keep")), "class-keepers")
    known = known.join(keepers, "root").select("rep", F.col("first.doc_id").alias("rep_id"), F.col("keep.doc_id").alias("class_id"), "keep", "n_links")
    return signed.select("doc_id", "v1", "v2", F.when(F.col("n") > 0, F.col("rep")).alias("rep")), stored(known, "classes")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, width: int = WORDS, rows: int = ROWS, hot_size: int = HOT, block: int = BLOCK) -> DataFrame:
    """``doc_id, rep_id, class_id, n_links`` for every row.

    ``rep_id`` is the least id among rows with the same shingles, ``class_id`` the least id of all that links lead
    to, and ``n_links`` the number of other rows with a Jaccard similarity of at least ``threshold``.  Words are
    what blanks part, in lower case; a text of fewer than ``width`` words is one shingle.

    Null and blank texts have no shingles: each is a class of its own without links.  Rows are told apart by their
    texts, so equal ids of different texts are different rows, and rows without an id link like any other; ids are
    null where no row of the group has one.  Repeated rows are copies of each other.  Texts of any length are
    taken whole.  Other columns are ignored; an empty table gives an empty result.
    """
    signed, known = _classes(docs, threshold, recall, width, rows, hot_size, block)
    own = signed.where("rep is not null").join(known.drop("keep"), "rep").select("doc_id", "rep_id", "class_id", "n_links")
    alone = signed.where("rep is null").select("doc_id", F.col("doc_id").alias("rep_id"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return own.unionByName(alone)


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class, that of the least id (null last), then the least hash of its text.

    Of rows that repeat both, the one that is least as JSON stays.  Rows without words all stay.  Columns are as they were, whatever they are
    called.  Other cases are as in :func:`near_duplicates`.
    """
    signed, known = _classes(docs, THRESHOLD, RECALL, WORDS, ROWS, HOT, BLOCK)
    own = signed.where("rep is not null").join(known.select("rep", "keep"), "rep")
    kept = F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("v1") == F.col("keep.v1")) & (F.col("v2") == F.col("keep.v2"))
    own = stored(own.select("doc_id", "v1", "v2", kept.alias("kept")), "near-duplicates")
    key = ["doc_id", "v1", "v2"]
    lost = own.where("not kept").select(*key).distinct()
    again = own.where("kept").groupBy(*key).count().where("count > 1").select(*key)
    v1, v2 = wide_hash(F.col("text").cast("string"))
    rows = docs.select(as_row(docs), F.col("doc_id").cast("long").alias("doc_id"), v1.alias("v1"), v2.alias("v2"))
    same = F.expr("d.doc_id <=> l.doc_id and d.v1 = l.v1 and d.v2 = l.v2")
    small = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    out = rows.alias("d").join(small(lost).alias("l"), same, "left_anti")
    if again.isEmpty():
        return out.select("row.*")
    once = out.alias("d").join(small(again).alias("l"), same, "left_semi").groupBy(*key).agg(F.min_by("row", F.to_json("row")).alias("row"))
    return out.alias("d").join(small(again).alias("l"), same, "left_anti").select("row").unionByName(once.select("row")).select("row.*")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
