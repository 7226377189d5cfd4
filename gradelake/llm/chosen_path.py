"""Near-duplicate documents by the chosen-path set similarity join.

1. Every text becomes the set of its five-word shingles (64-bit hashes) and a list of minwise tokens of it; texts of
   equal sets are one member, so copies are counted and never compared.
2. *Trees*: in each of some independent trees a node chooses one of the token positions, now and then two, by a hash
   of its own name; members that agree there go to the same child.  On average a pair at the threshold shares one
   child of each node that it shares, so some path leads it down together in a known part of the trees.  As many trees
   are grown as the wanted recall takes (:func:`tree_count`).
3. *Leaders*: each first node has a leader, the member that meets most others.  Members near to their leader are
   confirmed first and take its label.  From there on only members of different labels are compared.
4. *Small nodes* are compared exhaustively on sketches (a byte of each token).  Larger ones branch; those that are
   still large at the last level are cut into blocks, and each pair of blocks is compared like a small node.
5. *Confirmation* on full sets.  A node in which many sketches are alike brings its sets together and returns a
   spanning forest; the few pairs of other nodes meet their sets one by one.

Members are known by a 128-bit digest of their set, so ids may be null or repeated.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradelake.llm.common import as_row, frugal, measured, stored, wide_hash
from gradelake.llm.components import components

WORDS = 5
#: Sets are linked when 100 times their intersection is at least so many times their union.
PERCENT = 85
#: Minwise tokens of a set.
TOKENS = 128
#: Share of pairs at the threshold that must meet in a node of the last level; above it, or in a node met earlier, the share is higher.
RECALL = 0.9999
#: Share of pairs at the threshold whose sketches may be too unlike.
SKETCH_MISS = 1e-6
#: Levels below the roots; what is large even then is compared in blocks.
LEVELS = 5
#: Members of a node that are compared with each other.
SMALL = 256
#: Pairs of like sketches, per member, from which on a node brings its sets together.
DENSE = 2
#: Representatives (32 bytes each) that are broadcast, else joined by shuffle.
BROADCAST_ROWS = 500_000
#: Pairs whose sketches are compared at once.
PAIRS_AT_ONCE = 100_000
_KNOWN_WORDS = 300_000


def branches(threshold: float) -> float:
    """Chance that a node chooses a second position; the mean number is then one over the threshold."""
    return min(1.0, 1 / threshold - 1)


def survival(threshold: float, levels: int) -> float:
    """Chance that a pair at the threshold shares a node of the level in a tree."""
    both, share = branches(threshold), 1.0
    for _ in range(levels):
        met = threshold * share
        share = (1 - both) * met + both * (1 - (1 - met) ** 2)
    return share


def tree_count(threshold: float, recall: float, levels: int) -> int:
    """The least number of trees in which a pair at the threshold meets with probability ``recall``."""
    share = survival(threshold, levels)
    return 1 if share >= recall else math.ceil(math.log(1 - recall) / math.log(1 - share))


def sketch_cut(tokens: int, threshold: float, miss: float) -> int:
    """The most equal bytes that all but a share ``miss`` of the pairs at the threshold reach."""
    p, below = threshold + (1 - threshold) / 256, 0.0
    for equal in range(tokens + 1):
        below += math.comb(tokens, equal) * p**equal * (1 - p) ** (tokens - equal)
        if below > miss:
            return equal
    return tokens


class _Hashes(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > _KNOWN_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def _constants(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_PLACE = _constants(64, 21)


def shingles(text: str | None, hashes: dict[bytes, int], width: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of runs of ``width`` words, A-Z as a-z; fewer words are one shingle, none are none."""
    words = text.encode().lower().split() if text else []  # of bytes, so only ASCII counts
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(width, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        out += each[i : len(words) - n + 1 + i] * _PLACE[i]
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(out ^ (out >> np.uint64(32)))


def minwise(own: np.ndarray, tokens: int) -> np.ndarray:
    """The least hash of the set by each of ``tokens`` hash functions, mixed so that all bits tell them apart."""
    least = np.full(tokens, np.iinfo(np.uint64).max, np.uint64)
    factor, shift = _constants(tokens, 22)[:, None], _constants(tokens, 23)[:, None]
    for i in range(0, len(own), 4096):
        np.minimum(least, (own[None, i : i + 4096] * factor + shift).min(1), out=least)
    least = (least ^ (least >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return least ^ (least >> np.uint64(32))


_SIGNED = "doc_id bigint, v1 bigint, v2 bigint, rep binary, n bigint, nodes array<bigint>, sketch binary"


def _signatures(width: int, tokens: int, roots: list[tuple[int, int]]):
    """Per text the digest and size of its set, its first node in each tree, and its sketch."""
    tree, place = (np.array(x) for x in zip(*roots, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        name = _constants(len(roots), 25) * (tree + 1).astype(np.uint64)
        for batch in batches:
            reps, n, nodes, sketch = [], [], [], []
            for text in batch.column(3):
                own = shingles(text.as_py(), hashes, width)
                n.append(len(own))
                if not len(own):
                    for x in (reps, nodes, sketch):
                        x.append(None)
                    continue
                each = minwise(own, tokens)
                reps.append(xxhash.xxh3_128_digest(own.tobytes()))
                nodes.append(((each[place] ^ name) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64))
                sketch.append(each.astype(np.uint8).tobytes())
            columns = [pa.array(reps, pa.binary()), pa.array(n, pa.int64()), pa.array(nodes, pa.list_(pa.int64())), pa.array(sketch, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names=["doc_id", "v1", "v2", "rep", "n", "nodes", "sketch"])

    return frugal(run)


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            own = [shingles(text.as_py(), hashes, width) for text in batch.column(0)]
            reps = pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in own], pa.binary())
            yield pa.RecordBatch.from_arrays([reps, pa.array([x.view(np.int64) for x in own], pa.list_(pa.int64()))], names=["rep", "own"])

    return frugal(run)


#: What a member of a node brings along.
_MEMBER = ("rep", "label", "n", "sketch")


def _roots(trees: int, tokens: int, threshold: float) -> list[tuple[int, int]]:
    """``tree, position`` of the first choices, all of different positions while there are enough."""
    place = np.random.default_rng(24).permutation(tokens).tolist()
    second = [j for j in range(trees) if math.floor((j + 1) * branches(threshold)) > math.floor(j * branches(threshold))]
    return [(j, place[n % tokens]) for n, j in enumerate([*range(trees), *second])]


def _branched(large: DataFrame, tokens: int, threshold: float) -> DataFrame:
    """Members one level down; a byte of the sketch stands for the token."""
    one = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(tokens)).cast("int")
    two = F.pmod(one + 1 + F.pmod(F.xxhash64("node", F.lit(3)), F.lit(max(tokens - 1, 1))).cast("int"), F.lit(tokens))
    chosen = F.when(F.pmod(F.xxhash64("node", F.lit(2)), F.lit(1 << 20)) < int(branches(threshold) * (1 << 20)), F.array(one, two)).otherwise(F.array(one))
    rows = large.select(*_MEMBER, "node", F.explode(chosen).alias("position"))
    child = F.xxhash64("node", "position", F.substring("sketch", F.col("position") + 1, F.lit(1)))
    return rows.select(*_MEMBER, child.alias("node"))


def _mixed_nodes(members: DataFrame) -> DataFrame:
    """``node, size`` of the nodes that hold more than one label."""
    return members.groupBy("node").agg(F.count("*").alias("size"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("node", "size")


def _alike(cut: int, percent: int):
    """Rows ``cell, members``: pairs ``a, b`` of like sketches and of different labels; of a dense cell its members instead, as ``cell, a``."""

    def pairs_of(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs of places within groups of such sizes, some at a time."""
        start = np.cumsum(sizes) - sizes
        begin = 0
        many = np.cumsum(sizes * (sizes - 1) // 2)
        while begin < len(sizes):
            end = max(begin + 1, int(np.searchsorted(many, (many[begin - 1] if begin else 0) + PAIRS_AT_ONCE, "right")))
            own = np.arange(start[begin], start[end - 1] + sizes[end - 1])
            left = np.repeat(start[begin:end] + sizes[begin:end], sizes[begin:end]) - own - 1  # later ones of its group
            a = np.repeat(own, left)
            yield a, a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(left) - left, left)
            begin = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten()
            rep, label = flat.field("rep"), pc.dictionary_encode(flat.field("label")).indices.to_numpy(zero_copy_only=False)
            n, block = (flat.field(x).to_numpy(zero_copy_only=False) for x in ("n", "block"))
            sketch = np.frombuffer(b"".join(flat.field("sketch").to_pylist()), np.uint8).reshape(len(n), -1)
            cell = np.repeat(np.arange(len(sizes)), sizes)
            found = [(np.zeros(0, np.int64),) * 2]
            for a, b in pairs_of(sizes):
                # Members of one block of a cell of two meet in another cell.
                good = (label[a] != label[b]) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])) & ((block[a] < 0) | (block[a] != block[b]))
                a, b = a[good], b[good]
                good = (sketch[a] == sketch[b]).sum(1) >= cut if len(a) else np.zeros(0, bool)
                found.append((a[good], b[good]))
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            dense = np.bincount(cell[a], minlength=len(sizes)) > DENSE * sizes
            both = np.unique(np.concatenate([a[dense[cell[a]]], b[dense[cell[a]]]]))
            a, b = a[~dense[cell[a]]], b[~dense[cell[a]]]
            names = pa.concat_arrays([pa.nulls(len(a), pa.int64()), batch.column(0).cast(pa.int64()).take(pa.array(cell[both]))])
            yield pa.RecordBatch.from_arrays([names, rep.take(pa.array(np.concatenate([a, both]))), pa.concat_arrays([rep.take(pa.array(b)), pa.nulls(len(both), pa.binary())])], names=["cell", "a", "b"])

    return frugal(run)


def _intersections(own: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of some sets: products of 0/1 matrices, some values at a time."""
    owner = np.repeat(np.arange(len(own)), list(map(len, own)))
    _, column, seen = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    shared = np.cumsum(seen > 1) - 1
    keep = seen[column] > 1
    owner, column = owner[keep], shared[column[keep]]
    out = np.zeros((len(own), len(own)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for start in range(0, int(column.max(initial=-1)) + 1, 4096):
        at = slice(*np.searchsorted(column, [start, start + 4096]))
        block = np.zeros((len(own), 4096), np.float32)
        block[owner[at], column[at] - start] = 1
        out += block @ block.T
    return out


def _confirmed(percent: int):
    """Of a dense cell, edges that join what is linked, beyond what is known."""

    def run(group: pa.Table) -> pa.Table:
        own = [x.values.to_numpy() for x in group.column("own").combine_chunks()]
        n = np.array([len(x) for x in own], np.float64)
        both = _intersections(own)
        links = 100 * both >= percent * (n[:, None] + n[None, :] - both)
        reps, root = group.column("rep").to_pylist(), {}
        labels = group.column("label").to_pylist()

        def top(x: bytes) -> bytes:
            while root.get(x, x) != x:
                x = root[x]
            return x

        edges = []
        for i, j in zip(*np.nonzero(np.triu(links, 1)), strict=True):
            x, y = top(labels[i]), top(labels[j])
            if x != y:
                root[max(x, y)] = min(x, y)
                edges.append((reps[i], reps[j]))
        return pa.table([pa.array([e[k] for e in edges], pa.binary()) for k in (0, 1)], names=["a", "b"])

    return run


def _like(cut: int):
    @F.arrow_udf("boolean")
    def like(a: pa.Array, b: pa.Array) -> pa.Array:
        left, right = (np.frombuffer(b"".join(x.to_pylist()), np.uint8).reshape(len(x), -1) for x in (a, b))
        return pa.array((left == right).sum(1) >= cut)

    return like


def _small(df: DataFrame, rows: int) -> DataFrame:
    """The table, for a broadcast if it has few rows."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


class _Join:
    """What the steps share: the documents, the members, and the sets that were read so far."""

    def __init__(self, docs: DataFrame, reps: DataFrame, percent: int, width: int):
        self.docs, self.reps, self.percent, self.width = docs, reps, percent, width
        self.sets: DataFrame | None = None

    def read_sets(self, wanted: DataFrame) -> None:
        """Sets of the members ``rep`` that were not read yet; their texts are read again."""
        if self.sets is not None:
            wanted = wanted.join(self.sets.select("rep"), "rep", "left_anti")
        texts, seen = measured(self.reps.join(wanted, "rep", "left_semi").select("first.v1", "first.v2").distinct(), "set-texts", rows=F.count("*"))
        texts = self.docs.join(_small(texts, seen["rows"]), ["v1", "v2"], "left_semi").select("v1", "v2", "text").dropDuplicates(["v1", "v2"])
        new = stored(texts.select("text").mapInArrow(_sets(self.width), "rep binary, own array<bigint>"), "sets")
        self.sets = new if self.sets is None else self.sets.unionByName(new)

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """Of pairs ``a, b`` those that are linked, with their other columns."""
        met = pairs
        for x in "ab":
            met = met.join(self.sets.select(F.col("rep").alias(x), F.col("own").alias(f"own_{x}")), x)
        both = F.size(F.array_intersect("own_a", "own_b"))
        met = met.select(*pairs.columns, (F.size("own_a") + F.size("own_b")).alias("n"), both.alias("both"))
        return stored(met.where(100 * F.col("both") >= self.percent * (F.col("n") - F.col("both"))).select(*pairs.columns), "links")


def _led(members: DataFrame, reps: DataFrame, cut: int, percent: int) -> DataFrame:
    """Pairs ``a, b, meetings``: members and leaders of their nodes, of like sketches, and in how many meetings the leader is.

    Near copies of one text meet most often around it, so its leaders are few.
    """
    met = stored(members.withColumn("meetings", F.sum("size").over(Window.partitionBy("rep"))).drop("size"), "meetings")
    ranked = met.groupBy("node").agg(F.max(F.struct("meetings", "rep")).alias("leader"))
    pairs = met.join(ranked, "node").select(F.col("rep").alias("a"), F.col("leader.rep").alias("b"), "leader.meetings").where("a <> b").distinct()
    known = reps.select("rep", "n", "sketch")
    for x in "ab":
        pairs = pairs.join(known.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}")), x)
    sizes_fit = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    return stored(pairs.where(sizes_fit).where(_like(cut)("sketch_a", "sketch_b")).select("a", "b", "meetings"), "led-pairs")


def _labels(led: DataFrame) -> DataFrame:
    """``rep, label``: of confirmed leaders the one of most meetings, or that one's own.

    A leader is of more meetings than those it leads, so this leads up; rows of one label are of one component, and
    most of a component have one.
    """
    up = stored(led.groupBy("a").agg(F.max(F.struct("meetings", "b")).alias("up")).select("a", F.col("up.b").alias("b")), "leaders")
    on = up.select(F.col("a").alias("b"), F.col("b").alias("c"))
    labels = up.join(on, "b", "left").select(F.col("a").alias("rep"), F.coalesce("c", "b").alias("label"))
    return stored(labels, "labels")


def _cells(leaves: list[DataFrame], rest: DataFrame | None, small: int) -> DataFrame:
    """``cell, members``: small nodes, and pairs of blocks of those that are large at the last level."""
    rows = reduce(DataFrame.unionByName, leaves).select(*_MEMBER, F.col("node").alias("cell"), F.lit(-1).cast("long").alias("block"))
    if rest is not None:
        blocks = F.ceil(F.col("size") * 2 / small)
        cut = rest.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep", F.lit(5)), "blocks"))
        cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        own = F.when(F.col("block") == F.col("other"), -1).otherwise(F.col("block"))
        rows = rows.unionByName(cut.select(*_MEMBER, F.xxhash64("node", F.least("block", "other"), F.greatest("block", "other"), F.lit(6)).alias("cell"), own.cast("long").alias("block")))
    return rows.groupBy("cell").agg(F.collect_list(F.struct(*_MEMBER, "block")).alias("members"))


def _classes(docs: DataFrame, percent: int, recall: float, width: int, tokens: int, small: int, levels: int) -> tuple[DataFrame, DataFrame]:
    """Per row ``doc_id, v1, v2, rep, n``, with a null ``rep`` if there are no words; per linked member ``node, root``."""
    threshold = percent / 100
    cut = sketch_cut(tokens, threshold, SKETCH_MISS)
    v1, v2 = wide_hash(F.col("text"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select("doc_id", v1.alias("v1"), v2.alias("v2"), "text")
    roots = _roots(tree_count(threshold, recall, levels), tokens, threshold)
    signed = stored(docs.mapInArrow(_signatures(width, tokens, roots), _SIGNED), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "v1", "v2")).alias("first")
    each = F.first(F.struct("n", "nodes", "sketch")).alias("each")
    reps = stored(signed.where("rep is not null").groupBy("rep").agg(first, each).select("rep", "first", "each.*"), "members")
    join = _Join(docs, reps, percent, width)

    members = reps.select("rep", F.explode("nodes").alias("node"))
    met = members.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
    members = stored(members.join(met, "node"), "first-nodes")

    pairs = _led(members, reps, cut, percent)
    join.read_sets(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct())
    led = join.confirmed(pairs)
    edges, labels = [led.select("a", "b")], _labels(led)

    members = members.join(labels, "rep", "left").select("rep", F.coalesce("label", "rep").alias("label"), "node")
    leaves, rest = [], None
    for level in range(1, levels + 1):
        members = stored(members, "nodes")
        sizes, seen = measured(_mixed_nodes(members), "node-sizes", rows=F.count("*"), large=F.count_if(F.col("size") > small))
        members = members.join(_small(sizes, seen["rows"]), "node")
        if level == 1:
            members = stored(members.join(reps.select("rep", "n", "sketch"), "rep"), "mixed-nodes")
        leaves.append(members.where(F.col("size") <= small).drop("size"))
        large = members.where(F.col("size") > small)
        if not seen["large"]:
            break
        if level == levels:
            rest = large
            break
        members = _branched(large, tokens, threshold)

    found = stored(_cells(leaves, rest, small).mapInArrow(_alike(cut, percent), "cell bigint, a binary, b binary"), "like-sketches")
    pairs = stored(found.where("b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "like-pairs")
    dense = found.where("b is null").select("cell", F.col("a").alias("rep")).distinct()
    join.read_sets(pairs.select(F.explode(F.array("a", "b")).alias("rep")).unionByName(dense.select("rep")).distinct())
    edges.append(join.confirmed(pairs))
    own = dense.join(join.sets, "rep").join(labels, "rep", "left").select("cell", "rep", F.coalesce("label", "rep").alias("label"), "own")
    edges.append(stored(own.groupBy("cell").applyInArrow(_confirmed(percent), "a binary, b binary"), "dense-links"))
    return signed.select("doc_id", "v1", "v2", "rep", "n"), stored(components(reduce(DataFrame.unionByName, edges)), "components")


def _described(docs: DataFrame, percent: int, recall: float, width: int, tokens: int, small: int, levels: int) -> DataFrame:
    """``doc_id, v1, v2, n_shingles, component_id`` for every row."""
    signed, roots = _classes(docs, percent, recall, width, tokens, small, levels)
    own = signed.where("rep is not null").join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    # The members of a component, each with its least id, are fewer than its rows.
    least = stored(own.groupBy("root").agg(F.min("doc_id").alias("component_id")), "component-ids")
    own = own.join(least, "root").select("doc_id", "v1", "v2", F.col("n").alias("n_shingles"), "component_id")
    alone = signed.where("rep is null").select("doc_id", "v1", "v2", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return own.unionByName(alone)


def near_components(docs: DataFrame, percent: int = PERCENT, recall: float = RECALL, width: int = WORDS, tokens: int = TOKENS, small: int = SMALL, levels: int = LEVELS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row.

    Words are what ``\\x20`` and ``\\x09`` to ``\\x0D`` part, A-Z as a-z.  ``n_shingles`` is the number of distinct runs
    of ``width`` words (a shorter text is one).  Texts are linked when 100 times their common shingles are at least
    ``percent`` times those of both; ``component_id`` is the least id that links lead to, and a row is ``kept`` if it has that id.
    All links are confirmed on full sets; of those at the threshold itself a share of ``recall`` is met at least.

    Null, empty and blank texts have no shingles and no links.  Rows are told apart by their texts, so equal ids of
    different texts link each for itself; null ids come last, and the component of rows without any id is null, of which all are
    kept.  Repeated rows are linked with each other.  Texts of any length are taken whole.  Other columns are
    ignored; an empty table gives an empty result.
    """
    out = _described(docs, percent, recall, width, tokens, small, levels)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_components(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the rows that :func:`near_components` keeps; columns are as they were, whatever they are called."""
    given = {"percent": PERCENT, "recall": RECALL, "width": WORDS, "tokens": TOKENS, "small": SMALL, "levels": LEVELS} | options
    lost, seen = measured(_described(docs, **given).where("not doc_id <=> component_id").select("doc_id", "v1", "v2").distinct(), "near-copies", rows=F.count("*"))
    v1, v2 = wide_hash(F.col("text").cast("string"))
    rows = docs.select(as_row(docs), F.col("doc_id").cast("long").alias("doc_id"), v1.alias("v1"), v2.alias("v2"))
    same = F.expr("d.doc_id <=> l.doc_id and d.v1 = l.v1 and d.v2 = l.v2")
    return rows.alias("d").join(_small(lost, seen["rows"]).alias("l"), same, "left_anti").select("row.*")


def op11_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
