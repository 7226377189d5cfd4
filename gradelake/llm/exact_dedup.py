"""Exact deduplication over a log-structured merge index of text digests.

*One pass over the texts* gives every document's digest; from then on only digests travel.  They are loaded in
several memtables.  Each is reduced to one entry per digest (the longest original text, then the smallest
identifier), looked up in the runs flushed before, and flushed as a run: a table sorted by digest, with its least
and greatest digest and a filter of 64-bit words.  A *lookup* asks a run only for digests that lie in its range and
pass its filter, and skips a run for which none is left.  *Compaction* merges the runs into one when they are many.

Digests that a memtable holds twice, or that an older run holds, are the hits.  Only the texts of hits are read
again, and compared byte by byte with the text that stays.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake.llm.common import shared_dir, stored

#: Characters removed before texts are compared: space, and tab to carriage return.
BLANKS = r"[\x20\x09-\x0D]"
#: An index that has more runs than this is compacted.
MAX_RUNS = 4
#: Documents of a memtable, and memtables of one load at most: beyond, they grow.
MEMTABLE_ROWS, MEMTABLES = 100_000, 16
#: Entries for each word of a filter, and bits that each sets in its word.
ENTRIES_PER_WORD, FILTER_BITS = 4, 3
#: Rows (about 40 bytes each) that are broadcast up to this number, else joined by shuffle.
BROADCAST_ROWS = 500_000


def normalised(text: str = "text") -> Column:
    """The text without blanks; null counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), BLANKS, "")


def _best() -> Column:
    return F.min(F.struct((-F.col("n_points")).alias("order"), "doc_id")).alias("best")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


@dataclass
class Run:
    """One sorted table of entries, with what a lookup asks before it touches the table."""

    path: str
    rows: int
    low: bytes
    high: bytes
    words: int


class DigestIndex:
    """Sorted runs below one folder that all executors share; each has one entry ``digest, doc_id, n_points, n`` per digest."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/digests-{uuid.uuid4().hex}"
        self.runs: list[Run] = []
        #: Runs that lookups read, and runs that they could leave alone.
        self.read, self.skipped = 0, 0

    def _entries(self, run: Run) -> DataFrame:
        return self.spark.read.schema("digest binary, doc_id long, n_points int, n long").parquet(run.path + "/entries")

    def _filter(self, run: Run) -> DataFrame:
        return self.spark.read.schema("slot long, word long").parquet(run.path + "/filter")

    @staticmethod
    def _slot(words: int) -> tuple[Column, Column]:
        """The word of the filter that a digest belongs to, and the bits it sets there."""
        mask = F.lit(0).cast("long")
        for i in range(FILTER_BITS):
            bit = F.pmod(F.xxhash64(F.lit(i), "digest"), F.lit(64)).cast("int")
            mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
        return F.pmod(F.xxhash64("digest"), F.lit(words)), mask

    def flush(self, memtable: DataFrame) -> None:
        """Write a run of one entry per digest, its filter and its range."""
        path = f"{self.path}/{uuid.uuid4().hex}"
        memtable.select("digest", "doc_id", "n_points", "n").sortWithinPartitions("digest").write.parquet(path + "/entries")
        run = Run(path, 0, b"", b"", 1)
        entries = self._entries(run)
        run.rows, low, high = entries.agg(F.count("*"), F.min("digest"), F.max("digest")).first()
        if not run.rows:
            return
        run.low, run.high, run.words = bytes(low), bytes(high), -(-run.rows // ENTRIES_PER_WORD)
        slot, mask = self._slot(run.words)
        entries.groupBy(slot.alias("slot")).agg(F.bit_or(mask).alias("word")).write.parquet(path + "/filter")
        self.runs.append(run)

    def lookup(self, digests: DataFrame) -> DataFrame:
        """Those of the distinct ``digests`` that some run holds."""
        found = digests.select("digest").limit(0)
        for run in self.runs:
            slot, mask = self._slot(run.words)
            asked = digests.select("digest").where(F.col("digest").between(F.lit(run.low), F.lit(run.high)))
            words = _small(self._filter(run), run.words)
            maybe = asked.withColumn("slot", slot).join(words, "slot").where(F.col("word").bitwiseAND(mask) == mask).select("digest")
            maybe = stored(maybe, "digests-asked")
            n = maybe.count()
            if not n:
                self.skipped += 1
                continue
            self.read += 1
            found = found.unionByName(self._entries(run).select("digest").join(_small(maybe, n), "digest", "left_semi"))
        return found.distinct()

    def merged(self, digests: DataFrame | None = None, small: bool = False) -> DataFrame:
        """One entry per digest over all runs, of all digests or of the given ones."""
        entries = self.spark.createDataFrame([], "digest binary, doc_id long, n_points int, n long")
        for run in self.runs:
            entries = entries.unionByName(self._entries(run))
        if digests is not None:
            entries = entries.join(F.broadcast(digests) if small else digests, "digest", "left_semi")
        return entries.groupBy("digest").agg(_best(), F.sum("n").alias("n")).select("digest", "best.doc_id", (-F.col("best.order")).alias("n_points"), "n")

    def compact(self) -> None:
        """Merge all runs into one."""
        merged, self.runs = self.merged(), []
        self.flush(merged)

    def add(self, memtable: DataFrame) -> DataFrame:
        """Take in one entry per digest; returns the digests that are held more than once now."""
        memtable = stored(memtable, "digests-memtable")
        hits = stored(memtable.where("n > 1").select("digest").unionByName(self.lookup(memtable)).distinct(), "digests-hit")
        self.flush(memtable)
        if len(self.runs) > MAX_RUNS:
            self.compact()
        return hits


def exact_dedup(docs: DataFrame, digest_bytes: int = 32, memtable_rows: int = MEMTABLE_ROWS) -> DataFrame:
    """Group documents of equal normalised text: ``doc_id, keep_id, group_size, kept, text_sha256``, a row per document.

    Of equal texts the one with the most code points in the original, then the smallest id, stays.  Null and
    blank texts equal each other.  A repeated row is a copy of itself: both rows are returned, and ``kept`` is
    true for each row that has the kept id.  A null id sorts first, so it can be the one that stays.  Texts of any
    length are digested whole.  Columns other than ``doc_id`` and ``text`` are ignored; an empty table gives an
    empty result.  ``digest_bytes`` shortens the key, which only tests use, to see texts that collide parted.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    sha = F.unhex(F.sha2(F.col("norm").cast("binary"), 256))
    key = F.substring(sha, 1, digest_bytes)
    whole = sha if digest_bytes < 32 else F.lit(None).cast("binary")
    sized = docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n_points"), normalised().alias("norm"))
    entries = stored(sized.select("doc_id", "n_points", key.alias("digest"), whole.alias("whole")), "digests")
    rows = entries.count()
    memtables = max(1, min(MEMTABLES, -(-rows // memtable_rows)))

    index, hits = DigestIndex(spark), []
    for n in range(memtables):
        own = entries.where(F.pmod(F.xxhash64("doc_id"), F.lit(memtables)) == n)
        # Entries are combined in the map tasks first, so a digest of a third of all rows is one row per task.
        own = own.groupBy("digest").agg(_best(), F.count("*").alias("n"))
        hits.append(index.add(own.select("digest", "best.doc_id", (-F.col("best.order")).alias("n_points"), "n")))
    hit = hits[0]
    for more in hits[1:]:
        hit = hit.unionByName(more)
    hit = stored(hit.distinct(), "digests-hit")
    n_hit = hit.count()
    copied = stored(index.merged(hit, n_hit <= BROADCAST_ROWS).select("digest", F.col("doc_id").alias("keep_id"), F.col("n").alias("group_size")), "digests-copied")

    # Only the texts of copies are read again, by their ids; the digest tells rows apart that share an id.
    ids = stored(entries.join(_small(hit, n_hit), "digest", "left_semi").select("doc_id").distinct(), "digests-ids")
    again = docs.join(_small(ids.withColumnRenamed("doc_id", "hit_id"), ids.count()), F.expr("doc_id <=> hit_id"), "left_semi")
    texts = again.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n_points"), normalised().alias("norm")).withColumn("sha", sha)
    met = texts.withColumn("digest", F.substring("sha", 1, digest_bytes)).join(_small(copied, n_hit), "digest")
    # Stored, since AQE splits no join that shares its stage with an aggregate.
    keepers = stored(met.where("doc_id <=> keep_id").groupBy("digest").agg(F.first("norm").alias("keep_norm")), "exact-keepers")
    same = F.col("norm") == F.col("keep_norm")
    checked = met.join(keepers, "digest").select("digest", "doc_id", "keep_id", "group_size", "n_points", same.alias("same"), F.when(~same, F.col("norm")).alias("norm"), F.lower(F.hex("sha")).alias("text_sha256"))
    checked = stored(checked, "exact-hits")
    good, clash = checked.where("same"), checked.where("not same")
    if not clash.isEmpty():
        # Different texts behind one digest: they leave the group and are grouped by their bytes instead.
        lost = clash.groupBy("digest").agg(F.count("*").alias("lost"))
        good = good.join(lost, "digest", "left").withColumn("group_size", F.col("group_size") - F.coalesce("lost", F.lit(0)))
        best = clash.groupBy("norm").agg(_best(), F.count("*").alias("group_size"))
        clash = clash.drop("keep_id", "group_size").join(best, "norm").withColumn("keep_id", F.col("best.doc_id"))
        good = good.select("doc_id", "keep_id", "group_size", "text_sha256").unionByName(clash.select("doc_id", "keep_id", "group_size", "text_sha256"))
    alone = entries.join(_small(hit, n_hit), "digest", "left_anti").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lower(F.hex(F.coalesce("whole", "digest"))).alias("text_sha256"))
    out = good.select("doc_id", "keep_id", "group_size", "text_sha256").unionByName(alone)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = {
    "op2_exact_dedup": r"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
        k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM k
    """,
}
