"""Chat formatting after a collapse of cumulative snapshots, in DataFrame operations only.

A chat log often holds one conversation several times, each time some turns longer.  Every turn gets a rolling
hash of the turns up to it; a conversation whose last hash is found in the middle of a longer one is a
snapshot of it.  An anti-join retains the maximal ones, which are rendered.

The rolling hash is the exclusive or of hashes salted with the turn's position (two seeds, 128 bits), so it is
built per chunk of turns and carried over chunks: a conversation that holds a third of all turns is spread
over many tasks, and so is its rendering, by segments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradelake.llm.common import stored, wide_hash

#: Turns that are hashed in one window partition, and rendered into one segment.
CHUNK = 256


def prefixes(turns: DataFrame) -> DataFrame:
    """``conv_id, pos, n_turns, p1, p2, role, text``: the position of each turn and the hash of all turns up to it."""
    turns = turns.where("conv_id is not null").select("conv_id", "turn", "role", "text").withColumn("chunk", F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-(1 << 62))))
    sizes = turns.groupBy("conv_id", "chunk").agg(F.count("*").alias("size"))
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("conv_id", "chunk", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("offset"), F.sum("size").over(Window.partitionBy("conv_id")).alias("n_turns"))
    own = Window.partitionBy("conv_id", "chunk").orderBy(*[F.col(c).asc_nulls_first() for c in ("turn", "role", "text")])
    placed = turns.withColumn("rank", F.row_number().over(own)).join(sizes, ["conv_id", "chunk"]).withColumn("pos", F.col("offset") + F.col("rank"))
    content = ["pos", F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    h1, h2 = wide_hash(*content)
    placed = placed.select("conv_id", "chunk", "pos", "n_turns", "role", "text", h1.alias("h1"), h2.alias("h2"))
    totals = placed.groupBy("conv_id", "chunk").agg(F.bit_xor("h1").alias("t1"), F.bit_xor("h2").alias("t2"))
    before = [F.coalesce(F.bit_xor(t).over(earlier), F.lit(0)).alias(b) for t, b in (("t1", "b1"), ("t2", "b2"))]
    totals = totals.select("conv_id", "chunk", *before)
    upto = Window.partitionBy("conv_id", "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rolled = placed.join(totals, ["conv_id", "chunk"]).select("conv_id", "pos", "n_turns", "role", "text", *[F.bit_xor(h).over(upto).bitwiseXOR(F.col(b)).alias(p) for h, b, p in (("h1", "b1", "p1"), ("h2", "b2", "p2"))])
    return rolled


def collapse(turns: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id, n_turns, keep_id, kept``; also the parts from which :func:`render` works.

    A conversation is dropped if its turns, in order, are the first turns of a longer one, or all turns of one
    with a smaller id.  ``keep_id`` is the longest conversation that begins with it, then the smallest id.
    """
    return _decide(prefixes(turns))


def _decide(rolled: DataFrame) -> DataFrame:
    key = ["pos", "p1", "p2"]
    ends = rolled.where("pos = n_turns").select("conv_id", "n_turns", *key)
    # Equal conversations are one row here, so a third of all being equal makes no large group.
    distinct = ends.groupBy(*key).agg(F.min("conv_id").alias("first_id"))
    proper = rolled.where("pos < n_turns").select(*key).distinct()
    maximal = distinct.join(proper, key, "left_anti").select(*key, F.lit(True).alias("maximal"))
    longest = rolled.groupBy(*key).agg(F.min(F.struct((-F.col("n_turns")).alias("order"), "conv_id")).alias("best"))
    ruled = distinct.join(longest, key).join(maximal, key, "left")
    # Stored, since AQE splits no join that shares its stage with an aggregate.
    ruled = stored(ruled.select(*key, F.col("best.conv_id").alias("keep_id"), F.when(F.col("maximal"), F.col("first_id")).alias("kept_id")), "chat-rulings")
    return ends.join(ruled, key).select("conv_id", "n_turns", "keep_id", F.col("conv_id").eqNullSafe(F.col("kept_id")).alias("kept"))


def format_chats(turns: DataFrame) -> DataFrame:
    """Collapse, then render: ``conv_id, n_turns, keep_id, kept, segment, rendered``.

    A kept conversation has a row for each ``CHUNK`` turns, in ``segment`` order; a dropped one has one row
    with segment 0 and a null text.  Turns are ordered by turn (null first, then negative ones), role and text, and repeated rows are turns
    of their own.  A null role or text renders as empty and differs from an empty one in comparisons.  Rows
    without a ``conv_id`` belong to no conversation and are left out; other columns are ignored; an empty table gives an empty result.
    """
    rolled = stored(prefixes(turns), "chat-prefixes")
    decided = _decide(rolled.select("conv_id", "pos", "n_turns", "p1", "p2"))
    line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    said = rolled.join(decided.where("kept").select("conv_id"), "conv_id").withColumn("segment", F.floor((F.col("pos") - 1) / CHUNK))
    said = said.groupBy("conv_id", "segment").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("lines"))
    said = said.select("conv_id", "segment", F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("rendered"))
    return decided.join(said, "conv_id", "left").select("conv_id", "n_turns", "keep_id", "kept", F.coalesce("segment", F.lit(0)).alias("segment"), "rendered")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = {
    "op8_chat_format": f"""
        WITH t AS (SELECT conv_id, role, text, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n_turns,
            list(struct_pack(r := role, t := text)) OVER (w ROWS UNBOUNDED PRECEDING) AS prefix
            FROM conversations WHERE conv_id IS NOT NULL WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)),
        longest AS (SELECT prefix, arg_min(conv_id, struct_pack(a := -n_turns, b := conv_id)) AS keep_id FROM t GROUP BY prefix),
        c AS (SELECT t.conv_id, t.n_turns, l.keep_id, l.keep_id = t.conv_id AS kept FROM t JOIN longest l ON t.prefix = l.prefix WHERE t.pos = t.n_turns),
        s AS (SELECT conv_id, (pos - 1) // {CHUNK} AS segment, string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY pos) AS rendered FROM t GROUP BY ALL)
        SELECT c.conv_id, n_turns, keep_id, kept, coalesce(s.segment, 0) AS segment, s.rendered FROM c LEFT JOIN s ON c.conv_id = s.conv_id AND c.kept
    """,
}
