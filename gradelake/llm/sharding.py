"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

Each shard owns ``vnodes`` points of a ring of ``CELLS`` cells; a row's home is the owner of the first point at
or clockwise of its hash.  A shard takes rows up to its bound.  What overflows continues clockwise and fills
the first shards that still have room, first come first served.  With the bounds ``floor`` or ``ceil`` of
rows by shards, counts are at most one apart, and all but the overflow (a few per cent) stay at home.

Only counts travel to the plan: per arc, ``shards * vnodes`` rows whatever the size of the input.  Equal rows are
one entry with a count.  Entries are ranked in cells of the ring, each cut by a hash into ``PARTS`` parts, so no id
or cell is one task; each rank then looks up the segment of its arc that holds it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradelake.llm.common import stored

SHARDS = 40
VNODES = 64
#: Cells of the ring; a point and a row's hash are cells, so the ring is a table of fixed size.
CELLS = 1 << 16
#: Parts of a cell, by the hash of the whole row.
PARTS = 16
#: Equal rows that are dealt out in one go.
COPIES = 4096


def ring(spark: SparkSession, shards: int, vnodes: int) -> DataFrame:
    """``cell, arc, owner`` for every cell: the arc's number in ring order and the shard that owns its end."""
    points = spark.range(shards * vnodes).select((F.col("id") % shards).cast("int").alias("owner"), F.pmod(F.xxhash64(F.lit("point"), F.col("id") % shards, F.floor(F.col("id") / shards)), F.lit(CELLS)).cast("int").alias("end"))
    points = points.groupBy("end").agg(F.min("owner").alias("owner"))
    order = Window.partitionBy(F.lit(0)).orderBy("end")
    arcs = points.select("end", "owner", (F.row_number().over(order) - 1).alias("arc"), F.lag("end").over(order).alias("before"), F.max("end").over(Window.partitionBy(F.lit(0))).alias("last"))
    # The first arc also holds the cells behind the last point.
    spans = F.when(F.col("before").isNull(), F.concat(F.sequence(F.lit(0), "end"), F.when(F.col("last") < CELLS - 1, F.sequence(F.col("last") + 1, F.lit(CELLS - 1))).otherwise(F.expr("array()").cast("array<int>")))).otherwise(F.sequence(F.col("before") + 1, F.col("end")))
    return arcs.select(F.explode(spans).alias("cell"), "arc", "owner")


def cell_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("row"), key), F.lit(CELLS)).cast("int")


def segments(arcs: DataFrame, shards: int) -> DataFrame:
    """``arc, low, high, shard, first``: ranks ``low`` up to ``high`` of the arc go to ``shard`` at slots from ``first``.

    ``arcs`` has ``arc, owner, n`` for every arc, so this runs on a table of fixed size.
    """
    bound = F.floor(F.col("total") / shards) + (F.col("owner") < F.col("total") % shards).cast("long")
    everything = Window.partitionBy(F.lit(0))
    ordered = everything.orderBy("arc").rowsBetween(Window.unboundedPreceding, -1)
    owned = Window.partitionBy("owner").orderBy("arc").rowsBetween(Window.unboundedPreceding, -1)
    arcs = arcs.withColumn("total", F.sum("n").over(everything)).withColumn("bound", bound)
    arcs = arcs.withColumn("taken", F.least("bound", F.coalesce(F.sum("n").over(owned), F.lit(0))))
    arcs = arcs.withColumn("home", F.least("n", F.col("bound") - F.col("taken"))).withColumn("over", F.col("n") - F.col("home"))
    arcs = arcs.withColumn("queued", F.coalesce(F.sum("over").over(ordered), F.lit(0)))
    at_home = arcs.where("home > 0").select("arc", F.lit(0).cast("long").alias("low"), F.col("home").alias("high"), F.col("owner").alias("shard"), F.col("taken").alias("first"))

    # The overflow moves round the ring: each point hands on a queue, and a shard with room takes from its head.  Two rounds empty it.
    point = F.struct("arc", "owner", "over")
    laps = arcs.groupBy().agg(F.array_sort(F.collect_list(point)).alias("points"), F.array_sort(F.collect_set(F.struct("owner", "bound"))).alias("bounds"), F.array_sort(F.collect_list(F.struct("owner", "home"))).alias("homes"))
    room = F.transform("bounds", lambda b: b["bound"] - F.aggregate(F.filter("homes", lambda h: h["owner"] == b["owner"]), F.lit(0).cast("long"), lambda s, h: s + h["home"]))
    laps = laps.select(F.concat("points", F.transform("points", lambda p: F.struct(p["arc"].alias("arc"), p["owner"].alias("owner"), F.lit(0).cast("long").alias("over")))).alias("points"), F.transform("bounds", lambda b: b["owner"]).alias("owners"), F.transform("bounds", lambda b: b["bound"]).alias("bounds"), room.alias("room"))
    start = F.struct(F.lit(0).cast("long").alias("waiting"), F.col("room").alias("room"), F.expr("cast(array() as array<struct<owner:int,slot:bigint,n:bigint>>)").alias("takes"))

    def step(state: Column, p: Column) -> Column:
        waiting = state["waiting"] + p["over"]
        at = F.array_position(F.col("owners"), p["owner"]).cast("int")
        free = F.element_at(state["room"], at)
        n = F.least(waiting, free)
        took = F.struct((waiting - n).alias("waiting"), F.transform(state["room"], lambda r, i: F.when(i == at - 1, r - n).otherwise(r)).alias("room"), F.concat(state["takes"], F.array(F.struct(p["owner"].alias("owner"), (F.element_at(F.col("bounds"), at) - free).alias("slot"), n.alias("n")))).alias("takes"))
        idle = F.struct(waiting.alias("waiting"), state["room"].alias("room"), state["takes"].alias("takes"))
        return F.when(n > 0, took).otherwise(idle)

    takes = laps.select(F.posexplode(F.aggregate("points", start, step)["takes"]).alias("turn", "take")).select("turn", "take.*")
    takes = takes.withColumn("queued", F.coalesce(F.sum("n").over(everything.orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # Cut the queue wherever an arc or a take begins; the last beginning of either kind holds up to the next cut.
    none = F.lit(None)
    cuts = arcs.where("over > 0").select("queued", "arc", (F.col("home") - F.col("queued")).alias("shift"), none.cast("int").alias("owner"), none.cast("long").alias("slot"), F.col("over").alias("n"))
    cuts = cuts.unionByName(takes.select("queued", none.cast("int").alias("arc"), none.cast("long").alias("shift"), "owner", (F.col("slot") - F.col("queued")).alias("slot"), "n"))
    upto = everything.orderBy("queued").rangeBetween(Window.unboundedPreceding, 0)
    held = lambda c: F.last(c, ignorenulls=True).over(upto).alias(c)
    cuts = cuts.select("queued", (F.col("queued") + F.col("n")).alias("end"), held("arc"), held("shift"), held("owner"), held("slot")).groupBy("queued").agg(F.max("end").alias("end"), *[F.first(c).alias(c) for c in ("arc", "shift", "owner", "slot")])
    stop = F.coalesce(F.lead("queued").over(everything.orderBy("queued")), F.col("end"))
    moved = cuts.select("arc", (F.col("queued") + F.col("shift")).alias("low"), (stop + F.col("shift")).alias("high"), F.col("owner").alias("shard"), (F.col("queued") + F.col("slot")).alias("first"))
    return at_home.unionByName(moved)


def shard_rows(docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES) -> DataFrame:
    """Place every row: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``, plus ``home``, the shard without bounds.

    The law is ``rows``: counts are at most one apart.  ``size`` is the text's UTF-8 bytes plus 16; a null text
    has 16 and the crc of the empty text; texts of any length are measured whole.  Rows are placed by ``doc_id``,
    and a null id is placed like any other.  Rows of one id share an arc and are ordered by a hash, then size and
    crc; equal rows are interchangeable.  Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    own = ["doc_id", "size", "text_crc32"]
    part = F.pmod(F.xxhash64(F.lit("part"), *own), F.lit(PARTS)).cast("int")
    same = stored(rows.groupBy(*own).agg(F.count("*").alias("n")).select(*own, cell_of(F.col("doc_id")).alias("cell"), part.alias("part"), "n"), "shard-rows")

    wheel = F.broadcast(ring(spark, shards, vnodes))  # CELLS rows, whatever the data
    counts = stored(same.groupBy("cell", "part").agg(F.sum("n").alias("n")), "shard-counts")
    arcs = ring(spark, shards, vnodes).join(F.broadcast(counts.groupBy("cell").agg(F.sum("n").alias("n"))), "cell", "left").groupBy("arc", "owner").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    plan = segments(arcs, shards)
    earlier = Window.partitionBy("arc").orderBy("cell", "part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.join(wheel, "cell").select("cell", "part", "arc", "owner", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("cell", "part").orderBy(*own).rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    ranked = same.join(stored(before, "shard-offsets"), ["cell", "part"]).select(*own, "arc", "owner", "n", first.alias("from"))
    # Equal rows are told apart again in steps, so very many of them are spread over tasks.
    steps = ranked.select(*own, "arc", "owner", "n", "from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long"))).alias("step"))
    if not same.where(F.col("n") > COPIES).isEmpty():
        steps = steps.repartition("arc", "from", "step")
    copies = F.explode(F.sequence(F.col("step"), F.least(F.col("step") + COPIES, "n") - 1)).alias("copy")
    ranked = steps.select(*own, "arc", "owner", "from", copies).select(*own, "arc", "owner", (F.col("from") + F.col("copy")).alias("rank"))
    placed = ranked.join(F.broadcast(plan), (ranked.arc == plan.arc) & (ranked["rank"] >= plan.low) & (ranked["rank"] < plan.high))
    return placed.select(*own, F.lit("rows").alias("law"), "shard", (F.col("first") + F.col("rank") - F.col("low")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("owner").alias("home"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
