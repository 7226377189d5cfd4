"""A user's past scans: upserts, favourites, retention and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradelake.functions.numeric import to_decimals

KEPT = 24


def summary(scans: DataFrame) -> DataFrame:
    """The narrow form of a scan."""
    return scans.select("id", "user_id", "created_at", "overall", "confidence", "favorite")


def upsert(index: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` rows replace those of their id."""
    return new.unionByName(index.join(new.select("id").distinct(), "id", "left_anti"))


def delete(index: DataFrame, ids: DataFrame) -> DataFrame:
    return index.join(ids.select("id").distinct(), "id", "left_anti")


def toggle_favorites(index: DataFrame, ids: DataFrame) -> DataFrame:
    """Negate ``favorite`` of the given ids; ids that are not there change nothing."""
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    return index.join(hit, "id", "left").withColumn("favorite", F.col("favorite") != F.coalesce("_hit", F.lit(False))).select(*index.columns)


def attach(index: DataFrame, records: DataFrame, column: str) -> DataFrame:
    """Set ``column`` from ``records`` (one row per id) where there is a record."""
    new = records.select("id", F.col(column).alias("_new"))
    return index.join(new, "id", "left").withColumn(column, F.coalesce("_new", column)).select(*index.columns)


def retain(scans: DataFrame, kept: int = KEPT) -> DataFrame:
    """The ``kept`` scans of each user that stay: favourites first, then the newest; ``place`` counts them.

    Equal to evicting the last non-favourite after every save as long as favourites do not change.  Rank limits
    are applied before the shuffle, so a user with very many scans sends ``kept`` rows per task.
    """
    order = Window.partitionBy("user_id").orderBy(F.col("favorite").desc(), F.col("created_at").desc(), F.col("id").desc())
    return scans.withColumn("place", F.row_number().over(order)).where(F.col("place") <= kept)


def recent(scans: DataFrame, n: int = 12) -> DataFrame:
    """Each user's newest scans."""
    order = Window.partitionBy("user_id").orderBy(F.col("created_at").desc(), F.col("id").desc())
    return scans.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def statistics(scans: DataFrame) -> DataFrame:
    """Per user: number of scans, mean grade, best grade and number of gem grades."""
    return scans.groupBy("user_id").agg(
        F.count("*").alias("scans"),
        to_decimals(F.avg("overall"), 1).alias("mean_grade"),
        F.max("overall").alias("best_grade"),
        F.count_if(F.col("overall") >= 9.5).alias("gems"),
    )


def strided(listing: DataFrame, order: str, target: int, ranges: int = 64) -> DataFrame:
    """Every n-th row of a listing, so that about ``target`` are left; ``order`` is unique.

    Rows are cut into ranges of ``order`` at fixed values, so a position is the count of the ranges before it and
    the rank within its own: no task numbers all rows.  The values come from a sample of about 100 rows per range,
    which only decides how even the ranges are.
    """
    n = listing.count()
    step = max(1, n // target)
    sample = listing.select(order).sample(min(1.0, 100.0 * ranges / max(1, n)), seed=7).orderBy(order).limit(400 * ranges).collect()
    cuts = sorted({sample[len(sample) * i // ranges][0] for i in range(1, ranges)}) if sample else []
    part = sum((F.coalesce(F.col(order) >= F.lit(c), F.lit(False)).cast("int") for c in cuts), F.lit(0))
    ranged = listing.withColumn("_part", part)
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1 + F.col("_before")
    placed = ranged.join(F.broadcast(offsets), "_part").withColumn("_place", place)  # a row per range
    return placed.where((F.col("_place") % step == 0) & (F.col("_place") < step * target)).select(*listing.columns)
