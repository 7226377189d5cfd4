"""Catalog, index and label files: explicit schemas, bad rows counted rather than lost."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CATALOG = "id string, name string, number string, supertype string, subtypes array<string>, rarity string, setName string, setId string, releaseDate string, printedTotal int, imageSmall string, imageLarge string"
LABELS = "image string, name string, set string, number string, rectified boolean"
GRADES = "front string, back string, grade double, company string, note string"


def read_catalog(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Newline-delimited JSON, blank lines skipped."""
    rows = spark.read.schema(CATALOG).option("mode", "FAILFAST").json(path)
    return rows if limit is None else rows.limit(limit)


def write_catalog(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def read_labels(spark: SparkSession, path: str, schema: str = LABELS) -> DataFrame:
    """A JSON array of labels; a missing file has no labels."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def last_per_id(catalog: DataFrame, order: str) -> DataFrame:
    """One row per id, the last by ``order``."""
    columns = [c for c in catalog.columns if c != "id"]
    last = F.max_by(F.struct(*columns), order).alias("x")
    return catalog.groupBy("id").agg(last).select("id", "x.*")


def split_valid(rows: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """Rows that can be indexed, and the counts of those that cannot by reason."""
    reason = F.when(F.col("image").isNull(), "no image").when(F.col("embedding").isNull(), "no vector").when(F.size("embedding") != dim, "wrong length")
    marked = rows.withColumn("reject_reason", reason)
    return marked.where("reject_reason is null").drop("reject_reason"), marked.where("reject_reason is not null").groupBy("reject_reason").count()


def without_cached(rows: DataFrame, cached: DataFrame) -> DataFrame:
    """Rows whose image is not stored yet."""
    return rows.join(cached.select("id").distinct(), "id", "left_anti")


def read_vectors(spark: SparkSession, path: str, dim: int, ids: DataFrame) -> DataFrame:
    """A flat file of little-endian floats, one row of ``dim`` per id in order: ``id, embedding``.

    Fixed-length records are read in parallel; positions are those of the ids, and the counts must be equal.
    """
    records = spark.sparkContext.binaryRecords(path, 4 * dim).zipWithIndex().map(lambda x: (x[1], list(struct.unpack(f"<{dim}f", x[0]))))
    vectors = records.toDF("ord bigint, embedding array<float>")
    both = vectors.join(ids.select("ord", "id"), "ord", "full_outer")
    bad = F.when(F.col("id").isNull() | F.col("embedding").isNull(), F.raise_error(F.lit("ids and vectors differ in number"))).otherwise(F.col("id"))
    return both.select(bad.alias("id"), "embedding")


def write_vectors(rows: DataFrame, path: str) -> None:
    rows.select("id", F.col("embedding").cast("array<float>").alias("embedding")).write.mode("overwrite").parquet(path)


def paired_files(images: DataFrame, masks: DataFrame, least: int = 100) -> DataFrame:
    """Images that have a mask of the same stem; fewer than ``least`` are an error."""
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    pairs = images.withColumn("stem", stem).join(masks.select(stem.alias("stem"), F.col("path").alias("mask")), "stem")
    if pairs.limit(least).count() < least:
        raise ValueError(f"fewer than {least} pairs")
    return pairs


class PagedSource(DataSource):
    """A paged listing as a batch source: each page is one partition, fetched by the executors with retries.

    Options: ``pages`` and ``size``; ``fetch`` is a function ``(page, size) -> list of rows`` given to :func:`paged`.
    """

    fetch: Callable[[int, int], list[tuple]]
    ddl: str

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return self.ddl

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(type(self).fetch, int(self.options["pages"]), int(self.options.get("size", 250)))


class _PagedReader(DataSourceReader):
    def __init__(self, fetch: Callable, pages: int, size: int):
        self.fetch, self.pages, self.size = fetch, pages, size

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in range(1, self.pages + 1)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import time

        for attempt in range(1, 5):
            try:
                yield from self.fetch(partition.value, self.size)
                return
            except ConnectionError as e:
                if attempt == 4:
                    raise
                time.sleep(attempt * (5 if "429" in str(e) else 2))


def paged(spark: SparkSession, fetch: Callable[[int, int], list[tuple]], ddl: str, total: int, size: int = 250) -> DataFrame:
    """All rows of a listing of ``total`` rows."""
    source = type("Paged", (PagedSource,), {"fetch": staticmethod(fetch), "ddl": ddl})
    spark.dataSource.register(source)
    return spark.read.format("paged").option("pages", -(-total // size)).option("size", size).load()


def listed_fields(cards: DataFrame) -> DataFrame:
    """The 13 fields of the catalog file from listed cards: what is missing is null, a missing list is empty.

    Fixed values: the listing's names of nested fields (``set``, ``images``, ``nationalPokedexNumbers``).
    """
    empty = lambda name, kind: F.coalesce(name, F.array().cast(kind)).alias(name)
    dex = F.coalesce("nationalPokedexNumbers", F.array().cast("array<int>")).alias("dex")
    own_set = [F.col(f"set.{a}").alias(b) for a, b in (("id", "set_id"), ("name", "set_name"), ("series", "series"), ("releaseDate", "release_date"))]
    return cards.select("id", "name", "number", "rarity", "supertype", empty("subtypes", "array<string>"), dex, *own_set, F.col("images.small").alias("image_small"), F.col("images.large").alias("image_large"))


def indexed_fields(rows: DataFrame) -> DataFrame:
    """The 8 fields of the vector index's own catalog, from rows of :func:`listed_fields`."""
    subtypes = F.coalesce("subtypes", F.array().cast("array<string>")).alias("subtypes")
    return rows.select("id", "name", "number", "set_name", "release_date", "rarity", "supertype", subtypes)


def chosen_image(large: str, small: str) -> Column:
    """The large image, else the small one, else null; an empty address counts as none."""
    return F.coalesce(F.nullif(F.col(large), F.lit("")), F.nullif(F.col(small), F.lit("")))


def by_stem(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """Files joined to the catalog row whose id is their stem; files without a row are left out."""
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    return files.withColumn("id", stem).join(catalog, "id")


def candidate_ids(shown: DataFrame, candidates: DataFrame) -> DataFrame:
    """``query_id, id``: for the name and number that are shown, the candidate of least rank that has both, else null."""
    first = candidates.groupBy("query_id", "name", "number").agg(F.min_by("id", "rank").alias("id"))
    return shown.select("query_id", "name", "number").join(first, ["query_id", "name", "number"], "left").select("query_id", "id")


def split_by_card(rows: DataFrame, card: str, least: int = 50, share: float = 0.1) -> DataFrame:
    """Add ``validation``: a share of the cards, at least about ``least`` of them; all rows of a card are on one side.

    The side follows from a digest of the card alone, so it is the same in every run, whatever the order of rows.
    """
    n = max(1, rows.select(card).distinct().count())
    part = max(share, min(1.0, least / n))
    digest = F.conv(F.substring(F.md5(F.col(card).cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint")
    return rows.withColumn("validation", digest < int(part * (1 << 32)))


def admitted(files: DataFrame) -> DataFrame:
    """Images only, with ``route``: committed directly if an outline was found with confidence, else set by hand."""
    sure = (F.col("confidence") >= 0.8) & F.col("has_quad")
    return files.where(F.startswith("type", F.lit("image/"))).withColumn("route", F.when(F.coalesce(sure, F.lit(False)), "direct").otherwise("manual"))
