"""Scan documents: nested rows by id, put and deleted in batches, and kept as JSON.

The table is a folder of Parquet files by bucket of the id.  A batch rewrites the buckets it touches under its own
number and then logs them; readers take the latest logged number of each bucket.  So a batch that failed leaves nothing
to be seen, and one that is replayed changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: What a document holds; faces are nested as they were measured.
SCHEMA = """id string, created_at timestamp, name string, overall double, confidence double, favorite boolean,
front struct<score:double,issues:array<string>>, back struct<score:double,issues:array<string>>"""
#: What a list of scans shows of each.
INDEX = ("id", "created_at", "name", "overall", "favorite")
BUCKETS = 64


def parsed(lines: DataFrame, text: str = "value", schema: str = SCHEMA) -> tuple[DataFrame, DataFrame]:
    """Documents of JSON lines, and the lines that are none: ``value, reason``.

    Missing fields are null, unknown ones are passed over.  A null line, one that isn't JSON, one with a field of
    another type, and one without an id are not documents; they are handed back, never dropped.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    rows = lines.select(F.col(text).alias("value"), F.from_json(F.col(text), f"{schema}, _corrupt string", options).alias("doc"))
    reason = F.when(F.col("value").isNull(), "empty").when(F.col("doc._corrupt").isNotNull() | F.col("doc").isNull(), "not a document").when(F.col("doc.id").isNull(), "no id")
    rows = rows.withColumn("reason", reason)
    return rows.where("reason is null").select("doc.*").drop("_corrupt"), rows.where("reason is not null").select("value", "reason")


def written(documents: DataFrame) -> DataFrame:
    """One JSON line ``value`` per document; null fields are left out."""
    return documents.select(F.to_json(F.struct(*documents.columns)).alias("value"))


class DocumentTable:
    """Documents below ``path``; all batches go through one writer."""

    def __init__(self, spark: SparkSession, path: str, schema: str = SCHEMA, buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.buckets = spark, path.rstrip("/"), schema, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int")

    def _read(self, folder: str, schema: str, kind: str) -> DataFrame:
        path = f"{self.path}/{folder}"
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).format(kind).load(path)

    def log(self) -> DataFrame:
        """``bucket, batch`` of what was rewritten."""
        return self._read("log", "bucket int, batch bigint", "json")

    def read(self) -> DataFrame:
        """All documents as they are now; of each bucket only the latest files are read."""
        live = self.log().groupBy("bucket").agg(F.max("batch").alias("batch"))
        rows = self._read("data", f"{self.schema}, bucket int, batch bigint", "parquet")
        return rows.join(F.broadcast(live), ["bucket", "batch"]).drop("bucket", "batch")  # a row per bucket

    def get(self, ids: list[str]) -> DataFrame:
        return self.read().where(F.col("id").isin(ids))

    def index(self) -> DataFrame:
        """What lists show, derived from the documents, the newest first."""
        return self.read().select(*INDEX).orderBy(F.col("created_at").desc_nulls_last(), "id")

    def apply(self, changes: DataFrame, batch: int) -> None:
        """Take in a batch of ``doc`` (null to delete), ``id`` and ``seq``: of an id's changes the last counts.

        A batch of a number that was logged before changes nothing.  Rows without an id are an error.
        """
        if not self.log().where(F.col("batch") == batch).isEmpty():
            return
        last = changes.groupBy(F.when(F.col("id").isNotNull(), F.col("id")).otherwise(F.raise_error(F.lit("a change has no id"))).alias("id")).agg(F.max_by(F.struct("doc"), "seq").alias("last"))
        last = last.withColumn("bucket", self._bucket()).persist()
        try:
            touched = [r["bucket"] for r in last.select("bucket").distinct().collect()]  # BUCKETS at most
            if not touched:
                return
            kept = self.read().withColumn("bucket", self._bucket()).where(F.col("bucket").isin(touched)).join(last, "id", "left_anti")
            put = last.where("last.doc is not null").select("last.doc.*", "bucket")
            rows = kept.unionByName(put).withColumn("batch", F.lit(batch).cast("bigint"))
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(f"{self.path}/data")
            done = self.spark.createDataFrame([(b, batch) for b in touched], "bucket int, batch bigint")
            done.coalesce(1).write.mode("overwrite").json(f"{self.path}/log/at={batch}")
        finally:
            last.unpersist()

    def follow(self, changes: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Apply a stream of changes, batch by batch."""
        return changes.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
