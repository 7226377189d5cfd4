"""Scan documents: batches that are replayed or fail, and JSON that is none."""

import pytest
from pyspark.sql import functions as F

from gradelake.sources.documents import DocumentTable, parsed, written

DOC = "struct<id:string,created_at:timestamp,name:string,overall:double,confidence:double,favorite:boolean,front:struct<score:double,issues:array<string>>,back:struct<score:double,issues:array<string>>>"


def changes(spark, rows):
    """``(seq, id, overall)``; an overall of None deletes."""
    df = spark.createDataFrame(rows, "seq bigint, id string, overall double")
    doc = F.from_json(F.to_json(F.struct("id", "overall", F.lit("n").alias("name"), F.expr("timestamp_seconds(seq)").alias("created_at"), F.struct(F.array(F.lit("a")).alias("issues")).alias("front"))), DOC)
    return df.select("seq", "id", F.when(F.col("overall").isNotNull(), doc).alias("doc"))


def state(table):
    return sorted((r.id, r.overall) for r in table.read().collect())


def test_batches(spark, tmp_path):
    table = DocumentTable(spark, str(tmp_path / "t"), buckets=4)
    assert state(table) == [] and table.index().collect() == []
    table.apply(changes(spark, [(1, "a", 1.0), (2, "b", 2.0), (3, "a", 3.0), (4, "c", 4.0)]), 0)
    assert state(table) == [("a", 3.0), ("b", 2.0), ("c", 4.0)]
    second = changes(spark, [(5, "b", None), (6, "d", 6.0), (7, "c", 7.0), (8, "zz", None)])
    table.apply(second, 1)
    assert state(table) == [("a", 3.0), ("c", 7.0), ("d", 6.0)]
    for batch, again in ((1, second), (0, changes(spark, [(9, "a", 9.0)]))):
        table.apply(again, batch)  # replayed
    assert state(table) == [("a", 3.0), ("c", 7.0), ("d", 6.0)]
    assert [r.id for r in table.index().collect()] == ["c", "d", "a"]
    assert table.get(["c", "x"]).first().front.issues == ["a"]
    table.apply(changes(spark, [(10, "a", None), (11, "c", None), (12, "d", None)]), 2)
    assert state(table) == []
    table.apply(changes(spark, []), 3)
    with pytest.raises(Exception, match="no id"):
        table.apply(changes(spark, [(13, None, 1.0)]), 4)


def test_a_failed_batch_is_not_seen(spark, tmp_path):
    """Files without a log entry, as a lost writer leaves them, are not read, and the batch can be run again."""
    table = DocumentTable(spark, str(tmp_path / "t"), buckets=2)
    table.apply(changes(spark, [(1, "a", 1.0), (2, "b", 2.0)]), 0)
    half = table.read().withColumn("overall", F.lit(99.0)).withColumn("bucket", table._bucket()).withColumn("batch", F.lit(1).cast("bigint"))
    half.write.mode("append").partitionBy("bucket", "batch").parquet(str(tmp_path / "t/data"))
    assert state(table) == [("a", 1.0), ("b", 2.0)]
    table.apply(changes(spark, [(3, "a", 5.0)]), 1)
    assert state(table) == [("a", 5.0), ("b", 2.0)]


def test_stream(spark, tmp_path):
    source, table = tmp_path / "in", DocumentTable(spark, str(tmp_path / "t"))
    for n, rows in enumerate(([(1, "a", 1.0), (2, "b", 2.0)], [(3, "a", None), (4, "c", 4.0)])):
        changes(spark, rows).coalesce(1).write.mode("append").parquet(str(source))
        table.follow(spark.readStream.schema(f"seq bigint, id string, doc {DOC}").parquet(str(source)), str(tmp_path / "state")).awaitTermination()
        assert n or state(table) == [("a", 1.0), ("b", 2.0)]
    assert state(table) == [("b", 2.0), ("c", 4.0)]


def test_json(spark):
    lines = ['{"id":"a","overall":9.5,"front":{"score":1.0,"issues":["x"]},"more":1}', None, "", "{", '{"overall":1}', '{"id":"b","overall":"high"}', '{"id":"c"}']
    good, bad = parsed(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert sorted((r.id, r.overall) for r in good.collect()) == [("a", 9.5), ("c", None)]
    reasons = sorted(r.reason for r in bad.collect())
    assert len(reasons) == 5 and reasons.count("no id") == 1 and reasons.count("empty") >= 1
    again, none = parsed(written(good))
    assert sorted(map(str, again.collect())) == sorted(map(str, good.collect())) and none.isEmpty()
