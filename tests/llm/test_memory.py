"""What a worker holds at once: batches of the pipeline's stages are bounded in bytes."""

import pytest

import corpus_pipeline

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.mark.parametrize("before, after", [(None, 4 << 20), ("65536", 65536), ("64m", 4 << 20)])
def test_batches_of_stages_are_bounded(spark, docs, before, after):
    spark.conf.unset(BATCH) if before is None else spark.conf.set(BATCH, before)
    try:
        decontaminate = dict(corpus_pipeline.STAGES)["decontaminate"]
        decontaminate(spark, docs([(1, "a b c")]), "/root/testdata/sf0.001")
        assert int(spark.conf.get(BATCH)) == after
        big = spark.range(0, 40, 1, 1).selectExpr("repeat('x', 1000000) AS text")
        sizes = [r.n for r in big.mapInArrow(lambda it: (b.select([0]).rename_columns(["n"]).from_pydict({"n": [b.nbytes]}) for b in it), "n long").collect()]
        assert len(sizes) > 5 and max(sizes) <= after + 2_000_000
    finally:
        spark.conf.unset(BATCH)
