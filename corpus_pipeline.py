"""The corpus pipeline: five stages, each works on all rows its predecessor kept.

Language ID drops documents without any letters and labels the others; line dedup removes lines that repeat
earlier ones; the n-gram join keeps one document of each near-duplicate class; decontamination drops documents
that hold a benchmark item; BPE encodes what is left.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake.llm.bpe import digests
from gradelake.llm.common import removed, scratch, shared_dir
from gradelake.llm.decontaminate import drop_leaks
from gradelake.llm.language import labelled, remainder, train
from gradelake.llm.line_dedup import dedup_lines
from gradelake.llm.ngram_join import drop_near_duplicates

#: Blocks of the last stage are half as large as when it runs alone, since workers of earlier stages are still there.
BLOCK_CHARS = 4_000_000
#: Bytes of texts that go to a Python worker at once.  Without a bound it is the texts of 10,000 rows, of any length, once
#: in the executor and once in each worker, and neither gives all of that back to the system.
BATCH_BYTES = 4 << 20
TOKENIZER = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def in_small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, with ``BATCH_BYTES`` in the session's settings, where it stays since results are lazy; a smaller bound stays as it is."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        name = "spark.sql.execution.arrow.maxBytesPerBatch"
        # The setting can be written with a unit; then, as where it is missing, it is replaced unless it is a smaller number.
        now = spark.conf.get(name, None) or ""
        if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
            spark.conf.set(name, str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return run


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language, whose ``lang`` is the one predicted; those whose text is null or has no letters go."""
    model = train(docs.where(remainder(4) != 2))
    said = labelled(docs, model).where("said.lang_pred <> 'und'")
    return said.select(F.col("row").withField("lang", F.col("said.lang_pred")).alias("row")).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; ``n_chars`` follows the text.  All stay, also those that lose all lines."""
    return dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class; those without words are classes of their own."""
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, the token ids, and digests of the ids and of the decoded bytes; a null text has no ids."""
    return digests(docs, TOKENIZER, public_tokenizers.PATTERN, with_ids=True, block_chars=BLOCK_CHARS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", in_small_batches(language_id)),
    ("line_dedup", in_small_batches(line_dedup)),
    ("near_duplicates", in_small_batches(near_duplicates)),
    ("decontaminate", in_small_batches(decontaminate)),
    ("byte_bpe", in_small_batches(tokens)),
]

#: Language ID and the n-gram join are beyond SQL; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written and read again as the next one's input.

    What a stage stored for itself is deleted once its result is written.  Columns that a stage does not name
    are passed on as they are, whatever they are called.  Null, empty, very long and repeated texts are handled as the stages say; an empty
    table gives an empty result.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for n, (name, stage) in enumerate(STAGES):
        if n + 1 == len(STAGES):
            return stage(spark, docs, sf_dir)
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            removed(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
