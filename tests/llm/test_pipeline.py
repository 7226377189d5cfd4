"""The pipeline's stages on the smallest table."""

import duckdb
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from gradelake.llm.bpe import load_ranks
from gradelake.llm.common import stored
from gradelake.llm.decontaminate import budget, masks, nearest
from tests.llm.test_decontaminate import plain
from tests.llm.test_line_dedup import brute as lost_lines
from tests.llm.test_ngram_join import brute as classes


def test_stages(spark, sf):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    items = duckdb.sql(f"SELECT item_id, text FROM '{sf}/benchmark.parquet'").fetchall()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "decontaminate", "byte_bpe"]

    # Every text here has letters, so all stay; then each stage as brute force has it.
    gone = lost_lines(rows)
    rows = [(i, "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone.get(i, {}))) for i, t in rows]
    group = classes(rows)
    rows = [(i, t) for i, t in rows if group[i][0] == i]
    items = [plain(t) for _, t in items]
    bits = [(masks(x), len(x), budget(len(x))) for x in items]
    hits = {i for i, t in rows if len(t) < 4000 and any(nearest(m, n, plain(t))[0] <= k for m, n, k in bits)}
    expected = {i: t for i, t in rows if i not in hits}
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        docs = stage(spark, docs, sf)
        assert docs.columns == names, n
        docs = stored(docs, "test-stage")
    got = {r.doc_id: r.text for r in docs.collect()}
    assert {i: t for i, t in got.items() if len(t) < 4000} == {i: t for i, t in expected.items() if len(t) < 4000}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(corpus_pipeline.TOKENIZER), special_tokens={})
    counts = {r.doc_id: r.n_tokens for r in corpus_pipeline.STAGES[4][1](spark, docs, sf).collect()}
    assert counts == {i: len(library.encode_ordinary(t)) for i, t in got.items()}


def test_run_on_odd_rows(spark, tmp_path, sf):
    """Null, empty, very long, repeated and clashing values through ``run`` and every stage."""
    import shutil

    words = [f"word{i}" for i in range(400)]
    long = " ".join(words[i % 397] for i in range(20_000))
    item = duckdb.sql(f"SELECT text FROM '{sf}/benchmark.parquet' ORDER BY item_id LIMIT 1").fetchall()[0][0]
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 !?", "en"), (4, long, "en"), (5, long + " end", "de"), (6, "a text of its own that nothing else is like at all", None), (6, "a text of its own that nothing else is like at all", None), (None, "another text which has no id but many good words in it", "en"), (9, f"before it {item} and after", "en")]
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name in ("removed", "leaks", "said", "row", "version", "score", "n_spans", "lang_pred", "rep", "keep", "_id", "_version"):
        df = df.withColumn(name, F.lit("x"))
    df.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    shutil.copy(f"{sf}/benchmark.parquet", tmp_path / "benchmark.parquet")
    docs = df
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == df.columns, name
    left = docs.collect()
    assert all(r.removed == r.leaks == r.said == r.row == r.version == r.score == r.rep == r.keep == r._id == r._version == r.n_spans == r.lang_pred == "x" for r in left)
    assert sorted(str(r.doc_id) for r in left) == ["4", "6", "None"]
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(corpus_pipeline.TOKENIZER), special_tokens={})
    out = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert out == {r.doc_id: library.encode_ordinary(r.text) for r in left}


def test_run_on_an_empty_table(spark, tmp_path, sf):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
