"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The score is ``w0 + sum(w[i] x[i]) + sum over pairs of <v[i], v[j]> x[i] x[j]``, the pairs by the identity
``sum over pairs = (|sum(v[i] x[i])|**2 - sum(|v[i] x[i]|**2)) / 2``, so it takes time linear in the words of a text.
It is fitted on a bounded sample of labelled rows and applied to all rows in one map.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake.llm.common import release

#: Labelled rows to fit on, about: those with the least hashes of their id.
SAMPLE = 6_000
BUCKETS = 1 << 16
RANK = 8
EPOCHS = 8
RATE = 0.1
BATCH = 128
DECAY = 1e-5
#: Score from which a text is predicted to be good.
CUT = 0.3
_REMEMBERED = 300_000

STATISTICS = ("words", "chars", "word length", "upper", "digits", "signs", "words ending in a sign", "words without letters", "distinct words", "words like the last", "most frequent word", "lines", "repeated lines", "line length", "other scripts", "metadata chars", "metadata missing")
_FLAGS = {"Lu": 1, "Lt": 1, "Nd": 2, "Nl": 2, "No": 2, "Zs": 4}


def _flag(code: int) -> int:
    """1 upper case, 2 number, 4 blank, 8 sign, 0 other letter."""
    kind = unicodedata.category(chr(code))
    return _FLAGS.get(kind, 4 if code in (9, 10, 13) else 0 if kind[0] in "LM" else 8)


_CLASS = np.array([_flag(c) for c in range(0x3000)], np.uint8)


@dataclass
class Model:
    bias: float
    #: One weight and ``RANK`` factors per bucket, then per statistic.
    weights: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray


class _Bucket(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > _REMEMBERED:
            self.clear()
        self[word] = found = zlib.crc32(word.lower().encode()) % BUCKETS
        return found


def statistics(text: str, words: list[str], counts: Counter, n_chars: int | None) -> list[float]:
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kinds = np.bincount(_CLASS[codes[codes < len(_CLASS)]], minlength=9)
    n, m = max(1, len(text)), max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    signs = sum(c for w, c in counts.items() if not w[-1].isalnum())
    bare = sum(c for w, c in counts.items() if not (w[0].isalpha() or w[-1].isalpha() or any(map(str.isalpha, w))))
    return [np.log1p(len(words)), np.log1p(len(text)), sum(len(w) * c for w, c in counts.items()) / m, kinds[1] / n, kinds[2] / n, kinds[8] / n, signs / m, bare / m, len(counts) / m, sum(map(eq, words, words[1:])) / m, max(counts.values(), default=0) / m, np.log1p(len(lines)), 1 - len(set(lines)) / max(1, len(lines)), np.log1p(len(text) / max(1, len(lines))), (len(codes) - kinds.sum()) / n, np.log1p(max(0, n_chars or 0)), float(n_chars is None)]


def features(text: str | None, n_chars: int | None, bucket: _Bucket) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Buckets and values of the words (of length one together), and the statistics.  Null counts as empty."""
    text = text or ""
    words = text.split()
    counts = Counter(words)
    at = np.fromiter(map(bucket.__getitem__, counts), np.int64, len(counts))
    values = np.sqrt(np.fromiter(counts.values(), np.float32, len(counts)))
    if len(values):
        values /= np.linalg.norm(values)
    return at, values, statistics(text, words, counts, n_chars)


def raw_score(at: np.ndarray, values: np.ndarray, stats: np.ndarray, model: Model) -> float:
    """Before the logistic function."""
    dense = (np.asarray(stats) - model.mean) / model.scale
    dense = np.clip(dense, -3, 3).astype(np.float32) * 0.3
    x = np.concatenate([values, dense])
    own = np.concatenate([at, np.arange(BUCKETS, BUCKETS + len(dense))])
    vx = model.factors[own] * x[:, None]
    total = vx.sum(0)
    return float(model.bias + model.weights[own] @ x + 0.5 * (total @ total - (vx * vx).sum()))


def fit(rows: list[tuple[np.ndarray, np.ndarray, list[float], int]], epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Logistic loss, adaptive steps.  Without rows the model is neutral; with labels of one kind it follows them."""
    size = BUCKETS + len(STATISTICS)
    rng = np.random.default_rng(seed)
    factors = rng.normal(0, 0.02, (size, RANK)).astype(np.float32)
    weights = np.zeros(size, np.float32)
    if not rows:
        return Model(0.0, weights, factors * 0, np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)))
    stats = np.array([r[2] for r in rows])
    mean, scale = stats.mean(0), stats.std(0) + 1e-6
    dense = np.clip((stats - mean) / scale, -3, 3).astype(np.float32) * 0.3
    labels = np.array([r[3] for r in rows], np.float32)
    share = np.clip(labels.mean(), 0.01, 0.99)
    bias, bias_sum = float(np.log(share / (1 - share))), 1.0
    weight_sum, factor_sum = np.full(size, 1.0, np.float32), np.full((size, RANK), 1.0, np.float32)
    tail = np.arange(BUCKETS, size)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for start in range(0, len(rows), BATCH):
            batch = order[start : start + BATCH]
            at = [np.concatenate([rows[i][0], tail]) for i in batch]
            x = np.concatenate([np.concatenate([rows[i][1], dense[i]]) for i in batch])
            row = np.repeat(np.arange(len(batch)), [len(a) for a in at])
            used, place = np.unique(np.concatenate(at), return_inverse=True)
            v, w = factors[used], weights[used]
            vx = v[place] * x[:, None]
            sums = np.stack([np.bincount(row, vx[:, f], len(batch)) for f in range(RANK)], 1)
            pairs = 0.5 * ((sums**2).sum(1) - np.bincount(row, (vx * vx).sum(1), len(batch)))
            out = bias + np.bincount(row, w[place] * x, len(batch)) + pairs
            slope = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - labels[batch]) / len(batch) * 16
            gx = slope[row] * x
            gw = np.bincount(place, gx, len(used)) + DECAY * w
            inner = gx[:, None] * (sums[row] - vx)
            gv = np.stack([np.bincount(place, inner[:, f], len(used)) for f in range(RANK)], 1) + DECAY * v
            weight_sum[used] += gw**2
            factor_sum[used] += gv**2
            weights[used] -= RATE * gw / np.sqrt(weight_sum[used])
            factors[used] -= RATE * gv / np.sqrt(factor_sum[used])
            g = float(slope.sum())
            bias_sum += g * g
            bias -= RATE * g / bias_sum**0.5
    return Model(bias, weights, factors, mean, scale)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bucket = _Bucket()
    for batch in batches:
        ids, texts, n_chars, labels = (c.to_pylist() for c in batch.columns)
        rows = [features(t, n, bucket) for t, n in zip(texts, n_chars, strict=True)]
        at, values, stats = ([r[i] for r in rows] for i in range(3))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(at, pa.list_(pa.int64())), pa.array(values, pa.list_(pa.float32())), pa.array(stats, pa.list_(pa.float64())), pa.array(labels, pa.int32())], names=["doc_id", "at", "x", "stats", "label"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on about ``sample`` of the labelled documents.  Null labels are left out; of several labels of one id the least counts."""
    labels = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    n = max(1, labels.count())
    share = min(1.0, sample / n)
    chosen = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    # About ``sample`` ids, so they are broadcast.
    rows = docs.select("doc_id", "text", _n_chars(docs)).join(F.broadcast(chosen), "doc_id").mapInArrow(_extract, "doc_id bigint, at array<bigint>, x array<float>, stats array<double>, label int")
    found = sorted(((r.doc_id, r.at, r.x, r.stats, r.label) for r in rows.toLocalIterator()), key=lambda r: r[0])
    return fit([(np.array(at, np.int64), np.array(x, np.float32), stats, label) for _, at, x, stats, label in found])


def _n_chars(docs: DataFrame) -> Column:
    return (F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)).cast("long").alias("n_chars")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` from 0 to 1 and ``predicted``, 1 from ``CUT`` on.

    Null and empty texts are scored by their statistics like any other.  All columns of ``docs`` are kept;
    columns of the two names are replaced; a missing or null ``n_chars`` is a statistic of its own.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def rate(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        model, bucket = shared.value, _Bucket()
        for texts, n_chars in batches:
            raw = [raw_score(*features(t, n, bucket), model) for t, n in zip(texts.to_pylist(), n_chars.to_pylist(), strict=True)]
            yield pa.array(1 / (1 + np.exp(-np.clip(np.array(raw), -30, 30))), pa.float64())
        release()

    kept = docs.drop("score", "predicted")
    return kept.withColumn("score", rate("text", _n_chars(docs))).withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "n_chars")
    remainder = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(remainder != 0).select("doc_id", "quality")
    return score(docs, train(docs, labels)).select("doc_id", (remainder == 0).alias("held_out"), "score", "predicted")
