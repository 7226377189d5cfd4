"""Language identification: script ranges narrow the candidates, then Viterbi labels spans word by word.

*Model.*  Words of a bounded sample of labelled texts give log-probabilities of their letter n-grams per
language (hashed to a fixed table), and the scripts each language is written in.

*Scoring.*  Each distinct word of a task is scored once; languages that are not written in the word's script
are no candidates.  Viterbi with a switching penalty then labels the words of each document, so a short foreign
word does not change the label but a passage does.  A document gets the language with the most letters.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake.llm.common import as_row, release

#: Training rows per language, about: those with the least hashes of id and text; a language with fewer rows keeps all.
SAMPLE_PER_LANGUAGE = 1_500
BUCKETS = 1 << 16
ORDERS = (1, 2, 3, 4)
#: Log-probability that a change of language costs.
SWITCH = 12.0
#: Additive smoothing of n-gram counts.
SMOOTH = 0.5
#: Languages a model may have; the table is broadcast, so its size is bounded by BUCKETS times this.
MAX_LANGUAGES = 200
#: Distinct words a task remembers.
REMEMBERED = 200_000
#: Characters whose words are labelled at once, or one text.
CHUNK_CHARS = 4_000_000
#: Words that are scored at once.
SCORED_WORDS = 16_384

#: First code points of runs of one script (Unicode blocks), in order; 0 is any other sign.
SCRIPTS = [(0x41, 1), (0x250, 1), (0x370, 2), (0x400, 3), (0x530, 4), (0x590, 5), (0x600, 6), (0x700, 0), (0x900, 7), (0x980, 8), (0xE00, 9), (0xE80, 0), (0x10A0, 10), (0x1100, 11), (0x1200, 0), (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x3040, 12), (0x30A0, 13), (0x3100, 0), (0x3400, 14), (0xA000, 0), (0xAC00, 11), (0xD7B0, 0), (0xF900, 14), (0xFB00, 0), (0x20000, 14), (0x30000, 0)]
_FIRST = np.array([a for a, _ in SCRIPTS])
_SCRIPT = np.array([0] + [b for _, b in SCRIPTS])

WORD = r"\p{L}[\p{L}\p{M}]*"


@dataclass
class Model:
    languages: list[str]
    #: ``BUCKETS`` by languages.
    weights: np.ndarray
    #: Scripts (as bits) each language is written in.
    scripts: np.ndarray


def word_scripts(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The script of each word's first letter."""
    return _SCRIPT[np.searchsorted(_FIRST, codes[starts], "right")]


def ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of all words, the word each belongs to, and each word's script.

    Words are set between blanks, which can begin or end an n-gram, not both.
    """
    text = " " + " ".join(words) + " "
    # U+0130 is the only letter that grows in lower case; blanks part the words, so each is lowered by itself.
    codes = np.frombuffer(text.replace("\u0130", "i").lower().encode("utf-32-le"), np.uint32)
    blank = codes == 32
    word = np.cumsum(blank) - 1
    all_grams, owners = [], []
    with np.errstate(over="ignore"):
        mixed = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        rolled = np.zeros(len(codes), np.uint64)
        inside = np.ones(len(codes), bool)
        for n in range(1, max(ORDERS) + 1):
            # rolled[i] is the gram of n signs from i on; blanks stand only at its ends
            m = len(codes) - n + 1
            if m <= 0:
                break
            rolled = (rolled[:m] * np.uint64(0x100000001B3)) ^ (mixed[n - 1 :] >> np.uint64(17))
            inner = inside[:m] if n <= 2 else inside[:m] & ~blank[n - 2 : n - 2 + m]
            inside = inner
            keep = inner & ~(blank[:m] & blank[n - 1 :]) if n > 1 else ~blank
            if n in ORDERS:
                hashed = (rolled[keep] * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(48)
                all_grams.append(hashed.astype(np.int64) % BUCKETS)
                at = np.flatnonzero(keep)
                owners.append(word[at])
    starts = np.flatnonzero(blank)[: len(words)] + 1
    return np.concatenate(all_grams), np.concatenate(owners), word_scripts(codes, starts)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and language: n-gram counts and script counts, at most ``BUCKETS`` rows each."""
    find = regex.compile(WORD)
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = find.findall(text)
            if not words:
                continue
            own = sums.setdefault(lang, np.zeros(BUCKETS + 32, np.int64))
            grams, _, scripts = ngrams(words)
            own[:BUCKETS] += np.bincount(grams, minlength=BUCKETS)
            own[BUCKETS:] += np.bincount(scripts, minlength=32)
    for lang, own in sums.items():
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(own[at])], names=["lang", "bucket", "n"])
    release()


def train(docs: DataFrame, sample_per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Fit on ``text, lang`` of the given rows.

    Rows with a null text or lang are left out; no rows give a model without languages; repeated rows count each
    time.  More than ``MAX_LANGUAGES`` languages are a ``ValueError``, since the model is broadcast.
    """
    rows = docs.where("text is not null and lang is not null").select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    totals = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).toLocalIterator()}
    if len(totals) > MAX_LANGUAGES:
        raise ValueError("more languages than a model holds")
    # Hashes are spread evenly, so a share of their range is that share of the rows.
    share = F.lit(1.0)
    for lang, n in totals.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, sample_per_language / n))).otherwise(share)
    sample = rows.where(F.pmod("h", F.lit(1 << 20)) < share * (1 << 20)).select("lang", "text")
    table = sample.mapInArrow(_counts, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    languages = sorted(totals)
    place = {lang: i for i, lang in enumerate(languages)}
    sums = np.zeros((BUCKETS + 32, len(languages)))
    for r in table.toLocalIterator():  # languages times BUCKETS rows at most
        sums[r.bucket, place[r.lang]] = r.n
    grams, scripts = sums[:BUCKETS], sums[BUCKETS:]
    weights = np.log((grams + SMOOTH) / (grams.sum(0) + SMOOTH * BUCKETS)) if languages else grams
    common = scripts >= 0.001 * scripts.sum(0)
    bits = (common * (1 << np.arange(32))[:, None]).sum(0).astype(np.int64)
    return Model(languages, weights.astype(np.float32), bits)


def score_words(words: list[str], model: Model) -> np.ndarray:
    """Log-probabilities of each word per language, as differences from the best; other scripts' languages are far off."""
    grams, owner, scripts = ngrams(words)
    out = np.zeros((len(words), len(model.languages)), np.float32)
    for lang in range(out.shape[1]):
        out[:, lang] = np.bincount(owner, weights=model.weights[grams, lang], minlength=len(words))
    out /= len(ORDERS)
    candidate = (model.scripts[None, :] >> scripts[:, None]) & 1 == 1
    candidate |= ~candidate.any(1, keepdims=True)
    out = np.where(candidate, out, -np.inf)
    out -= out.max(1, keepdims=True)
    return np.maximum(out, -50.0).astype(np.float32)


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """The best label of every word.  ``scores`` holds the words of all documents in a row; documents move in step, longest first."""
    labels = np.zeros(len(scores), np.int8 if scores.shape[1] < 128 else np.int16)
    order = np.argsort(-lengths, kind="stable")
    begins = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    active = np.searchsorted(-sizes, -np.arange(1, (sizes[0] if len(sizes) else 0) + 1), "right")  # documents with a word t
    back = np.zeros(scores.shape, labels.dtype)
    best = np.zeros((len(sizes), scores.shape[1]), np.float32)
    stay = np.arange(scores.shape[1], dtype=labels.dtype)
    for t, n in enumerate(active):
        at = begins[:n] + t
        now = best[:n]
        top = now.argmax(1)
        leave = now[np.arange(n), top] - penalty
        switch = leave[:, None] > now
        back[at] = np.where(switch, top[:, None], stay)
        best[:n] = np.maximum(now, leave[:, None]) + scores[at]
        best[:n] -= best[:n].max(1, keepdims=True)
    last = best.argmax(1)
    state = last.astype(labels.dtype)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        at = begins[:n] + t
        labels[at] = state[:n]
        state[:n] = back[at, state[:n]]
    return labels


def _predict(texts: list[str | None], model: Model, find: regex.Pattern, number: dict[str, int], known: list[np.ndarray]) -> list[dict]:
    seen = sum(map(len, known))
    own: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    for text in texts:
        words = find.findall(text) if text else []
        own.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
        sizes.append(np.fromiter(map(len, words), np.int32, len(words)))
    lengths = np.fromiter(map(len, own), np.int64, len(own))
    none = np.zeros(0, np.int32)
    ids, letters = np.concatenate([none, *own]), np.concatenate([none, *sizes])
    fresh = list(number)[seen:]
    known += [score_words(fresh[i : i + SCORED_WORDS], model) for i in range(0, len(fresh), SCORED_WORDS)]
    table = np.concatenate(known) if known else np.zeros((0, len(model.languages)), np.float32)
    known[:] = [table]
    scores = table[ids]
    labels = viterbi(scores, lengths)
    doc = np.repeat(np.arange(len(texts)), lengths)
    n = len(model.languages)
    share = np.bincount(doc * n + labels, weights=letters, minlength=len(texts) * n).reshape(len(texts), n)
    total = share.sum(1)
    change = np.ones(len(ids), bool)
    change[1:] = (doc[1:] != doc[:-1]) | (labels[1:] != labels[:-1])
    spans = np.bincount(doc[change], minlength=len(texts))
    top = share.argmax(1)
    return [{"lang_pred": model.languages[k] if t else "und", "score": s / t if t else 0.0, "n_spans": int(c)} for k, s, t, c in zip(top, share.max(1), total, spans, strict=True)]


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred, score, n_spans``: the language of the most letters, its share of the letters, and the number of spans of one language.

    A null text, a text without letters, and any text for a model without languages have ``und``, 0 and no spans.
    Of languages with equally many letters the first in alphabetical order counts; between labels of equal score
    Viterbi stays, then takes the first.  Texts of any length are labelled whole, a row at a time if they are long.
    Repeated rows are each labelled, alike.  All columns of ``docs`` are kept, whatever they are called; only
    columns of the three names are replaced.  An empty table gives an empty result.
    """
    return labelled(docs, model).select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in ("lang_pred", "score", "n_spans")], "said.lang_pred", "said.score", "said.n_spans")


def labelled(docs: DataFrame, model: Model) -> DataFrame:
    """``row, said``: each row of ``docs`` as a struct, and what is said of it."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("n_spans", pa.int32())])

    @F.arrow_udf("struct<lang_pred:string,score:double,n_spans:int>")
    def label(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model, find = shared.value, regex.compile(WORD)
        number: dict[str, int] = defaultdict(count().__next__)
        known: list[np.ndarray] = []
        for texts in batches:
            rows: list[dict] = []
            part: list[str | None] = []
            chars = 0
            for i, text in enumerate(texts):
                part.append(text.as_py())
                chars += len(part[-1] or "")
                if chars < CHUNK_CHARS and i + 1 < len(texts):
                    continue
                if not model.languages:
                    rows += [{"lang_pred": "und", "score": 0.0, "n_spans": 0}] * len(part)
                else:
                    if len(number) > REMEMBERED:
                        number, known = defaultdict(count().__next__), []
                    rows += _predict(part, model, find, number, known)
                part, chars = [], 0
            yield pa.array(rows, kind)
        # What is still named here would not be handed back.
        number, known, texts, rows, part = {}, [], None, [], []
        release()

    label = label.asNondeterministic()  # else a filter on the label runs it twice
    return docs.select(as_row(docs), label("text").alias("said"))


def remainder(n: int) -> Column:
    """The crc32 of ``doc_id`` as text, modulo ``n``."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.where(remainder(4) != 2))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score", "n_spans")
