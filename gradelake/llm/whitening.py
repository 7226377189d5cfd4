"""Whitening of embeddings: centred exactly, rotated to the principal components, scaled to unit variance.

Entries become integers (``floor(scale * c) + shift``), so sums, and with them the centre, are exact.  Spark's
``RowMatrix`` over the centred rows gives their Gramian; divided by the number of rows it is the covariance.  Its
eigenvectors are found on the driver, which holds one matrix of the dimension and no rows, and go to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructType

from gradelake.llm.common import as_row, stored

#: An entry ``c`` becomes ``floor(SCALE * c) + SHIFT``.
SCALE, SHIFT = 64, 1_000_000
#: Components that are returned at most.
COMPONENTS = 32


@dataclass(frozen=True)
class Fit:
    """Number and sums of the rows, and the components by falling eigenvalue: one column each."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float


def usable(vector: str) -> Column:
    """Whether a vector has entries, and all of them are finite numbers."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & ~bad


def integers(vectors: DataFrame, column: str, scale: int, shift: int) -> DataFrame:
    """``row, x``: usable rows of the most common length (the longer one of a tie), with integer entries."""
    rows = vectors.select(as_row(vectors.drop(column)), F.col(column).cast("array<double>").alias("c")).where(usable("c"))
    x = F.transform("c", lambda c: F.floor(c * scale) + shift)
    rows = stored(rows.select("row", x.alias("x")), "integer-vectors")
    sizes = rows.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    return rows.where(F.size("x") == (sizes["size"] if sizes else 0))


def centred(rows: DataFrame, n: int, sums: np.ndarray) -> DataFrame:
    """One vector column: ``(n * x - sum) / n``, an exact integer until the division."""
    total = F.lit(sums.tolist()).cast("array<bigint>")
    centre = F.zip_with("x", total, lambda x, s: (x * n - s).cast("double") / n)
    return MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(centre).alias("v")), "v")


def fit(rows: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """The components of ``x``; None without rows.

    A component whose eigenvalue is nought but for rounding has no direction and no variance to scale: it is left out.
    The sign of each is such that its largest entry (the first one of a tie) is positive.
    """
    each = rows.select(F.posexplode("x").alias("pos", "x")).groupBy("pos").agg(F.sum("x").alias("sum"), F.count("*").alias("n"))
    found = each.orderBy("pos").collect()  # one row per dimension
    if not found:
        return None
    n, sums = found[0]["n"], np.array([r["sum"] for r in found], np.int64)
    gram = RowMatrix(centred(rows, n, sums)).computeGramianMatrix().toArray()
    covariance = (gram + gram.T) / (2 * n)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    trace = float(np.trace(covariance))
    wanted = np.flatnonzero(values > trace * len(values) * np.finfo(float).eps)[:components]
    vectors = vectors[:, wanted]
    largest = np.abs(vectors).argmax(0)
    vectors = vectors * np.sign(vectors[largest, np.arange(len(wanted))])
    return Fit(n, sums, np.ascontiguousarray(vectors), values[wanted], trace)


def _project(fit: Fit, x: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Exact deviations ``n * x - sums`` of some rows, and the rows whitened."""
    apart = np.stack(x.to_numpy()).astype(np.int64) * fit.n - fit.sums
    return apart, (apart / fit.n) @ fit.vectors / np.sqrt(fit.values)


def _squares(apart: np.ndarray) -> np.ndarray:
    """The sum of squares of each row; an error if a 64-bit integer can't hold one."""
    if (apart.astype(float) ** 2).sum(1).max(initial=0) >= 2**63:
        raise OverflowError("a deviation is beyond 64 bits: there are too many rows, or entries too large")
    return (apart * apart).sum(1)


def identity_error(rows: DataFrame, fit: Fit) -> float:
    """The largest entry of the whitened rows' covariance minus the identity, measured on all rows: each task returns its sums."""
    shared = rows.sparkSession.sparkContext.broadcast(fit)
    k = len(fit.values)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gram = np.zeros((k + 1, k))
        for batch in batches:
            if len(batch):
                white = _project(shared.value, batch["x"])[1]
                gram[:k] += white.T @ white
                gram[k] += white.sum(0)
        i, j = np.indices(gram.shape)
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "value": gram.ravel()})

    out = np.zeros((k + 1, k))
    for r in rows.select("x").mapInPandas(sums, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect():
        out[r["i"], r["j"]] = r["value"]
    mean = out[k] / fit.n
    return float(np.abs(out[:k] / fit.n - np.outer(mean, mean) - np.eye(k)).max(initial=0))


def whiten(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """``row, n, deviation, whitened, explained, identity_error`` for every usable row.

    ``row`` has the other columns of the row as a struct, whatever they are called.  ``n`` is the number of usable rows,
    ``deviation`` the exact squared distance to the centre times ``n`` squared (an error where 64 bits can't hold
    it), ``whitened`` and ``explained`` have one entry per component, and ``identity_error`` is how far the
    covariance of all whitened rows is from the identity.

    Rows without a vector go, and those with an empty one or with a null or non-finite entry.  Vectors of another
    length than the most common one go too (of a tie the longer length stays).  Repeated rows each count.
    Directions without variance are no components, so equal rows, or a single one, have empty arrays.  An empty
    table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = integers(vectors, column, scale, shift)
    found = fit(rows, components)
    schema = StructType().add("deviation", LongType()).add("whitened", ArrayType(DoubleType()))
    if found is None:
        return rows.selectExpr("row", "0L as n", "0L as deviation", "cast(array() as array<double>) as whitened", "cast(array() as array<double>) as explained", "0d as identity_error")
    shared = spark.sparkContext.broadcast(found)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                apart, white = _project(shared.value, batch["x"])
                yield pd.DataFrame({"row": batch["row"], "deviation": _squares(apart), "whitened": list(white)})

    out = rows.mapInPandas(project, StructType([rows.schema["row"], *schema.fields]))
    explained = F.lit((found.values / found.trace).tolist()).cast("array<double>")
    return out.select("row", F.lit(found.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(identity_error(rows, found)).alias("identity_error"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per usable vector and component."""
    out = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    long = out.select("row.vec_id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("pos", "whitened"))
    return long.select("vec_id", (F.col("pos") + 1).alias("component"), "n", "deviation", "whitened", F.get("explained", F.col("pos")).alias("explained"), "identity_error")
