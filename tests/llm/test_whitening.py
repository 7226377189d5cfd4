"""Whitening against numpy on whole matrices and exact integers."""

import datetime
import math
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gradelake.llm.whitening import _squares, op12_whitening, whiten


def brute(rows, scale=64, shift=1_000_000):
    """``n``, the deviation of each row, the covariance and its eigenvalues by falling size."""
    x = [[math.floor(scale * c) + shift for c in v] for _, v in rows]
    n, dims = len(x), len(x[0])
    sums = [sum(v[d] for v in x) for d in range(dims)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for v in x]
    centre = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(v, sums, strict=True)] for v in x])
    covariance = centre.T @ centre / n
    return n, deviation, centre, covariance


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query(spark, size):
    folder = f"/root/testdata/{size}"
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{folder}/embeddings.parquet' ORDER BY vec_id").fetchall()
    n, deviation, centre, covariance = brute(rows)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    got = op12_whitening(spark, folder).toPandas().sort_values(["vec_id", "component"])
    assert list(got.columns) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert len(got) == 32 * n and set(got["n"]) == {n}
    assert got["vec_id"].tolist() == [i for i, _ in rows for _ in range(32)] and got["component"].tolist() == list(range(1, 33)) * n
    assert got["deviation"].tolist() == [d for d in deviation for _ in range(32)]
    assert np.allclose(got["explained"].to_numpy().reshape(n, 32), values[:32] / covariance.trace(), rtol=1e-9)
    white = got["whitened"].to_numpy().reshape(n, 32)
    want = centre @ vectors[:, :32] / np.sqrt(values[:32])
    sign = np.sign((white * want).sum(0))
    assert np.allclose(white, want * sign, rtol=1e-6, atol=1e-7)
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9
    assert np.abs(white.T @ white / n - np.eye(32)).max() < 1e-9


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.5, 1.0, -2.0]), (2, [0.25, -1.0, 3.0]), (3, [1.5, 0.0, 0.0]), (3, [1.5, 0.0, 0.0]), (None, [-4.0, 2.0, 0.125])]
    bad = [(5, None), (6, []), (7, [1.0, None, 2.0]), (8, [nan, 1.0, 1.0]), (9, [inf, 1.0, 1.0]), (10, [-inf, 1.0, 1.0]), (11, [1.0, 2.0])]
    df = spark.createDataFrame([*good, *bad], "vec_id bigint, embedding array<float>")
    df = df.withColumns({"row": F.lit("x"), "x": F.lit(2**60 + 1), "n": F.lit(None).cast("long"), "whitened": F.array(F.lit(1)), "c": F.lit(datetime.date(2020, 1, 2)), "deviation": F.struct(F.lit("y").alias("v"))})
    out = whiten(df).collect()
    n, deviation, centre, covariance = brute(good)
    assert sorted((str(r.row.vec_id), r.deviation) for r in out) == sorted((str(i), d) for (i, _), d in zip(good, deviation, strict=True))
    assert all((r.row.row, r.row.x, r.row.n, r.row.whitened, r.row.c, r.row.deviation.v) == ("x", 2**60 + 1, None, [1], datetime.date(2020, 1, 2), "y") for r in out)
    white = np.array([r.whitened for r in out])
    assert white.shape == (5, 3) and np.allclose(white.T @ white / n, np.eye(3), atol=1e-9) and all(r.identity_error < 1e-9 and r.n == n for r in out)
    assert np.allclose(sum(out[0].explained), 1)
    assert whiten(df, components=2).first().whitened.__len__() == 2
    # Without variance there is nothing to scale.
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id bigint, embedding array<double>")
    assert [(r.deviation, r.whitened, r.explained, r.identity_error) for r in whiten(same).collect()] == [(0, [], [], 0.0)] * 2
    flat = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(9)], "vec_id bigint, embedding array<double>")
    assert {len(r.whitened) for r in whiten(flat).collect()} == {1}
    for rows in (df.limit(0), df.where("vec_id between 5 and 10")):
        assert whiten(rows).collect() == []
        assert whiten(rows).columns == whiten(df).columns


def test_squares_are_exact():
    big = np.array([[2**31, 2**30 + 1]])
    assert _squares(big)[0] == 2**62 + (2**30 + 1) ** 2
    with pytest.raises(OverflowError):
        _squares(np.array([[2**32, 0]]))
