"""Masks as bits: 64 pixels of an image are one word, so overlaps are counts of bits.

A mask is rows ``image, word, bits``; words without a set bit may be left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def packed(pixels: DataFrame, on: Column, width: int) -> DataFrame:
    """The mask of the pixels ``image, y, x`` for which ``on`` holds; words are built in the map tasks. Null is off."""
    at = F.col("y") * width + F.col("x")
    rows = pixels.where(on).select("image", F.floor(at / 64).alias("word"), (at % 64).cast("int").alias("_bit"))
    return rows.groupBy("image", "word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("bits"))


def overlaps(predicted: DataFrame, truth: DataFrame, images: DataFrame) -> DataFrame:
    """``image, both, n_predicted, n_truth, dice`` for every row of ``images``.

    Dice is ``(2 both + 1) / (n_predicted + n_truth + 1)``, so two empty masks agree fully and an empty one with a
    large one hardly.
    """
    met = predicted.withColumnRenamed("bits", "p").join(truth.withColumnRenamed("bits", "t"), ["image", "word"], "full")
    p, t = F.coalesce("p", F.lit(0).cast("bigint")), F.coalesce("t", F.lit(0).cast("bigint"))
    each = met.groupBy("image").agg(F.sum(F.bit_count(p.bitwiseAND(t))).alias("both"), F.sum(F.bit_count(p)).alias("n_predicted"), F.sum(F.bit_count(t)).alias("n_truth"))
    out = images.select("image").distinct().join(each, "image", "left").na.fill(0, ["both", "n_predicted", "n_truth"])
    return out.withColumn("dice", (F.col("both") * 2 + 1) / (F.col("n_predicted") + F.col("n_truth") + 1))


def soft_losses(pixels: DataFrame, logit: Column, target: Column) -> DataFrame:
    """``image, loss``: one less the dice of probabilities with a target of 0 or 1."""
    probability = F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))
    sums = pixels.groupBy("image").agg(F.sum(probability * target).alias("both"), F.sum(probability).alias("p"), F.sum(target).alias("t"))
    return sums.select("image", (F.lit(1.0) - (F.col("both") * 2.0 + 1.0) / (F.col("p") + F.col("t") + 1.0)).alias("loss"))
