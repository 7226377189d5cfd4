"""Faces to grades: blend, caps, confidence, range and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelake.functions.numeric import first_least, mean_or_zero, to_decimals, to_half
from gradelake.operators import scoring as S

FRONT = 0.55
#: Weights of the subgrades.
WEIGHTS = {"centering": 0.25, "corners": 0.25, "edges": 0.20, "surface": 0.30}
#: Least grade and label.
LABELS = [(10.0, "Gem Mint"), (9.5, "Gem Mint Candidate"), (9.0, "Mint"), (8.0, "Near Mint–Mint"), (7.0, "Near Mint"), (6.0, "Excellent–Mint"), (5.0, "Excellent"), (4.0, "Very Good–Excellent"), (3.0, "Very Good"), (2.0, "Good"), (0.0, "Poor")]


def region_scores(regions: DataFrame) -> DataFrame:
    """``scan_id, face, corners, edges``: means of the scores of a face's regions, 0 if it has none."""
    corner, edge = S.corner_score(F.col("corner_w")), S.edge_score(F.col("edge_w"), F.col("nicks"))
    return regions.groupBy("scan_id", "face").agg(mean_or_zero(corner).alias("corners"), mean_or_zero(edge).alias("edges"))


def paired(faces: DataFrame, columns: list[str]) -> DataFrame:
    """One row per scan that has a front and a back, by one aggregation: ``f_*`` and ``b_*``."""
    sides = [F.max(F.when(F.col("face") == side, F.col(c))).alias(f"{side[0]}_{c}") for c in columns for side in ("front", "back")]
    return faces.groupBy("scan_id").agg(F.count_if(F.col("face") == "front").alias("_f"), F.count_if(F.col("face") == "back").alias("_b"), *sides).where("_f > 0 and _b > 0").drop("_f", "_b")


def blended(name: str) -> Column:
    return to_half(F.col(f"f_{name}") * FRONT + F.col(f"b_{name}") * (1 - FRONT))


def blend(regions: DataFrame) -> DataFrame:
    """Corner and edge subgrades of every scan with both faces."""
    both = paired(region_scores(regions), ["corners", "edges"])
    return both.select("scan_id", blended("corners").alias("corners"), blended("edges").alias("edges"))


def capped(df: DataFrame) -> DataFrame:
    """Composite, caps, overall grade and limiting factor from the four subgrades and the worst damage of both faces."""
    df = df.withColumn("composite", to_half(F.col("centering") * WEIGHTS["centering"] + F.col("corners") * WEIGHTS["corners"] + F.col("edges") * WEIGHTS["edges"] + F.col("surface") * WEIGHTS["surface"]))
    damage = [(n, F.col(n)) for n in ("corners", "edges", "surface")]
    df = df.withColumn("damage_min", F.least("corners", "edges", "surface")).withColumn("centering_cap", F.when(F.col("centering") >= 8, 10.0).otherwise(F.col("centering") + 2.0))
    structural = F.when((F.col("worst_whitening") > 0.65) & (F.col("worst_sharp_loss") > 0.6), 5.0).when(F.col("worst_severity") >= 0.9, 4.0)
    factor = F.when(F.col("centering_cap") < F.least("composite", "damage_min"), "centering").when(F.col("damage_min") < F.col("composite"), first_least(*damage)).otherwise(first_least(("centering", F.col("centering")), *damage))
    df = df.withColumn("structural_cap", structural).withColumn("limiting_factor", factor)
    least = F.least("composite", "damage_min", "centering_cap", F.coalesce("structural_cap", F.lit(10.0)))
    return df.withColumn("overall", to_half(F.greatest(F.lit(1.0), least)))


def graded(regions: DataFrame, faces: DataFrame) -> DataFrame:
    """One row per scan with both faces: subgrades, caps and the overall grade.

    ``faces`` has the borders, the surface measures and the worst damage of each face.
    """
    scored = S.centering(faces).withColumn("surface", S.surface_score(F.col("density"), F.col("print_lines"), F.col("gloss"))).withColumnRenamed("centering_score", "centering")
    names = ["centering", "corners", "edges", "surface", "worst_whitening", "worst_sharp_loss", "worst_severity"]
    both = paired(scored.join(region_scores(regions), ["scan_id", "face"]), names)
    worst = [F.greatest(F.col(f"f_{n}"), F.col(f"b_{n}"), F.lit(0.0)).alias(n) for n in names[4:]]
    return capped(both.select("scan_id", *[blended(n).alias(n) for n in names[:4]], *worst))


def base_quality(side: str) -> Column:
    """What a face's photo leaves of full confidence, for the base figure."""
    flag = lambda c: F.col(f"{side}_{c}").cast("int")
    light = (F.col(f"{side}_too_dark") | F.col(f"{side}_too_bright")).cast("int")
    return F.greatest(F.lit(0.3), F.lit(1.0) - flag("blurry") * 0.3 - flag("too_much_glare") * 0.2 - light * 0.15 - flag("too_far") * 0.15)


def photo_factor(side: str) -> Column:
    """The same as a product, for the final figure."""
    factor = lambda condition, f: F.when(condition, f).otherwise(1.0)
    return factor(F.col(f"{side}_blurry"), 0.55) * factor(F.col(f"{side}_too_much_glare"), 0.6) * factor(F.col(f"{side}_too_dark") | F.col(f"{side}_too_bright"), 0.8) * factor(F.col(f"{side}_too_far"), 0.7)


def confident(faces: DataFrame) -> DataFrame:
    """Base and final confidence of each scan, its photo check, and why it is rejected.

    ``faces`` has the photo measures, ``detection`` (confidence of the outline) and ``pass_spread``.
    """
    flagged = S.quality_flags(faces)
    both = paired(flagged, ["blurry", "too_much_glare", "too_dark", "too_bright", "too_far", "usable", "detection", "pass_spread"])
    detection = (F.col("f_detection") + F.col("b_detection")) / 2.0
    base = to_decimals((base_quality("f") + base_quality("b")) / 2.0 * 0.92, 2)
    both = both.withColumns({"base_confidence": base, "detection": detection, "pass_spread": (F.col("f_pass_spread") + F.col("b_pass_spread")) / 2.0})
    final = F.col("base_confidence") * F.least(F.lit(1.0), F.col("detection") / 0.75) * F.least(photo_factor("f"), photo_factor("b")) * (F.lit(1.0) - F.least(F.lit(0.35), F.col("pass_spread") * 0.15))
    reason = F.when(F.col("detection") < 0.5, "card not found").when(~(F.col("f_usable") & F.col("b_usable")), "photo not usable")
    return both.select("scan_id", "base_confidence", to_decimals(final, 2).alias("confidence"), reason.alias("reject_reason"))


def ranged(df: DataFrame) -> DataFrame:
    """The likely range around ``overall``; its width follows the base confidence."""
    half = to_half(F.lit(0.5) + (F.lit(1.0) - F.col("base_confidence")))
    return df.withColumn("low", to_half(F.greatest(F.lit(1.0), F.col("overall") - half))).withColumn("high", to_half(F.least(F.lit(10.0), F.col("overall") + half)))


def label(grade: Column) -> Column:
    out = F.lit(LABELS[-1][1])
    for low, name in reversed(LABELS):
        out = F.when(grade >= low, name).otherwise(out)
    return out


def face_detection_confidence(auto: Column, agreement: Column, snapped: Column) -> Column:
    """Confidence of an outline given by hand: confirmed by detection, snapped to edges, or neither."""
    return F.when((auto >= 0.5) & (agreement >= 0.97), 0.95).when(snapped >= 2, 0.8).otherwise(0.55)
