"""Lines by consensus: seeded hypotheses per side, scored on the side's own points, the first best refitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelake.functions.random import _low, _times
from gradelake.operators.geometry import line_fit

#: The generator's seed factor, multiplier and increment; points within the tolerance are near; rounds.
SEED, MULTIPLIER, INCREMENT = 2654435761, 1664525, 1013904223
TOLERANCE, ROUNDS = 3.0, 80


def _leaps(steps: int) -> list[tuple[int, int]]:
    """For the states after 1 to ``steps`` steps the factor of the seed and what is added to it: the generator in closed form."""
    out, factor, added = [], 1, 0
    for _ in range(steps):
        factor, added = factor * MULTIPLIER % (1 << 32), (added * MULTIPLIER + INCREMENT) % (1 << 32)
        out.append((factor, added))
    return out


def _drawn(n: Column, factor: Column, added: Column) -> Column:
    """A point number below ``n``; the number of points is the seed."""
    state = _low(_times(factor, _low(n * F.lit(SEED))) + added)
    return F.shiftright(state * n, 32).cast("int")


def consensus_lines(points: DataFrame, keys: list[str], x: str = "x", y: str = "y", tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> DataFrame:
    """``keys, n, near, slope, intercept``: per key the line through two points that most points are near to, refitted on those.

    Points are numbered by ``x``, then ``y``; of equally good pairs the first drawn counts (``near`` is its number of
    points).  Pairs of one ``x`` make no line; if all are such, all points are fitted, and ``near`` is null.  Under four
    points make no line; under four near ones leave the pair's own.  Points with a null or without a key's value are left out.

    A key's points lie in one row (a side has no more than an image has lines), so a key costs one exchange, however
    many hypotheses it draws.
    """
    met = points.where(" and ".join(f"`{c}` is not null" for c in (*keys, x, y)))
    sides = met.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(x).cast("double").alias("u"), F.col(y).cast("double").alias("v")))).alias("_p")).withColumn("n", F.size("_p").cast("long"))
    leaps = _leaps(2 * rounds)
    pairs = F.array(*[F.struct(F.lit(r).alias("r"), *[F.lit(v).cast("long").alias(c) for c, v in zip("abcd", (*leaps[2 * r], *leaps[2 * r + 1]), strict=True)]) for r in range(rounds)])
    drawn = sides.where("n >= 4").withColumn("_h", F.explode(pairs))
    ends = drawn.select(*keys, "_p", F.col("_h.r").alias("_r"), F.get("_p", _drawn(F.col("n"), F.col("_h.a"), F.col("_h.b"))).alias("_1"), F.get("_p", _drawn(F.col("n"), F.col("_h.c"), F.col("_h.d"))).alias("_2"))
    ends = ends.where(F.abs(F.col("_2.u") - F.col("_1.u")) >= 1e-6).withColumn("_a", (F.col("_2.v") - F.col("_1.v")) / (F.col("_2.u") - F.col("_1.u"))).withColumn("_b", F.col("_1.v") - F.col("_a") * F.col("_1.u"))
    near = lambda p: F.abs(p["v"] - (F.col("_a") * p["u"] + F.col("_b"))) < tolerance
    scored = ends.select(*keys, "_a", "_b", "_r", F.size(F.filter("_p", near)).alias("near"))
    best = scored.groupBy(*keys).agg(F.max_by(F.struct("_a", "_b", "near"), F.struct("near", -F.col("_r"))).alias("_w")).select(*keys, "_w.*")
    won = sides.join(best, keys, "left")
    own = F.when(F.col("_a").isNull(), F.col("_p")).otherwise(F.filter("_p", near))
    fitted = line_fit(won.select(*keys, F.inline(own).alias("u", "v")), keys, "u", "v")
    line = won.select(*keys, "n", "near", "_a", "_b").join(fitted, keys, "left")
    return line.select(*keys, "n", "near", F.coalesce("slope", "_a").alias("slope"), F.when(F.col("slope").isNull(), F.col("_b")).otherwise(F.col("intercept")).alias("intercept"))
