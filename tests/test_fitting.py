"""Consensus lines over rows give what the array kernel gives side by side."""

import random

from pyspark.sql import functions as F

from gradelake.pixels import fitting, kernels
from gradelake.plans import outline_queries

SCHEMA = "image bigint, side string, x double, y double"


def test_equals_the_kernel(spark):
    """Long sides with stray points, short ones, level ones, repeated points, ties, and sides of one place only."""
    rng = random.Random(7)
    sides = {}
    for image in range(12):
        slope, at = rng.uniform(-0.2, 0.2), rng.uniform(5, 40)
        line = [(float(u), slope * u + at + rng.uniform(-1, 1) + (rng.uniform(-60, 60) if rng.random() < 0.3 else 0)) for u in range(12, 90, 3)]
        sides |= {(image, "left"): line, (image, "top"): [(float(u), at) for u in range(10)], (image, "right"): line[:image], (image, "bottom"): [(3.0, float(v)) for v in range(image + 1)]}
    sides[0, "top"] = [(1.0, 0.0), (2.0, 50.0), (3.0, 0.0), (4.0, 90.0), (4.0, 90.0)]
    rows = spark.createDataFrame([(*k, *p) for k, ps in sides.items() for p in ps] + [(1, "left", None, 2.0), (None, "left", 1.0, 2.0)], SCHEMA)
    found = {(r.image, r.side): r for r in fitting.consensus_lines(rows, ["image", "side"]).collect()}
    assert found.keys() == {k for k, ps in sides.items() if ps}
    for key, r in found.items():
        u, v = (kernels.np.array(c) for c in zip(*sorted(sides[key]), strict=True))
        want = kernels.consensus_line(u, v)
        assert r.n == len(u)
        if want is None:
            assert r.slope is None and r.intercept is None
        else:
            assert abs(r.slope - want[0]) < 1e-9 and abs(r.intercept - want[1]) < 1e-7, key
    assert fitting.consensus_lines(rows.limit(0), ["image", "side"]).count() == 0


def test_the_query_meets_every_branch(spark, sf):
    rows = outline_queries.consensus_line(spark, "/root/testdata/sf0.01").agg(
        F.count_if(F.expr("n < 4 and slope is null")).alias("few"), F.count_if(F.expr("near < 4")).alias("pair"), F.count_if(F.expr("near >= 4 and near < n")).alias("strays"), F.count_if(F.expr("near = n")).alias("all"),
    )
    assert min(rows.first()) > 0
