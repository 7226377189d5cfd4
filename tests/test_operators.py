"""Expectations on small literal rows."""

import pytest
from pyspark.sql import functions as F

from gradelake.functions import numeric as N
from gradelake.functions import text as T
from gradelake.operators import geometry, grading, history, matching, pricing
from gradelake.pixels import relational
from gradelake.plans import market_queries
from gradelake.sources import catalog
from gradelake.streaming import live


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_rounding(spark):
    lit = F.lit
    got = one(spark, N.to_decimals(lit(1.005), 2), N.to_decimals(lit(-2.5)), N.to_decimals(lit(2.5)), N.to_half(lit(8.25)), N.clamp(lit(11.0), 1, 10))
    assert got == (1.0, -2.0, 3.0, 8.5, 10.0)
    rows = spark.createDataFrame([(float(i),) for i in (1, 2, 3, 4)], "x double")
    assert rows.agg(N.upper_median(F.col("x"))).first()[0] == 3.0
    assert spark.range(0).agg(N.mean_or_zero(F.col("id"))).first()[0] == 0.0


def grade(spark, centering, corners, edges, surface, whitening=0.0, sharp=0.0, severity=0.0):
    row = spark.createDataFrame([(1, centering, corners, edges, surface, whitening, sharp, severity)], "scan_id int, centering double, corners double, edges double, surface double, worst_whitening double, worst_sharp_loss double, worst_severity double")
    return grading.capped(row).first()


def test_caps(spark):
    nine = grade(spark, 9.0, 9.0, 9.0, 9.0)
    assert (nine.overall, nine.composite, nine.structural_cap) == (9.0, 9.0, None)
    worn = grade(spark, 9.0, 6.0, 9.0, 9.0)
    assert worn.overall == 6.0 and worn.limiting_factor == "corners" and worn.composite > 6
    off = grade(spark, 2.0, 10.0, 9.0, 9.0)
    assert (off.overall, off.limiting_factor) == (4.0, "centering")
    assert grade(spark, 8.0, 9.0, 9.0, 9.0).overall >= 8
    assert grade(spark, 10.0, 10.0, 10.0, 10.0, 0.7, 0.7).structural_cap == 5.0
    assert grade(spark, 10.0, 10.0, 10.0, 10.0, severity=0.95).overall == 4.0


def test_prices(spark):
    rows = spark.createDataFrame([(1, None, 9.0), (2, 0.0, 9.0), (3, 100.0, 9.0), (4, 100.0, 10.0)], "id int, raw double, grade double")
    got = sorted((r.id, r.amount) for r in pricing.graded_values(rows).collect())
    assert got == [(3, 200.0), (3, 500.0), (4, 500.0)]


def test_numbers_and_names(spark):
    lit = F.lit
    assert one(spark, *[T.collector_number(lit(x)) for x in ("004/102", "SV49", "TG12/TG30", "0", "/5", "")]) == ("4", "sv49", "tg12", "0", None, None)
    assert one(spark, *[T.printed_total(lit(x)) for x in ("4/102", "TG12/TG030", "7")]) == (102, 30, None)
    assert one(spark, T.similarity(lit("Abc"), lit("a b c")), T.similarity(lit(""), lit("x"))) == (1.0, 0.0)
    assert one(spark, T.capitals(lit("boss's-orders")), T.spaced(lit("topLeft")), T.kana_key(lit("ぴカ・a漢"))) == ("Boss'S-Orders", "top left", "ピカ・漢")


def test_matching(spark):
    index = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0]), (2, [0.99, 0.14, 0.0, 0.0]), (3, [0.0, 1.0, 0.0, 0.0])], "id bigint, embedding array<float>")
    cards = spark.createDataFrame([(1, "Chansey", "3", "Base", "1999/01/09"), (2, "Chansey", "2", "Evolutions", "2016/11/02"), (3, "Other", "9", "Base", None)], "id bigint, name string, number string, set_name string, release_date string")
    asks = spark.createDataFrame([(10, [1.0, 0.0, 0.0, 0.0], None, None), (11, [1.0, 0.0, 0.0, 0.0], "Chansey", "2/108"), (12, [1.0, 0.0], "Chansey", "2")], "query_id bigint, vector array<double>, name string, number string")
    shortlist = matching.nearest(asks.select("query_id", "vector"), index)
    best = {r.query_id: (r.id, r.method) for r in matching.hybrid_match(shortlist, asks, cards).collect()}
    assert best == {10: (1, "art"), 11: (2, "art+text")}
    plain = matching.nearest_by_expression(asks.select("query_id", "vector"), index)
    assert sorted((r.query_id, r.id, r["rank"]) for r in plain.collect()) == sorted((r.query_id, r.id, r["rank"]) for r in shortlist.collect())
    assert matching.nearest(asks.select("query_id", "vector"), index.limit(0)).count() == 0
    who = matching.identity(matching.hybrid_match(shortlist, asks, cards)).where("query_id = 11").first()
    assert who.era == "2016 · Evolutions" and 0 < who.confidence <= 1


def test_snapping(spark):
    words = lambda *w: spark.createDataFrame([(i, x, "".join(c for c in x.lower() if c.isalnum())) for i, x in enumerate(w)], "ord int, display string, norm string")
    names = spark.createDataFrame([(x,) for x in ("chansei", "charizard ex", "dark charlzard", "ultra bail", None, "", "ex")], "name string")
    got = {r.name: r.snapped for r in matching.snap_names(names, words("Chansey", "Charizard"), words("Ultra Ball")).collect()}
    assert got == {"chansei": "Chansey", "charizard ex": "Charizard ex", "dark charlzard": "Dark Charizard", "ultra bail": "Ultra Ball", "ex": None}
    kana = spark.createDataFrame([(0, "Pika", "ピカチュウ")], "ord int, display string, norm string")
    read = spark.createDataFrame([("ぴかちゅう",), ("latin",)], "name string")
    assert {r.name: r.snapped for r in matching.snap_kana(read, kana).collect()} == {"ぴかちゅう": "Pika", "latin": None}


def test_retention(spark):
    rows = spark.createDataFrame([(i, 1, i, i % 9 == 0) for i in range(40)], "id bigint, user_id bigint, created_at bigint, favorite boolean")
    kept = {r.id for r in history.retain(rows).collect()}
    index = []
    for i in range(40):  # evict the last that is no favourite after each save
        index.insert(0, i)
        if len(index) > 24:
            index.remove(next(x for x in reversed(index) if x % 9))
    assert kept == set(index)


def test_sources(spark, tmp_path):
    rows = spark.createDataFrame([("a", "A"), ("b", "B"), ("a", "C")], "id string, name string").withColumn("n", F.monotonically_increasing_id())
    assert {r.id: r.name for r in catalog.last_per_id(rows.coalesce(1), "n").collect()} == {"a": "C", "b": "B"}
    import struct

    path = tmp_path / "v.f32"
    path.write_bytes(struct.pack("<4f", 1, 2, 3, 4))
    ids = spark.createDataFrame([(0, "x"), (1, "y")], "ord bigint, id string")
    assert sorted((r.id, r.embedding) for r in catalog.read_vectors(spark, str(path), 2, ids).collect()) == [("x", [1.0, 2.0]), ("y", [3.0, 4.0])]
    with pytest.raises(Exception, match="differ"):
        catalog.read_vectors(spark, str(path), 2, ids.limit(1)).collect()
    assert catalog.read_labels(spark, str(tmp_path / "none.json")).count() == 0
    listing = catalog.paged(spark, lambda page, size: [(page * 10 + i,) for i in range(size)], "id int", 6, 3)
    assert sorted(r.id for r in listing.collect()) == [10, 11, 12, 20, 21, 22]


def test_stream_equals_replay(spark, tmp_path):
    frames = spark.createDataFrame([(s, i, i * 60, (i * 7 % 10) / 10, (i * 3 % 10) / 10, float(i)) for s in (1, 2) for i in range(30)], "session bigint, frame bigint, t_ms bigint, confidence double, coverage double, position double")
    frames.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frames.schema).parquet(str(tmp_path / "in"))
    query = live.track(stream, None).writeStream.format("memory").queryName("tracked").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    got = sorted(map(tuple, spark.table("tracked").collect()), key=str)
    assert got == sorted(map(tuple, live.replay(frames).collect()), key=str)


def test_line_fit_needs_four_points(spark):
    """Two and three points make no line; a point two deviations off is left out if four remain; one place on x gives a level line."""
    points = [(1, 0.0, 0.0), (1, 1.0, 2.0), (2, 0.0, 1.0), (2, 1.0, 1.0), (2, 2.0, 1.0), (4, 3.0, 1.0), (4, 3.0, 2.0), (4, 3.0, 3.0), (4, 3.0, 6.0)]
    points += [(3, float(x), 2.0 * x + 5 + (100 if x == 9 else 0)) for x in range(20)]
    rows = spark.createDataFrame(points, "line int, x double, y double")
    got = {r.line: (r.slope, r.intercept) for r in geometry.line_fit(rows, ["line"]).collect()}
    assert got[1] == got[2] == (None, None) and got[4] == (0.0, 3.0)
    assert got[3] == (pytest.approx(2.0), pytest.approx(5.0))


def quad(spark, *xy):
    names = [f"{n}_{a}" for n in geometry.CORNERS for a in "xy"]
    df = spark.createDataFrame([(*map(float, xy), 1000.0, 1200.0, 0.0, 1.0)], ", ".join(f"{n} double" for n in (*names, "frame_w", "frame_h", "blown", "density")))
    return geometry.gate(geometry.measures(df)).first()


def test_quads(spark):
    good = quad(spark, 100, 100, 814, 100, 814, 1100, 100, 1100)
    assert good.convex and good.plausible and good.confidence > 0.9
    assert not quad(spark, 480, 600, 814, 100, 814, 1100, 100, 1100).convex
    assert quad(spark, 100, 600, 100, 100, 814, 100, 814, 1100).convex  # a collinear corner breaks nothing
    assert not quad(spark, -50, 0, 664, 0, 664, 1000, -50, 1000).plausible  # on the bound is outside


def test_no_reference_pixels_count_as_gray(spark):
    rows = spark.createDataFrame([(1, 0, 0, 9.0, 9.0, 9.0)], "image int, y int, x int, r double, g double, b double")
    assert tuple(relational.mean_color(rows, F.col("x") > 5).first()) == (1, 128.0, 128.0, 128.0)


def test_vectors_of_other_lengths(spark):
    """An odd or null vector, wherever it stands, takes nothing away from the others."""
    index = spark.createDataFrame([(9, [1.0]), (8, None), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "id bigint, embedding array<float>")
    asks = spark.createDataFrame([(5, [1.0, 0.1]), (6, [2.0]), (7, None)], "query_id bigint, vector array<double>")
    got = sorted((r.query_id, r.id, r["rank"]) for r in matching.nearest(asks, index).collect())
    assert got == [(5, 1, 1), (5, 2, 2), (6, 9, 1)]


def test_a_score_must_beat_the_rounded_best(spark):
    """0.60045 is shown as 0.6, so a later 0.6004 still wins over it; a later 0.5999 does not."""
    cards = spark.createDataFrame([(i, f"n{i}", "1", "s", None) for i in (1, 2, 3)], "id bigint, name string, number string, set_name string, release_date string")
    asks = spark.createDataFrame([(1, None, None)], "query_id bigint, name string, number string")
    short = lambda *art: spark.createDataFrame([(1, i + 1, a / 0.6, i + 1) for i, a in enumerate(art)], "query_id bigint, id bigint, art double, rank int")
    assert matching.hybrid_match(short(0.60045, 0.6004, 0.5999), asks, cards).first().id == 2
    assert matching.hybrid_match(short(0.60045, 0.5999), asks, cards).first().id == 1


def test_requests_reach_every_branch(spark):
    """Numbered, unnumbered, a number that nothing has, a name that nothing has, and more hits than are shown."""
    sf = "/root/testdata/sf0.01"
    found = market_queries.catalog_search(spark, sf)
    numbered = {r.numbered for r in found.select("numbered").distinct().collect()}
    deep = found.groupBy("query_id").count()
    assert numbered == {True, False} and deep.agg(F.max("count")).first()[0] == pricing.PAGE
    assert market_queries.candidate_rank(spark, sf).agg(F.max("rank")).first()[0] == pricing.SHOWN
    assert not market_queries.market_record(spark, sf).where("not identified").isEmpty()


def test_strided_over_ranges(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit("x").alias("v"))
    assert sorted(r.k for r in history.strided(rows, "k", 30, ranges=5).collect()) == [i * 33 for i in range(30)]
    assert history.strided(rows.limit(0), "k", 30).count() == 0


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([("a", "n", "1", "i", [1.0, 2.0]), ("b", "n", "1", None, [1.0, 2.0]), ("c", "n", "1", "i", None), ("d", "n", "1", "i", [1.0])], "id string, name string, number string, image string, embedding array<double>")
    good, bad = catalog.split_valid(rows, 2)
    assert [r.id for r in good.collect()] == ["a"] and {r.reject_reason: r["count"] for r in bad.collect()} == {"no image": 1, "no vector": 1, "wrong length": 1}
    assert [r.id for r in catalog.without_cached(rows, rows.where("id <> 'b'")).collect()] == ["b"]
    catalog.write_vectors(good, str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v")).first().embedding == [1.0, 2.0]
    catalog.write_catalog(good.select("id", "name", "number"), str(tmp_path / "c"))
    assert [r.name for r in catalog.read_catalog(spark, str(tmp_path / "c")).collect()] == ["n"]
    images = spark.createDataFrame([("x/1.png",), ("x/2.png",)], "path string")
    masks = spark.createDataFrame([("y/2.jpg",)], "path string")
    assert [r.mask for r in catalog.paired_files(images, masks, 1).collect()] == ["y/2.jpg"]
    with pytest.raises(ValueError, match="fewer"):
        catalog.paired_files(images, masks, 2)
