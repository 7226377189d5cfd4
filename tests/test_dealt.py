"""Pictures are dealt to tasks once, by image: what is done for their pixels shuffles none of them."""

import re

import pytest

import __spark_entry__


def exchanges(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return re.findall(r"(?<![A-Za-z])Exchange (\w+)\((\w+)", plan)


@pytest.mark.parametrize("name", ["sobel", "box_blur", "laplacian_var", "gradient_threshold", "first_edge_scan", "border_width", "rectify", "detect_scene", "surface_grid", "surface_report", "surface_defects", "refine_quads"])
def test_no_pixel_travels(spark, name):
    """The only rows that are shuffled are the pictures' keys."""
    assert {e[1] for e in exchanges(__spark_entry__.queries()[name](spark, "/root/testdata/sf0.01"))} == {"s_suppkey"}


@pytest.mark.parametrize("name", ["rectify_tilted", "face_consensus"])
def test_nothing_asked_is_broadcast(spark, name):
    """Photos meet their quads where they were dealt to; what leaves these groups is dealt by image (partial sums, or pixels of the rim)."""
    df = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.01")
    assert {e[1] for e in exchanges(df)} == {"s_suppkey", "image"}
    assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["first_edge_scan", "border_width", "rectify", "detect_scene", "surface_report"])
def test_pictures_are_made_once(spark, name):
    """One scan of the suppliers, however many sides or parts are measured."""
    plan = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_known_width_gives_the_same_rows(spark):
    """Neighbours by place in an image's order equal those by lines and columns, for every operator, also in narrow rasters."""
    from gradelake.pixels import relational as R

    for w, h in ((7, 5), (1, 6), (6, 1), (2, 2)):
        rows = [(i, y, x, float((31 * x * x + 17 * y * i + x * y) % 97)) for i in (1, 2) for y in range(h) for x in range(w)]
        gray = spark.createDataFrame(rows, "image bigint, y bigint, x bigint, v double")
        for operator in (R.box_blur, R.sobel, R.laplacian):
            assert sorted(operator(gray, w).collect()) == sorted(operator(gray).collect())
