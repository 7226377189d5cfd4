"""Queries on catalog files, capture and the marks on a picture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake.operators import geometry, outlook
from gradelake.pixels import relational as R
from gradelake.plans.views import SCENE_W, view, with_views
from gradelake.sources import catalog


def _raw(spark: SparkSession, sf: str) -> DataFrame:
    """Listed cards, nested as a listing gives them, each field missing in some."""
    i = F.col("id")
    known = lambda gap, value: F.when(i % gap != 0, value)
    address = lambda size, gap: known(gap, F.concat(F.lit(f"{size}/"), i.cast("string")))
    set_of = F.struct(F.lower("set_name").alias("id"), known(9, F.col("set_name")).alias("name"), known(5, F.concat(F.lit("Series "), (i % 7).cast("string"))).alias("series"), F.col("release_date").alias("releaseDate"))
    images = F.struct(address("small", 4).alias("small"), F.when(i % 10 == 1, "").otherwise(address("large", 5)).alias("large"))
    return view(spark, sf, "v_catalog").select(
        "id", "name", "number",
        known(6, F.concat(F.lit("rarity "), (i % 4).cast("string"))).alias("rarity"),
        known(8, F.col("supertype")).alias("supertype"),
        known(3, F.split("supertype", " ")).alias("subtypes"),
        known(2, F.array((i % 900).cast("int"))).alias("nationalPokedexNumbers"),
        known(11, set_of).alias("set"),
        known(13, images).alias("images"),
    )


def catalog_fields(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.listed_fields(_raw(spark, sf))


def index_fields(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.indexed_fields(catalog.listed_fields(_raw(spark, sf)))


def image_choice(spark: SparkSession, sf: str) -> DataFrame:
    """The picture of each card that its vector is made from."""
    rows = catalog.listed_fields(_raw(spark, sf))
    return rows.select("id", catalog.chosen_image("image_large", "image_small").alias("image"))


def stem_lookup(spark: SparkSession, sf: str) -> DataFrame:
    key = F.when(F.col("p_partkey") % 6 == 0, F.lit("none")).otherwise(F.col("p_partkey").cast("string"))
    files = spark.read.parquet(f"{sf}/part.parquet").select(F.concat(F.lit("photos/a.b/"), key, F.lit(".jpg")).alias("path"))
    return catalog.by_stem(files, view(spark, sf, "v_catalog").select(F.col("id").cast("string").alias("id"), "name"))


def candidate_id(spark: SparkSession, sf: str) -> DataFrame:
    """The shown name and number of each order against candidates that repeat both."""
    rows = spark.read.parquet(f"{sf}/lineitem.parquet")
    candidates = rows.select(F.col("l_orderkey").alias("query_id"), F.col("l_returnflag").alias("name"), F.col("l_linestatus").alias("number"), F.col("l_partkey").alias("id"), F.struct("l_linenumber", "l_partkey").alias("rank"))
    shown = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("query_id"), F.lit("N").alias("name"), F.when(F.col("o_orderkey") % 2 == 0, "O").otherwise("F").alias("number"))
    return catalog.candidate_ids(shown, candidates)


def shown_grade(spark: SparkSession, sf: str) -> DataFrame:
    """The grade beside the market value: the likeliest one of PSA, or the overall one of scans without estimates."""
    scans = view(spark, sf, "v_history").select("id", "overall", "confidence")
    estimates = outlook.ladder(scans.where("id % 3 <> 0"), ["id"])
    return outlook.likeliest(scans, estimates).select("id", "grade")


def card_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_partkey").agg(F.count("*").alias("photos"))
    return catalog.split_by_card(rows, "l_partkey").select("l_partkey", "photos", "validation")


def input_admission(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("frame") % 9 == 0, "text/plain").when(F.col("frame") % 2 == 0, "image/png").otherwise("image/jpeg")
    files = view(spark, sf, "v_frames").select("frame", kind.alias("type"), "confidence", (F.col("coverage") > 0.1).alias("has_quad"))
    return catalog.admitted(files).select("frame", "route")


def quad_moves(spark: SparkSession, sf: str) -> DataFrame:
    """A corner dragged out of the frame, a quad half of the way to another, and the quad inside its own box."""
    rows = view(spark, sf, "v_quad")
    names = [f"{n}_{a}" for n in geometry.CORNERS for a in "xy"]
    two = rows.select("id", *[F.col(n).alias(f"a_{n}") for n in names], *[(F.col(n) + 8.0).alias(f"b_{n}") for n in names])
    half = geometry.lerped(two, F.lit(0.25)).select("id", F.col("tl_x").alias("lerp_x"), F.col("br_y").alias("lerp_y"))
    own = geometry.cropped(geometry.bounding_box(rows)).select("id", F.col("tl_x").alias("crop_x"), F.col("br_y").alias("crop_y"))
    drag = geometry.dragged(rows, F.col("tl_x") * 3.0, F.col("tl_y") - 150.0).select("id", "drag_x", "drag_y")
    return drag.join(half, "id").join(own, "id")


def border_delta(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "v_center").select("scan_id", "region", "part", *[(F.col(f"{s}_px") * 0.125).alias(f"{s}_mm") for s in ("left", "right", "top", "bottom")])
    return geometry.border_delta(rows).select("scan_id", "region", "part", "delta_x_mm", "delta_y_mm")


def depth_colors(spark: SparkSession, sf: str) -> DataFrame:
    """On 107 rows of the scene, where the last line lies below four fifths rounded down."""
    return R.depth_colors(view(spark, sf, "v_scene").where("y < 107"), SCENE_W, 107, 22).select("image", "side", *[F.round(c, 6).alias(c) for c in "rgb"])


QUERIES = {f.__name__: f for f in (catalog_fields, index_fields, image_choice, stem_lookup, candidate_id, shown_grade, card_split, input_admission, quad_moves, border_delta, depth_colors)}

_LARGE = "CASE WHEN id % 13 = 0 THEN NULL WHEN id % 10 = 1 THEN '' WHEN id % 5 <> 0 THEN concat('large/', CAST(id AS VARCHAR)) END"
_SMALL = "CASE WHEN id % 13 <> 0 AND id % 4 <> 0 THEN concat('small/', CAST(id AS VARCHAR)) END"
_FIELDS = """id, name, number, CASE WHEN id % 11 <> 0 AND id % 9 <> 0 THEN set_name END AS set_name, CASE WHEN id % 11 <> 0 THEN release_date END AS release_date,
    CASE WHEN id % 6 <> 0 THEN concat('rarity ', CAST(id % 4 AS VARCHAR)) END AS rarity, CASE WHEN id % 8 <> 0 THEN supertype END AS supertype,
    CASE WHEN id % 3 <> 0 THEN string_split(supertype, ' ') ELSE CAST([] AS VARCHAR[]) END AS subtypes"""
#: The five fields that only the listing's file has.
_MORE = f"""CASE WHEN id % 2 <> 0 THEN [CAST(id % 900 AS INT)] ELSE CAST([] AS INT[]) END AS dex, CASE WHEN id % 11 <> 0 THEN lower(set_name) END AS set_id,
    CASE WHEN id % 11 <> 0 AND id % 5 <> 0 THEN concat('Series ', CAST(id % 7 AS VARCHAR)) END AS series, {_SMALL} AS image_small, {_LARGE} AS image_large"""


def _sql(*views: str, body: str) -> str:
    return with_views(*views, body=body)


SQL = {
    "catalog_fields": _sql("v_catalog", body=f"SELECT {_FIELDS}, {_MORE} FROM v_catalog"),
    "index_fields": _sql("v_catalog", body=f"SELECT {_FIELDS} FROM v_catalog"),
    "image_choice": _sql("v_catalog", body=f"SELECT id, coalesce(nullif({_LARGE}, ''), {_SMALL}) AS image FROM v_catalog"),
    "stem_lookup": "SELECT CAST(p_partkey AS VARCHAR) AS id, concat('photos/a.b/', CAST(p_partkey AS VARCHAR), '.jpg') AS path, p_name AS name FROM part WHERE p_partkey % 6 <> 0",
    "candidate_id": """WITH c AS (SELECT l_orderkey AS q, l_linestatus AS number, arg_min(l_partkey, struct_pack(a := l_linenumber, b := l_partkey)) AS id FROM lineitem WHERE l_returnflag = 'N' GROUP BY ALL)
        SELECT o_orderkey AS query_id, c.id FROM orders LEFT JOIN c ON c.q = o_orderkey AND c.number = CASE WHEN o_orderkey % 2 = 0 THEN 'O' ELSE 'F' END""",
    # The nearest of the ten grades to the overall one less 0.15, the higher of two equally near.
    "shown_grade": _sql("v_history", body="SELECT id, CASE WHEN id % 3 <> 0 THEN least(10e0, greatest(1e0, floor(overall - 0.15e0 + 0.5e0))) ELSE overall END AS grade FROM v_history"),
    "card_split": """WITH c AS (SELECT l_partkey, count(*) AS photos FROM lineitem GROUP BY 1), n AS (SELECT count(*) AS n FROM c)
        SELECT l_partkey, photos, CAST(concat('0x', substr(md5(CAST(l_partkey AS VARCHAR)), 1, 8)) AS BIGINT) < floor(greatest(0.1e0, least(1e0, 50e0 / n)) * 4294967296e0) AS validation FROM c, n""",
    "input_admission": _sql("v_frames", body="SELECT frame, CASE WHEN confidence >= 0.8e0 AND coverage > 0.1e0 THEN 'direct' ELSE 'manual' END AS route FROM v_frames WHERE frame % 9 <> 0"),
    "quad_moves": _sql(
        "v_quad",
        body=""", b AS (SELECT *, least(tl_x, tr_x, br_x, bl_x) AS x0, least(tl_y, tr_y, br_y, bl_y) AS y0, greatest(tl_x, tr_x, br_x, bl_x) AS x1, greatest(tl_y, tr_y, br_y, bl_y) AS y1 FROM v_quad),
        m AS (SELECT *, greatest(x1 - x0, y1 - y0) * 0.08e0 AS m FROM b)
        SELECT id, least(frame_w, greatest(0e0, tl_x * 3e0)) AS drag_x, least(frame_h, greatest(0e0, tl_y - 150e0)) AS drag_y, tl_x + 2e0 AS lerp_x, br_y + 2e0 AS lerp_y,
            tl_x - greatest(0e0, floor(x0 - m)) AS crop_x, br_y - greatest(0e0, floor(y0 - m)) AS crop_y FROM m""",
    ).replace(") , b AS", "), b AS"),
    "border_delta": _sql("v_center", body="SELECT scan_id, region, part, abs(left_px * 0.125e0 - right_px * 0.125e0) AS delta_x_mm, abs(top_px * 0.125e0 - bottom_px * 0.125e0) AS delta_y_mm FROM v_center"),
    "depth_colors": _sql("v_scene", body=f"SELECT image, CASE WHEN x = 22 THEN 'left' ELSE 'right' END AS side, round(avg(r), 6) AS r, round(avg(g), 6) AS g, round(avg(b), 6) AS b FROM v_scene WHERE x IN (22, {SCENE_W - 1 - 22}) AND y >= 21 AND y < 107 * 0.8e0 AND (y - 21) % 8 = 0 GROUP BY ALL"),
}
