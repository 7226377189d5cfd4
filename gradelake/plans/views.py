"""Domain-shaped views over the test tables, in SQL that both Spark and DuckDB run.

Each view is text in terms of the tables; values are cast, so both engines have the same types.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")

VIEWS = {
    "v_region": """SELECT l_orderkey AS scan_id, CASE WHEN l_linestatus = 'F' THEN 'front' ELSE 'back' END AS face, l_linenumber AS region,
        l_discount AS corner_w, l_tax AS edge_w, CAST(l_linenumber % 3 AS INT) AS nicks, l_quantity / 1000e0 AS density, 1e0 - l_tax AS gloss,
        l_quantity / 50e0 AS severity, l_discount * 8e0 AS struct_w, l_tax * 12e0 AS sharp_loss, l_partkey AS part FROM lineitem""",
    "v_center": """SELECT l_orderkey AS scan_id, l_linenumber AS region, l_suppkey AS supp, l_partkey AS part, l_quantity * 3e0 AS left_px, 4e0 + l_linenumber * 4e0 AS right_px,
        30e0 AS top_px, 30e0 + l_linenumber AS bottom_px FROM lineitem""",
    "v_face": """SELECT l_orderkey AS scan_id, CASE WHEN l_linestatus = 'F' THEN 'front' ELSE 'back' END AS face,
        max(l_quantity) * 3e0 AS left_px, 4e0 + max(l_linenumber) * 12e0 AS right_px, 30e0 AS top_px, 30e0 + max(l_linenumber) AS bottom_px,
        max(l_quantity) / 1000e0 AS density, 1e0 - max(l_tax) AS gloss, CAST(sum(CASE WHEN l_linenumber % 3 = 2 THEN 1 ELSE 0 END) AS INT) AS print_lines,
        max(l_discount) * 8e0 AS worst_whitening, max(l_tax) * 12e0 AS worst_sharp_loss, max(l_quantity) / 50e0 AS worst_severity,
        CAST(30 + (l_orderkey * 7 + max(l_linenumber)) % 60 AS DOUBLE) AS sharpness, CAST((l_orderkey + max(l_linenumber)) % 20 AS DOUBLE) / 200e0 AS glare,
        CAST((l_orderkey * 7 + max(l_linenumber) * 31) % 256 AS DOUBLE) AS brightness, CAST((l_orderkey + max(l_linenumber)) % 50 AS DOUBLE) / 50e0 AS coverage,
        0.4e0 + CAST((l_orderkey + max(l_linenumber)) % 60 AS DOUBLE) / 100e0 AS detection, CAST(max(l_linenumber) AS DOUBLE) / 4e0 AS pass_spread
        FROM lineitem GROUP BY l_orderkey, l_linestatus""",
    "v_quality": """SELECT event_id, value AS sharpness, CAST(event_id % 20 AS DOUBLE) / 100e0 AS glare, CAST((event_id * 7) % 256 AS DOUBLE) AS brightness,
        CAST(event_id % 50 AS DOUBLE) / 50e0 AS coverage FROM events""",
    "v_pass": """SELECT l_orderkey AS scan_id, l_linenumber AS region, max(l_discount) AS w, max(l_tax) AS t, max(l_partkey) AS pk, max(l_returnflag) AS f
        FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "v_catalog": """SELECT p_partkey AS id, p_name AS name, CAST(p_size AS STRING) AS number, p_brand AS set_name, p_type AS supertype,
        CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE concat(CAST(1999 + p_partkey % 25 AS STRING), '/', lpad(CAST(1 + p_partkey % 12 AS STRING), 2, '0'), '/', lpad(CAST(1 + p_partkey % 28 AS STRING), 2, '0')) END AS release_date,
        CAST(50 + p_partkey % 5 AS INT) AS printed_total, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_retailprice END AS raw FROM part""",
    # Every branch of the search: prefixes, names that nothing has, no number, and numbers that nothing has.
    "v_ask": """SELECT p_partkey AS query_id, CASE WHEN p_partkey % 7 = 0 THEN 'zz none' WHEN p_partkey % 3 = 0 THEN substr(p_name, 1, 2) ELSE p_name END AS name,
        CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN '901/950' ELSE concat(CAST(p_size AS STRING), '/', CAST(50 + p_partkey % 5 AS STRING)) END AS number, p_brand AS set_name FROM part""",
    "v_history": """SELECT event_id AS id, ts AS created_at, user_id, 1e0 + CAST(event_id % 19 AS DOUBLE) * 0.5e0 AS overall, event_type = 'purchase' AS favorite,
        0.3e0 + CAST(event_id % 70 AS DOUBLE) / 100e0 AS confidence FROM events""",
    "v_frames": """SELECT user_id AS session, event_id AS frame, event_id * 37 AS t_ms, CAST(event_id * 13 % 100 AS DOUBLE) / 100e0 AS confidence,
        CAST(event_id * 29 % 100 AS DOUBLE) / 100e0 AS coverage, value AS position FROM events""",
    "v_calibration": """SELECT truth, pred, greatest(1e0, pred - 1e0) AS low, least(10e0, pred + 1e0) AS high, factor FROM (
        SELECT 1e0 + o_orderkey % 10 AS truth, least(10e0, greatest(1e0, 1e0 + o_orderkey % 10 + (o_custkey % 9 - 4) * 0.5e0)) AS pred, o_orderpriority AS factor FROM orders) c""",
    "v_quad": """SELECT o_orderkey AS id, 1000e0 AS frame_w, 1200e0 AS frame_h, CASE WHEN o_orderkey % 13 = 0 THEN 480e0 WHEN o_orderkey % 17 = 0 THEN 410e0 ELSE 100e0 + o_orderkey % 150 END AS tl_x, CASE WHEN o_orderkey % 13 = 0 THEN 600e0 WHEN o_orderkey % 17 = 0 THEN 535e0 ELSE 120e0 + o_orderkey % 90 END AS tl_y, 700e0 + o_orderkey % 130 AS tr_x, 110e0 + o_orderkey % 70 AS tr_y,
        720e0 + o_orderkey % 110 AS br_x, 980e0 + o_orderkey % 60 AS br_y, 110e0 + o_orderkey % 140 AS bl_x, 960e0 + o_orderkey % 50 AS bl_y,
        CAST(o_orderkey % 40 AS DOUBLE) / 100e0 AS blown, CAST(o_orderkey % 11 AS DOUBLE) / 10e0 AS density FROM orders""",
    "v_points": """SELECT l_suppkey AS line, l_orderkey AS id, l_quantity AS x, l_quantity * 2e0 + 5e0 + CASE WHEN l_orderkey % 17 = 0 THEN 90e0 ELSE l_discount * 10e0 END AS y FROM lineitem""",
    "v_colors": """SELECT event_id AS query_id, CAST(event_id * 7 % 256 AS DOUBLE) AS r, CAST(event_id * 5 % 256 AS DOUBLE) AS g, CAST(event_id * 3 % 256 AS DOUBLE) AS b,
        CAST(event_id * 11 % 5000 AS DOUBLE) AS art_variance, CAST(event_id * 17 % 5000 AS DOUBLE) AS lower_variance FROM events""",
}



def requests(spark: bool) -> str:
    """Identification requests: vectors between one of the index and the next one's, and names read with faults, or not at all."""
    blend = "zip_with(e.embedding, f.embedding, (x, y) -> {x} + {y})" if spark else "list_transform(list_zip(e.embedding, f.embedding), lambda p: {x} + {y})"
    x, y = ("x", "y") if spark else ("p[1]", "p[2]")
    share = "(0.5e0 + e.vec_id % 4 * 0.1e0)"
    vector = blend.format(x=f"CAST({x} AS DOUBLE) * {share}", y=f"CAST({y} AS DOUBLE) * (1e0 - {share})")
    return f"""SELECT e.vec_id AS query_id, CASE WHEN f.vec_id IS NULL THEN CAST(e.embedding AS {'ARRAY<DOUBLE>' if spark else 'DOUBLE[]'}) ELSE {vector} END AS vector,
        CASE WHEN e.vec_id % 60 = 0 THEN NULL WHEN e.vec_id % 40 = 0 THEN concat(substr(p.p_name, 1, 3), substr(p.p_name, 5)) ELSE concat(substr(p.p_name, 1, 2), 'x', substr(p.p_name, 4)) END AS name,
        CASE WHEN e.vec_id % 80 = 0 THEN NULL ELSE concat('0', CAST(p.p_size AS STRING), '/', CAST(50 + p.p_partkey % 5 AS STRING)) END AS number,
        p.p_name AS true_name, CASE WHEN e.vec_id % 100 = 0 THEN NULL ELSE p.p_brand END AS true_set
        FROM embeddings e JOIN part p ON e.vec_id = p.p_partkey LEFT JOIN embeddings f ON f.vec_id = e.vec_id + 1"""


#: A small scene in closed form for every supplier: a card with one worn corner and a nick on a dark ground, at a brightness of its own.
SCENE_W, SCENE_H = 100, 120
_CARD = "x >= 20 AND x < 76 AND y >= 15 AND y < 93"
_ART = "x >= 23 AND x < 71 AND y >= 19 AND y < 89"
#: The corner is one of four, by mirrored coordinates; the nick is on one of four sides, or absent.
_WORN = "CASE WHEN image % 2 = 0 THEN x ELSE 95 - x END >= 68 AND CASE WHEN image % 4 < 2 THEN y ELSE 107 - y END >= 85 AND CASE WHEN image % 2 = 0 THEN x - 68 ELSE 27 - x END + CASE WHEN image % 4 < 2 THEN y - 85 ELSE 22 - y END > 6"
_NICK = "CASE image % 5 WHEN 0 THEN x >= 20 AND x < 32 AND y >= 40 AND y < 46 WHEN 1 THEN x >= 64 AND x < 76 AND y >= 40 AND y < 46 WHEN 2 THEN y >= 15 AND y < 27 AND x >= 40 AND x < 46 WHEN 3 THEN y >= 81 AND y < 93 AND x >= 40 AND x < 46 ELSE false END"
_NOISE = "((31 * x + 17 * y) % 13 - 6)"


def _pixels(spark: bool, w: int, h: int) -> str:
    """``image, x, y`` of every supplier's image.  In Spark the places travel to the images, so an image's pixels stay where its row was dealt to."""
    if spark:
        return f"SELECT /*+ BROADCAST(q) */ s_suppkey AS image, id % {w} AS x, id DIV {w} AS y FROM supplier CROSS JOIN range({w * h}) q"
    return f"SELECT s_suppkey AS image, CAST(id % {w} AS BIGINT) AS x, CAST(floor(id / {w}) AS BIGINT) AS y FROM supplier CROSS JOIN (SELECT range AS id FROM range({w * h})) q"


def _channel(worn: int, art: int, border: int, ground: int) -> str:
    return f"CAST(CASE WHEN {_CARD} AND (({_WORN}) OR ({_NICK})) THEN {worn} WHEN {_ART} THEN {art} + {_NOISE} WHEN {_CARD} THEN {border} ELSE {ground} END - 3 * (image % 4) AS DOUBLE)"


def scene(spark: bool) -> str:
    return f"SELECT image, y, x, {_channel(245, 30, 228, 38)} AS r, {_channel(244, 60, 198, 40)} AS g, {_channel(240, 140, 64, 44)} AS b FROM ({_pixels(spark, SCENE_W, SCENE_H)}) p"


def surface(spark: bool) -> str:
    """A rectified face of 80 by 100 for every supplier, with bright specks and one bright row."""
    mark = "(y = 30 + image % 20 OR (x * 7 + y * 11 + image) % 61 = 0)"
    channel = lambda c: f"CAST(CASE WHEN {mark} THEN 250 ELSE {c} + (x * 3 + y * 5) % 7 END AS DOUBLE)"
    return f"SELECT image, y, x, {channel(90)} AS r, {channel(80)} AS g, {channel(70)} AS b FROM ({_pixels(spark, 80, 100)}) p"


#: A tilted card in a frame of the same size.  Half its sides, its art and the frame's middle; the tilt differs by image.
TILT_W, TILT_H, HALF_W, HALF_H = 100, 120, 28, 39
TILT = "((image % 5 - 2) * 0.02e0)"
#: A picture without contrast has a hundredth of the colours' range.
FLAT = "(image % 11 = 0)"


def tilted(spark: bool) -> str:
    """A card with a worn corner and a nick, turned by an angle of its own, for every supplier."""
    u, v = f"((x - 50) + {TILT} * (y - 60))", f"((y - 60) - {TILT} * (x - 50))"
    card, art = f"abs({u}) <= {HALF_W} AND abs({v}) <= {HALF_H}", f"abs({u}) <= 19 AND abs({v}) <= 29"
    worn = f"({card} AND image % 2 = 0 AND {u} + {v} > 57)"
    nick = f"({card} AND image % 3 = 0 AND {u} < -20 AND {v} >= 0 AND {v} < 8)"

    def channel(white: int, inner: int, border: int, ground: int) -> str:
        whole = f"CASE WHEN {worn} OR {nick} THEN {white} WHEN {art} THEN {inner} + {_NOISE} WHEN {card} THEN {border} ELSE {ground} END"
        return f"CAST(CASE WHEN {FLAT} THEN 100 + floor(({whole}) / 100) ELSE {whole} END AS DOUBLE)"

    return f"SELECT image, y, x, {channel(245, 30, 228, 38)} AS r, {channel(244, 60, 198, 40)} AS g, {channel(240, 140, 64, 44)} AS b FROM ({_pixels(spark, TILT_W, TILT_H)}) p"


def corner_sql(name: str, axis: str) -> str:
    """A true corner of the tilted card in closed form."""
    u, v = (HALF_W if name[1] == "r" else -HALF_W), (HALF_H if name[0] == "b" else -HALF_H)
    above = f"{u} - {TILT} * ({v})" if axis == "x" else f"{v} + {TILT} * ({u})"
    return f"({50 if axis == 'x' else 60} + ({above}) / (1 + {TILT} * {TILT}))"


def hints(spark: bool) -> str:
    """Outlines given by hand: the true one, off by up to five pixels, or far too small."""
    columns = []
    for name in ("tl", "tr", "br", "bl"):
        for axis in "xy":
            small = f"{(25 if name[1] == 'r' else 19) if axis == 'x' else (63 if name[0] == 'b' else 57)}e0"
            columns.append(f"CAST(CASE WHEN image % 13 = 0 THEN {small} ELSE {corner_sql(name, axis)} + image % {6 if axis == 'x' else 4} END AS DOUBLE) AS {name}_{axis}")
    return f"SELECT image, {TILT_W}e0 AS frame_w, {TILT_H}e0 AS frame_h, " + ", ".join(columns) + " FROM (SELECT s_suppkey AS image FROM supplier) q"


def worn(spark: bool) -> str:
    """Rectified faces of 80 by 100: clean, scratched, scratched on foil, or lined and of uneven brightness."""
    patch = "(x BETWEEN 18 AND 34 AND y BETWEEN 40 AND 54)"
    mark = f"((image % 4 IN (1, 2) AND {patch} AND (x + 2 * y) % 5 = 0) OR (image % 4 = 3 AND y = 30 + image % 20) OR (image % 4 = 3 AND y = 70 AND x > 40))"
    foil = f"(image % 4 = 2 AND {patch})"
    base = lambda c, up: f"CASE WHEN {foil} THEN {c} + {up} * ((x + y) % 2) WHEN image % 8 = 3 THEN {c} + x * 2 ELSE {c} + (x * 3 + y * 5) % 7 END"
    channel = lambda c, up: f"CAST(CASE WHEN {mark} THEN 250 ELSE {base(c, up)} END AS DOUBLE)"
    return f"SELECT image, y, x, {channel(60, 100)} AS r, {channel(50, 0)} AS g, {channel(40, 90)} AS b FROM ({_pixels(spark, 80, 100)}) p"


def masks(spark: bool) -> str:
    """Where the tilted card is, and where a bright pixel says so; some of either are empty."""
    u, v = f"((x - 50) + {TILT} * (y - 60))", f"((y - 60) - {TILT} * (x - 50))"
    truth = f"(image % 9 <> 0 AND abs({u}) <= {HALF_W} AND abs({v}) <= {HALF_H})"
    guess = f"(image % 9 <> 0 AND image % 10 <> 1 AND abs({u} - image % 4) <= {HALF_W} AND abs({v}) <= {HALF_H - 2})"
    return f"SELECT image, y, x, {truth} AS truth, {guess} AS guess, CAST((x * 7 + y * 3 + image) % 9 - 4 AS DOUBLE) AS logit FROM ({_pixels(spark, TILT_W, TILT_H)}) p"


#: Views of pictures, one per supplier, and how many of these one task works on: all it does for an image stays in that task.
PICTURES, TASK_IMAGES = ("v_mask", "v_scene", "v_surface", "v_tilted", "v_hint", "v_worn"), 32
SCENES = {"v_request": requests, "v_mask": masks, "v_scene": scene, "v_surface": surface, "v_tilted": tilted, "v_hint": hints, "v_worn": worn}


def sql_of(name: str, spark: bool) -> str:
    return SCENES[name](spark) if name in SCENES else VIEWS[name]


def _dealt(suppliers: DataFrame) -> DataFrame:
    """The images' keys dealt to tasks.  What is grouped, joined or ordered by image keeps this partitioning, so pixels never travel.

    For joins by image and place the session is told that rows dealt by a part of the keys are together; the setting stays.
    """
    suppliers.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    keys = suppliers.select("s_suppkey")
    return keys.repartition(max(1, -(-keys.count() // TASK_IMAGES)), "s_suppkey")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a DataFrame; only the tables and columns it names are read."""
    text = sql_of(name, True)
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f" {t}" in text}
    if name in PICTURES:
        tables["supplier"] = _dealt(tables["supplier"])
    for t, df in tables.items():
        df.createOrReplaceTempView(f"_{t}")
        text = text.replace(f"FROM {t}", f"FROM _{t}").replace(f"JOIN {t}", f"JOIN _{t}")
    return spark.sql(text)


def with_views(*names: str, body: str) -> str:
    """DuckDB SQL with the views in front of ``body``."""
    return "WITH " + ", ".join(f"{n} AS ({sql_of(n, False)})" for n in names) + " " + body
