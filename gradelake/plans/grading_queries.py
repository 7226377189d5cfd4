"""Queries on scoring, grading and what follows from grades."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake.functions.numeric import to_decimals
from gradelake.operators import consensus, grading, outlook
from gradelake.operators import scoring as S
from gradelake.plans import sqltext as Q
from gradelake.plans.views import view, with_views


def grade_blend(spark: SparkSession, sf: str) -> DataFrame:
    return grading.blend(view(spark, sf, "v_region"))


def _blend_sql() -> str:
    face = lambda c, side: f"avg(CASE WHEN face = '{side}' THEN {c} END)"
    mixed = lambda c: Q.hr(f"{face(c, 'front')} * 0.55e0 + {face(c, 'back')} * (1e0 - 0.55e0)")
    return f"s AS (SELECT scan_id, face, {Q.corner_score('corner_w')} AS c, {Q.edge_score('edge_w', 'nicks')} AS e FROM v_region), blended AS (SELECT scan_id, {mixed('c')} AS corners, {mixed('e')} AS edges FROM s GROUP BY scan_id HAVING count(DISTINCT face) = 2)"


def centering_scores(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.centering(S.calibrated(view(spark, sf, "v_center"), F.lit(635.0), F.lit(889.0)))
    return rows.select("scan_id", "region", "supp", "part", "left_pct", "right_pct", "top_pct", "bottom_pct", "horizontal_ratio", "vertical_ratio", "centering_score", "centering_pass", to_decimals(F.col("left_px") * F.col("mm_x"), 2).alias("left_mm"))


def _centering_sql(table: str, keep: str) -> str:
    pct = f"SELECT *, {Q.jr('left_px / CASE WHEN left_px + right_px = 0 THEN 1 ELSE left_px + right_px END * 100e0', 1)} AS left_pct, {Q.jr('top_px / CASE WHEN top_px + bottom_px = 0 THEN 1 ELSE top_px + bottom_px END * 100e0', 1)} AS top_pct FROM {table}"
    both = f"SELECT *, {Q.jr('100e0 - left_pct', 1)} AS right_pct, {Q.jr('100e0 - top_pct', 1)} AS bottom_pct FROM ({pct}) a"
    ratio = lambda a, b: f"concat(CAST(CAST({Q.jr(f'greatest({a}, {b})')} AS INT) AS VARCHAR), '/', CAST(CAST({Q.jr(f'100e0 - greatest({a}, {b})')} AS INT) AS VARCHAR))"
    worst = "greatest(left_pct, right_pct, top_pct, bottom_pct)"
    return f"SELECT {keep}, left_pct, right_pct, top_pct, bottom_pct, {ratio('left_pct', 'right_pct')} AS horizontal_ratio, {ratio('top_pct', 'bottom_pct')} AS vertical_ratio, {Q.centering_score(worst)} AS centering_score, {worst} <= 55 AS centering_pass FROM ({both}) b"


def surface_scores(spark: SparkSession, sf: str) -> DataFrame:
    d, g, p = F.col("density"), F.col("gloss"), (F.col("region") % 3).cast("int")
    rows = view(spark, sf, "v_region")
    return rows.select("scan_id", "part", "region", S.surface_score(d, p, g).alias("score"), F.array_join(S.surface_issues(d, p, F.col("region") == 7, g), "; ").alias("issues"))


def quality_flags(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.quality_flags(view(spark, sf, "v_quality"))
    return rows.select("event_id", "blurry", "too_much_glare", "too_dark", "too_bright", "too_far", F.array_join("warnings", ",").alias("warnings"), "usable")


def grade_caps(spark: SparkSession, sf: str) -> DataFrame:
    rows = grading.graded(view(spark, sf, "v_region"), view(spark, sf, "v_face"))
    return rows.select("scan_id", "centering", "corners", "edges", "surface", "composite", "overall", "limiting_factor", "structural_cap")


def _caps_sql() -> str:
    mixed = lambda c: Q.hr(f"max(CASE WHEN face = 'front' THEN {c} END) * 0.55e0 + max(CASE WHEN face = 'back' THEN {c} END) * (1e0 - 0.55e0)")
    faces = f"f AS (SELECT c.*, {Q.surface_score('density', 'print_lines', 'gloss')} AS surface FROM ({_centering_sql('v_face', 'scan_id, face, density, gloss, print_lines, worst_whitening, worst_sharp_loss, worst_severity')}) c)"
    sub = f"g AS (SELECT f.scan_id, {mixed('centering_score')} AS centering, {mixed('surface')} AS surface, max(worst_whitening) AS ww, max(worst_sharp_loss) AS ws, max(worst_severity) AS wd FROM f GROUP BY f.scan_id HAVING count(*) = 2)"
    comp = f"h AS (SELECT g.*, b.corners, b.edges, {Q.hr('centering * 0.25e0 + corners * 0.25e0 + edges * 0.2e0 + surface * 0.3e0')} AS composite, least(corners, edges, surface) AS dmin, CASE WHEN centering >= 8 THEN 10e0 ELSE centering + 2e0 END AS ccap, CASE WHEN ww > 0.65e0 AND ws > 0.6e0 THEN 5e0 WHEN wd >= 0.9e0 THEN 4e0 END AS structural_cap FROM g JOIN blended b USING (scan_id))"
    damage = "CASE WHEN corners = dmin THEN 'corners' WHEN edges = dmin THEN 'edges' ELSE 'surface' END"
    return f"{_blend_sql()}, {faces}, {sub}, {comp}, graded AS (SELECT scan_id, centering, corners, edges, surface, composite, {Q.hr('greatest(1e0, least(composite, dmin, ccap, coalesce(structural_cap, 10e0)))')} AS overall, CASE WHEN ccap < least(composite, dmin) THEN 'centering' WHEN dmin < composite THEN {damage} WHEN centering <= dmin THEN 'centering' ELSE {damage} END AS limiting_factor, structural_cap FROM h)"


def confidence_gate(spark: SparkSession, sf: str) -> DataFrame:
    faces = view(spark, sf, "v_face")
    rows = grading.graded(view(spark, sf, "v_region"), faces).join(grading.confident(faces), "scan_id")
    return grading.ranged(rows).select("scan_id", "base_confidence", "confidence", "reject_reason", "overall", "low", "high")


def _confidence_sql() -> str:
    flags = "q AS (SELECT scan_id, detection, pass_spread, sharpness < 45 AS blurry, glare > 0.06e0 AS glary, brightness < 55 OR brightness > 215 AS lit, coverage < 0.25e0 AS far FROM v_face)"
    base = "r AS (SELECT *, greatest(0.3e0, 1e0 - CAST(blurry AS INT) * 0.3e0 - CAST(glary AS INT) * 0.2e0 - CAST(lit AS INT) * 0.15e0 - CAST(far AS INT) * 0.15e0) AS b, (CASE WHEN blurry THEN 0.55e0 ELSE 1e0 END) * (CASE WHEN glary THEN 0.6e0 ELSE 1e0 END) * (CASE WHEN lit THEN 0.8e0 ELSE 1e0 END) * (CASE WHEN far THEN 0.7e0 ELSE 1e0 END) AS p FROM q)"
    both = f"c AS (SELECT scan_id, {Q.jr('sum(b) / 2e0 * 0.92e0', 2)} AS base_confidence, sum(detection) / 2e0 AS det, sum(pass_spread) / 2e0 AS sp, min(p) AS p, bool_or(blurry OR lit) AS bad FROM r GROUP BY scan_id HAVING count(*) = 2)"
    half = Q.hr("0.5e0 + (1e0 - base_confidence)")
    final = Q.jr("base_confidence * least(1e0, det / 0.75e0) * p * (1e0 - least(0.35e0, sp * 0.15e0))", 2)
    return f"{_caps_sql()}, {flags}, {base}, {both} SELECT c.scan_id, base_confidence, {final} AS confidence, CASE WHEN det < 0.5e0 THEN 'card not found' WHEN bad THEN 'photo not usable' END AS reject_reason, overall, {Q.hr(f'greatest(1e0, overall - {half})')} AS low, {Q.hr(f'least(10e0, overall + {half})')} AS high FROM c JOIN graded USING (scan_id)"


def grade_labels(spark: SparkSession, sf: str) -> DataFrame:
    g = F.col("overall")
    return view(spark, sf, "v_history").select("id", "overall", grading.label(g).alias("label"), S.grade_tone(g).alias("tone"), S.confidence_level(F.col("confidence")).alias("level"))


def _labels_sql() -> str:
    return "(CASE " + " ".join(f"WHEN overall >= {low}e0 THEN '{name}'" for low, name in grading.LABELS[:-1]) + f" ELSE '{grading.LABELS[-1][1]}' END)"


def ladder_probabilities(spark: SparkSession, sf: str) -> DataFrame:
    return outlook.ladder(view(spark, sf, "v_history"), ["id"])


def _ladder_sql() -> str:
    rungs = " UNION ALL ".join(f"SELECT '{c}' AS company, {s}e0 AS strictness, unnest([{', '.join(f'{g}e0' for g in outlook.rungs(h))}]) AS grade" for c, s, h in outlook.COMPANIES)
    return with_views("v_history", body=f""", l AS ({rungs}), s AS (SELECT id, company, grade, -abs(grade - (overall - strictness)) / (1.6e0 - confidence) AS s FROM v_history CROSS JOIN l),
        w AS (SELECT *, exp((s - max(s) OVER (PARTITION BY id, company)) * 2.2e0) AS w FROM s),
        p AS (SELECT *, sum(w) OVER (PARTITION BY id, company) AS total, row_number() OVER (PARTITION BY id, company ORDER BY w DESC, grade DESC) AS rank FROM w)
        SELECT id, company, CAST(rank AS INT) AS rank, grade, {Q.jr('w / total', 2)} AS probability FROM p WHERE rank <= 3""").replace(") , l", "), l")


def submission_advice(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "v_history").select("id", outlook.advice(F.col("overall"), F.col("confidence")).alias("a")).select("id", "a.recommended", "a.headline")


def _regions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = view(spark, sf, "v_region")
    w, e, n = F.col("corner_w"), F.col("edge_w"), F.col("nicks")
    names = F.array(*map(F.lit, ("topLeft", "topRight", "bottomRight", "bottomLeft")))
    sides = F.array(*map(F.lit, ("top", "right", "bottom", "left")))
    issue = S.corner_issue(w * 4.0)
    corners = rows.select("scan_id", "face", "region", F.element_at(names, (F.col("region") % 4 + 1).cast("int")).alias("corner"), (w * 4.0).alias("whitening"), S.corner_damaged(w * 4.0).alias("damaged"), F.array_compact(F.array(issue)).alias("issues"))
    edges = rows.select("scan_id", "face", "region", F.element_at(sides, (F.col("region") % 4 + 1).cast("int")).alias("edge"), e.alias("whitening"), n.alias("nicks"), S.edge_issues(e, n).alias("issues"))
    defects = rows.where("severity >= 0.5").select("scan_id", "face", "region", F.when(F.col("region") % 2 == 0, "print-line").otherwise("holo-scratch").alias("type"), F.col("corner_w").alias("x"), F.col("edge_w").alias("y"), "severity")
    return corners, edges, defects


def defect_report(spark: SparkSession, sf: str) -> DataFrame:
    return outlook.defect_report(*_regions(spark, sf)).select("scan_id", "face", "area", "location", "severity", "description", "label", "rank")


def _defects_sql() -> str:
    side = "CASE WHEN face = 'front' THEN 'Front' ELSE 'Back' END"
    pct = lambda x: f"concat(CAST(CAST({Q.jr(f'{x} * 100e0')} AS INT) AS VARCHAR), '%')"
    w = "(corner_w * 4e0)"
    ci, ei = Q.issue(w, S.CORNER_ISSUES), Q.issue("edge_w", S.EDGE_ISSUES)
    nick = "CASE WHEN nicks > 0 THEN concat(CAST(nicks AS VARCHAR), ' nick', CASE WHEN nicks > 1 THEN 's' ELSE '' END) END"
    corner = f"SELECT scan_id, face, region, 'Corner' AS area, concat({side}, ' ', (['top left', 'top right', 'bottom right', 'bottom left'])[CAST(region % 4 + 1 AS INT)]) AS location, {w} AS severity, coalesce({ci}, concat({pct(w)}, ' whitening')) AS description FROM v_region WHERE {w} > 0.12e0"
    edge = f"SELECT scan_id, face, region, 'Edge', concat({side}, ' ', (['top', 'right', 'bottom', 'left'])[CAST(region % 4 + 1 AS INT)]), greatest(edge_w, least(1e0, nicks / 4e0)), concat_ws(', ', {ei}, {nick} || ' detected', {nick}) FROM v_region WHERE {ei} IS NOT NULL OR nicks > 0"
    spot = f"SELECT scan_id, face, region, 'Surface', concat({side}, ' @ ', {pct('corner_w')}, ', ', {pct('edge_w')}), severity, CASE WHEN region % 2 = 0 THEN 'print line' ELSE 'holo scratch' END FROM v_region WHERE severity >= 0.5e0"
    return with_views("v_region", body=f", r AS ({corner} UNION ALL {edge} UNION ALL {spot}) SELECT scan_id, face, area, location, severity, description, CASE WHEN severity >= 0.66e0 THEN 'Major' WHEN severity >= 0.33e0 THEN 'Moderate' ELSE 'Minor' END AS label, CAST(row_number() OVER (PARTITION BY scan_id ORDER BY severity DESC, face <> 'front', area, region, location, description) AS INT) AS rank FROM r").replace(") , r", "), r")


def _explained(spark: SparkSession, sf: str) -> DataFrame:
    regions, faces = view(spark, sf, "v_region"), view(spark, sf, "v_face")
    grades = grading.ranged(grading.graded(regions, faces).join(grading.confident(faces).select("scan_id", "base_confidence"), "scan_id"))
    measured = S.centering(faces).withColumn("surface_issues", S.surface_issues(F.col("density"), F.col("print_lines"), F.lit(False), F.col("gloss")))
    worst = regions.groupBy("scan_id", "face").agg(F.max("corner_w").alias("w"), F.max("edge_w").alias("e"), F.max("nicks").alias("n"))
    damaged = F.when(S.corner_damaged(F.col("w") * 4.0), S.corner_issue(F.col("w") * 4.0))
    measured = measured.join(worst, ["scan_id", "face"]).withColumn("corner_issues", F.array_compact(F.array(damaged))).withColumn("edge_issues", S.edge_issues(F.col("e"), F.col("n")))
    names = ["left_pct", "right_pct", "top_pct", "bottom_pct", "horizontal_ratio", "vertical_ratio", "surface_issues", "corner_issues", "edge_issues"]
    return grades.join(grading.paired(measured, names), "scan_id")


def explanations(spark: SparkSession, sf: str) -> DataFrame:
    rows = outlook.explanations(_explained(spark, sf))
    return rows.select("scan_id", "at", "category", "title", F.array_join("points", " ").alias("points"))


def _explanations_sql() -> str:
    head = _confidence_sql()
    cut = head.rindex(" SELECT c.scan_id")
    centred = f"m AS ({_centering_sql('v_face', 'scan_id, face, density, gloss, print_lines')})"
    worst = "x AS (SELECT scan_id, face, max(corner_w) * 4e0 AS w, max(edge_w) AS e, max(nicks) AS n FROM v_region GROUP BY ALL)"
    nick = "CASE WHEN n > 0 THEN concat(CAST(n AS VARCHAR), ' nick', CASE WHEN n > 1 THEN 's' ELSE '' END, ' detected') END"
    lines = "CASE WHEN print_lines > 0 THEN concat(CAST(print_lines AS VARCHAR), ' print line', CASE WHEN print_lines > 1 THEN 's' ELSE '' END) END"
    surf = f"concat_ws('; ', CASE WHEN density > 0.12e0 THEN 'widespread surface wear' WHEN density > 0.05e0 THEN 'scattered surface marks' END, {lines}, CASE WHEN gloss < 0.6e0 THEN 'uneven gloss' END)"
    num = lambda c: f"CAST({c} AS VARCHAR)"
    facet = f"y AS (SELECT m.*, CASE WHEN w > 0.12e0 THEN {Q.issue('w', S.CORNER_ISSUES)} ELSE '' END AS ci, concat_ws(', ', {Q.issue('e', S.EDGE_ISSUES)}, {nick}) AS ei, {surf} AS si FROM m JOIN x USING (scan_id, face))"
    side = lambda p, f: ", ".join(f"max(CASE WHEN face = '{f}' THEN {c} END) AS {p}_{c}" for c in ("left_pct", "right_pct", "top_pct", "bottom_pct", "horizontal_ratio", "vertical_ratio", "ci", "ei", "si"))
    wide = f"z AS (SELECT y.scan_id, {side('f', 'front')}, {side('b', 'back')} FROM y GROUP BY y.scan_id HAVING count(*) = 2)"
    top = "greatest(f_left_pct, f_right_pct, f_top_pct, f_bottom_pct)"
    points = {
        "centering": f"concat('Front horizontal centering measures ', {num('f_left_pct')}, '% / ', {num('f_right_pct')}, '% (', f_horizontal_ratio, '); vertical ', {num('f_top_pct')}, '% / ', {num('f_bottom_pct')}, '% (', f_vertical_ratio, '). ', CASE WHEN {top} <= 55 THEN 'Within PSA''s 55/45 threshold for Gem Mint centering.' WHEN {top} <= 60 THEN 'Within PSA 9 range (60/40) but outside Gem Mint tolerance — centering costs the top grade.' WHEN {top} <= 65 THEN 'Roughly 65/35 — centering caps this card around PSA 8.' ELSE 'Noticeably off-center; this is the dominant factor holding the grade down.' END, ' Back centering: ', {num('b_left_pct')}, '% / ', {num('b_right_pct')}, '% horizontal, ', {num('b_top_pct')}, '% / ', {num('b_bottom_pct')}, '% vertical.')",
        "corners": "CASE WHEN f_ci = '' AND b_ci = '' THEN 'All eight corners (front and back) appear sharp with no significant whitening detected.' ELSE concat_ws(' ', CASE WHEN f_ci <> '' THEN concat('Front corners: ', f_ci, '.') END, CASE WHEN b_ci <> '' THEN concat('Back corners: ', b_ci, '.') END) END",
        "edges": "CASE WHEN f_ei = '' AND b_ei = '' THEN 'Edges are clean on both faces — no whitening, silvering or nicks above detection threshold.' ELSE concat_ws(' ', CASE WHEN f_ei <> '' THEN concat('Front edges: ', f_ei, '.') END, CASE WHEN b_ei <> '' THEN concat('Back edges: ', b_ei, '.') END) END",
        "surface": "concat_ws(' ', CASE WHEN f_si = '' THEN 'Front surface is clean: no scratches, print lines or gloss breaks above detection threshold.' ELSE concat('Front surface findings: ', f_si, '.') END, CASE WHEN b_si <> '' THEN concat('Back surface findings: ', b_si, '.') END)",
        "overall": f"concat_ws(' ', CASE WHEN limiting_factor = 'centering' THEN concat('Centering cap: centering (', {num('centering')}, ') caps this card at ', {num('overall')}, ' (', {_labels_sql()}, ').') ELSE concat('Weakest-link rule: ', limiting_factor, ' sets the ceiling here — final ', {num('overall')}, ' (', {_labels_sql()}, ').') END, concat('Reported as a likely range of ', {num('low')}, '–', {num('high')}, '.'), CASE WHEN structural_cap IS NOT NULL THEN concat('Structural damage detected — the grade is automatically capped at ', {num('structural_cap')}, ' regardless of the other categories.') END)",
    }
    ranged = f"k AS ({head[cut + 1 :]}), a AS (SELECT g.*, k.low, k.high, z.* EXCLUDE (scan_id) FROM graded g JOIN k USING (scan_id) JOIN z USING (scan_id))"
    rows = " UNION ALL ".join(f"SELECT scan_id, {i} AS at, '{n}' AS category, concat('{n.capitalize()} — ', {num(n)}) AS title, {p} AS points FROM a" for i, (n, p) in enumerate(points.items()))
    return f"{head[:cut]}, {centred}, {worst}, {facet}, {wide}, {ranged} {rows}"


def _passes(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "v_pass").withColumn("pass", F.explode(F.array(*map(F.lit, range(3)))))
    return rows.withColumn("whitening", F.col("w") + ((F.col("pk") * 7 + F.col("pass") * 13) % 9) / 100.0)


def consensus_regions(spark: SparkSession, sf: str) -> DataFrame:
    w = F.col("whitening")
    rows = _passes(spark, sf).select("scan_id", "region", "pass", "whitening", S.corner_sharpness(w).alias("sharpness"), S.corner_score(w).alias("score"), S.corner_damaged(w).alias("damaged"), S.corner_issue(w).alias("issue"))
    return consensus.corners(rows, ["scan_id", "region"])


def consensus_edges(spark: SparkSession, sf: str) -> DataFrame:
    w, n = F.col("whitening"), ((F.col("pk") + F.col("pass")) % 3).cast("int")
    rows = _passes(spark, sf).select("scan_id", "region", "pass", "whitening", n.alias("nicks"), S.edge_score(w, n).alias("score"), S.edge_issues(w, n).alias("issues"))
    return consensus.edges(rows, ["scan_id", "region"]).withColumn("issues", F.array_join("issues", ", "))


def consensus_surfaces(spark: SparkSession, sf: str) -> DataFrame:
    d, g = F.col("whitening") / 2.0, F.lit(1.0) - F.col("t")
    rows = _passes(spark, sf).select("scan_id", "region", d.alias("density"), g.alias("gloss"), S.surface_score(d, F.col("pass"), g).alias("score"))
    return consensus.surfaces(rows, ["scan_id", "region"])


def consensus_defects(spark: SparkSession, sf: str) -> DataFrame:
    pk, p = F.col("pk"), F.col("pass")
    rows = _passes(spark, sf).select("scan_id", "region", "pass", F.when((pk + p) % 4 == 0, "print-line").otherwise(F.col("f")).alias("type"), (F.col("w") * 5.0 + ((pk * 7 + p * 13) % 9) / 100.0).alias("x"), (F.col("t") * 5.0 + ((pk * 5 + p * 11) % 7) / 100.0).alias("y"))
    return consensus.defects(rows, ["scan_id", "region"]).select("scan_id", "region", "type", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


_PASS = "p AS (SELECT *, w + ((pk * 7 + pass * 13) % 9) / 100e0 AS whitening FROM v_pass CROSS JOIN (VALUES (0), (1), (2)) n(pass))"


def _consensus_sql(body: str) -> str:
    return with_views("v_pass", body=f", {_PASS} {body}").replace(") , p", "), p")


_mean3 = lambda x, n=3: Q.jr(f"avg({x})", n)
_edge_nicks = "CAST((pk + pass) % 3 AS INT)"
_edge_text = f"concat_ws(', ', {Q.issue('whitening', S.EDGE_ISSUES)}, CASE WHEN {_edge_nicks} > 0 THEN concat(CAST({_edge_nicks} AS VARCHAR), ' nick', CASE WHEN {_edge_nicks} > 1 THEN 's' ELSE '' END, ' detected') END)"

QUERIES = {f.__name__: f for f in (grade_blend, centering_scores, surface_scores, quality_flags, grade_caps, confidence_gate, grade_labels, ladder_probabilities, submission_advice, defect_report, explanations, consensus_regions, consensus_edges, consensus_surfaces, consensus_defects)}

SQL = {
    "grade_blend": with_views("v_region", body="") + ", " + _blend_sql() + " SELECT * FROM blended",
    "centering_scores": with_views("v_center", body=f"SELECT a.*, b.left_mm FROM ({_centering_sql('v_center', 'scan_id, region, supp, part, left_px')}) a, LATERAL (SELECT {Q.jr('a.left_px * (63.5e0 / 635e0)', 2)} AS left_mm) b").replace("SELECT a.*, b", "SELECT a.* EXCLUDE (left_px), b"),
    "surface_scores": with_views("v_region", body=f"SELECT scan_id, part, region, {Q.surface_score('density', 'CAST(region % 3 AS INT)', 'gloss')} AS score, concat_ws('; ', CASE WHEN density > 0.12e0 THEN 'widespread surface wear' WHEN density > 0.05e0 THEN 'scattered surface marks' END, CASE WHEN region % 3 > 0 THEN concat(CAST(region % 3 AS VARCHAR), ' print line', CASE WHEN region % 3 > 1 THEN 's' ELSE '' END) END, CASE WHEN region = 7 THEN 'holo scratches' END, CASE WHEN gloss < 0.6e0 THEN 'uneven gloss' END) AS issues FROM v_region"),
    "quality_flags": with_views("v_quality", body=", f AS (SELECT event_id, sharpness < 45 AS blurry, glare > 0.06e0 AS too_much_glare, brightness < 55 AS too_dark, brightness > 215 AS too_bright, coverage < 0.25e0 AS too_far FROM v_quality) SELECT *, concat_ws(',', CASE WHEN blurry THEN 'blurry' END, CASE WHEN too_much_glare THEN 'too_much_glare' END, CASE WHEN too_dark THEN 'too_dark' END, CASE WHEN too_bright THEN 'too_bright' END, CASE WHEN too_far THEN 'too_far' END) AS warnings, NOT (blurry OR too_dark OR too_bright) AS usable FROM f").replace(") , f", "), f"),
    "grade_caps": with_views("v_region", "v_face", body="") + ", " + _caps_sql() + " SELECT * FROM graded",
    "confidence_gate": with_views("v_region", "v_face", body="") + ", " + _confidence_sql(),
    "grade_labels": with_views("v_history", body=f"SELECT id, overall, {_labels_sql()} AS label, CASE WHEN overall >= 9 THEN 'good' WHEN overall >= 7 THEN 'fair' WHEN overall >= 5 THEN 'worn' ELSE 'poor' END AS tone, CASE WHEN confidence >= 0.75e0 THEN 'high' WHEN confidence >= 0.5e0 THEN 'medium' ELSE 'low' END AS level FROM v_history"),
    "ladder_probabilities": _ladder_sql(),
    "submission_advice": with_views("v_history", body="SELECT id, overall >= 8 AS recommended, CASE WHEN overall >= 9 AND confidence >= 0.7e0 THEN 'Strong grading candidate' WHEN overall >= 8 THEN 'Worth considering' WHEN overall >= 6 THEN 'Likely not cost-effective' ELSE 'Not recommended' END AS headline FROM v_history"),
    "defect_report": _defects_sql(),
    "explanations": with_views("v_region", "v_face", body="") + ", " + _explanations_sql(),
    "consensus_regions": _consensus_sql(f"SELECT scan_id, region, {_mean3('whitening')} AS whitening, {_mean3(Q.clamp('1e0 - whitening * 2e0', 0, 1))} AS sharpness, {_mean3(Q.corner_score('whitening'), 1)} AS score, count(*) FILTER (whitening > 0.12e0) >= 2 AS damaged, CASE WHEN count(*) FILTER (whitening > 0.12e0) >= 2 THEN arg_min({Q.issue('whitening', S.CORNER_ISSUES)}, pass) FILTER (whitening > 0.12e0) END AS issue FROM p GROUP BY scan_id, region"),
    "consensus_edges": _consensus_sql(f"SELECT scan_id, region, {_mean3('whitening')} AS whitening, CAST({Q.jr(_mean3(_edge_nicks, 2))} AS INT) AS nicks, {_mean3(Q.edge_score('whitening', _edge_nicks), 1)} AS score, CASE WHEN count(*) FILTER ({_edge_text} <> '') >= 2 THEN arg_min({_edge_text}, pass) FILTER ({_edge_text} <> '') ELSE '' END AS issues FROM p GROUP BY scan_id, region"),
    "consensus_surfaces": _consensus_sql(f"SELECT scan_id, region, {_mean3('whitening / 2e0')} AS density, {_mean3('1e0 - t')} AS gloss, {_mean3(Q.surface_score('(whitening / 2e0)', 'pass', '(1e0 - t)'), 1)} AS score FROM p GROUP BY scan_id, region"),
    "consensus_defects": _consensus_sql(", d AS (SELECT scan_id, region, pass, CASE WHEN (pk + pass) % 4 = 0 THEN 'print-line' ELSE f END AS type, w * 5e0 + ((pk * 7 + pass * 13) % 9) / 100e0 AS x, t * 5e0 + ((pk * 5 + pass * 11) % 7) / 100e0 AS y FROM p) SELECT scan_id, region, type, round(x, 6) AS x, round(y, 6) AS y FROM d WHERE pass = 0 AND EXISTS (SELECT 1 FROM d o WHERE o.pass > 0 AND o.scan_id = d.scan_id AND o.region = d.region AND o.type = d.type AND sqrt((o.x - d.x) * (o.x - d.x) + (o.y - d.y) * (o.y - d.y)) < 0.06e0)").replace(") , d", "), d"),
}
