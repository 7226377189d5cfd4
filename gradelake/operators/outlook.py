"""From grades to what they mean: likely grades per company, advice, defect reports and explanations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradelake.functions.numeric import to_decimals
from gradelake.functions.text import spaced
from gradelake.operators import scoring as S
from gradelake.operators.grading import label

#: Company, strictness, and whether it gives half points from 5 up.
COMPANIES = [("PSA", 0.15, False), ("BGS", 0.30, True), ("CGC", 0.20, True)]
SHARPNESS = 2.2


def rungs(halves: bool) -> list[float]:
    """The grades of a company, from the top."""
    return [g / 2 for g in range(20, 1, -1) if g % 2 == 0 or (halves and g > 10)]


def ladder(df: DataFrame, keys: list[str], top: int = 3) -> DataFrame:
    """The likeliest grades of each company for ``overall`` and ``confidence``: softmax over the distance to the grade.

    Every row meets each company once.  The weights of its rungs are plain columns, so they are compiled; since they
    fall with the distance, only the rungs around the target are ranked, ``top`` to either side.  Of equal weights the
    higher grade comes first.
    """
    grades = {company: rungs(halves) for company, _, halves in COMPANIES}
    most = max(map(len, grades.values()))
    steps = F.explode(F.array(*[F.struct(F.lit(c).alias("company"), F.lit(s).alias("strictness"), F.array(*map(F.lit, grades[c])).alias("grades"), F.lit(h).alias("halves")) for c, s, h in COMPANIES]))
    out = df.select(*keys, "overall", "confidence", steps.alias("x")).select(*keys, "overall", "confidence", "x.*")
    at = F.col("overall") - F.col("strictness")
    score = lambda g: -F.abs(g - (F.col("overall") - F.col("strictness"))) / (F.lit(1.6) - F.col("confidence"))
    # The nearest grade in closed form.
    whole = F.least(F.lit(10.0), F.greatest(F.lit(1.0), F.rint(at)))
    half = F.least(F.lit(10.0), F.greatest(F.lit(5.0), F.rint(at * 2.0) / 2.0))
    out = out.withColumn("best", F.greatest(score(whole), F.when(F.col("halves"), score(half))))
    weight = lambda g: F.exp((score(g) - F.col("best")) * SHARPNESS)
    rung = lambda k: F.get("grades", k)
    total, above = F.lit(0.0), F.lit(0)
    for k in range(most):
        total = total + F.coalesce(weight(rung(F.lit(k))), F.lit(0.0))
        above = above + F.coalesce((rung(F.lit(k)) > at).cast("int"), F.lit(0))
    first = F.greatest(F.lit(0), F.least(F.size("grades") - 2 * top, above - top))
    out = out.select(*keys, "company", "overall", "confidence", "strictness", "grades", "best", total.alias("total"), first.alias("first"))
    near = [F.struct(weight(rung(F.col("first") + k)).alias("w"), rung(F.col("first") + k).alias("grade")).alias(f"n{k}") for k in range(2 * top)]
    out = out.select(*keys, "company", "total", *near)
    places = [F.greatest(*[F.col(f"n{k}") for k in range(2 * top)]).alias("r1")]
    for r in range(2, top + 1):
        out = out.select("*", places[-1])
        places.append(F.greatest(*[F.when(F.col(f"n{k}") < F.col(f"r{r - 1}"), F.col(f"n{k}")) for k in range(2 * top)]).alias(f"r{r}"))
    out = out.select(*keys, "company", "total", *[F.col(f"r{r}") for r in range(1, top)], places[-1])
    ranks = F.explode(F.array(*[F.struct(F.lit(r).alias("rank"), F.col(f"r{r}").alias("x")) for r in range(1, top + 1)]))
    out = out.select(*keys, "company", "total", ranks.alias("y"))
    return out.select(*keys, "company", "y.rank", F.col("y.x.grade").alias("grade"), to_decimals(F.col("y.x.w") / F.col("total"), 2).alias("probability"))


def likeliest(scans: DataFrame, estimates: DataFrame, company: str = "PSA") -> DataFrame:
    """``scans`` with ``grade``: the likeliest grade of the company where there is an estimate, else ``overall``.

    ``estimates`` has ``id, company, rank, grade`` as :func:`ladder` gives them.
    """
    first = estimates.where((F.col("company") == company) & (F.col("rank") == 1)).select("id", F.col("grade").alias("_likeliest"))
    return scans.join(first, "id", "left").withColumn("grade", F.coalesce("_likeliest", "overall")).drop("_likeliest")


def advice(overall: Column, confidence: Column) -> Column:
    """Whether to submit the card, and a headline."""
    what = lambda yes, line: F.struct(F.lit(yes).alias("recommended"), F.lit(line).alias("headline"))
    return F.when((overall >= 9) & (confidence >= 0.7), what(True, "Strong grading candidate")).when(overall >= 8, what(True, "Worth considering")).when(overall >= 6, what(False, "Likely not cost-effective")).otherwise(what(False, "Not recommended"))


def whole_percent(share: Column) -> Column:
    return F.concat(to_decimals(share * 100.0).cast("int").cast("string"), F.lit("%"))


def defect_report(corners: DataFrame, edges: DataFrame, defects: DataFrame) -> DataFrame:
    """Every reportable defect of all faces, worst first within a scan, the front before the back.

    ``corners``: scan_id, face, region, whitening, damaged, issues; ``edges``: ... whitening, nicks, issues;
    ``defects``: scan_id, face, type, x, y, severity.  ``region`` orders what a face has.
    """
    side = F.initcap("face")
    issues = F.array_join("issues", ", ")
    corner = corners.where("damaged or whitening > 0.15").select("scan_id", "face", "region", F.lit("Corner").alias("area"), F.concat(side, F.lit(" "), spaced(F.col("corner"))).alias("location"), F.col("whitening").alias("severity"), F.when(F.size("issues") > 0, issues).otherwise(F.concat(whole_percent(F.col("whitening")), F.lit(" whitening"))).alias("description"))
    nicks = F.when(F.col("nicks") > 0, F.concat(F.col("nicks").cast("string"), F.lit(" nick"), F.when(F.col("nicks") > 1, "s").otherwise("")))
    edge = edges.where("size(issues) > 0 or nicks > 0").select("scan_id", "face", "region", F.lit("Edge").alias("area"), F.concat(side, F.lit(" "), F.col("edge")).alias("location"), F.greatest("whitening", F.least(F.lit(1.0), F.col("nicks") / 4.0)).alias("severity"), F.array_join(F.concat("issues", F.array_compact(F.array(nicks))), ", ").alias("description"))
    spot = defects.select("scan_id", "face", "region", F.lit("Surface").alias("area"), F.concat(side, F.lit(" @ "), whole_percent(F.col("x")), F.lit(", "), whole_percent(F.col("y"))).alias("location"), "severity", F.replace("type", F.lit("-"), F.lit(" ")).alias("description"))
    rows = corner.unionByName(edge).unionByName(spot).withColumn("label", S.severity_label(F.col("severity")))
    order = Window.partitionBy("scan_id").orderBy(F.col("severity").desc(), F.col("face") != "front", "area", "region", "location", "description")
    return rows.withColumn("rank", F.row_number().over(order))


def explanations(df: DataFrame) -> DataFrame:
    """``category, title, points`` per scan, from its grade row with the front's and back's measurements.

    Points keep the order in which they are listed; what does not apply is left out.
    """
    c = F.col
    worst = F.greatest("f_left_pct", "f_right_pct", "f_top_pct", "f_bottom_pct")
    say = lambda text, *a: F.format_string(text, *[c(x) if isinstance(x, str) else x for x in a])
    # The sentences.
    band = F.when(worst <= 55, "Within PSA's 55/45 threshold for Gem Mint centering.").when(worst <= 60, "Within PSA 9 range (60/40) but outside Gem Mint tolerance — centering costs the top grade.").when(worst <= 65, "Roughly 65/35 — centering caps this card around PSA 8.").otherwise("Noticeably off-center; this is the dominant factor holding the grade down.")
    clean_corners = F.when((F.size("f_corner_issues") + F.size("b_corner_issues")) == 0, "All eight corners (front and back) appear sharp with no significant whitening detected.")
    clean_edges = F.when((F.size("f_edge_issues") + F.size("b_edge_issues")) == 0, "Edges are clean on both faces — no whitening, silvering or nicks above detection threshold.")
    surface = F.when(F.size("f_surface_issues") == 0, "Front surface is clean: no scratches, print lines or gloss breaks above detection threshold.").otherwise(F.concat(F.lit("Front surface findings: "), F.array_join("f_surface_issues", "; "), F.lit(".")))
    back_surface = F.when(F.size("b_surface_issues") > 0, F.concat(F.lit("Back surface findings: "), F.array_join("b_surface_issues", "; "), F.lit(".")))
    bound = F.when(c("limiting_factor") == "centering", say("Centering cap: centering (%s) caps this card at %s (%s).", "centering", "overall", label(c("overall")))).otherwise(say("Weakest-link rule: %s sets the ceiling here — final %s (%s).", "limiting_factor", "overall", label(c("overall"))))
    cap = F.when(c("structural_cap").isNotNull(), say("Structural damage detected — the grade is automatically capped at %s regardless of the other categories.", "structural_cap"))
    listed = {
        "centering": [say("Front horizontal centering measures %s%% / %s%% (%s); vertical %s%% / %s%% (%s).", "f_left_pct", "f_right_pct", "f_horizontal_ratio", "f_top_pct", "f_bottom_pct", "f_vertical_ratio"), band, say("Back centering: %s%% / %s%% horizontal, %s%% / %s%% vertical.", "b_left_pct", "b_right_pct", "b_top_pct", "b_bottom_pct")],
        "corners": [clean_corners, *[F.when(F.size(f"{s}_corner_issues") > 0, F.concat(F.lit(f"{n} corners: "), F.array_join(f"{s}_corner_issues", ", "), F.lit("."))) for s, n in (("f", "Front"), ("b", "Back"))]],
        "edges": [clean_edges, *[F.when(F.size(f"{s}_edge_issues") > 0, F.concat(F.lit(f"{n} edges: "), F.array_join(f"{s}_edge_issues", ", "), F.lit("."))) for s, n in (("f", "Front"), ("b", "Back"))]],
        "surface": [surface, back_surface],
        "overall": [bound, say("Reported as a likely range of %s–%s.", "low", "high"), cap],
    }
    parts = [F.struct(F.lit(i).alias("at"), F.lit(name).alias("category"), F.concat(F.lit(f"{name.capitalize()} — "), c(name).cast("string")).alias("title"), F.array_compact(F.array(*points)).alias("points")) for i, (name, points) in enumerate(listed.items())]
    return df.select("scan_id", F.explode(F.array(*parts)).alias("x")).select("scan_id", "x.at", "x.category", "x.title", "x.points")
