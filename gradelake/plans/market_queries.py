"""Queries on names, matching, prices, history and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake.functions import text as T
from gradelake.operators import evaluation, history, matching, pricing, search
from gradelake.plans import sqltext as Q
from gradelake.plans.views import view, with_views

_RAW_NUMBER = "concat('00', number, '/', CAST(printed_total AS VARCHAR))"


def name_norm(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "v_catalog").select("id", T.key(F.col("name")).alias("norm"), T.plain_card_name(F.concat("name", F.lit(" #12 4/102"))).alias("plain"), T.era(F.col("release_date"), F.col("set_name")).alias("era"), T.capitals(F.concat(F.col("name"), F.lit("'s-x"))).alias("title"))


def collector_number(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.lit("00"), F.col("number"), F.lit("/"), F.col("printed_total").cast("string"))
    coded = F.concat(F.lit(" TG"), F.col("number"), F.lit("/TG30"))
    return view(spark, sf, "v_catalog").select("id", T.collector_number(raw).alias("plain"), T.collector_number(coded).alias("coded"), T.printed_total(raw).alias("total"), T.printed_total(coded).alias("coded_total"))


def ocr_clean(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("x\n  "), F.col("name"), F.lit(" 120 HP!\nstage"))
    number = F.concat(F.lit("No. 0"), F.col("number"), F.lit(" / "), F.col("printed_total").cast("string"))
    alone = F.concat(F.lit("code SV"), F.col("number"))
    return view(spark, sf, "v_catalog").select("id", T.read_name(text).alias("name"), T.read_number(number).alias("number"), T.read_number(alone).alias("alone"), T.read_number(F.lit("none")).alias("nothing"))


def text_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """How like each name that was read is to the true one, and to the set's name."""
    rows = view(spark, sf, "v_request").where("name is not null")
    return rows.select("query_id", T.similarity(F.col("name"), F.col("true_name")).alias("sim"), T.similarity(F.col("name"), F.col("true_set")).alias("set_sim"))


#: The query set of searches.
SEARCHED = "query_id % 50 = 0"


def _species(spark: SparkSession, sf: str) -> DataFrame:
    first = F.substring_index("name", " ", 1)
    names = view(spark, sf, "v_catalog").groupBy(first.alias("display")).agg(F.min("id").alias("ord"))
    return names.select("ord", "display", T.key(F.col("display")).alias("norm"))


def _trainers(spark: SparkSession, sf: str) -> DataFrame:
    names = view(spark, sf, "v_catalog").groupBy(F.col("name").alias("display")).agg(F.min("id").alias("ord"))
    return names.select("ord", "display", T.key(F.col("display")).alias("norm"))


def name_snap(spark: SparkSession, sf: str) -> DataFrame:
    names = view(spark, sf, "v_request").select(F.concat(F.lit("dark "), F.substring_index("name", " ", 1), F.lit(" vmaxx")).alias("name")).unionByName(view(spark, sf, "v_request").select("name"))
    return matching.snap_names(names, _species(spark, sf), _trainers(spark, sf))


def art_knn(spark: SparkSession, sf: str) -> DataFrame:
    index = view_embeddings(spark, sf)
    queries = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return matching.nearest(queries.where(SEARCHED), index).select("query_id", "id", F.round("art", 8).alias("art"), "rank")


def view_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")


def _matched(spark: SparkSession, sf: str, asked: str = "true") -> DataFrame:
    requests = view(spark, sf, "v_request").where(asked)
    vectors = requests.select("query_id", "vector")
    # As many requests as rows skip what cannot be near; a stated few meet all rows.
    shortlist = search.Cells(view_embeddings(spark, sf)).nearest(vectors) if asked == "true" else matching.nearest(vectors, view_embeddings(spark, sf))
    return matching.hybrid_match(shortlist, requests, view(spark, sf, "v_catalog"))


def hybrid_match(spark: SparkSession, sf: str) -> DataFrame:
    return _matched(spark, sf, SEARCHED).select("query_id", "id", "name", "art_score", "text_score", "score", "method")


def identity_fallback(spark: SparkSession, sf: str) -> DataFrame:
    requests = view(spark, sf, "v_colors").select("query_id")
    found = matching.identity(_matched(spark, sf))
    return matching.with_fallback(requests, found, matching.heuristic_identity(view(spark, sf, "v_colors")))


def recognition_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    truth = view(spark, sf, "v_request").select("query_id", "true_name", "true_set")
    found = _matched(spark, sf).select("query_id", "name", "set_name")
    return evaluation.recognition(truth.join(found, "query_id", "left"))


def _knn(asked: str, queries: str = "(SELECT query_id, vector FROM v_request)") -> str:
    return f""", i AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT query_id, CAST(vector AS DOUBLE[]) AS v FROM {queries} w WHERE {asked}),
    il AS (SELECT id, v, sqrt(list_dot_product(v, v)) AS len FROM i), ql AS (SELECT query_id, v, sqrt(list_dot_product(v, v)) AS len FROM q),
    k AS (SELECT query_id, id, round(list_dot_product(ql.v, il.v) / ql.len / il.len, 12) AS art FROM ql CROSS JOIN il),
    n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY art DESC, id) AS rank FROM k QUALIFY rank <= 25)"""


_TEXT = f"""least(1e0, coalesce(CASE WHEN length(trim(r.name)) >= 2 THEN {Q.similarity('trim(r.name)', 'c.name')} * 0.6e0 END, 0e0)
    + CASE WHEN {Q.collector_number('r.number')} = {Q.collector_number('c.number')} THEN 0.4e0 ELSE 0e0 END)"""


def _match(asked: str = "true") -> str:
    """The fold over each shortlist in order of rank: a score above the rounded best so far wins."""
    entry = f"struct_pack(rank := rank, id := id, name := name, set_name := set_name, number := number, release_date := release_date, art := art, txt := txt, total := total, shown := {Q.jr('total', 3)})"
    return (
        _knn(asked)
        + f""", t AS (SELECT n.query_id, n.id, c.name, c.set_name, c.number, c.release_date, n.art, n.rank, {_TEXT} AS txt FROM n JOIN v_catalog c ON n.id = c.id JOIN v_request r ON n.query_id = r.query_id),
    u AS (SELECT *, art * 0.6e0 + txt * 0.6e0 AS total FROM t),
    w AS (SELECT query_id, list_reduce(list({entry} ORDER BY rank), lambda won, x: CASE WHEN x.total > won.shown THEN x ELSE won END) AS x FROM u GROUP BY query_id),
    m AS (SELECT query_id, x.id AS id, x.name AS name, x.set_name AS set_name, x.number AS number, x.release_date AS release_date, x.art AS art, x.txt AS txt, x.total AS total FROM w)"""
    )


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "v_ask")


def catalog_search(spark: SparkSession, sf: str) -> DataFrame:
    return pricing.search(_asked(spark, sf), view(spark, sf, "v_catalog")).select("query_id", "id", "found_at", "numbered")


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    return pricing.ranked(pricing.search(_asked(spark, sf), view(spark, sf, "v_catalog")), _asked(spark, sf))


def candidate_rank(spark: SparkSession, sf: str) -> DataFrame:
    return _candidates(spark, sf).select("query_id", "id", "rank", "raw")


def set_match(spark: SparkSession, sf: str) -> DataFrame:
    return pricing.match_set(_candidates(spark, sf), _asked(spark, sf)).select("query_id", "id", "set_name")


def alternatives(spark: SparkSession, sf: str) -> DataFrame:
    candidates = _candidates(spark, sf)
    return pricing.alternatives(candidates, pricing.match_set(candidates, _asked(spark, sf))).select("query_id", "id", "place")


def market_record(spark: SparkSession, sf: str) -> DataFrame:
    chosen = pricing.match_set(_candidates(spark, sf), _asked(spark, sf)).select("query_id", "id", "name", "raw")
    records = pricing.market_records(_asked(spark, sf), chosen)
    return records.select("query_id", "id", "name", "raw", "identified", T.money(F.col("raw"), F.lit("USD")).alias("shown"))


def price_pick(spark: SparkSession, sf: str) -> DataFrame:
    i, raw = F.col("id"), F.col("raw")
    entry = lambda name, ok, x: F.struct(F.lit(name).alias("key"), F.when(ok, raw * x).alias("market"))
    variants = F.array(entry("promo", i % 3 == 0, 3.0), entry("normal", i % 2 == 0, 1.0), entry("holofoil", i % 5 == 0, 2.0))
    price = pricing.pick_price(variants, F.when(i % 13 == 0, F.lit(7.5)), F.when(i % 17 == 0, F.lit(6.5)))
    return view(spark, sf, "v_catalog").select("id", price.alias("p")).select("id", "p.amount", "p.currency", "p.source")


def graded_values(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "v_catalog").select("id", "raw", (F.lit(1.0) + F.col("id") % 19 * 0.5).alias("grade"))
    return pricing.graded_values(rows)


def history_retention(spark: SparkSession, sf: str) -> DataFrame:
    return history.retain(view(spark, sf, "v_history")).select("user_id", "id", "favorite", "place")


def recent_scans(spark: SparkSession, sf: str) -> DataFrame:
    return history.recent(history.summary(view(spark, sf, "v_history"))).select("user_id", "id", "place")


def history_upsert(spark: SparkSession, sf: str) -> DataFrame:
    scans = history.summary(view(spark, sf, "v_history"))
    new = scans.where("id % 10 = 0").withColumn("overall", F.lit(10.0))
    index = history.delete(history.upsert(scans, new), scans.where("id % 7 = 0"))
    index = history.toggle_favorites(index, scans.where("id % 3 = 0"))
    return history.attach(index, scans.where("id % 4 = 0").select("id", F.lit(0.5).alias("confidence")), "confidence").select("id", "overall", "favorite", "confidence")


def dashboard_stats(spark: SparkSession, sf: str) -> DataFrame:
    return history.statistics(view(spark, sf, "v_history"))


def strided_sample(spark: SparkSession, sf: str) -> DataFrame:
    return history.strided(view(spark, sf, "v_catalog").select("id", "name"), "id", 40)


def calibration_report(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.calibration(view(spark, sf, "v_calibration"))


def bias_by_factor(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.bias_by(view(spark, sf, "v_calibration"), "factor")


_NEWEST = "ORDER BY release_date DESC NULLS LAST, id"
_ASK = f"""a AS (SELECT query_id, name AS asked, set_name AS asked_set, {Q.collector_number('number')} AS want, {Q.printed_total('number')} AS total FROM v_ask WHERE length(trim(name)) >= 2)"""
_FITS = """len(list_filter(string_split_regex(lower(asked), ' +'), lambda t: t <> '' AND len(list_filter(string_split_regex(lower(name), ' +'), lambda w: starts_with(w, t))) = 0)) = 0"""
_SEARCH = f""", {_ASK}, p AS (SELECT asked, name FROM (SELECT DISTINCT asked FROM a) x CROSS JOIN (SELECT DISTINCT name FROM v_catalog) y WHERE {_FITS}),
    s AS (SELECT a.*, c.*, coalesce(CAST({Q.collector_number('c.number')} = want AS INT), 0) AS hit FROM a JOIN p ON a.asked = p.asked JOIN v_catalog c ON c.name = p.name),
    f AS (SELECT *, row_number() OVER (PARTITION BY query_id {_NEWEST}) AS found_at FROM (SELECT *, max(hit) OVER (PARTITION BY query_id) AS best FROM s) x WHERE hit = best QUALIFY found_at <= 50)"""
_RANK = f""", r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coalesce({Q.collector_number('number')} = want, false) DESC, coalesce(printed_total = total, false) DESC, (raw IS NOT NULL) DESC, coalesce(release_date, '') DESC, found_at) AS rank FROM f QUALIFY rank <= 12)"""
_CHOSEN = f""", h AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY coalesce({Q.key('set_name')} = nullif({Q.key('asked_set')}, ''), false) DESC, rank) = 1)"""


def _with(*views: str, body: str) -> str:
    return with_views(*views, body="").rstrip() + " " + body


_MULT = "CASE WHEN g >= 10 THEN 5e0 WHEN g = 9 THEN 2e0 WHEN g = 8 THEN 1.3e0 WHEN g = 7 THEN 1e0 WHEN g = 6 THEN 0.9e0 WHEN g = 5 THEN 0.8e0 ELSE greatest(0.6e0, g / 10e0) END"
_COLORS = ", c0 AS (SELECT query_id, CASE WHEN r > 150 AND g > 120 AND b < 110 AND r + g > b * 2.2e0 THEN 'yellow' WHEN abs(r - g) < 20 AND abs(g - b) < 20 AND r > 130 THEN 'silver' END AS frame, CASE WHEN art_variance > 2600 THEN 'holo' WHEN lower_variance > 2600 THEN 'reverse-holo' ELSE 'none' END AS holo FROM v_colors)"

QUERIES = {
    f.__name__: f
    for f in (name_norm, collector_number, ocr_clean, text_similarity, name_snap, art_knn, hybrid_match, identity_fallback, recognition_accuracy, catalog_search, candidate_rank, set_match, alternatives, market_record, price_pick, graded_values, history_retention, recent_scans, history_upsert, dashboard_stats, strided_sample, calibration_report, bias_by_factor)
}

_SPLIT = """, raw AS (SELECT DISTINCT name FROM (SELECT concat('dark ', split_part(name, ' ', 1), ' vmaxx') AS name FROM v_request WHERE name IS NOT NULL UNION ALL SELECT name FROM v_request) u WHERE length(trim(name)) >= 2),
    sp AS (SELECT split_part(name, ' ', 1) AS display, min(id) AS ord FROM v_catalog GROUP BY 1), tr AS (SELECT name AS display, min(id) AS ord FROM v_catalog GROUP BY 1),
    sw(w, shown, nth) AS (VALUES """ + ", ".join(f"('{k}', '{v}', {i})" for i, (k, v) in enumerate(matching.SUFFIXES.items())) + """), pw(w, shown, nth) AS (VALUES """ + ", ".join(f"('{k}', '{v.replace(chr(39), chr(39) * 2)}', {i})" for i, (k, v) in enumerate(matching.PREFIXES.items())) + """),
    tok AS (SELECT name, unnest(string_split_regex(lower(trim(name)), ' +')) AS t, generate_subscripts(string_split_regex(lower(trim(name)), ' +'), 1) AS i FROM raw),
    lab AS (SELECT tok.*, (SELECT arg_min(shown, nth + 100 * CAST(w <> t AS INT)) FROM sw WHERE w = t OR (length(t) > 2 AND length(w) > 2 AND levenshtein(t, w) <= 1)) AS suf, (SELECT arg_min(shown, nth + 100 * CAST(w <> t AS INT)) FROM pw WHERE w = t OR (length(t) > 2 AND length(w) > 2 AND levenshtein(t, w) <= 1)) AS pre FROM tok),
    cut AS (SELECT name, string_agg(suf, ' ' ORDER BY i) AS sufs, string_agg(CASE WHEN suf IS NULL THEN pre END, ' ' ORDER BY i) AS pres, coalesce(string_agg(CASE WHEN suf IS NULL AND pre IS NULL THEN t END, '' ORDER BY i), '') AS joined, string_agg(CASE WHEN suf IS NULL AND pre IS NULL THEN concat(upper(substr(t, 1, 1)), substr(t, 2)) END, ' ' ORDER BY i) AS title FROM lab GROUP BY name),
    bs AS (SELECT cut.name, display, """ + Q.similarity("joined", "display") + """ AS sim FROM cut, sp WHERE length(joined) >= 2 QUALIFY row_number() OVER (PARTITION BY cut.name ORDER BY sim DESC, ord) = 1 AND sim > 0),
    bt AS (SELECT cut.name, display, """ + Q.similarity("cut.name", "display") + """ AS sim FROM cut, tr QUALIFY row_number() OVER (PARTITION BY cut.name ORDER BY sim DESC, ord) = 1 AND sim >= 0.62e0),
    o AS (SELECT cut.name, coalesce(bs.display, nullif(title, '')) AS base, pres, sufs, bs.sim AS s_sim, bt.display AS o_name, bt.sim AS o_sim FROM cut LEFT JOIN bs ON cut.name = bs.name LEFT JOIN bt ON cut.name = bt.name),
    z AS (SELECT *, CASE WHEN base IS NOT NULL THEN concat_ws(' ', pres, base, sufs) END AS shown, CASE WHEN base IS NOT NULL THEN coalesce(s_sim, 0e0) END AS sim0 FROM o)
    SELECT name, CASE WHEN o_sim > coalesce(sim0, -1e0) THEN o_name ELSE shown END AS snapped, CASE WHEN o_sim > coalesce(sim0, -1e0) THEN o_sim ELSE sim0 END AS sim FROM z"""

SQL = {
    "name_norm": _with("v_catalog", body=f"SELECT id, {Q.key('name')} AS norm, trim(regexp_replace(regexp_replace(concat(name, ' #12 4/102'), '\\s*[0-9]+\\s*/\\s*[0-9]+\\s*$', ''), '\\s*#?[0-9]{{1,3}}\\s*$', '')) AS plain, coalesce(concat(substr(release_date, 1, 4), ' · ', set_name), set_name) AS era, concat(array_to_string(list_transform(string_split(name, ' '), lambda w: concat(upper(substr(w, 1, 1)), substr(w, 2))), ' '), '''S-X') AS title FROM v_catalog").replace("concat(substr(release_date, 1, 4), ' · ', set_name)", "substr(release_date, 1, 4) || ' · ' || set_name"),
    "collector_number": _with("v_catalog", body=f"SELECT id, {Q.collector_number(_RAW_NUMBER)} AS plain, lower(concat('TG', number)) AS coded, printed_total AS total, 30 AS coded_total FROM v_catalog"),
    "ocr_clean": _with("v_catalog", body="SELECT id, trim(regexp_replace(regexp_replace(concat(name, ' 120 HP!'), '[^A-Za-z''.\\- ]', ' ', 'g'), ' +', ' ', 'g')) AS name, concat(CAST(CAST(number AS INT) AS VARCHAR), '/', CAST(printed_total AS VARCHAR)) AS number, concat('SV', number) AS alone, CAST(NULL AS VARCHAR) AS nothing FROM v_catalog"),
    "text_similarity": _with("v_request", body=f"SELECT query_id, {Q.similarity('name', 'true_name')} AS sim, {Q.similarity('name', 'true_set')} AS set_sim FROM v_request WHERE name IS NOT NULL"),
    "name_snap": _with("v_request", "v_catalog", body=_SPLIT),
    "art_knn": "WITH " + _knn(SEARCHED, "(SELECT vec_id AS query_id, embedding AS vector FROM embeddings)").lstrip(", ") + (" SELECT query_id, id, round(art, 8) AS art, CAST(rank AS INT) AS rank FROM n"),
    "hybrid_match": _with("v_request", "v_catalog", body=_match(SEARCHED) + f" SELECT query_id, id, name, {Q.jr('art', 3)} AS art_score, {Q.jr('txt', 3)} AS text_score, {Q.jr('total', 3)} AS score, CASE WHEN txt > 0 THEN 'art+text' ELSE 'art' END AS method FROM m"),
    "identity_fallback": _with("v_request", "v_catalog", "v_colors", body=_match() + _COLORS + f" SELECT c.query_id, m.name, m.set_name, m.number, coalesce(substr(release_date, 1, 4) || ' · ' || set_name, set_name) AS era, CASE WHEN m.id IS NOT NULL THEN 'unknown' ELSE holo END AS holo, coalesce(CASE WHEN m.id IS NOT NULL THEN least(1e0, greatest(0e0, {Q.jr('total', 3)})) END, CASE WHEN frame IS NOT NULL THEN 0.45e0 ELSE 0.2e0 END) AS confidence, CASE WHEN m.id IS NOT NULL THEN 'match' ELSE 'heuristic' END AS source FROM c0 c LEFT JOIN m ON c.query_id = m.query_id"),
    "recognition_accuracy": _with("v_request", "v_catalog", body=_match() + f", e AS (SELECT coalesce({Q.key('m.name')} = {Q.key('q.true_name')}, false) AS n, q.true_set IS NOT NULL AS l, coalesce({Q.key('m.set_name')} = {Q.key('q.true_set')}, false) AS s FROM v_request q LEFT JOIN m ON q.query_id = m.query_id) SELECT count(*) AS photos, count(*) FILTER (n) AS names_right, count(*) FILTER (l) AS sets_labelled, count(*) FILTER (l AND s) AS sets_right, {Q.jr('count(*) FILTER (n) / CAST(count(*) AS DOUBLE)', 4)} AS name_accuracy, {Q.jr('count(*) FILTER (l AND s) / CAST(nullif(count(*) FILTER (l), 0) AS DOUBLE)', 4)} AS set_accuracy FROM e"),
    "catalog_search": _with("v_ask", "v_catalog", body=_SEARCH + " SELECT query_id, id, CAST(found_at AS INT) AS found_at, hit = 1 AS numbered FROM f"),
    "candidate_rank": _with("v_ask", "v_catalog", body=_SEARCH + _RANK + " SELECT query_id, id, CAST(rank AS INT) AS rank, raw FROM r"),
    "set_match": _with("v_ask", "v_catalog", body=_SEARCH + _RANK + _CHOSEN + " SELECT query_id, id, set_name FROM h"),
    "alternatives": _with("v_ask", "v_catalog", body=_SEARCH + _RANK + _CHOSEN + " SELECT r.query_id, r.id, CAST(row_number() OVER (PARTITION BY r.query_id ORDER BY r.rank) AS INT) AS place FROM r LEFT JOIN h ON r.query_id = h.query_id AND r.id = h.id WHERE h.id IS NULL QUALIFY place <= 6"),
    "market_record": _with("v_ask", "v_catalog", body=_SEARCH + _RANK + _CHOSEN + " SELECT a.query_id, h.id, h.name, h.raw, h.id IS NOT NULL AS identified, CASE WHEN h.raw IS NOT NULL THEN concat('$', format('{:,.2f}', h.raw)) END AS shown FROM a LEFT JOIN h ON a.query_id = h.query_id"),
    "price_pick": _with("v_catalog", body=", p AS (SELECT id, coalesce(CASE WHEN id % 5 = 0 THEN raw * 2e0 END, CASE WHEN id % 2 = 0 THEN raw * 1e0 END, CASE WHEN id % 3 = 0 THEN raw * 3e0 END) AS usd, CASE WHEN id % 13 = 0 THEN 7.5e0 WHEN id % 17 = 0 THEN 6.5e0 END AS eur FROM v_catalog) SELECT id, coalesce(usd, eur) AS amount, CASE WHEN usd IS NOT NULL THEN 'USD' WHEN eur IS NOT NULL THEN 'EUR' END AS currency, CASE WHEN usd IS NOT NULL THEN 'TCGplayer' WHEN eur IS NOT NULL THEN 'Cardmarket' END AS source FROM p"),
    "graded_values": _with("v_catalog", body=f", g AS (SELECT id, raw, CAST(floor(1e0 + id % 19 * 0.5e0 + 0.5e0) AS BIGINT) AS g FROM v_catalog WHERE raw > 0) SELECT id, concat('PSA ', CAST(g AS VARCHAR), ' (est.)') AS label, {Q.jr(f'raw * {_MULT}', 2)} AS amount, true AS estimated FROM g UNION ALL SELECT id, 'PSA 10 ceiling (est.)', {Q.jr('raw * 5e0', 2)}, true FROM g WHERE g < 10"),
    "history_retention": _with("v_history", body="SELECT user_id, id, favorite, CAST(row_number() OVER (PARTITION BY user_id ORDER BY favorite DESC, created_at DESC, id DESC) AS INT) AS place FROM v_history QUALIFY place <= 24"),
    "recent_scans": _with("v_history", body="SELECT user_id, id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS INT) AS place FROM v_history QUALIFY place <= 12"),
    "history_upsert": _with("v_history", body="SELECT id, CASE WHEN id % 10 = 0 THEN 10e0 ELSE overall END AS overall, favorite <> (id % 3 = 0) AS favorite, CASE WHEN id % 4 = 0 THEN 0.5e0 ELSE confidence END AS confidence FROM v_history WHERE id % 7 <> 0"),
    "dashboard_stats": _with("v_history", body=f"SELECT user_id, count(*) AS scans, {Q.jr('avg(overall)', 1)} AS mean_grade, max(overall) AS best_grade, count(*) FILTER (overall >= 9.5e0) AS gems FROM v_history GROUP BY user_id"),
    "strided_sample": _with("v_catalog", body="SELECT id, name FROM (SELECT id, name, row_number() OVER (ORDER BY id) - 1 AS p, greatest(1, CAST(count(*) OVER () AS BIGINT) // 40) AS step FROM v_catalog) s WHERE p % step = 0 AND p < step * 40"),
    "calibration_report": _with("v_calibration", body=f"SELECT count(*) AS cards, {Q.jr('avg(abs(pred - truth))', 3)} AS mean_error, {Q.jr('avg(pred - truth)', 3)} AS bias, count(*) FILTER (truth >= low AND truth <= high) AS in_range, count(*) FILTER (abs(pred - truth) <= 1) AS within_one FROM v_calibration"),
    "bias_by_factor": _with("v_calibration", body=f"SELECT factor, count(*) AS cards, {Q.jr('avg(pred - truth)', 3)} AS bias FROM v_calibration GROUP BY factor"),
}
