"""Catalog search, candidate ranking, price choice and projected graded values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradelake.functions import text as T
from gradelake.functions.numeric import to_decimals

#: Rows a search returns, and of these the ones that are ranked for display.
PAGE, SHOWN, ALTERNATIVES = 50, 12, 6
#: Price variants in order of preference.
VARIANTS = ["holofoil", "reverseHolofoil", "1stEditionHolofoil", "unlimitedHolofoil", "normal", "1stEdition"]
#: Multiple of the raw price by grade.
MULTIPLES = {10: 5.0, 9: 2.0, 8: 1.3, 7: 1.0, 6: 0.9, 5: 0.8}


#: Characters of a name's words that requests are joined by.
PREFIX = 3


def matching_names(asked: DataFrame, names: DataFrame) -> DataFrame:
    """``asked, name``: which distinct ``name`` each distinct ``asked`` fits; every word asked begins a word of the name.

    Joined on the first characters of the request's longest word: as many as ``PREFIX``, or all it has.
    """
    tokens = F.filter(F.split(F.lower(F.regexp_replace("asked", r"[^A-Za-z0-9 '.\-]", " ")), r"\s+"), lambda t: t != "")
    longest = F.array_max(F.transform(tokens, lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"]
    keyed = asked.select("asked").distinct().withColumn("key", F.substring(longest, 1, PREFIX))
    heads = F.flatten(F.transform(F.split(F.lower("name"), " +"), lambda w: F.array(*[F.substring(w, 1, i) for i in range(1, PREFIX + 1)])))
    words = names.select("name").distinct().withColumn("key", F.explode(F.array_distinct(heads)))
    return keyed.join(words, "key").where(T.word_prefixes(F.col("name"), F.col("asked"))).select("asked", "name").distinct()


def search(requests: DataFrame, catalog: DataFrame, page: int = PAGE) -> DataFrame:
    """The newest ``page`` catalog rows of each request: every word asked begins a word of the name, and the number is equal.

    A request with a number that finds nothing is answered without its number.  Requests with a name of under
    two characters are left out.  Names are matched once each.  Of every name, and of every name and number, only the
    newest ``page`` rows can be among the answers, so the others are cut before requests meet them.
    """
    asked = requests.where(F.length(F.trim("name")) >= 2).select("query_id", F.col("name").alias("asked"), T.collector_number(F.col("number")).alias("_number"))
    met = asked.join(matching_names(asked, catalog), "asked").select("query_id", "_number", "name")
    rows = catalog.withColumn("_own", T.collector_number(F.col("number")))
    newest = [F.col("release_date").desc_nulls_last(), "id"]
    cut = lambda *keys: rows.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*newest))).where(F.col("_at") <= page).drop("_at")
    numbered = met.where("_number is not null").join(cut("name", "_own").withColumnRenamed("_own", "_number"), ["name", "_number"])
    found = numbered.select("query_id").distinct()
    other = met.join(found, "query_id", "left_anti").join(cut("name").drop("_own"), "name")
    columns = ["query_id", *catalog.columns]
    both = numbered.select(*columns, F.lit(True).alias("numbered")).unionByName(other.select(*columns, F.lit(False).alias("numbered")))
    return both.withColumn("found_at", F.row_number().over(Window.partitionBy("query_id").orderBy(*newest))).where(F.col("found_at") <= page)


def pick_price(variants: Column, trend: Column, average: Column) -> Column:
    """``amount, currency, source``: the first priced variant by preference, then by its order in ``variants``, then the two other figures.

    ``variants`` is an array of ``key, market`` in its source's order.  A price of 0 is a price.
    """
    priced = F.filter(variants, lambda v: v["market"].isNotNull())
    of = lambda name: F.get(F.filter(priced, lambda v: v["key"] == name), 0)["market"]
    market = F.coalesce(*map(of, VARIANTS), F.get(priced, 0)["market"])
    other = F.coalesce(trend, average)
    price = lambda amount, currency, source: F.struct(amount.alias("amount"), F.lit(currency).alias("currency"), F.lit(source).alias("source"))
    return F.when(market.isNotNull(), price(market, "USD", "TCGplayer")).when(other.isNotNull(), price(other, "EUR", "Cardmarket"))


def ranked(found: DataFrame, requests: DataFrame, shown: int = SHOWN) -> DataFrame:
    """Search results in order: equal number, equal printed total, priced, newest; ``shown`` per request."""
    asked = requests.select("query_id", T.collector_number(F.col("number")).alias("_number"), T.printed_total(F.col("number")).alias("_total"))
    met = found.join(asked, "query_id", "left")
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("int").desc()
    order = Window.partitionBy("query_id").orderBy(yes(T.collector_number(F.col("number")) == F.col("_number")), yes(F.col("printed_total") == F.col("_total")), F.col("raw").isNotNull().cast("int").desc(), F.coalesce("release_date", F.lit("")).desc(), "found_at")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= shown).drop("_number", "_total")


def multiple(grade: Column) -> Column:
    """For a whole grade."""
    out = F.greatest(F.lit(0.6), grade / 10.0)
    for g, m in MULTIPLES.items():
        out = F.when(grade == g if g < 10 else grade >= g, m).otherwise(out)
    return out


def graded_values(df: DataFrame) -> DataFrame:
    """``label, amount, estimated`` per row of ``raw, grade``: the likely grade's value, and the ceiling below grade 10.

    Rows without a positive price give none.
    """
    grade = F.floor(F.col("grade") + F.lit(0.5))
    likely = F.struct(F.concat(F.lit("PSA "), grade.cast("string"), F.lit(" (est.)")).alias("label"), to_decimals(F.col("raw") * multiple(grade), 2).alias("amount"))
    ceiling = F.struct(F.lit("PSA 10 ceiling (est.)").alias("label"), to_decimals(F.col("raw") * MULTIPLES[10], 2).alias("amount"))
    values = F.array_compact(F.array(likely, F.when(grade < 10, ceiling)))
    kept = [c for c in df.columns if c not in ("raw", "grade")]
    return df.where("raw > 0").select(*kept, F.explode(values).alias("x")).select(*kept, "x.label", "x.amount", F.lit(True).alias("estimated"))


def market_records(requests: DataFrame, chosen: DataFrame) -> DataFrame:
    """One record per request: what was chosen, its raw price, and whether anything was found."""
    out = requests.select("query_id").join(chosen, "query_id", "left")
    return out.withColumn("identified", F.col("id").isNotNull())


def match_set(candidates: DataFrame, identities: DataFrame) -> DataFrame:
    """The first candidate of the recognised set, else the first one."""
    sets = identities.select("query_id", T.or_null(T.key(F.col("set_name"))).alias("_set"))
    met = candidates.join(sets, "query_id", "left")
    order = Window.partitionBy("query_id").orderBy(F.coalesce(T.key(F.col("set_name")) == F.col("_set"), F.lit(False)).desc(), "rank")
    return met.withColumn("_at", F.row_number().over(order)).where("_at = 1").drop("_at", "_set")


def alternatives(candidates: DataFrame, selected: DataFrame, n: int = ALTERNATIVES) -> DataFrame:
    """Other candidates than the selected, the best ``n``."""
    rest = candidates.join(selected.select("query_id", "id"), ["query_id", "id"], "left_anti")
    order = Window.partitionBy("query_id").orderBy("rank")
    return rest.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
