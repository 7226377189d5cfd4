"""URL allow and block lists: a trie over reversed host labels, then path prefixes.

The trie holds host labels from the right (``org``, then ``example``), and below each host the path prefixes
by segment, the last one of a rule possibly a part of a segment.  A url walks it once; of all rules met the
longest wins.  The trie is broadcast up to a checked number of rules; longer lists are joined instead, on the
host suffixes of each url.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ``(verdict, rule)``; a rule is a host, then a path that starts with a slash; a rule without a slash fits every path.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: A trie of more rules than this is not broadcast (about 1 kB each at most).
BROADCAST_RULES = 200_000
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: str = "url") -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path(url: str = "url") -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def split_rule(rule: str) -> tuple[str, str]:
    """``example.org/es/`` is the host ``example.org`` and the path ``/es/``."""
    name, slash, rest = rule.partition("/")
    return name.translate(str.maketrans(_UPPER, _LOWER)), slash + rest


def build_trie(rules: Iterable[tuple[str, str]]) -> dict:
    """Nested dicts: ``labels`` lead to longer hosts, ``segments`` to longer paths, ``ends`` holds rests of a path that match by prefix."""
    node = lambda: {"labels": {}, "path": {"segments": {}, "ends": []}}
    root = node()
    for verdict, rule in rules:
        name, prefix = split_rule(rule)
        at = root
        for label in reversed(name.split(".")):
            at = at["labels"].setdefault(label, node())
        at = at["path"]
        *whole, part = prefix.split("/")
        for segment in whole:
            at = at["segments"].setdefault(segment, {"segments": {}, "ends": []})
        at["ends"].append((part, len(name) + len(prefix), len(name), verdict == "block", rule, verdict))
    return root


def longest(trie: dict, name: str, prefix: str) -> tuple | None:
    """The rule that wins: the longest, then the longer host, then a block."""
    best, at = None, trie
    segments = prefix.split("/")
    for label in reversed(name.split(".")):
        at = at["labels"].get(label)
        if at is None:
            break
        below = at["path"]
        for segment in segments:
            for end in below["ends"]:
                if segment.startswith(end[0]) and (best is None or end[1:4] > best[1:4]):
                    best = end
            below = below["segments"].get(segment)
            if below is None:
                break
    return best


def judge(pages: DataFrame, rules: list[tuple[str, str]] | DataFrame = RULES, default: str = "allow") -> DataFrame:
    """Add ``host, path, rule, verdict`` to ``page_id``; urls that no rule fits get ``default`` and a null rule.

    Rules are a list or a DataFrame ``(verdict, rule)``.  A rule without a slash fits every path of its host; A-Z
    of a rule's host count as lower case; rules with a null part are left out; a rule whose host is empty fits
    only hosts whose last label is empty.  Null urls and urls without ``://`` have an empty host and path.  Of
    equal rules with both verdicts, block wins.  Rows are kept as they come, repeated ones too, and urls of any
    length are read whole; other columns are ignored; an empty table gives an empty result.
    """
    parts = pages.select("page_id", host().alias("host"), path().alias("path"))
    if isinstance(rules, DataFrame):
        if rules.count() > BROADCAST_RULES:
            return judge_by_join(parts, rules, default)
        rules = [(r.verdict, r.rule) for r in rules.select("verdict", "rule").toLocalIterator()]
    rules = [(verdict, rule) for verdict, rule in rules if verdict is not None and rule is not None]
    shared = pages.sparkSession.sparkContext.broadcast(build_trie(rules))

    @F.pandas_udf("rule string, verdict string")
    def walk(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        trie = shared.value
        for names, paths in batches:
            won = [longest(trie, n, p) for n, p in zip(names, paths, strict=True)]
            yield pd.DataFrame({"rule": [w and w[4] for w in won], "verdict": [w[5] if w else default for w in won]}, dtype=object)

    return parts.withColumn("won", walk("host", "path")).select("page_id", "host", "path", "won.rule", "won.verdict")


def judge_by_join(parts: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same for lists of any length: distinct ``(host, path)`` by their host suffixes against the rules' hosts."""
    cut = F.split("rule", "/", 2)
    rules = rules.where("verdict is not null and rule is not null")
    rules = rules.select("verdict", "rule", F.translate(cut[0], _UPPER, _LOWER).alias("suffix"), F.coalesce(F.concat(F.lit("/"), F.get(cut, F.lit(1))), F.lit("")).alias("prefix"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    distinct = parts.select("host", "path").distinct()
    fits = distinct.withColumn("suffix", F.explode(suffixes)).join(rules, "suffix").where(F.startswith("path", "prefix"))
    order = F.struct(F.length("rule"), F.length("suffix"), F.col("verdict") == "block", "rule", "verdict")
    won = fits.groupBy("host", "path").agg(F.max(order).alias("won"))
    return parts.join(won, ["host", "path"], "left").select("page_id", "host", "path", "won.rule", F.coalesce("won.verdict", F.lit(default)).alias("verdict"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))


SQL = {
    "op3_url_filter": r"""
        WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
        r(verdict, host, prefix) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
        f AS (SELECT p.*, r.host || r.prefix AS rule, r.verdict FROM p LEFT JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.prefix))
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f
        QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) = 1
    """,
}
