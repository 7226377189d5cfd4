"""URL rules against a plain scan of all rules."""

import random

import pytest
from pyspark.sql import functions as F

from gradelake.llm import url_filter as U


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    n = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n])
    rest = rest[n:]
    return host, rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]


def brute(url, rules, default="allow"):
    host, path = parse(url)
    fits = []
    for verdict, rule in rules:
        name, prefix = U.split_rule(rule)
        if (host == name or host.endswith("." + name)) and path.startswith(prefix):
            fits.append((len(rule), len(name), verdict == "block", rule, verdict))
    won = max(fits, default=None)
    return (host, path, won and won[3], won[4] if won else default)


URLS = [None, "", "no scheme", "http://", "http://EXAMPLE.org/es/1", "https://a.b.example.org/en/148.html?x#y", "http://example.org", "http://org/", "x://notexample.org/en/1", "ftp://a.com/fr/", "http://a.com/de/2?z=://q/", "://com/fr/", "http://com/FR/", "http://É.com/de/", "http://example.org:80/es/", "a\n://example.org/es/\nb", "http://.org/", "http://org./", "//x://org/"]


def judged(spark, urls, rules=U.RULES):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").withColumn("host", F.lit("clash")).withColumn("rule", F.lit("clash"))
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge(pages, rules).collect()}


def test_contract_rules(spark):
    assert judged(spark, URLS) == {i: brute(u, U.RULES) for i, u in enumerate(URLS)}


@pytest.mark.parametrize("limit", [U.BROADCAST_RULES, 0])
def test_random_rules(spark, monkeypatch, limit):
    """By trie, and by join where the list is too long for one."""
    monkeypatch.setattr(U, "BROADCAST_RULES", limit)
    rng = random.Random(8)
    hosts = ["com", "a.com", "b.a.com", "org", "x.org", "a.x.org"]
    paths = ["/", "/a", "/a/", "/a/b", "/ab/c/", "/b"]
    rules = list({(rng.choice(["allow", "block"]), rng.choice(hosts) + rng.choice(paths)) for _ in range(25)})
    urls = [f"http://{rng.choice(['', 'w.'])}{rng.choice(hosts)}{rng.choice(['', '/', '/a', '/a/b/c', '/ab', '/ab/c/d', '/b?q'])}" for _ in range(200)]
    table = spark.createDataFrame(rules, "verdict string, rule string")
    assert judged(spark, urls, table) == {i: brute(u, rules) for i, u in enumerate(urls)}


def test_empty(spark):
    assert U.judge(spark.createDataFrame([], "page_id bigint, url string")).count() == 0


@pytest.mark.parametrize("limit", [U.BROADCAST_RULES, 0])
def test_rules_of_a_host_only(spark, monkeypatch, limit):
    monkeypatch.setattr(U, "BROADCAST_RULES", limit)
    rules = [("block", "example.org"), ("allow", "example.org/es/"), ("allow", "a.example.org"), ("block", "com")]
    urls = [*URLS, "http://example.org?q", "http://a.example.org/x/y", "http://b.example.org/es"]
    table = spark.createDataFrame(rules, "verdict string, rule string")
    assert judged(spark, urls, table) == {i: brute(u, rules) for i, u in enumerate(urls)}


@pytest.mark.parametrize("limit", [U.BROADCAST_RULES, 0])
def test_odd_rules(spark, monkeypatch, limit):
    """Null parts leave a rule out, hosts in upper case fit, repeated rows stay, and long urls are read whole."""
    monkeypatch.setattr(U, "BROADCAST_RULES", limit)
    rules = [("block", "Example.ORG/es/"), (None, "com/"), ("allow", None), ("block", "long.com/" + "a" * 5000)]
    urls = ["http://example.org/es/1", "http://a.com/", "http://long.com/" + "a" * 5000 + "b", "http://long.com/" + "a" * 4999, "http://example.org/es/1"]
    got = judged(spark, urls, spark.createDataFrame(rules, "verdict string, rule string"))
    assert [got[i][3] for i in range(5)] == ["block", "allow", "block", "allow", "block"]
    assert got[0][2] == got[4][2] == "Example.ORG/es/"
