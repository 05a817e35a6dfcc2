from __future__ import annotations

import random

import pytest

from skysieve.llm import url_cascade
from skysieve.llm.url_cascade import Cascade, judge_urls


def brute(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host, tail = rest[:cut], rest[cut:]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        path = tail[: min([i for i in (tail.find(c) for c in "?#") if i >= 0], default=len(tail))]
    fits = []
    for rule, verdict in rules:
        if rule:
            h, slash, p = rule.partition("/")
            h, p = h.lower(), slash + p
            if host and (host == h or host.endswith("." + h)) and path.startswith(p):
                fits.append((len(h + p), len(h), verdict == "block", h + p, verdict))
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else default


RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
URLS = [
    None, "", "no scheme", "http://", "://net/", "http://net", "http://net/", "https://a.net/x", "http://xnet/",
    "http://EXAMPLE.net/en/1", "http://www.example.net/en/", "http://www.example.net/EN/", "http://example.net/en",
    "http://example.net?en/", "http://example.net#/en/", "http://b.example.com/de/?q", "http://example.com/deu",
    "http://x.org/fr/1#t", "http://org/fr/", "ftp://a://b.net/", "http://a.net:80/", "http://u@a.net/", "http://.net/",
    "http://a..net/x", "http://a.net./", "http://ÄB.net/\n/x", "http://" + "a." * 3000 + "net/" + "p/" * 3000,
]


def judged(spark, urls, rules):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").repartition(3)
    listed = spark.createDataFrame(rules, "rule string, verdict string")
    rows = judge_urls(pages, listed).collect()
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}


def test_contract_rules(spark):
    got = judged(spark, URLS, RULES)
    assert [got[i] for i in range(len(URLS))] == [brute(u, RULES) for u in URLS]


def test_many_rules_with_paths_conflicts_and_duplicates(spark, monkeypatch):
    monkeypatch.setattr(url_cascade, "MISTAKES", 0.5)  # many levels
    rng = random.Random(4)
    hosts = [".".join(rng.choice("abcd") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    rules = [(rng.choice(hosts) + rng.choice(["", "/", "/x", "/x/", "/xy/z/"]), rng.choice(["allow", "block"])) for _ in range(80)]
    rules += [(None, "block"), ("", "allow"), rules[0]]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/x', '/x/y', '/xy/z/1', '?/x'])}" for _ in range(300)] + URLS
    got = judged(spark, urls, rules)
    assert [got[i] for i in range(len(urls))] == [brute(u, rules) for u in urls]


def test_long_lists_are_judged_in_slices(spark, monkeypatch):
    monkeypatch.setattr(url_cascade, "LEVEL_BITS", 10)
    got = judged(spark, URLS, RULES)
    assert [got[i] for i in range(len(URLS))] == [brute(u, RULES) for u in URLS]


@pytest.mark.parametrize("mistakes", [0.02, 0.6])
def test_cascade_is_exact_over_its_universe(spark, monkeypatch, mistakes):
    monkeypatch.setattr(url_cascade, "MISTAKES", mistakes)
    universe = spark.range(4000).selectExpr("cast(id as string) as key")
    listed = universe.where("key % 7 = 0").unionAll(spark.sql("select 'not in the corpus'"))
    cascade = Cascade(listed, universe, "x")
    took = cascade.carry(universe).where(cascade.has(universe["key"])).select("key").collect()
    assert sorted(int(r.key) for r in took) == list(range(0, 4000, 7))
    assert len(cascade.levels) > (3 if mistakes > 0.5 else 1)


def test_empty_tables_and_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "http://a.net/", "h", "r")], "page_id long, url string, host string, rule string")
    rules = spark.createDataFrame(RULES, "rule string, verdict string")
    row = judge_urls(pages, rules).first()
    assert (row.host, row.rule, row.verdict) == ("a.net", "net/", "block")
    assert judge_urls(pages.limit(0), rules).collect() == []
    row = judge_urls(pages, rules.limit(0), default="block").first()
    assert (row.host, row.rule, row.verdict) == ("a.net", None, "block")
