"""URL verdicts against plain matching; the cascade against sets."""

from __future__ import annotations

import random
import re

import pytest

from corpusmill.llm import cascade
from corpusmill.llm.queries import URL_RULES

URLS = [
    None, "", "no scheme/en/1", "http://example.org/es/", "HTTP://WWW.Example.ORG/es/x?y#z", "http://example.org/en/17.html", "http://notexample.org/en/1", "http://a.b.c.com/de/", "http://com/fr/x",
    "http://com", "http://x.com?de/", "http://x.com#/de/", "x://y://example.org/es/", "http://ÄÖ.ORG/", "http://a.org", "http://a.org/", "http:///de/", "http://a..com/de/", "http://.com/de/", "http://example.org:80/es/",
    "http://cheap-pills.example.net/x", "http://www.cheap-pills.example.net/", "http://example.net/cheap-pills", "http://x.com/DE/", "http://x.com/de", "http://a.org/\n/es/", "http://example.org/en/1", "http://sub.example.org/es/é",
]


def plain(url, rules, domains):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, verdict = max(fits, default=(0, None, None))
    if verdict is None:
        verdict = "block" if any(host == d or host.endswith("." + d) for d in domains) else "allow"
    return host, path, rule, verdict


def test_verdicts_equal_plain_matching(spark):
    rng = random.Random(3)
    urls = URLS + [f"http://{rng.choice(['a.', 'b.c.', ''])}{rng.choice(['example.org', 'x.com', 'loans.net', 'z.net'])}/{rng.choice(['es', 'en', 'de', 'fr'])}/{rng.randrange(99)}" for _ in range(300)]
    pages = spark.createDataFrame([(i % 250, u, "mine") for i, u in enumerate(urls)], "page_id long, url string, Host string")
    domains = {r["host"] for r in cascade.spam_domains(pages).collect()}
    assert domains == {"cheap-pills.example.net", "loans.net"}
    out = cascade.judged(pages, URL_RULES, cascade.spam_domains(pages))
    assert out.columns == ["page_id", "url", "Host", "host_", "path", "rule", "verdict"]
    got = sorted(map(repr, ((r["url"], r["host_"], r["path"], r["rule"], r["verdict"]) for r in out.collect())))
    assert got == sorted(map(repr, ((u, *plain(u, URL_RULES, domains)) for u in urls)))


@pytest.mark.parametrize(("listed", "others"), [(0, 50), (1, 2000), (300, 3000), (50, 0)])
def test_a_cascade_is_exact_over_its_universe(spark, listed, others):
    inside, outside = [f"in{i}" for i in range(listed)], [f"out{i}" for i in range(others)]
    universe = spark.createDataFrame([(k,) for k in inside + outside], "key string")
    made = cascade.build(spark.createDataFrame([(k,) for k in [*inside, "unseen"]], "key string"), universe)
    got = {r["key"]: r["x"] for r in universe.select("key", made.holds(universe["key"]).alias("x")).collect()}
    assert got == dict.fromkeys(inside, True) | dict.fromkeys(outside, False)


def test_no_rules_and_no_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    assert [(r["rule"], r["verdict"]) for r in cascade.judged(pages, []).collect()] == [(None, "allow")]
    assert cascade.judged(pages.limit(0), URL_RULES, cascade.spam_domains(pages.limit(0))).count() == 0


def test_a_list_beyond_the_bound_is_split(spark, monkeypatch):
    monkeypatch.setattr(cascade, "MAX_FILTER_BITS", 1024)
    universe = spark.range(6000).selectExpr("cast(id as string) key")
    made = cascade.build(spark.range(500).selectExpr("cast(id * 7 as string) key"), universe)
    assert len(made.cascades) > 2 and all(level.bits <= 1024 for c in made.cascades for level in c.levels)
    wrong = universe.where(made.holds(universe["key"]) != ((universe["key"].cast("int") % 7 == 0) & (universe["key"].cast("int") < 3500)))
    assert wrong.count() == 0


def test_a_very_long_url(spark):
    long = "http://sub.example.org/en/1" + "x" * 1_000_000
    pages = spark.createDataFrame([(1, long), (2, long)], "page_id long, url string")
    assert {(r["rule"], r["verdict"], len(r["path"])) for r in cascade.judged(pages, URL_RULES).collect()} == {("example.org/en/1", "block", 1_000_005)}
