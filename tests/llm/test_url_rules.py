"""URL rules against running every expression on every URL."""

from __future__ import annotations

import re

from geoledger.llm import queries, url_rules as U

URLS = [
    "http://example.com/en/1", "https://WWW.Example.com/en/1?x", "http://a.www.example.com/en/", "http://example.com/EN/", "http://notexample.com/en/", "http://x.net/es/1",
    "http://net/fr/", "http://x.net", "http://x.net?/es/", "ftp://h.com#/", "no scheme/en/", "://", "", None, "http://spam-farm.example.org/en/1", "http://www.cheap-pills.example.com/en/",
    "http://spam-farmer.org/", "http://x.com/spam-farm.org", "http://example.com/en/" + "a" * 30_000, "http://u:p@free-bets.net:80/", "http://x\n.com/a\nb://c/d",
]


def plain(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [r for r in rules if re.search(r.pattern, host + path)]
    best = min(fits, key=lambda r: (r.tier, -r.weight, r.rule), default=None)
    return host, path, best and best.rule, best.verdict if best else "allow"


def test_rules(spark):
    rules = [U.host_path_rule(*r) for r in queries.SITE_RULES] + [U.host_word_rule(w) for w in queries.BLOCKED_WORDS]
    rules.append(U.Rule("digits", "[0-9]{3}", (), "block", 2))
    urls = URLS + URLS[:3] + [f"http://s{i}.org/{i}" for i in range(150)]
    pages = spark.createDataFrame([(i, u, "x", 5) for i, u in enumerate(urls)], "page_id long, url string, rule string, token int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.filter_urls(pages, U.rules_frame(spark, rules)).collect()}
    assert got == {i: plain(u, rules) for i, u in enumerate(urls)}
    assert U.filter_urls(pages.limit(0), U.rules_frame(spark, rules)).collect() == []
    assert {r.verdict for r in U.filter_urls(pages, U.rules_frame(spark, [])).collect()} == {"allow"}


def test_no_python_on_the_way(spark):
    from ..conftest import SF

    plan = queries.QUERIES["op10_url_rules"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct|NestedLoop", plan)
