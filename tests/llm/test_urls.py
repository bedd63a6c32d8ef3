"""URL rules, features and verdicts."""

import math

import pytest

from rowmend.llm.urls import FEATURES, judged_urls, parse_rule, with_features, host_of, path_of
from pyspark.sql import functions as F

RULES = [parse_rule(r) for r in ("block net/", "allow example.net/en/", "block example.com/de/", "allow org/fr/")]


def judged(rows, urls, rules=RULES):
    table = rows([(i, u, "h", "p") for i, u in enumerate(urls)], "page_id long, url string, host string, label string")
    return {r["id"]: r for r in judged_urls(table, rules).collect()}


def test_hosts_paths_and_rules(rows):
    cases = [
        (None, "", "", None), ("", "", "", None), ("no scheme/x", "", "", None),
        ("http://A.Example.NET/en/1?q=/de/#f", "a.example.net", "/en/1", "example.net/en/"),
        ("http://example.net/EN/", "example.net", "/EN/", "net/"),
        ("http://notexample.net", "notexample.net", "", None),
        ("http://badexample.net/en/x", "badexample.net", "/en/x", "net/"),
        ("x://org/fr/", "org", "/fr/", "org/fr/"), ("http://morg/fr/", "morg", "/fr/", None),
        ("a://b.org://c.net/", "b.org:", "//c.net/", None),
        ("http://example.com?x=/de/", "example.com", "", None), ("http://ÄB.com/Ü", "Äb.com", "/Ü", None),
        ("http://sub.example.com/de/", "sub.example.com", "/de/", "example.com/de/"),
        ("://net/", "net", "/", "net/"), ("http:///x", "", "/x", None),
    ]
    got = judged(rows, [c[0] for c in cases])
    for number, (_, host, path, rule) in enumerate(cases):
        assert (got[number]["host"], got[number]["path"], got[number]["rule"]) == (host, path, rule)
    verdicts = {r.text: r.verdict for r in RULES}
    assert all(got[n]["verdict"] == verdicts[c[3]] for n, c in enumerate(cases) if c[3])


def test_trees_learn_the_look_of_a_url(rows):
    r = range(120)
    bad = [f"http://h{i}.net/{i}{i}{i}/{i * 7919}?a={i}&b={i * 31}&c=1" for i in r]
    good = [f"http://h{i}.example.net/en/page-of-words" for i in r]
    new = [f"http://q{i}.com/{i}{i}{i}/{i * 7907}?a={i}&b={i * 37}&c=1" for i in range(20)] + [
        f"http://q{i}.example.com/en/some-more-words" for i in range(20)]
    got = judged(rows, bad + good + new)
    assert [got[240 + i]["verdict"] for i in range(40)] == ["block"] * 20 + ["allow"] * 20


def test_nothing_to_learn_from_allows(rows, no_rows):
    assert {r["verdict"] for r in judged(rows, ["http://x.com/", None]).values()} == {"allow"}
    assert judged(rows, ["http://x.net/", "http://x.com/"])[1]["verdict"] == "allow"
    assert {r["rule"] for r in judged(rows, ["http://x.net/"], []).values()} == {None}
    table = rows([(1, "http://x.net/")], "page_id long, url string")
    assert judged_urls(no_rows(table), RULES).count() == 0
    twice = rows([(1, "http://x.net/"), (1, "http://x.net/"), (None, "http://x.net/")], "page_id long, url string")
    assert judged_urls(twice, RULES).count() == 3


def test_features(rows):
    url = "http://a.b.net/x/y1?p=1&q=2#z"
    table = rows([(url,), (None,), ("",)], "url string").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    first, none, empty = with_features(table).collect()
    shares = [url.count(c) / len(url) for c in set(url)]
    assert first["entropy"] == pytest.approx(-sum(p * math.log2(p) for p in shares))
    assert (first["host_depth"], first["path_depth"], first["parameters"], first["has_fragment"]) == (3, 2, 2, 1)
    assert first["digit_ratio"] == pytest.approx(3 / len(url)) and first["suffix"] == "net"
    assert [none[f] for f in FEATURES[:9]] == [empty[f] for f in FEATURES[:9]] == [0.0] * 9


def test_rules_are_checked():
    for line in ("deny net/", "block net", "block /x", ""):
        with pytest.raises(ValueError):
            parse_rule(line)


def test_no_python_in_the_plan(spark, rows):
    table = rows([(i, f"http://a{i}.{'net' if i % 2 else 'example.net/en'}/{i}") for i in range(40)], "page_id long, url string")
    plan = judged_urls(table, RULES)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
