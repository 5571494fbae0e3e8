"""Url rules against a scan over all rules."""

import random

import pytest

from quillspark.llm.queries import RULES
from quillspark.llm.url_rules import Rule, Trie, judge, split_url


def scan(rules, host, path):
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: (len(r.text), r.verdict == "block"), default=None)


def test_split():
    assert [split_url(u) for u in (None, "", "a.org/x", "HTTP://Ex.ORG/A?b#c", "x://h#f/", "x://h?q", "a://b://c/d", "://", "x://É.Org/é")] == [
        ("", ""), ("", ""), ("", ""), ("ex.org", "/A"), ("h", ""), ("h", ""), ("b:", "//c/d"), ("", ""), ("É.org", "/é")]


def test_trie_is_the_scan():
    r = random.Random(3)
    names, parts = ["org", "com", "a", "b.org", "a.b.org", "com.org", ""], ["", "/", "/e", "/en/", "/en/1", "/en/12/x", "/fr"]
    for _ in range(200):
        rules = [Rule(r.choice(["allow", "block"]), r.choice(names), r.choice(parts)) for _ in range(r.randint(0, 6))] + RULES
        trie = Trie(rules)
        for _ in range(60):
            host = r.choice(["x.", "", "."]) + r.choice(names + ["example.org", "example.com", "xorg", "org.", "org:80"])
            path = r.choice(parts + ["/en/123", "/e/n", "//", "/es/1", "/de/", "/fr/q", "x"])
            want, got = scan(rules, host, path), trie.longest(host, path)
            assert (got and (len(got.text), got.verdict)) == (want and (len(want.text), want.verdict)), (rules, host, path)


def test_edges(spark):
    urls = [(1, "https://A.example.org/es/1"), (2, None), (None, "https://x.org"), (3, "http://w.example.org/en/17?x"), (3, "http://w.example.org/en/17?x"), (4, "http://b.com/fr/" + "p" * 100_000)]
    docs = spark.createDataFrame([(a, b, "r", 1) for a, b in urls], "page_id long, url string, rule string, id int")
    got = sorted((str(r.page_id), r.rule, r.verdict) for r in judge(docs, RULES).collect())
    assert got == [("1", "example.org/es/", "block"), ("2", None, "allow"), ("3", "example.org/en/1", "block"), ("3", "example.org/en/1", "block"), ("4", "com/fr/", "allow"), ("None", None, "allow")]
    assert judge(docs.limit(0), RULES).collect() == []


def test_rule_hosts_in_capitals_and_bounds(monkeypatch):
    assert Trie([Rule("block", "Example.ORG", "/A")]).longest("w.example.org", "/Ab").text == "Example.ORG/A"
    monkeypatch.setattr("quillspark.llm.url_rules.MOST_CHARACTERS", 10)
    with pytest.raises(ValueError):
        Trie([Rule("block", "example.org", "/")])
