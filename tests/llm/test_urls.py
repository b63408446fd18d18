"""Url rules and vocabulary: boundaries, subdomains, longest rule, odd urls."""

from __future__ import annotations

import re
from random import Random

import pytest
from pyspark.sql import functions as F

from occgraph.llm import urls
from occgraph.llm.queries import URL_RULES


def judged(spark, given, rules=URL_RULES, weights=None):
    rows = spark.createDataFrame(list(enumerate(given)), "page_id long, url string")
    return [(r["verdict"]["host"], r["verdict"]["path"], r["verdict"]["rule"], r["verdict"]["verdict"]) for r in urls.url_verdicts(rows, rules, weights).orderBy("page_id").collect()]


def test_hosts_and_paths(spark):
    given = [None, "", "no scheme.com/x", "http://", "HTTP://WWW.É.Org", "x://A.org?b#c/d", "a://b://c/d", "http://h.org/p?q=/r", "http://h.org#f", "http://h.org/a\nb c", "https://u@h.org:80/x/"]
    assert [x[:2] for x in judged(spark, given)] == [
        ("", ""), ("", ""), ("", ""), ("", ""), ("www.É.org", ""), ("a.org", ""), ("b:", "//c/d"), ("h.org", "/p"), ("h.org", ""), ("h.org", "/a\nb c"), ("u@h.org:80", "/x/")]
    assert {x[3] for x in judged(spark, given)} == {"allow"}


def test_longest_rule_wins(spark):
    given = {
        "http://a.com/x": ("com/", "allow"), "http://a.com": (None, "allow"), "http://casino.com": (None, "block"), "http://casino.com/": ("com/", "allow"),
        "http://example.com/en/1": ("example.com/en/", "block"), "http://b.example.com/en/": ("example.com/en/", "block"), "http://b.example.com/en": ("com/", "allow"),
        "http://www.example.com/en/x": ("www.example.com/en/", "allow"), "http://x.www.example.com/en/x": ("www.example.com/en/", "allow"), "http://myexample.com/en/": ("com/", "allow"),
        "http://net/es/1": ("net/es/", "block"), "http://a.net/fr/": ("net/fr/", "block"), "http://a.internet/fr/": (None, "allow"), "http://a.net/EN/": (None, "allow"), "http://a.com.": (None, "allow"),
    }
    assert [x[2:] for x in judged(spark, given)] == list(given.values())
    tied = [("allow", "a.b/cd"), ("block", "x.a.b/"), ("allow", "b"), ("block", "b")]
    assert [x[2:] for x in judged(spark, ["z://x.a.b/cde", "z://c.b"], tied)] == [("a.b/cd", "allow") if len("a.b/cd") > len("x.a.b/") else ("x.a.b/", "block"), ("b", "block")]
    assert [x[2:] for x in judged(spark, ["z://q/r", None], [("block", "/r")])] == [("/r", "block"), (None, "allow")]


def test_terms_stand_alone(spark):
    weights = {"sex": 3, "free": 2, "win": 1, "hot-deal": 1, "x": 1}
    given = {
        "http://sussex.org/": "allow", "http://sex.org/": "block", "http://a.org/SEX": "block", "http://a.org/my-sex": "block", "http://a.org/sex2": "allow",
        "http://free.org/free/free": "allow", "http://free.org/win": "block", "http://win.org/x/hot-deal": "block", "http://win.org/hot-deals/x": "allow", "http://win.org/?free": "allow",
        "http://free.org/ésex": "block",
    }
    assert [x[3] for x in judged(spark, given, [], weights)] == list(given.values())
    assert [x[3] for x in judged(spark, given, [], {})] == ["allow"] * len(given)
    for bad in ({"": 3}, {"-x": 3}, {"é": 3}):
        with pytest.raises(ValueError):
            urls.judge([], bad)
    with pytest.raises(ValueError):
        urls.judge([("maybe", "a/")])


def test_automaton_equals_patterns():
    r = Random(3)
    words = urls.Vocabulary(urls.VOCABULARY)
    for _ in range(3000):
        text = "".join(r.choice(["sex", "cam", "s", "free", "-", ".", "/", "bet", "ads", "x", "casino", "win", "é", "1"]) for _ in range(r.randint(0, 12)))
        assert words.terms(text) == {t for t in urls.VOCABULARY if re.search(f"(?<![a-z0-9]){t}(?![a-z0-9])", text)}


def test_other_columns_stay(spark):
    rows = spark.createDataFrame([(1, "http://a.com/x", "own", "own"), (1, "http://a.com/x", "own", "own"), (2, "http://a.org/" + "free-" * 200_000, "own", "own")], "page_id long, url string, verdict string, rule string")
    out = urls.url_verdicts(rows, URL_RULES)
    assert out.columns == ["page_id", "url", "verdict", "rule", "verdict_"] and out.filter("verdict = 'own' AND rule = 'own'").count() == 3
    assert [r["verdict"] for r in out.orderBy("page_id").select(F.col("verdict_.verdict").alias("verdict")).collect()] == ["allow"] * 3
    assert urls.url_verdicts(rows.limit(0), URL_RULES).count() == 0
