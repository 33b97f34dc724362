"""Operator 12 against a plain version."""

import random
import re

import pytest

from lattica.llm import url_filter as U
from lattica.llm.queries import RULES

PAGES = "page_id long, url string, host string, rule string"


def plain(url, rules=RULES, vocabulary=U.VOCABULARY, limit=U.LIMIT):
    host = path = ""
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    if m:
        host, path = re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]
    fit = [r for r in rules if (host == (h := r.partition("/")[0]) or host.endswith("." + h)) and path.startswith("/" + r.partition("/")[2])]
    rule = max(fit, key=lambda r: (len(r), r.find("/"))) if fit else None
    low = re.sub("[A-Z]", lambda x: x[0].lower(), url or "")
    found = {t: len(re.findall(rf"(?<![a-z0-9]){re.escape(t)}(?![a-z0-9])", low)) for t in vocabulary}
    weight = sum(vocabulary[t] for t, n in found.items() if n)
    return (host, path, rule, rules[rule] if rule else "block" if weight >= limit else "allow", sum(n for t, n in found.items() if vocabulary[t] >= limit), sum(n > 0 for t, n in found.items() if vocabulary[t] < limit), weight)


URLS = [
    None, "", "no scheme", "://", "http://", "https://NET", "https://net/", "http://a.net", "http://a.net/x", "http://anet/x", "http://example.net/en/1", "http://EXAMPLE.net/en", "http://sub.example.net/EN/1", "http://x.example.com/de/", "http://xexample.com/de/",
    "http://a.org/fr/1?porn", "http://a.org/de/porn", "http://a.info/porn", "http://pornography.info/", "http://a.info/free/free/free", "http://a.info/free-win", "http://a.info/FREE_WIN", "http://a.info?free#win", "http://é.info/freeé/win", "http://a.info/\nfree\nwin", "http://net?x", "http://net#/en/", "x://a://b/c", "http://user:pw@a.net:80/x", "http://a..net/", "http://.net/", "http://" + "a" * 100_000 + ".net/free/win", "http://a.info/" + "free/" * 50_000, "http://adult-x.info/", "http://ads-track.info/page=2", "http://a.info/?page=2&ref=x",
]


def test_matches_a_plain_version(spark):
    rng = random.Random(1)
    parts = ["http://", "example.", "net", "com", "org", ".", "/", "/en/", "/de/", "/fr/", "?", "#", "free", "porn", "win", "-", "a", "X", "é"]
    urls = URLS + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 12))) for _ in range(800)]
    rows = [(k % 700, u, "x", "x") for k, u in enumerate(urls)] + [(None, "http://a.net/x", "x", "x")] * 2
    got = U.filter_urls(spark.createDataFrame(rows, PAGES).repartition(3), RULES)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr((i, *plain(u))) for i, u, *_ in rows)


def test_the_longest_rule_wins_and_rules_may_be_many(spark):
    rules = {"a.com/": "block", "a.com/x/": "allow", "a.com/x/y": "block", "b.a.com/": "allow", "com/": "block"} | {f"h{i}.info/": "block" for i in range(500)}
    urls = ["http://a.com/", "http://a.com/x/", "http://a.com/x/yz", "http://c.b.a.com/x/y", "http://z.com/q", "http://h499.info/", "http://h500.info/"]
    got = U.filter_urls(spark.createDataFrame([(i, u, "", "") for i, u in enumerate(urls)], PAGES), rules).orderBy("page_id").collect()
    assert [tuple(r)[1:] for r in got] == [plain(u, rules) for u in urls]


def test_own_vocabulary_and_no_rules(spark):
    df = spark.createDataFrame([(1, "http://a/Foo.bar baz", "", ""), (2, "http://a/foo-foo", "", "")], PAGES)
    got = {r["page_id"]: (r["verdict"], r["strict"], r["soft"], r["weight"]) for r in U.filter_urls(df, {}, vocabulary={"FOO": 3, "bar b": 1, "baz": 2, "": 9}, limit=5).collect()}
    assert got == {1: ("block", 0, 2, 5), 2: ("allow", 0, 1, 3)}
    assert {r["verdict"] for r in U.filter_urls(df, {}, vocabulary={}).collect()} == {"allow"}


def test_empty_table_and_bad_rules(spark):
    df = spark.createDataFrame([], PAGES)
    assert U.filter_urls(df, RULES).count() == 0
    with pytest.raises(ValueError):
        U.filter_urls(df, {"a/": "perhaps"})
    with pytest.raises(ValueError):
        U.rule_for(df["host"], df["url"], [f"h{i}/" for i in range(U.MOST_RULES + 1)])
