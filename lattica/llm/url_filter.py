"""URL filters: rules by host and path, and a weighted vocabulary.

A rule decides for a host, its subdomains and a path; the longest that fits
wins.  Where none fits, an Aho-Corasick automaton finds the terms of the
vocabulary in the URL.  A term counts where no ASCII letter or digit stands
next to it.  Each distinct term adds its weight once, and the URL is blocked
from a sum of :data:`LIMIT` on: one strict term has that weight by itself,
soft terms need to be several.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The sum of weights that blocks.
LIMIT = 2
#: A small vocabulary of terms, the strict ones and the soft ones.
STRICT = ("adult", "casino", "escort", "hentai", "porn", "porno", "sexcam", "viagra", "warez", "xxx")
SOFT = ("ads", "bet", "bets", "bonus", "cams", "cheap", "coupon", "crack", "deals", "farm", "free", "girls", "hot", "jackpot", "keygen", "loan", "loans", "lottery", "nude", "pill", "pills", "poker", "replica", "sex", "slots", "spam", "torrent", "track", "tracker", "win")
VOCABULARY = {t: LIMIT for t in STRICT} | {t: 1 for t in SOFT}
#: Most rules and terms: both go to every task as they are.
MOST_RULES, MOST_TERMS = 10_000, 1_000_000

_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null and without ``://``."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for null and without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[str]) -> Column:
    """The longest of the rules (``host/path``) that fits a host or one above it, and whose path starts the path; null if none does.

    Of rules as long as one another the one with the longer host wins.  A
    host's own suffixes are looked up in a table of the rules' hosts.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    by_host: dict[str, list[str]] = {}
    for r in sorted(set(rules), key=lambda r: (-len(r), -r.find("/"), r)):
        by_host.setdefault(r.partition("/")[0], []).append("/" + r.partition("/")[2])
    if not by_host:
        return F.lit(None).cast("string")
    table = F.create_map(*[x for h, paths in by_host.items() for x in (F.lit(h), F.array(*map(F.lit, paths)))])
    parts = F.split(host, r"\.", -1)
    size = F.size(parts)
    suffixes = F.transform(F.sequence(F.lit(1), size), lambda i: F.array_join(F.slice(parts, i, size), "."))
    fitting = lambda h: F.transform(F.filter(F.coalesce(F.element_at(table, h), F.array().cast("array<string>")), lambda p: path.startswith(p)), lambda p: F.concat(h, p))
    found = F.flatten(F.transform(suffixes, fitting))
    # suffixes come longest first, so of equal lengths the first has the longer host
    return F.aggregate(found, F.lit(None).cast("string"), lambda best, r: F.when(best.isNull() | (F.length(r) > F.length(best)), r).otherwise(best))


def automaton(terms: Iterable[str]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for t in terms:
        out.add_word(t, t)
    out.make_automaton()
    return out


def hits(machine, text: str) -> list[str]:
    """The terms that stand in a lower-cased text by themselves, each as often as it does."""
    n = len(text)
    return [t for end, t in machine.iter(text) if (end + 1 == n or text[end + 1] not in _WORD) and (end - len(t) < 0 or text[end - len(t)] not in _WORD)]


def count_terms(url: Column, vocabulary: Mapping[str, int] = VOCABULARY, limit: int = LIMIT) -> Column:
    """A struct for each URL: hits of strict terms (of weight ``limit`` or more), distinct soft terms and the sum of weights of distinct terms.

    The whole URL is read, A-Z lower-cased; null is empty.
    """
    terms = {t.translate(_LOWER): w for t, w in vocabulary.items() if t}
    if len(terms) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms")
    built: list = []

    def judge(urls: pd.Series) -> pd.DataFrame:
        machine = built[0] if built else None
        if machine is None and terms:
            built.append(machine := automaton(terms))
        rows = []
        for u in urls:
            own = hits(machine, u.translate(_LOWER)) if terms and u else []
            once = set(own)
            rows.append((sum(terms[t] >= limit for t in own), sum(terms[t] < limit for t in once), sum(terms[t] for t in once)))
        return pd.DataFrame(rows, columns=["strict", "soft", "weight"])

    return F.pandas_udf(judge, "strict long, soft long, weight long")(url)


def filter_urls(pages: DataFrame, rules: Mapping[str, str], id_col: str = "page_id", url_col: str = "url", vocabulary: Mapping[str, int] = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """(id, host, path, rule, verdict, strict, soft, weight): one row for each row of ``pages``.

    ``rules`` maps ``host/path`` to ``allow`` or ``block``; the verdict is that
    of the rule that fits, else ``block`` from a weight of ``limit`` on, else
    ``allow``.  Null URLs and those without ``://`` have an empty host and path,
    which no rule fits; their terms count all the same, and a null one has
    none.  Long URLs are read whole, repeated rows are judged each, other
    columns are not read, and an empty table gives an empty result.
    """
    if set(rules.values()) - {"allow", "block"}:
        raise ValueError("a rule allows or blocks")
    rows = pages.select(pages[id_col].alias(id_col), F.col(url_col).alias("url")).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rows = rows.withColumns({"rule": rule_for(F.col("host"), F.col("path"), list(rules)), "found": count_terms(F.col("url"), vocabulary, limit)})
    blocked = F.when(F.col("found.weight") >= limit, "block").otherwise("allow")
    by_rule = F.element_at(F.create_map(*[F.lit(x) for item in rules.items() for x in item]), F.col("rule")) if rules else F.lit(None).cast("string")
    return rows.select(id_col, "host", "path", "rule", F.coalesce(by_rule, blocked).alias("verdict"), "found.strict", "found.soft", "found.weight")


def oracle(rules: Mapping[str, str], vocabulary: Mapping[str, int] = VOCABULARY, limit: int = LIMIT) -> str:
    """The same in SQL: a pattern for each term and a case for each rule."""
    listed = ", ".join(f"('{t}', {w})" for t, w in vocabulary.items())
    ruled = ", ".join(f"('{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{v}')" for r, v in rules.items())
    return rf"""
WITH terms(term, weight) AS (VALUES {listed}), rules(rule_host, rule_path, says) AS (VALUES {ruled}), split AS (
    SELECT row_number() OVER () AS k, page_id, url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM {{pages}}
), ruled AS (
    SELECT k, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(says, length(rule_host || rule_path)) AS says FROM split JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY 1
), found AS (
    SELECT k, coalesce(sum(hits) FILTER (weight >= {limit}), 0)::BIGINT AS strict, count(*) FILTER (weight < {limit}) AS soft, sum(weight)::BIGINT AS weight FROM (
        SELECT k, weight, len(regexp_extract_all(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '\b' || term || '\b')) AS hits FROM split, terms
    ) WHERE hits > 0 GROUP BY 1
)
SELECT page_id, host, path, rule, coalesce(says, CASE WHEN weight >= {limit} THEN 'block' ELSE 'allow' END) AS verdict, coalesce(strict, 0) AS strict, coalesce(soft, 0) AS soft, coalesce(weight, 0) AS weight FROM split LEFT JOIN ruled USING (k) LEFT JOIN found USING (k)
"""
