"""Repeated strings, exact copies and near copies against brute force."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm.components import components
from lattica.llm._store import Sieve
from lattica.llm.exact_dedup import drop_copies, exact_dedup, golomb_decode, golomb_encode, layout
from lattica.llm.near_dedup import drop_near_copies, estimate, near_dedup, registers
from lattica.llm._text import mix
from lattica.llm.suffix_dedup import suffix_dedup

from .conftest import words


def same_rows(got, want):
    """Both as lists of tuples, in any order; null sorts first."""
    order = lambda r: [(v is not None, v) for v in r]
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)


def brute_suffix(rows, length):
    """(id, ...) a row; rows that share an id go by a hash of the text, and equal rows are one document."""
    order = {}
    for i, t, h in sorted(set(rows), key=lambda r: (-(2**63) if r[0] is None else r[0], r[2])):
        order[i, t or ""] = (t or "").encode()
    seen, out = set(), {}
    for key, b in order.items():
        cut = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                cut[p : p + length] = b"\1" * length
            else:
                seen.add(w)
        runs = sum(1 for k in range(len(cut)) if cut[k] and (k == 0 or not cut[k - 1]))
        out[key] = (len(b), sum(cut), runs, hashlib.sha256(bytes(x for x, c in zip(b, cut, strict=True) if not c)).hexdigest())
    return [(i, *out[i, t or ""]) for i, t, _ in rows]


def hashed(df):
    """(id, text, hash of the text as Spark makes it) of all rows."""
    return [tuple(r) for r in df.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit("")))).collect()]


@pytest.mark.parametrize(("length", "chunk"), [(64, 1 << 19), (100, 1 << 19), (100, 900)])
def test_suffix_matches_brute_force(docs_of, length, chunk):
    rng = random.Random(length)
    shared = [words(rng, 60) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [words(rng, rng.randrange(0, 40))]
        for _ in range(rng.randrange(3)):
            s = rng.choice(shared)
            a, b = sorted(rng.sample(range(len(s)), 2))
            parts += [s[a:b], words(rng, rng.randrange(0, 20))]
        rows.append((i, " ".join(parts)))
    rows += [(100, "a" * 700), (101, "ab" * 400), (102, "x" * 50), (103, None), (104, rows[5][1]), (105, "é" * 200)]
    repeat = words(rng, 40)
    # rows without id and rows that share one are documents of their own; equal rows are one
    rows += [(None, words(rng, 20) + repeat), (None, repeat + words(rng, 20)), (None, words(rng, 30)), (None, rows[7][1]), (3, repeat + words(rng, 9)), (106, repeat), (106, repeat)]
    df = docs_of(rows)
    same_rows(suffix_dedup(df, length, chunk=chunk).collect(), brute_suffix(hashed(df), length))


@pytest.mark.parametrize("size", [62, 90, 140])
def test_suffix_line_that_all_documents_have(docs_of, monkeypatch, size):
    """A common line between unique texts: right rows, and no rank gathers more than a few rows a task."""
    from lattica.llm import suffix_dedup as module

    rng = random.Random(size)
    line = words(rng, size)[:size]
    rows = [(i, f"{words(rng, 40, 10**6)} {line} {words(rng, 40, 10**6)}") for i in range(300)]
    df = docs_of(rows, clash=False)
    same_rows(suffix_dedup(df, chunk=4000).collect(), brute_suffix(hashed(df), 100))
    src = df.select(F.col("doc_id").alias("d"), F.lit(0).cast("long").alias("t"), "text").coalesce(3)
    # a task learns a rank when a chunk holds it twice, so it sends a few rows at most before it knows
    most = src.mapInArrow(module._emit(100, 4000), module._ANCHORS).groupBy("g").count().agg(F.max("count")).first()[0]
    assert most <= 3 * 10


def test_suffix_odd_rows(docs_of, odd_rows, spark):
    df = docs_of(odd_rows)
    got = suffix_dedup(df, with_text=True)
    same_rows(got.drop("kept").collect(), brute_suffix(hashed(df), 100))
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[8]["n_removed"] == by[8]["n_bytes"] and by[7]["n_removed"] == 0 and by[1]["n_bytes"] == 0
    assert bytes(by[7]["kept"]).decode() == dict(odd_rows)[7]
    assert suffix_dedup(docs_of([(1, "a")]).where("false")).collect() == []


def test_golomb_round_trip():
    rng = np.random.default_rng(1)
    for n, width in ((0, 8), (1, 8), (5, 3), (1000, 40), (3000, 12)):
        x = np.sort(rng.integers(0, 1 << width, n)).astype(np.int64)
        data = golomb_encode(x, width)
        assert np.array_equal(golomb_decode(data), x)
    assert len(golomb_encode(np.sort(rng.integers(0, 1 << 40, 10_000)), 40)) < 10_000 * 4.5


@pytest.mark.parametrize(("bits", "part_rows"), [(48, 50_000), (6, 7)])
def test_exact_matches_brute_force(docs_of, bits, part_rows):
    """With 6 bits most fingerprints collide: verification alone has to tell texts apart."""
    rng = random.Random(5)
    texts = [words(rng, 5) for _ in range(20)] + ["", None, " ", "A", "a"]
    rows = [(i, rng.choice(texts)) for i in range(150)] + [(None, "A")]
    got = {r["doc_id"]: r for r in exact_dedup(docs_of(rows), bits=bits, part_rows=part_rows).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        group = [j for j, u in rows if (u or "") == (t or "")]
        keep = max((j for j in group if j is not None), default=None)
        r = got[i]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(group), i == keep)
        assert r["text_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_exact_odd_rows(docs_of, odd_rows):
    want = []
    for i, t in odd_rows:
        group = [j for j, u in odd_rows if (u or "") == (t or "")]
        keep = max(group, key=lambda j: (j is not None, j))
        want.append((i, keep, len(group), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    same_rows(exact_dedup(docs_of(odd_rows)).collect(), want)
    df = docs_of(odd_rows)
    left = drop_copies(df)
    assert left.columns == df.columns
    texts = [r["text"] or "" for r in left.collect()]
    assert sorted(texts) == sorted({t or "" for _, t in odd_rows})
    assert {(r["doc_id"], r["text"]) for r in left.collect()} <= set(odd_rows)
    assert exact_dedup(df.where("false")).collect() == drop_copies(df.where("false")).collect() == []


def test_exact_shuffles_only_suspects(docs_of, spark):
    """No exchange carries the text of a document that is not a suspect (but one in 16 that passes the bit table)."""
    rng = random.Random(6)
    rows = [(i, words(rng, 60, 9000)) for i in range(600)] + [(1000 + i, "a copy of one text") for i in range(20)]
    df = docs_of(rows, clash=False)
    seen = []
    from lattica.llm import exact_dedup as module

    split = module.Sieve.split

    def watched(self, rows, key):
        out = split(self, rows, key)
        seen.append(tuple(x.count() for x in out))
        return out

    module.Sieve.split, kept = watched, split
    try:
        assert exact_dedup(df).where("kept").count() == 601
    finally:
        module.Sieve.split = kept
    assert len(seen) == 1 and 20 <= seen[0][0] < 120


def test_golomb_lists_stay_short_at_scale():
    """At 20,000 parts a list, with its header, costs less than six bytes a fingerprint."""
    n = 20_000 << 20
    parts, owners = layout(n)
    assert parts == 20_000
    step = -(-(1 << 48) // owners)
    rng = np.random.default_rng(3)
    each = n // parts // owners
    lists = [golomb_encode(np.unique(rng.integers(0, step, each)), math.ceil(math.log2(step))) for _ in range(50)]
    assert sum(map(len, lists)) < 6 * each * 50


@pytest.mark.parametrize(("limit", "foreign"), [(1 << 20, 0.1), (4096, 0.2), (0, 0.4)])
def test_sieve_loses_no_key(spark, limit, foreign):
    """However small the table is, every key passes; the others pass as often as the bits that the keys set."""
    keys = spark.range(0, 40_000, 7).selectExpr("xxhash64(id) as k")
    sieve = Sieve.of(keys, limit)
    maybe, free = sieve.split(spark.range(40_000), F.xxhash64("id"))
    got = {r["id"] for r in maybe.collect()}
    assert set(range(0, 40_000, 7)) <= got and len(got) < 40_000 * (1 / 7 + foreign)
    assert {r["id"] for r in free.collect()} == set(range(40_000)) - got


@pytest.fixture
def small_sieve(monkeypatch):
    """Bit tables of 256 bits, as if the keys were far more than fit."""
    from lattica.llm import _store

    monkeypatch.setattr(_store, "SIEVE_ROWS", 4)
    monkeypatch.setattr(_store.Sieve.of.__func__, "__defaults__", (0,))


def test_full_tables_change_no_result(docs_of, small_sieve):
    """Exact, near and suffix dedup with bit tables that are nearly full give what they give otherwise."""
    rng = random.Random(8)
    rows = [(i, words(rng, 60, 9000)) for i in range(300)]
    rows += [(1000 + i, rows[i % 150][1] + " tail" * (i % 2)) for i in range(300)]
    df = docs_of(rows, clash=False)
    assert sorted((r["doc_id"], r["component_id"]) for r in near_dedup(df, 2).collect()) == sorted((i, c) for i, _, c, _ in brute_near(rows, 2, 80))
    groups = {}
    for i, t in rows:
        groups.setdefault(t, []).append(i)
    assert sorted((r["doc_id"], r["keep_id"]) for r in exact_dedup(df).collect()) == sorted((i, max(groups[t])) for i, t in rows)
    assert {r["doc_id"] for r in drop_copies(df).collect()} == {max(g) for g in groups.values()}
    same_rows(suffix_dedup(df, 64).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect(), brute_suffix(hashed(df), 64))


def brute_near(rows, k, percent):
    """(id, size, component, kept) a row; equal rows are one document, other rows that share an id are not."""
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i, t or ""] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    order = lambda v: (v[0] is not None, v)
    for x, y in itertools.combinations(sorted(sets, key=order), 2):
        if sets[x] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
            p, q = sorted((find(x), find(y)), key=order)
            parent[q] = p
    return [(i, len(sets[i, t or ""]), find((i, t or ""))[0], find((i, t or ""))[0] == i) for i, t in rows]


@pytest.mark.parametrize("k", [2, 5])
def test_near_matches_brute_force(docs_of, k):
    rng = random.Random(k)
    rows, i = [], 0
    for _ in range(25):
        base = words(rng, rng.randrange(8, 90)).split()
        for _ in range(rng.randrange(1, 8)):
            w = list(base)
            for _ in range(rng.randrange(0, 5)):
                w[rng.randrange(len(w))] = f"z{rng.randrange(1000)}"
            rows.append((i, " ".join(w).upper() if rng.random() < 0.2 else " ".join(w)))
            i += 1
    rows += [(900, None), (901, ""), (902, "solo"), (903, "SOLO "), (904, "two words"), (905, "two words")]
    same_rows(near_dedup(docs_of(rows), k=k).collect(), brute_near(rows, k, 80))


@pytest.mark.parametrize("block", [512, 3])
def test_near_chain_and_star(docs_of, monkeypatch, block):
    """A chain whose ends are far apart is one component, as is a star of copies that differ among each other."""
    from lattica.llm import near_dedup as module

    monkeypatch.setattr(module, "BLOCK", block)
    rng = random.Random(9)
    base = words(rng, 120, 10_000).split()
    rows, w = [], list(base)
    for i in range(12):
        rows.append((i, " ".join(w)))
        w[i * 9 : i * 9 + 4] = [f"c{i}x{j}" for j in range(4)]
    star = words(rng, 200, 10_000).split()
    for i in range(40):
        v = list(star)
        for _ in range(8):
            v[rng.randrange(len(v))] = f"s{i}y{rng.randrange(99)}"
        rows.append((100 + i, " ".join(v)))
    rows.append((500, " ".join(star)))
    same_rows(near_dedup(docs_of(rows), k=2).collect(), brute_near(rows, 2, 80))


def test_near_odd_rows(docs_of, odd_rows):
    df = docs_of(odd_rows)
    same_rows(near_dedup(df).collect(), brute_near(odd_rows, 5, 80))
    left = drop_near_copies(df)
    assert left.columns == df.columns
    assert {r["doc_id"] for r in left.collect()} == {i for i, *_, kept in brute_near(odd_rows, 5, 80) if kept}
    assert near_dedup(df.where("false")).collect() == drop_near_copies(df.where("false")).collect() == []


def test_near_links_through_rows_that_share_an_id(docs_of):
    """Two texts that are linked only through rows without id, and two documents of one id."""
    rng = random.Random(4)
    x, y = (words(rng, 50, 9000) for _ in range(2))
    rows = [(1, x), (2, y), (None, f"{x} z"), (None, f"{y} z"), (7, words(rng, 30, 9000)), (7, f"{y} q")]
    same_rows(near_dedup(docs_of(rows), k=2).collect(), brute_near(rows, 2, 80))


def test_registers_of_one_hash_estimate_similarity():
    """Short sets too, whose empty buckets borrow: equal registers have the sets' Jaccard similarity."""
    rng = np.random.default_rng(8)
    for size in (1, 5, 10, 60, 1000):
        both = round(size * 0.8)
        shares = []
        for _ in range(200):
            pool = mix(rng.integers(0, 2**63, 2 * size - both, dtype=np.uint64))
            x, y = np.sort(pool[:size]), np.sort(pool[size - both :])
            regs = registers(np.concatenate([x, y]), np.array([0, x.size, x.size + y.size]), 130)
            shares.append(estimate(regs[0], regs[1], np.array(x.size), np.array(y.size)))
        assert abs(np.mean(shares) - both / (2 * size - both)) < 0.03, size


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(1000, 1060)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    assert got == {x: find(x) for p in pairs if p[0] != p[1] for x in p}
