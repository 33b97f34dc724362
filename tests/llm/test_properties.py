"""Properties that hold for any input."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lattica.llm import decontam, html_extract, pii
from lattica.llm._text import texts, words
from lattica.llm.exact_dedup import golomb_decode, golomb_encode
from lattica.llm.near_dedup import estimate, registers, shingles
from lattica.llm.suffix_dedup import pack, spans, unpack

quick = settings(max_examples=150, deadline=None)


@quick
@given(st.lists(st.integers(0, 2**48 - 1), max_size=200))
def test_golomb(xs):
    x = np.array(sorted(xs), np.int64)
    assert np.array_equal(golomb_decode(golomb_encode(x, 48)), x)


@quick
@given(st.lists(st.tuples(st.integers(0, 300), st.integers(1, 60)), max_size=30))
def test_spans_are_the_union(xs):
    covered = {p for s, n in xs for p in range(s, s + n)}
    got = spans(np.array([s for s, _ in xs], np.int64), np.array([s + n for s, n in xs], np.int64))
    assert {p for s, e in got.tolist() for p in range(s, e)} == covered
    assert all(a[1] < b[0] for a, b in zip(got.tolist(), got.tolist()[1:], strict=False))


@quick
@given(st.integers(0, 2**36), st.integers(0, 4000), st.integers(0, 4000), st.booleans())
def test_packed_anchors(lo, before, span, dup):
    a = lo + before
    assert unpack(pack(a, lo, lo + span, int(dup))) == (a, lo, lo + span)


@quick
@given(st.lists(st.text(alphabet="aB \t\n\x0b\x0c\r\x1cé🙂 ", max_size=40), max_size=6))
def test_words_are_the_pattern(xs):
    raw, offs = texts(pa.array(xs, pa.string()))
    s, e, t = words(raw, offs)
    got = [(int(k), bytes(raw[a:b]).decode()) for a, b, k in zip(s, e, t, strict=True)]
    assert got == [(k, m) for k, x in enumerate(xs) for m in re.findall(r"[^\x20\x09-\x0D]+", x)]


@quick
@given(st.lists(st.sampled_from("abcd"), max_size=30), st.integers(1, 5))
def test_shingles_are_a_set(xs, k):
    names, at = shingles(*texts(pa.array([" ".join(xs)])), k)
    want = {tuple(xs[i : i + k]) for i in range(len(xs) - k + 1)} if len(xs) >= k else {tuple(xs)} if xs else set()
    assert at[-1] == len(want) == len(set(names.tolist()))


def test_estimates_are_near():
    rng = np.random.default_rng(3)
    for j in (0.2, 0.5, 0.8, 0.95):
        n = 2000
        both = round(2 * n * j / (1 + j))
        pool = rng.integers(1, 2**64, 2 * n - both, dtype=np.uint64)
        x, y = pool[:n], np.append(pool[:both], pool[n:])
        r = registers(np.concatenate([x, y]), np.array([0, n, 2 * n]), 520)
        assert abs(estimate(r[0], r[1], n, n) - j) < 0.09


@quick
@given(st.lists(st.sampled_from("abcde"), max_size=40), st.lists(st.sampled_from("abcde"), max_size=15), st.integers(1, 5))
def test_tiles_match_and_are_apart(doc, item, least):
    d, i = (np.array([ord(c) for c in x], np.uint64) for x in (doc, item))
    got = decontam.tile(d, i, least)
    assert all(n >= least and doc[a : a + n] == item[b : b + n] for a, b, n in got)
    for pos in (0, 1):
        used = [p for t in got for p in range(t[pos], t[pos] + t[2])]
        assert len(used) == len(set(used))


@quick
@given(st.text(alphabet="a1@.+- ()9é4\n", max_size=60))
def test_base_spans_lie_in_the_text(t):
    for k, s, e in pii.base_spans(t):
        assert 0 <= s < e <= len(t) and 0 <= k < 4


@quick
@given(st.text(alphabet="<>/pdivab\"'=&;! -x", max_size=120))
def test_any_markup_is_read(page):
    out = html_extract.extract(page)
    assert out == out.strip() and "\n\n\n" not in out
