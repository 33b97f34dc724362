"""Operator 11 against comparing all words with all words."""

import random
import re
import zlib
from collections import Counter

import pytest

from lattica.llm import spelling
from lattica.llm.queries import _letter_lost

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def edits_to(a: str, b: str) -> bool:
    """One insertion, deletion or replacement, by trying all of them."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain(counts: dict, ratio: int = 10) -> dict:
    out = {}
    for w, n in counts.items():
        near = sorted((-m, v) for v, m in counts.items() if v != w and edits_to(w, v))
        is_form = bool(near) and -near[0][0] >= ratio * n
        out[w] = [near[0][1] if is_form else None, w, n, len(near), -near[0][0] if is_form else None]
    for row in out.values():
        while out[row[1]][0] is not None:
            row[1] = out[row[1]][0]
    return {w: tuple(r) for w, r in out.items()}


def result(df) -> dict:
    rows = df.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


def vocabulary(rng: random.Random) -> dict:
    words = {"".join(rng.choice("abÉ") for _ in range(rng.randrange(4, 10))) for _ in range(300)}
    words |= {"common" + x for x in "abcdefghijklmnopqrstuvwxyz"} | {"x" + x + "common" for x in "abcdefghijkl"} | {"aaaaaaa" + "a" * k for k in range(6)}
    long = ["".join(rng.choice("abcdefg") for _ in range(n)) for n in (64, 65, 66, 200, 3000)]
    words |= {*long, *(w[:20] + "z" + w[21:] for w in long), *(w + "q" for w in long), *("q" + w for w in long), *(w[: len(w) // 2] + w[len(w) // 2 + 1 :] for w in long)}
    return {w: rng.choice([2, 3, 25, 26, 300, 4000]) for w in sorted(words)}


@pytest.mark.parametrize(("hot", "shard_rows"), [(256, 100_000), (2, 40), (20, 300)])
def test_matches_brute_force(spark, hot, shard_rows):
    counts = vocabulary(random.Random(hot))
    got = spelling.group_variants(spark.createDataFrame(list(counts.items()), "word string, n long"), hot=hot, shard_rows=shard_rows)
    assert result(got) == plain(counts)


def test_forms_follow_one_another_and_ties_go_by_code_point(spark):
    counts = {"letters": 100_000, "lettors": 9_000, "lettorz": 800, "lettrz": 70, "lettrrz": 7, "zebraé": 50, "zebras": 50, "zebra": 5, "alone": 3, "alonf": 29}
    got = result(spelling.group_variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert got == plain(counts)
    assert got["lettrrz"][1] == "letters" and got["zebra"][0] == "zebras" and got["alone"][0] is None


def test_words_of_documents(spark, docs_of, odd_rows):
    rows = [*odd_rows, (10, "Straßen straßen STRASSEN ÀÉÎÕÜÿ×÷ abcdefg-abcdefg abcdef abcdefgh1abcdefgh"), (None, "abcdefg " * 40), (11, "abcdefg " * 40), (12, "\x00Abcdefg\nABCDEFG")]
    rows += [(100 + i, "Repeating words wordings " * 3) for i in range(62)]
    want = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            want[run] += len(run) >= 7
    want = {w: n for w, n in want.items() if n >= 2}
    assert result(spelling.spelling_variants(docs_of(rows), edit=_letter_lost)) == plain(want)


def test_empty_table(spark, docs_of):
    assert spelling.spelling_variants(docs_of([])).count() == 0
    assert spelling.spelling_variants(docs_of([(1, None), (2, "short")])).count() == 0


def test_the_ratio_is_above_one(spark):
    with pytest.raises(ValueError):
        spelling.group_variants(spark.createDataFrame([("abcd", 1)], "word string, n long"), ratio=1)
