"""Spelling variants of words: halves found by automaton shards.

Two words are near if one letter (code point) inserted, deleted or replaced
turns one into the other.  Then one half of the shorter word stands unchanged
at the start or the end of the longer.  Every word's halves go to the automaton
of a shard, picked by a hash of the half; a word is scanned by the shards that
can hold a half of a word of its length or of one letter less, a match counts
at the right offset and length only, and the distance is verified.  Halves that
too many words share are halved again by what is left of the words, as often
as it takes, so no shard is ever large and no pair is left out.

Words are distinct rows (word, n); only their vocabulary is shuffled here.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import cut

#: Letters of a run: ASCII and Latin-1.
LETTERS = "A-Za-zÀ-ÿ"
#: Rows of one half beyond which it is halved again, and rows of a shard, about.
HOT, SHARD_ROWS = 256, 100_000
#: Parts into which the rows of one half are dealt where they meet the hot halves.
SALTS = 32
#: Candidate pairs verified at once; longest word that is compared in a matrix.
PAIRS, WIDE = 100_000, 64
#: Neither pattern nor part of a word.
_GAP = "\n"


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 7, min_n: int = 2, edit=None) -> DataFrame:
    """(word, n): the lower-cased (A-Z only) runs of letters of all texts, with their number.

    ``edit`` takes the columns of id (text, null as empty) and lower-cased run
    and returns the word counted.  Runs of fewer than ``min_length`` letters are
    left out before it, words after it.  Null and empty texts have no runs.
    """
    runs = F.regexp_extract_all(docs[text_col], F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0))
    rows = docs.select(F.coalesce(docs[id_col].cast("string"), F.lit("")).alias("i"), F.explode(runs).alias("w"))
    rows = rows.select("i", F.translate("w", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("w"))
    if edit is not None:
        rows = rows.select(edit(F.col("i"), F.col("w")).alias("w")).where(F.length("w") >= min_length)
    return rows.groupBy(F.col("w").alias("word")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_n)


def _kept(p: Column, q: Column, rest: Column, role: int) -> list[Column]:
    """What is kept of a word that keeps ``p`` letters at the start and ``q`` at the end, when the ``rest`` between is halved: one half each."""
    half = F.floor(rest / 2).cast("int")
    return [F.struct((p + half).alias("p"), q.alias("q"), F.lit(role).alias("role")), F.struct(p.alias("p"), (q + rest - half).alias("q"), F.lit(role).alias("role"))]


def _keyed(rows: DataFrame, halves: Column) -> DataFrame:
    """A row for each half: role 0 halves the word itself, role 1 as a word of one letter less would be."""
    rows = rows.withColumn("half", F.explode(halves)).select("word", "n", "half.*")
    key = F.xxhash64("p", "q", F.substring("word", F.lit(1), F.col("p")), F.expr("right(word, q)"))
    return rows.withColumn("key", key)


def _halved(words: DataFrame) -> DataFrame:
    whole, none = F.length("word"), F.lit(0)
    return _keyed(words, F.array(*_kept(none, none, whole, 0), *_kept(none, none, whole - 1, 1)))


def _halved_again(rows: DataFrame) -> DataFrame:
    p, q = F.col("p"), F.col("q")
    rest = F.length("word") - p - q - F.col("role")
    return _keyed(rows, F.when(F.col("role") == 0, F.array(*_kept(p, q, rest, 0))).otherwise(F.array(*_kept(p, q, rest, 1))))


def _split(rows: DataFrame, hot: int) -> tuple[DataFrame, DataFrame, int]:
    """The rows of halves with up to ``hot`` rows, the others, and the number of the first."""
    often = rows.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > hot).select("key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(True).alias("often"))
    salt = F.pmod(F.xxhash64("word", F.lit(7)), F.lit(SALTS)).cast("int").alias("salt")
    marked = cut(rows.select("*", salt).join(often, ["key", "salt"], "left").select(*rows.columns, F.coalesce("often", F.lit(False)).alias("often")))
    n = {r["often"]: r["count"] for r in marked.groupBy("often").count().collect()}
    return marked.where(~F.col("often")).drop("often"), marked.where("often").drop("often"), n.get(True, 0)


def _ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges ``first[i] .. last[i] - 1``, and the i of each."""
    size = last - first
    owner = np.repeat(np.arange(size.size), size)
    return np.arange(owner.size) - np.repeat(np.cumsum(size) - size, size) + first[owner], owner


def _common(a: str, b: str) -> int:
    """Letters that two texts have in common from the start."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    return lo


class _Words:
    """Distinct words, and which pairs of them are near."""

    def __init__(self, words: list[str]):
        self.words, self.length = words, np.fromiter(map(len, words), np.int64, len(words))
        small = [w if len(w) <= WIDE else "" for w in words]
        # both aligned at the left and at the right; 0 and 1 stand for no letter, so that words of two lengths end by differing
        codes = lambda own: np.frombuffer("".join(own).encode("utf-32-le"), np.uint32).reshape(len(own), WIDE + 1)
        self.left, self.right = codes([w.ljust(WIDE + 1, "\0") for w in small]), codes([w[::-1].ljust(WIDE + 1, "\1") for w in small])

    def near(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether ``a`` and ``b``, as long or one letter longer, are one letter apart; and the letters they share from the start."""
        alike, tail = np.zeros(a.size, np.int64), np.zeros(a.size, np.int64)
        wide = self.length[b] > WIDE
        for i in range(0, a.size, PAIRS):
            s = slice(i, i + PAIRS)
            for out, m in ((alike, self.left), (tail, self.right)):
                apart = m[a[s]] != m[b[s]]
                apart[:, -1] = True
                out[s] = apart.argmax(1)
        for i in np.flatnonzero(wide):
            x, y = self.words[a[i]], self.words[b[i]]
            alike[i], tail[i] = _common(x, y), _common(x[::-1], y[::-1])
        short, same = np.minimum(self.length[a], self.length[b]), self.length[a] == self.length[b]
        alike, tail = np.minimum(alike, short), np.minimum(tail, short)
        return np.where(same, alike + tail == short - 1, alike + tail >= short) & (a != b), alike


def near_pairs(rows: pd.DataFrame) -> pd.DataFrame:
    """The near pairs of one shard, in both directions: an automaton over the halves of its rows scans its words.

    Two words are paired at the half that ends or begins at their first
    difference, so that no other shard pairs them, too.
    """
    import ahocorasick

    rows = rows.drop_duplicates(["word", "p", "q", "role"])
    known, first, at = np.unique(rows["word"].to_numpy(object), return_index=True, return_inverse=True)
    own, times = _Words(known.tolist()), rows["n"].to_numpy()[first]
    is_pattern = rows["role"].to_numpy() == 0
    word, p, q = at[is_pattern], rows["p"].to_numpy(np.int64)[is_pattern], rows["q"].to_numpy(np.int64)[is_pattern]
    machine, numbers = ahocorasick.Automaton(), {}
    front = p >= q
    segments = [w[:i] if f else w[len(w) - j :] for w, i, j, f in zip(known[word].tolist(), p.tolist(), q.tolist(), front.tolist(), strict=True)]
    number = np.fromiter((numbers.setdefault(s, len(numbers)) for s in segments), np.int64, len(segments))
    for s, k in numbers.items():
        machine.add_word(s, (k, len(s)))
    out = [(np.zeros(0, np.int64),) * 2]
    if numbers:
        machine.make_automaton()
        # patterns in order of segment, side and length: what a match may pair with is a range
        longest = int(own.length.max()) + 2
        place = (number * 2 + front) * longest + own.length[word]
        order = np.argsort(place, kind="stable")
        place, word, p, q = place[order], word[order], p[order], q[order]
        starts = np.concatenate([[0], np.cumsum(own.length + 1)])
        begun = 0
        while begun < known.size:
            ended = max(begun + 1, int(np.searchsorted(starts, starts[begun] + 500_000, "right")) - 1)
            text = _GAP.join(own.words[begun:ended])
            found = np.array([(e, k, n) for e, (k, n) in machine.iter(text)], np.int64).reshape(-1, 3)
            end, k, n = found[:, 0] + 1 + starts[begun], found[:, 1], found[:, 2]
            w = np.searchsorted(starts, end - 1, "right") - 1
            for side, fits in ((1, end - n == starts[w]), (0, end == starts[w] + own.length[w])):
                scanned = w[fits]
                base = (k[fits] * 2 + side) * longest + own.length[scanned]
                lo, hi = np.searchsorted(place, base - 1, "left"), np.searchsorted(place, base, "right")
                # in runs of bounded size
                sums = np.concatenate([[0], np.cumsum(hi - lo)])
                i = 0
                while i < scanned.size:
                    j = max(i + 1, int(np.searchsorted(sums, sums[i] + 10 * PAIRS, "right")) - 1)
                    row, owner = _ranges(lo[i:j], hi[i:j])
                    a, b = word[row], scanned[i:j][owner]
                    # of two words of one length the first is the pattern
                    once = (own.length[a] < own.length[b]) | (a < b)
                    a, b, row = a[once], b[once], row[once]
                    ok, alike = own.near(a, b)
                    ok &= (alike >= p[row]) & ((q[row] == 0) | (alike < own.length[a] - q[row]))
                    out.append((a[ok], b[ok]))
                    i = j
            begun = ended
    a, b = (np.concatenate(x) for x in zip(*out, strict=True))
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    return pd.DataFrame({"word": known[a].astype(object), "near": known[b].astype(object), "near_n": times[b].astype(np.int64)})


def near_words(words: DataFrame, hot: int = HOT, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(word, near, near_n): every near pair of distinct words of four letters or more, in both directions, once.

    A word has at most as many partners as there are ways to edit it, so the
    result grows with the vocabulary.
    """
    longest = words.agg(F.max(F.length("word"))).first()[0] or 0
    rows, out = _halved(words), None
    for level in range(max(1, math.ceil(math.log2(max(longest, 2))))):
        if level:
            rows = _halved_again(rows)
        cold, rows, more = _split(rows, hot)
        out = cold if out is None else out.unionByName(cold)
        if not more:
            break
    else:
        # one letter at most is left between what is kept: no more rows than ways to fill it
        out = out.unionByName(rows)
    shards = max(1, -(-out.count() // shard_rows))
    out = out.withColumn("shard", F.pmod("key", F.lit(shards)))
    return out.groupBy("shard").applyInPandas(lambda pdf: near_pairs(pdf), "word string, near string, near_n long")


def group_variants(words: DataFrame, ratio: int = 10, hot: int = HOT, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for a table (word, n) of distinct words of four letters or more.

    A word's form is its near word with the largest n (of equal ones the
    smallest in code-point order), if that is at least ``ratio`` (above 1)
    times its own n; its root is the last of the forms that follow one another,
    or the word itself.  ``n_near`` is the number of near words.
    """
    if ratio <= 1:
        raise ValueError("a ratio above 1 keeps forms from going in circles")
    words = cut(words.select("word", "n"))
    best = F.min(F.struct((-F.col("near_n")).alias("k"), "near"))
    near = near_words(words, hot, shard_rows).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    own = words.join(near, "word", "left").withColumns({"n_near": F.coalesce("n_near", F.lit(0)).cast("long"), "is": -F.col("best.k") >= ratio * F.col("n")})
    own = cut(own.select("word", "n", "n_near", F.when(F.col("is"), F.col("best.near")).alias("form"), F.when(F.col("is"), -F.col("best.k")).alias("form_n")))
    most = own.agg(F.max("n")).first()[0] or 1
    root = own.where("form is not null").select("word", F.col("form").alias("root"))
    # each form has ratio times the n at least, which bounds how many can follow one another; every round doubles how far a root has come
    for _ in range(max(0, math.ceil(math.log2(max(1.0, math.log(most, ratio)))))):
        root = cut(root)
        further = root.select(F.col("word").alias("root"), F.col("root").alias("next"))
        root = root.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return own.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 7, min_n: int = 2, ratio: int = 10, edit=None) -> DataFrame:
    """Spelling variants among the words of whole texts, :func:`count_words` and :func:`group_variants` in one.

    Null, empty and blank texts have no words, a null id counts as an empty
    one, repeated rows count again, other columns are not read, and an empty
    table gives an empty result.  Texts and words may have any length.
    """
    return group_variants(count_words(docs, id_col, text_col, min_length, min_n, edit), ratio)


#: The same by deleting letters: two words of one length share what is left after losing the letter at one place, words of two lengths the shorter.
ORACLE = r"""
WITH RECURSIVE steps AS (
    SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS tab
), runs AS (
    SELECT coalesce(doc_id::VARCHAR, '') AS i, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM {docs}
), each_run AS (
    SELECT i, w, count(*) AS times FROM runs WHERE length(w) >= 7 GROUP BY ALL
), hashed AS (
    SELECT w, times, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(i || ':' || w, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [(192 + (unicode(c) >> 6))::BIGINT, (128 + (unicode(c) & 63))::BIGINT] END))), lambda h, b: xor(h >> 8, tab[(xor(h, b) & 255) + 1]))) AS h FROM each_run, steps
), edited AS (
    SELECT times, CASE WHEN h % 31 = 0 THEN w[:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS w FROM hashed
), vocabulary AS (
    SELECT w AS word, sum(times)::BIGINT AS n FROM edited WHERE length(w) >= 7 GROUP BY 1 HAVING sum(times) >= 2
), less AS (
    SELECT word, n, length(word) AS size, i, word[:i] || word[i + 2:] AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM vocabulary)
), pairs AS (
    SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.size = b.size AND a.word <> b.word
    UNION ALL
    SELECT DISTINCT a.word, b.word, b.n FROM less a JOIN vocabulary b ON a.rest = b.word
    UNION ALL
    SELECT DISTINCT b.word, a.word, a.n FROM less a JOIN vocabulary b ON a.rest = b.word
), best AS (
    SELECT word, count(*) AS n_near, max(near_n) AS top_n, arg_min(near, (-near_n, encode(near))) AS top FROM pairs GROUP BY 1
), own AS (
    SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN top_n >= 10 * v.n THEN top END AS form, CASE WHEN top_n >= 10 * v.n THEN top_n END AS form_n FROM vocabulary v LEFT JOIN best USING (word)
), walk AS (
    SELECT word, word AS root, form AS next FROM own
    UNION ALL
    SELECT walk.word, own.word, own.form FROM walk JOIN own ON walk.next = own.word
)
SELECT own.word, form, root, n, n_near, form_n FROM own JOIN (SELECT word, root FROM walk WHERE next IS NULL) USING (word)
"""
