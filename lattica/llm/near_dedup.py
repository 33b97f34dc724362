"""Near-duplicate groups by HyperMinHash sketches.

1. Each document becomes a row: id, number of distinct word shingles, a
   128-bit name of its shingle set, and a sketch.  One hash of each shingle
   picks a bucket; the bucket's register keeps, of its smallest value, the
   count of leading zeros and ten mantissa bits.  Buckets that stay empty, as
   in short documents, borrow the value of another by a fixed sequence of
   picks (optimal densification, Shrivastava 2017).
2. Documents with one set are one class with a number of its own; only one
   row of it goes on.
3. Bands of registers deal the classes into buckets.  Every member is tested
   with the bucket's first.  Where a bucket still has other members with
   different labels (the first within two links), its members go to tasks for
   pairs of blocks.  There a member is tested with those that are not yet
   connected to it, and only links that connect something are returned; all
   pairs are never listed.  A pair inside one component needs no test, as its
   outcome changes nothing.
4. A test is first the collision-corrected estimate from the registers, which
   drops pairs LOOSE standard errors below the threshold, and then the Jaccard
   similarity of the full shingle sets.  Components of the links and the
   classes give the groups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import Sieve, content, cut, dealt_join, frequent, keyed, made, release, unkeyed, with_key, without
from ._text import BYTE, LOWER, U, join, mix, pieces, span_names, texts, words
from .components import components

#: Registers in a band and bands; a pair at 0.8 shares no band once in 30,000 times, one at 0.3 shares one in 16.
ROWS, BANDS = 5, 26
MANTISSA = 10
#: Expected share of equal registers of disjoint sets of one size, times 2**MANTISSA (Yu and Weber, 2017).
_COLLISION = 0.169919487159739093975315012348
#: A pair whose estimate is so many standard errors below the threshold is no link; a pair at the threshold is that low once in 10**9 times.
LOOSE = 6
#: Classes in a block of the last round, and shingles of them, about.
BLOCK, BLOCK_SHINGLES = 512, 2_000_000
#: Tests with one first member in a task, about.
FAN = 256
#: Picks for an empty bucket before its next neighbour is taken.
PICKS = 64


def shingles(raw: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit names of the k-word shingles of each text, sorted, and where each text's begin; fewer words are one shingle."""
    n = offs.size - 1
    starts, ends, text = words(raw, offs)
    name = span_names(BYTE[LOWER[raw]], starts, ends)
    at = np.searchsorted(text, np.arange(n + 1))
    count = np.diff(at)
    acc = name.copy()
    for j in range(1, k):
        acc = join(acc[: acc.size - 1], name[j:]) if acc.size else acc
    full = np.repeat(count >= k, count)
    last = np.repeat(at[1:], count)
    begins = np.flatnonzero(full & (np.arange(text.size) + k <= last))
    got, of = acc[begins], text[begins]
    short = np.flatnonzero((count > 0) & (count < k))
    if short.size:
        whole = []
        for i in short.tolist():
            x = name[at[i] : at[i] + 1]
            for j in range(at[i] + 1, at[i + 1]):
                x = join(x, name[j : j + 1])
            whole.append(x[0])
        got, of = np.append(got, np.array(whole, np.uint64)), np.append(of, short)
    got = mix(got)
    order = np.lexsort((got, of))
    got, of = got[order], of[order]
    new = np.ones(got.size, bool)
    new[1:] = (got[1:] != got[:-1]) | (of[1:] != of[:-1])
    got, of = got[new], of[new]
    return got, np.searchsorted(of, np.arange(n + 1))


def registers(names: np.ndarray, at: np.ndarray, count: int) -> np.ndarray:
    """A row of ``count`` 16-bit registers for each text; zeros for an empty set."""
    rng = np.random.default_rng(11)
    picks = rng.integers(0, count, (PICKS, count))
    none = 1 << 32
    n = at.size - 1
    least = np.full(n * count, none, np.uint64)
    row = np.repeat(np.arange(n), np.diff(at))
    np.minimum.at(least, row * count + ((names >> U(32)) * U(count) >> U(32)).astype(np.int64), names & U(0xFFFFFFFF))
    least = least.reshape(n, count)
    some = np.diff(at) > 0
    todo = np.flatnonzero(some & (least == none).any(1))
    own = least[todo]  # only values of the text's own buckets are lent; the first pick that has one counts
    for pick in [*picks, *((np.arange(count) + shift) % count for shift in range(1, count))]:
        if not todo.size:
            break
        now, lent = least[todo], own[:, pick]
        least[todo] = now = np.where((now == none) & (lent != none), lent, now)
        more = (now == none).any(1)
        todo, own = todo[more], own[more]
    exponent = np.frexp(least.astype(float))[1]  # bits of the value
    mantissa = np.where(exponent > MANTISSA, least >> np.maximum(exponent - MANTISSA - 1, 0).astype(np.uint64), least << np.maximum(MANTISSA + 1 - exponent, 0).astype(np.uint64)) & U((1 << MANTISSA) - 1)
    out = ((32 - exponent).astype(np.uint64) << U(MANTISSA) | mantissa).astype("<u2")
    out[~some] = 0
    return out


def estimate(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of equal registers, less the share that collides."""
    ratio = np.maximum(n, m) / np.maximum(np.minimum(n, m), 1)
    chance = _COLLISION * 2.0**-MANTISSA * 4 * ratio / (1 + ratio) ** 2
    return np.maximum(((x == y).mean(-1) - chance) / (1 - chance), 0)


def _loose(percent: int) -> float:
    share = percent / 100
    return share - LOOSE * (share * (1 - share) / (ROWS * BANDS)) ** 0.5


def _sketch(k: int, count: int):
    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                names, at = shingles(*texts(part.column("text")), k)
                size = np.diff(at)
                sums = []
                for seed in (1, 2):
                    c = np.zeros(names.size + 1, np.uint64)
                    np.cumsum(mix(names + U(seed)), out=c[1:])
                    sums.append((c[at[1:]] - c[at[:-1]]).view(np.int64))
                regs = registers(names, at, count)
                yield pa.RecordBatch.from_arrays([part.column("d"), part.column("t"), pa.array(size.astype(np.int64)), pa.array(sums[0]), pa.array(sums[1]), pa.array([r.tobytes() for r in regs], pa.binary())], names=["d", "t", "n", "k1", "k2", "regs"])

    return run


def _sets(k: int):
    """Registers and names of the shingles as arrays of numbers."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                names, at = shingles(*texts(part.column("text")), k)
                regs = np.frombuffer(b"".join(part.column("regs").to_pylist()), "<i2")
                lists = [pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(flat)) for offs, flat in ((np.arange(part.num_rows + 1) * ROWS * BANDS, regs), (at, names.view(np.int64)))]
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("n"), *lists], names=["node", "n", "regs", "names"])

    return run


def _similar(percent: int) -> Column:
    """Whether sets a and b are a link: first by the estimate of :func:`estimate`, then by the shingles themselves."""
    equal = F.size(F.filter(F.zip_with("regs_a", "regs_b", lambda x, y: x == y), lambda e: e)) / (ROWS * BANDS)
    ratio = F.greatest("n_a", "n_b") / F.greatest(F.least("n_a", "n_b"), F.lit(1))
    chance = ratio / ((1 + ratio) * (1 + ratio)) * (4 * _COLLISION * 2.0**-MANTISSA)
    both = F.size(F.array_intersect("names_a", "names_b"))
    return F.when((equal - chance) / (1 - chance) >= _loose(percent), 100 * both >= percent * (F.col("n_a") + F.col("n_b") - both)).otherwise(False)


def _across(percent: int):
    """Links between members of one block pair that connect what wasn't connected."""

    def run(pdf):
        import pandas as pd

        low = _loose(percent)
        regs = np.stack(pdf["regs"].to_numpy())
        d, n, left, own = (pdf[c].to_numpy() for c in ("node", "n", "left", "own"))
        sets = pdf["names"].to_list()
        at = np.concatenate([[0], np.cumsum([x.size for x in sets])])
        _, word = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(pdf)), np.diff(at))
        order = np.argsort(word, kind="stable")
        posting, begins = owner[order], np.searchsorted(word[order], np.arange(word.max() + 2 if word.size else 1))
        _, comp = np.unique(pdf["comp"].to_numpy(), return_inverse=True)
        right = np.flatnonzero(~left | own)
        out = []
        for i in np.flatnonzero(left):
            o = right[comp[right] != comp[i]]
            o = o[estimate(regs[i], regs[o], n[i], n[o]) >= low] if o.size else o
            if not o.size:
                continue
            # exact sizes of all intersections with this member at once
            mine = word[at[i] : at[i + 1]]
            both = np.bincount(np.concatenate([posting[begins[w] : begins[w + 1]] for w in mine]), minlength=len(pdf))[o]
            for x in o[100 * both >= percent * (n[i] + n[o] - both)]:
                if comp[x] != comp[i]:
                    comp[comp == comp[x]] = comp[i]
                    out.append((min(d[i], d[x]), max(d[i], d[x])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _links(src: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) between numbers of classes, enough of them for the components."""
    bands = F.array(*[F.xxhash64(F.substring("regs", 2 * ROWS * i + 1, 2 * ROWS), F.lit(i)) for i in range(BANDS)])
    banded = classes.select("node", F.explode(bands).alias("band"))
    full = cut(banded.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("center")).where("size > 1"))
    members = cut(dealt_join(banded, full, ["band"], frequent(full, ["band"], BANDS * classes.count(), "size")))
    some = cut(members.select("node").distinct().join(classes.select("node", "d", "t", "n", "regs"), "node"))
    sieve = Sieve.of(some.select(F.xxhash64("d", "t")))
    text = sieve.split(src, F.xxhash64("d", "t"))[0]
    # rows that repeat in id and text are one: any of them will do
    text = text.join(some, ["d", "t"]).dropDuplicates(["node"]).select("node", "n", "regs", "text")
    sets = cut(text.mapInArrow(_sets(k), "node long, n long, regs array<smallint>, names array<bigint>"))

    tested = cut(members.where("node != center").select(F.col("center").alias("a"), F.col("node").alias("b")).distinct())
    # the first member of a large bucket is copied once for FAN tests, so its tests are dealt out
    fans = cut(tested.groupBy("a").agg(F.count(F.lit(1)).alias("tests"))).withColumn("fans", F.ceil(F.col("tests") / FAN).cast("int"))
    side = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("n", "regs", "names")]
    left = sets.select(F.col("node").alias("a"), *side("a")).join(fans, "a").withColumn("fan", F.explode(F.sequence(F.lit(0), F.col("fans") - 1)))
    right = dealt_join(tested, fans, ["a"], frequent(fans, ["a"], tested.count(), "tests"))
    right = right.select("a", "b", F.pmod(F.xxhash64("b"), F.col("fans")).cast("int").alias("fan")).join(sets.select(F.col("node").alias("b"), *side("b")), "b")
    links = cut(right.join(left, ["a", "fan"]).where(_similar(percent)).select("a", "b"))

    first = cut(links.groupBy("b").agg(F.min("a").alias("a")))
    hubs = frequent(first.groupBy("a").agg(F.count(F.lit(1)).alias("links")), ["a"], first.count(), "links")
    label = dealt_join(first, first.select(F.col("b").alias("a"), F.col("a").alias("up")), ["a"], hubs, "left").select(F.col("b").alias("node"), F.coalesce("up", "a").alias("label"))
    # pairs with the center are tested already, so buckets of two are done and the others go on without it
    rest = members.where("size > 2 and node != center").select("band", "node")
    labelled = rest.join(label, "node", "left").withColumn("comp", F.coalesce("label", "node")).drop("label").join(classes.select("node", "n"), "node")
    # members of a bucket's largest component meet only those outside of it; blocks are bounded by classes and by shingles
    by_comp = labelled.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    several = by_comp.groupBy("band").agg(F.max(F.struct("c", "comp", "s")).alias("top"), F.sum("c").alias("size"), F.sum("s").alias("all")).where("size > top.c")
    blocks = lambda c, s: F.greatest(F.ceil(c / BLOCK), F.ceil(s / BLOCK_SHINGLES)).cast("int")
    several = several.select("band", "size", F.col("top.comp").alias("major"), blocks(F.col("top.c"), F.col("top.s")).alias("inner"), blocks(F.col("size") - F.col("top.c"), F.col("all") - F.col("top.s")).alias("outer"))
    labelled = cut(labelled.select("band", "node", "comp"))
    several = cut(several)
    opened = cut(dealt_join(labelled, several, ["band"], frequent(several, ["band"], labelled.count(), "size")))
    outside = F.col("comp") != F.col("major")
    own = F.pmod(F.xxhash64("node"), F.when(outside, F.col("outer")).otherwise(F.col("inner"))).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    task = lambda inner, i, j, left, alone: F.struct(F.lit(inner).alias("inner"), i.alias("i"), j.alias("j"), left.alias("left"), alone.alias("own"))
    yes, no, at = F.lit(True), F.lit(False), F.col("at")
    among = F.transform(every("outer"), lambda o: task(False, F.least(at, o), F.greatest(at, o), at <= o, at == o))
    toward = F.transform(every("inner"), lambda m: task(True, at, m, yes, no))
    tasks = F.when(outside, F.concat(among, toward)).otherwise(F.transform(every("outer"), lambda o: task(True, o, at, no, no)))
    dealt = opened.withColumn("at", own).select("band", "node", "comp", F.inline(tasks))
    more = dealt.join(sets, "node").groupBy("band", "inner", "i", "j").applyInPandas(_across(percent), "a long, b long")
    return links.unionAll(more)


def _groups(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """A row per input row: d, t, n and the first (d, t) that can be reached (root_d, root_t)."""
    src = docs.select(keyed(docs, id_col), content(docs, text_col), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    begun = made()
    sketch = cut(src.mapInArrow(_sketch(k, ROWS * BANDS), "d long, t long, n long, k1 long, k2 long, regs binary"))
    total = sketch.count()
    classes = sketch.where("n > 0").groupBy("k1", "k2", "n").agg(F.min(F.struct("d", "t", "regs")).alias("x"), F.count(F.lit(1)).alias("rows"))
    # numbers are given while the table is written and never change after that
    classes = cut(classes.select("k1", "k2", "n", "rows", "x.*").withColumn("node", F.monotonically_increasing_id()))
    comp = cut(components(_links(src, classes, k, percent)))
    least = comp.join(classes.select("node", "d", "t"), "node").groupBy("component").agg(F.min(F.struct("d", "t")).alias("root"))
    roots = comp.join(least, "component").select("node", "root")
    # a class of one row without links needs no join: it is its own root
    found = classes.join(roots, "node", "left").where("rows > 1 or root is not null").select("k1", "k2", "n", "rows", F.coalesce("root", F.struct("d", "t")).alias("root"))
    rows = sketch.select("d", "t", "n", "k1", "k2")
    found = cut(found)
    release(docs.sparkSession, begun, sketch, found)
    out = dealt_join(rows.where("n > 0"), found, ["k1", "k2", "n"], frequent(found, ["k1", "k2", "n"], total, "rows"), "left").select("d", "t", "n", "root").unionByName(rows.where("n = 0").select("d", "t", "n", F.struct("d", "t").alias("root")))
    return out.select("d", "t", "n", F.coalesce("root.d", "d").alias("root_d"), F.coalesce("root.t", "t").alias("root_t"))


def near_dedup(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns a row per input row: id, n_shingles, component_id, kept.

    Words are runs of anything but ASCII white space, A-Z in lower case; a
    text's set is its distinct ``k``-word shingles, one for all its words if
    it has fewer; texts of any length are read whole.  Two documents are
    linked if the sets' Jaccard similarity is at least ``percent`` / 100.
    component_id is the smallest id that can be reached; kept is whether that
    is the row's own.  A link at the threshold is missed once in about 30,000
    times by the bands and once in 10**9 times by the estimate.

    Null and empty texts have the empty set and are linked with nothing.  A
    null id is the smallest.  Rows that share an id (or have none) and have
    different texts are documents of their own; rows with one id and one text
    get the same row each.  Other columns, whatever their names, are ignored;
    an empty table gives an empty result.
    """
    out = _groups(docs, k, percent, id_col, text_col)
    return out.select(unkeyed(F.col("d")).alias(id_col), F.col("n").alias("n_shingles"), unkeyed(F.col("root_d")).alias("component_id"), (F.col("d") == F.col("root_d")).alias("kept"))


def drop_near_copies(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, of which one document stays for each group: the first by id, and by a hash of the text among equal ids.

    Rows that repeat in id and text are one document and stay or go together.
    """
    gone = _groups(docs, k, percent, id_col, text_col).where("d != root_d or t != root_t").select("d", "t").distinct()
    return without(with_key(docs, d=keyed(docs, id_col), t=content(docs, text_col)), gone)


ORACLE = """
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM {docs}),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS m FROM t UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.doc_id),
c AS (SELECT doc_id, min(m) AS component_id FROM r GROUP BY doc_id)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n ON n.doc_id = c.doc_id
"""
