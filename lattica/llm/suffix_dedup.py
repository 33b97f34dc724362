"""Removal of repeated byte strings by distributed prefix doubling.

A byte is removed when it lies in a ``length``-byte string that also starts
earlier in the corpus (smaller id, or the same document and an earlier start).

Prefix doubling gives each position a rank for its next h bytes, then for its
next 2h from the pair (rank at p, rank at p + h), and drops positions whose
rank is unique.  This module departs from it in two ways: a rank is a 64-bit
hash of its pair instead of a number from a sort, so the rounds for h = 1, 2,
4 ... 64 run inside each text without a shuffle, and only four rounds are
global.  In these Spark deals and sorts (rank, position) rows and drops those
whose rank is unique:

* h = 32: each window of ``length`` bytes is represented by the position of
  its smallest 32-byte rank, so one row stands for about 35 positions.  A rank
  that occurs once is unique, and all windows it stands for leave;
* all bytes that the windows of a row cover (its context): equal ones repeat
  as a whole, the earliest stays, and the others are cut without further work,
  so copies cost one row per 35 bytes;
* where contexts differ (the edges of repeats), runs of 18 windows by the 83
  bytes that they share; unique ones leave;
* single windows by their pair (rank64 at p, rank64 at p + 36).

Ranks carry 128 bits together (32-byte rank and context or window).  What a
task has met more than once is known to repeat: it sends one row for such a
rank, and the others skip the round or, if they equal an earlier row, all
rounds.  So a string that is in every document reaches its task once a task
that reads documents, not once a document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import Sieve, content, cut, keyed, unkeyed
from ._text import BYTE, CHUNK, U, join, mix, pieces, texts

SEED = 32
#: Repeating groups that a task remembers.
SEEN = 50_000
_ANCHORS = "g long, c long, d long, t long, pack long"
#: Bits of the distances that :func:`pack` keeps beside an anchor.
_BITS = 12
_MASK = (1 << _BITS) - 1
#: Kinds of rows: nothing is known; an equal row is earlier; one of several with this rank in a task; the one that is sent for them.
PLAIN, DUP, ONE_OF, FIRST_OF = range(4)


def pack(a, lo, last, kind):
    """An anchor, its first and last window start and its kind, in one integer; rows are moved by the million."""
    return (((a << _BITS | (a - lo)) << _BITS) | (last - lo)) << 2 | kind


def unpack(x):
    """Undoes :func:`pack` but for the kind: (anchor, first start, last start)."""
    a = x >> (2 * _BITS + 2)
    lo = a - (x >> (_BITS + 2) & _MASK)
    return a, lo, lo + (x >> 2 & _MASK)


def ranks(raw: np.ndarray, upto: int) -> dict[int, np.ndarray]:
    """Names of the next h bytes at every position, h = 1, 2, 4 ... ``upto``; shorter arrays where fewer bytes follow."""
    out, h = {1: BYTE[raw]}, 1
    while 2 * h <= upto:
        r = out[h]
        out[2 * h] = join(r[: max(r.size - h, 0)], r[h:])
        h *= 2
    return {k: out[k] for k in (SEED, h) if k in out}


def cover(r: np.ndarray, h: int, length: int) -> np.ndarray:
    """Names of the next ``length`` bytes (h <= length <= 2h) from two overlapping ranks of h bytes."""
    shift = length - h
    return join(r[: max(r.size - shift, 0)] ^ U(length), r[shift:]) if shift else r


def _largest(length: int) -> int:
    return 1 << (length.bit_length() - 1)


def anchors(raw: np.ndarray, offs: np.ndarray, length: int):
    """For a run of texts: name, context name, text number, anchor, first and last window start of each group of windows."""
    reach = length - SEED + 1
    n = np.maximum(np.diff(offs) - length + 1, 0)
    total = int(n.sum())
    if not total:
        return None
    at = np.repeat(offs[:-1] - (np.cumsum(n) - n), n) + np.arange(total)
    text = np.repeat(np.arange(n.size), n)
    top = _largest(length)
    r = ranks(raw, top)
    r32 = r[SEED]
    least = (r32 & U(0xFFFFFFFF00000000)) | np.arange(r32.size, dtype=np.uint64)
    k = 1
    while 2 * k <= reach:
        least = np.minimum(least[:-k], least[k:])
        k *= 2
    if reach > k:
        least = np.minimum(least[: least.size - (reach - k)], least[reach - k :])
    where = (least[at] & U(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(total, bool)
    new[1:] = (where[1:] != where[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], total) - 1
    a, lo, hi, text = where[first], at[first], at[last], text[first]
    whole = cover(r[top], top, length)
    shape = (((a - lo) << 20) | (hi - lo)).astype(np.uint64)
    c = mix(join(whole[lo], whole[hi]) + shape * U(0x9E3779B97F4A7C15))
    begin = offs[text]
    return mix(r32[a]).view(np.int64), c.view(np.int64), text, a - begin, lo - begin, hi - begin


def _ids(part, text) -> tuple[np.ndarray, np.ndarray]:
    """Id and text hash of each row's document."""
    return tuple(part.column(k).to_numpy(zero_copy_only=False)[text] for k in ("d", "t"))


def _merge(h, c, d, t, a):
    """True where an equal (h, c) that is earlier by (d, t, a) is in the same chunk; rows of one document and place are one."""
    order = np.lexsort((a, t, d, c, h))
    h, c, d, t, a = (x[order] for x in (h, c, d, t, a))
    new = np.ones(order.size, bool)
    new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    dup = np.empty(order.size, bool)
    dup[order] = (d != d[first]) | (t != t[first]) | (a != a[first])
    return dup


class _Seen:
    """Groups that a task has met more than once, with their earliest place; bounded, and safe to forget."""

    def __init__(self):
        self.first: dict[tuple[int, int], tuple[int, int, int]] = {}
        self.names = np.zeros(0, np.int64)

    def mark(self, h, c, d, t, a, dup) -> None:
        """Sets ``dup`` where an equal group that is earlier was met before, and learns the groups that repeat in this chunk."""
        for i in np.flatnonzero(~dup & _within(h, self.names)).tolist():
            key, place = (int(h[i]), int(c[i])), (int(d[i]), int(t[i]), int(a[i]))
            if key in self.first:
                dup[i] = self.first[key] < place
                self.first[key] = min(self.first[key], place)
        if len(self.first) < SEEN:
            again = set(zip(h[dup].tolist(), c[dup].tolist(), strict=True))
            new = [i for i in np.flatnonzero(~dup & np.isin(h, h[dup])).tolist() if (int(h[i]), int(c[i])) in again]
            for i in new:
                self.first.setdefault((int(h[i]), int(c[i])), (int(d[i]), int(t[i]), int(a[i])))
            if new:
                self.names = np.unique(np.append(self.names, h[new]))


class _Several:
    """Ranks that a task has met more than once; bounded, and safe to forget."""

    def __init__(self):
        self.names = np.zeros(0, np.int64)

    def kinds(self, names: np.ndarray) -> np.ndarray:
        """PLAIN, ONE_OF or FIRST_OF for each name; later rows of a name that was FIRST_OF are ONE_OF."""
        order = np.argsort(names, kind="stable")
        same = names[order][1:] == names[order][:-1]
        after, before = np.zeros(names.size, bool), np.zeros(names.size, bool)
        after[order[1:]], before[order[:-1]] = same, same
        known = _within(names, self.names)
        if self.names.size < SEEN:
            self.names = np.union1d(self.names, names[before & ~after])
        return np.where(known | after, ONE_OF, np.where(before, FIRST_OF, PLAIN))


def _within(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, x), known.size - 1)] == x if known.size else np.zeros(x.size, bool)


def _alone(d, t, a) -> np.ndarray:
    """A name that no other row has, so that rows which need no company are dealt evenly."""
    return mix(mix(d.view(np.uint64) ^ t.view(np.uint64)) + a.astype(np.uint64)).view(np.int64)


def _emit(length: int, chunk: int):
    def run(batches):
        seen, several = _Seen(), _Several()
        for batch in batches:
            for part in pieces(batch, "text", chunk):
                raw, offs = texts(part.column("text"))
                found = anchors(raw, offs, length)
                if found is None:
                    continue
                h, c, text, a, lo, last = found
                d, t = _ids(part, text)
                dup = _merge(h, c, d, t, a)
                seen.mark(h, c, d, t, a, dup)
                kind = np.full(h.size, DUP)
                kind[~dup] = several.kinds(h[~dup])
                # one of several goes to the rows of its context at once, which undoes the ^
                g = np.where(dup, _alone(d, t, a), np.where(kind == ONE_OF, h ^ c, h))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (g, np.where(dup, 0, c), d, t, pack(a, lo, last, kind))], names=["g", "c", "d", "t", "pack"])

    return run


#: Windows of an anchor that share a rank in the round before the last.
WIDTH = 18


def _edges(part, upto: int):
    """Offsets, ranks, text number, name, anchor, first and last window start of the edges in a part."""
    raw, offs = texts(part.column("text"))
    marks = part.column("edges")
    text = np.repeat(np.arange(len(marks)), np.asarray(marks.value_lengths().fill_null(0)))
    a, lo, last = unpack(marks.flatten().to_numpy(zero_copy_only=False))
    r = ranks(raw, upto)
    return offs, r, text, mix(r[SEED][offs[text] + a]) if text.size else None, a, lo, last


def _groups(length: int):
    """One row for each run of up to WIDTH windows, ranked by the bytes that all of them have."""

    def run(batches):
        top, common, several = _largest(length), length - WIDTH + 1, _Several()
        h_top = top if top <= common else top // 2
        for batch in batches:
            for part in pieces(batch, "text"):
                offs, r, text, h, a, lo, last = _edges(part, h_top)
                if not text.size:
                    continue
                first, final = (a - last) // WIDTH, (a - lo) // WIDTH
                n = final - first + 1
                row = np.repeat(np.arange(n.size), n)
                g = first[row] + np.arange(row.size) - np.repeat(np.cumsum(n) - n, n)
                whole = cover(r[h_top], h_top, common)
                key = mix(whole[np.minimum(offs[text[row]] + a[row] - g * WIDTH, whole.size - 1)])
                k2 = mix(h[row] + g.astype(np.uint64))
                d, t = _ids(part, text[row])
                kind = several.kinds((key ^ mix(k2)).view(np.int64))
                key = np.where(kind == ONE_OF, _alone(d, t, a[row] + g), key.view(np.int64))
                own = pack(a[row], np.maximum(lo[row], a[row] - g * WIDTH - WIDTH + 1), np.minimum(last[row], a[row] - g * WIDTH), kind)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, k2.view(np.int64), d, t, own)], names=["key", "k2", "d", "t", "pack"])

    return run


def _windows(length: int):
    """One row for each window that needs its own rank."""

    def run(batches):
        top, seen = _largest(length), _Seen()
        for batch in batches:
            for part in pieces(batch, "text"):
                offs, r, text, h, a, lo, last = _edges(part, top)
                if not text.size:
                    continue
                n = last - lo + 1
                row = np.repeat(np.arange(n.size), n)
                p = lo[row] + np.arange(row.size) - np.repeat(np.cumsum(n) - n, n)
                whole = cover(r[top], top, length)
                key = whole[np.minimum(offs[text[row]] + p, whole.size - 1)].view(np.int64)
                k2 = mix(h[row] + (a[row] - p).astype(np.uint64)).view(np.int64)
                d, t = _ids(part, text[row])
                dup = _merge(key, k2, d, t, p)
                seen.mark(key, k2, d, t, p, dup)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.where(dup, _alone(d, t, p), key), np.where(dup, 0, k2), d, t, p << 1 | dup)], names=["key", "k2", "d", "t", "p"])

    return run


def spans(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The union of half-open spans, as sorted rows (start, end); spans that touch become one."""
    if not starts.size:
        return np.zeros((0, 2), np.int64)
    order = np.argsort(starts, kind="stable")
    s, e = starts[order].astype(np.int64), np.maximum.accumulate(ends[order].astype(np.int64))
    new = np.ones(s.size, bool)
    new[1:] = s[1:] > e[:-1]
    first = np.flatnonzero(new)
    return np.stack([s[first], e[np.append(first[1:], s.size) - 1]], 1)


def _values(x) -> np.ndarray:
    return x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.zeros(0, np.int64)


def _finish(length: int, with_text: bool):
    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text", 1 << 22):
                raw, offs = texts(part.column("text"))
                repeats, single = part.column("repeats"), part.column("single")
                rows = []
                for i in range(part.num_rows):
                    own = raw[offs[i] : offs[i + 1]]
                    _, lo, last = unpack(_values(repeats[i]))
                    p = _values(single[i]) >> 1
                    cuts = np.minimum(spans(np.append(lo, p), np.append(last, p) + length), own.size)
                    kept, at = [], 0
                    for s, e in cuts.tolist():
                        kept.append(own[at:s].tobytes())
                        at = e
                    kept.append(own[at:].tobytes())
                    left = b"".join(kept)
                    rows.append((own.size, int((cuts[:, 1] - cuts[:, 0]).sum()), len(cuts), hashlib.sha256(left).hexdigest(), left))
                cols = list(zip(*rows, strict=True))
                arrays = [part.column("d"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3])]
                names = ["d", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if with_text:
                    arrays.append(pa.array(cols[4], pa.binary()))
                    names.append("kept")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def suffix_dedup(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, chunk: int = CHUNK) -> DataFrame:
    """Cuts every byte covered by a ``length``-byte string that also starts earlier.

    Returns a row per input row: id, n_bytes, n_removed, n_spans, kept_sha256
    and, with ``with_text``, the kept bytes.  A null text is empty; a text
    shorter than ``length`` loses nothing; a text of any length is treated
    whole.  Null ids come before all others.  Rows that share an id (or have
    none) and differ in text are documents of their own, in the order of a
    hash of the text; rows with one id and one text are one document and each
    get its row.  Other columns, whatever their names, are ignored; an empty
    table gives an empty result.  ``length`` is from 64 to 4096; ``chunk``
    bytes of text are worked on at once.
    """
    if not 2 * SEED <= length <= _MASK + 1:
        raise ValueError(f"length is from {2 * SEED} to {_MASK + 1}")
    src = docs.select(keyed(docs, id_col), content(docs, text_col), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    found = src.mapInArrow(_emit(length, chunk), _ANCHORS)
    kind, pos = F.col("pack").bitwiseAND(F.lit(3)), F.struct("d", "t", "pack")
    by_rank = Window.partitionBy("g")
    counted = found.withColumns({"n": F.count(F.lit(1)).over(by_rank), "least": F.min("c").over(by_rank), "most": F.max("c").over(by_rank), "of": F.max(kind).over(by_rank)})
    alive = counted.where((kind != PLAIN) | (F.col("n") > 1))
    h = F.when(kind == ONE_OF, F.col("g").bitwiseXOR(F.col("c"))).otherwise(F.col("g"))
    # several contexts: in these rows, or in the task of a row that was sent for others
    alive = alive.select(h.alias("h"), "c", "d", "t", "pack", ((F.col("least") != F.col("most")) | (F.col("of") >= ONE_OF)).alias("differ"))
    ranked = alive.withColumn("first", F.min(pos).over(Window.partitionBy("h", "c")))
    marks = ranked.select("d", "t", "pack", ((kind == DUP) | (pos != F.col("first"))).alias("repeat"), "differ").where("repeat or differ")
    # sets, as rows that repeat as a whole have the same marks
    marks = cut(marks.groupBy("d", "t").agg(F.collect_set(F.when(F.col("repeat"), F.col("pack"))).alias("repeats"), F.collect_set(F.when(~F.col("repeat"), F.col("pack"))).alias("edges")))
    # texts without a mark stay where they are; one exchange of the others serves all joins below
    sieve = Sieve.of(marks.select(F.xxhash64("d", "t")))
    maybe, free = sieve.split(src, F.xxhash64("d", "t"))
    by_id = maybe.repartition("d", "t")
    window = Window.partitionBy("key", "k2")
    edge = by_id.join(marks.where(F.size("edges") > 0).select("d", "t", "edges"), ["d", "t"])
    edge = edge.mapInArrow(_groups(length), "key long, k2 long, d long, t long, pack long").withColumn("n", F.count(F.lit(1)).over(window)).where((F.col("n") > 1) | (kind != PLAIN))
    edge = edge.groupBy("d", "t").agg(F.collect_set("pack").alias("edges"))
    single = by_id.join(edge, ["d", "t"]).mapInArrow(_windows(length), "key long, k2 long, d long, t long, p long")
    place = F.struct("d", "t", F.shiftright("p", 1).alias("p"))
    single = single.withColumn("first", F.min(place).over(window)).where((F.col("p").bitwiseAND(F.lit(1)) == 1) | (place != F.col("first")))
    single = single.groupBy("d", "t").agg(F.collect_set("p").alias("single"))
    kinds = "d long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    marked = by_id.join(marks.select("d", "t", "repeats"), ["d", "t"], "left").join(single, ["d", "t"], "left").select("d", "text", "repeats", "single")
    none = F.lit(None).cast("array<long>")
    out = marked.unionByName(free.select("d", "text", none.alias("repeats"), none.alias("single"))).mapInArrow(_finish(length, with_text), kinds)
    return out.withColumn("d", unkeyed(F.col("d"))).withColumnRenamed("d", id_col)


ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM {docs}),
w AS (SELECT doc_id, p, md5(substr(x, 2 * p + 1, 200)) AS g FROM (SELECT doc_id, x, unnest(range(0, greatest(length(x) // 2 - 99, 0))) AS p FROM d)),
k AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS i FROM w) WHERE i > 1),
m AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM (SELECT doc_id, p, CASE WHEN p - lag(p, 1, -1000) OVER (PARTITION BY doc_id ORDER BY p) > 100 THEN 1 ELSE 0 END AS new FROM k)),
r AS (SELECT doc_id, run, min(p) AS s, max(p) + 100 AS e FROM m GROUP BY doc_id, run),
c AS (SELECT doc_id, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY s) AS a, s AS b FROM r
      UNION ALL SELECT d.doc_id, coalesce(max(e), 0), any_value(length(x) // 2) FROM d LEFT JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id),
h AS (SELECT d.doc_id, any_value(length(x) // 2) AS n, sum(b - a) AS kept, count(*) - 1 AS runs, string_agg(substr(x, 2 * a + 1, 2 * (b - a)), '' ORDER BY a, b) AS y FROM d JOIN c ON c.doc_id = d.doc_id GROUP BY d.doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(n - kept AS BIGINT) AS n_removed, CAST(runs AS BIGINT) AS n_spans, sha256(unhex(y)) AS kept_sha256 FROM h
"""
