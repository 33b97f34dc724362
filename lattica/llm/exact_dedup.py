"""Exact deduplication by exchange of Golomb-coded fingerprints.

1. Each document becomes a slim row: id, SHA-256 of its text, fingerprint.
   Slim rows are dealt evenly into parts and kept in the shared folder.
2. Each part sorts its distinct fingerprints (those that it holds twice are
   suspects already, so copies reach an owner once a part), splits them by
   owner (a range of fingerprints) and sends each owner one Golomb-Rice coded
   list.
3. An owner decodes the lists it gets, finds the fingerprints that occur more
   than once and answers each part with a bitmap over the list it sent.
4. A part marks its suspects.  A broadcast bit table of their fingerprints
   (of bounded size) lets the other texts stay where they are: only suspects,
   and about one in 16 of the others (more once the table is full), are
   shuffled.  Texts of one SHA-256 are
   compared byte by byte as min = max, which Spark combines before the
   shuffle, so a group of copies is never in one task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import Sieve, content, cut, dealt_join, frequent, keyed, made, release, unkeyed, with_key, without

#: Bits of a fingerprint; 48 make about one false suspect in 10**5 at 10**9 documents.
BITS = 48
#: Slim rows in a part: at least and at most.
PART_ROWS, PART_MOST = 50_000, 1 << 20
#: Fingerprints with an owner, about.
OWNER_ROWS = 2_000_000


def layout(n: int, part_rows: int = PART_ROWS) -> tuple[int, int]:
    """Parts and owners for n rows.

    A list, from one part to one owner, costs a header, so parts grow with n
    until they have PART_MOST rows: lists keep about 100 fingerprints at 20,000
    parts, and a fingerprint costs less than five bytes.
    """
    rows = min(max(part_rows, math.isqrt(64 * n)), PART_MOST)
    parts = max(1, -(-n // rows))
    return parts, min(parts, max(1, -(-n // OWNER_ROWS), min(parts, 8)))


def golomb_encode(values: np.ndarray, width: int) -> bytes:
    """Sorted non-negative integers as Golomb-Rice coded gaps.

    Layout: count and parameter k (12 bytes), then the gaps' quotients in
    unary (q zeros and a one), then their k-bit remainders, each stream padded
    to bytes, so both are read without a loop.
    """
    n = values.size
    gaps = np.diff(values, prepend=0).astype(np.uint64)
    k = max(0, int(math.log2(max(1.0, 2.0**width / max(n, 1)))))
    q = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.zeros(int(q.sum()) + n, np.uint8)
    unary[np.cumsum(q + 1) - 1] = 1
    low = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)[None, :]) & np.uint64(1)).astype(np.uint8)
    head = np.array([n, unary.size, k], "<i4").tobytes()
    return head + np.packbits(unary).tobytes() + np.packbits(low.ravel()).tobytes()


def golomb_decode(data: bytes) -> np.ndarray:
    """Undoes :func:`golomb_encode`."""
    n, size, k = np.frombuffer(data, "<i4", 3).tolist()
    raw = np.frombuffer(data, np.uint8)[12:]
    used = (size + 7) // 8
    ones = np.flatnonzero(np.unpackbits(raw[:used], count=size))
    q = np.diff(ones, prepend=-1) - 1
    low = np.unpackbits(raw[used:], count=n * k).reshape(n, k).astype(np.uint64) if k else np.zeros((n, 0), np.uint64)
    gaps = (q.astype(np.uint64) << np.uint64(k)) + (low << np.arange(k, dtype=np.uint64)).sum(1, dtype=np.uint64)
    return np.cumsum(gaps).astype(np.int64)


def _send(owners: int, bits: int):
    step = -(-(1 << bits) // owners)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fp = np.unique(pdf["fp"].to_numpy(np.int64))
        owner = fp // step
        cuts = np.flatnonzero(np.diff(owner, prepend=-1))
        rows = [(int(owner[s]), int(pdf["part"].iloc[0]), golomb_encode(fp[s:e] - owner[s] * step, math.ceil(math.log2(step)) if step > 1 else 0)) for s, e in zip(cuts, [*cuts[1:], fp.size], strict=True)]
        return pd.DataFrame(rows, columns=["owner", "part", "code"])

    return run


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    lists = [golomb_decode(c) for c in pdf["code"]]
    values, counts = np.unique(np.concatenate(lists), return_counts=True)
    twice = values[counts > 1]
    return pd.DataFrame({"part": pdf["part"], "owner": pdf["owner"], "bitmap": [np.packbits(np.isin(x, twice)).tobytes() for x in lists]})


def _mark(rows: pd.DataFrame, bitmaps: pd.DataFrame) -> pd.DataFrame:
    values, where, counts = np.unique(rows["fp"].to_numpy(np.int64), return_inverse=True, return_counts=True)
    suspect = counts > 1
    owner = values // int(bitmaps["step"].iloc[0])
    for o, b in zip(bitmaps["owner"], bitmaps["bitmap"], strict=True):
        s, e = np.searchsorted(owner, [o, o + 1])
        suspect[s:e] |= np.unpackbits(np.frombuffer(b, np.uint8), count=e - s).astype(bool)
    return pd.DataFrame({"d": rows["d"], "t": rows["t"], "fp": rows["fp"], "sha": rows["sha"], "suspect": suspect[where]})


def _sha(text):
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _groups(src: DataFrame, n: int, bits: int, part_rows: int) -> tuple[DataFrame, DataFrame]:
    """Slim rows (d, t, sha, suspect), and groups of suspects (sha, keep, keep_t, size, repeats), each verified byte by byte.

    ``src`` has d, t and text.  ``repeats`` counts the rows that equal the one
    that stays in id and text.
    """
    begun = made()
    parts, owners = layout(n, part_rows)
    step = -(-(1 << bits) // owners)
    fp = F.conv(F.substring(F.hex("sha"), 1, 15), 16, 10).cast("long").bitwiseAND(F.lit((1 << bits) - 1))
    # rows are dealt by their number while the table is written, so neither equal ids nor equal rows meet in one part
    part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)).cast("int")
    slim = cut(src.select("d", "t", _sha(F.col("text")).alias("sha")).select("d", "t", "sha", fp.alias("fp"), part.alias("part")))
    sent = slim.select("part", "fp").groupBy("part").applyInPandas(_send(owners, bits), "owner long, part int, code binary")
    bitmaps = sent.groupBy("owner").applyInPandas(_answer, "part int, owner long, bitmap binary").withColumn("step", F.lit(step).cast("long"))
    marked = cut(slim.groupBy("part").cogroup(bitmaps.groupBy("part")).applyInPandas(_mark, "d long, t long, fp long, sha binary, suspect boolean"))
    suspects = marked.where("suspect")
    keys = cut(suspects.select(F.xxhash64("fp").alias("k")).distinct())
    sieve = Sieve.of(keys)
    texts = src.select("text", _sha(F.col("text")).alias("sha")).select("text", "sha", fp.alias("fp"))
    texts = sieve.split(texts, F.xxhash64("fp"))[0]
    same = texts.groupBy("sha").agg(F.min("text").alias("a"), F.max("text").alias("b"))
    same = same.select("sha", F.when(F.col("a") == F.col("b"), F.lit(True)).otherwise(F.raise_error(F.lit("different texts with one SHA-256"))).alias("verified"))
    pos = F.struct("d", "t")
    groups = suspects.groupBy("sha", "d", "t").agg(F.count(F.lit(1)).alias("n")).groupBy("sha").agg(F.max(F.struct(pos.alias("pos"), "n")).alias("x"), F.sum("n").alias("size"))
    groups = groups.join(same, "sha").where("verified")
    groups = cut(groups.select("sha", F.col("x.pos.d").alias("keep"), F.col("x.pos.t").alias("keep_t"), "size", F.col("x.n").alias("repeats")))
    release(src.sparkSession, begun, marked, groups)
    return marked.select("d", "t", "sha", "suspect"), groups


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, part_rows: int = PART_ROWS) -> DataFrame:
    """Returns a row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; null counts as empty; a text of any
    length is hashed and compared whole.  Of equal texts the row with the
    largest id stays (a null id is the smallest).  Rows that share text and id
    are one group, of which each row reads kept = true if that id is the
    largest; :func:`drop_copies` keeps one of them.  Rows that share an id but
    not the text are apart.  Other columns, whatever their names, are ignored;
    an empty table gives an empty result.  If two texts had the same SHA-256
    the job would fail rather than drop one.
    """
    src = docs.select(keyed(docs, id_col), content(docs, text_col), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    n = docs.count()
    marked, groups = _groups(src, n, bits, part_rows)
    single = marked.where("not suspect").select("d", F.col("d").alias("keep"), F.lit(1).cast("long").alias("size"), "sha")
    double = dealt_join(marked.where("suspect").select("d", "sha"), groups.select("sha", "keep", "size"), ["sha"], frequent(groups, ["sha"], n, "size")).select("d", "keep", "size", "sha")
    out = single.unionByName(double)
    return out.select(unkeyed(F.col("d")).alias(id_col), unkeyed(F.col("keep")).alias("keep_id"), F.col("size").alias("group_size"), (F.col("d") == F.col("keep")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, part_rows: int = PART_ROWS) -> DataFrame:
    """The rows of ``docs``, with all columns, of which one stays for each text: that with the largest id, repeats of it go too.

    Of rows that repeat in id and text and differ in other columns, the one
    whose remaining columns sort first as JSON stays.
    """
    src = docs.select(keyed(docs, id_col), content(docs, text_col), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    n = docs.count()
    marked, groups = _groups(src, n, bits, part_rows)
    double = dealt_join(marked.where("suspect").select("d", "t", "sha"), groups, ["sha"], frequent(groups, ["sha"], n, "size"))
    # all rows of a repeated key leave here, and one of them comes back below
    gone = double.where("d != keep or t != keep_t or repeats > 1").select("d", "t").distinct()
    rows = with_key(docs, d=keyed(docs, id_col), t=content(docs, text_col))
    again = groups.where("repeats > 1").select(F.col("keep").alias("d"), F.col("keep_t").alias("t"))
    once = rows.join(again, ["d", "t"], "left_semi").groupBy("d", "t").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*")
    return without(rows, gone).unionByName(once)


ORACLE = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM {docs} WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
