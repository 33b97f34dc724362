"""Benchmark decontamination by greedy string tiling.

A document and a benchmark item are two token strings.  Tiles are the longest
matches that don't overlap, marked again and again until none of at least
``min_match`` tokens is left; running Karp-Rabin hashes of token runs find
them.  What the tiles cover of the item decides, so an item whose passages
were moved around is still found.

Seeds come first: hashes of ``min_match`` tokens of all items.  A document
without a seed has no tile and costs one vectorised lookup.  The benchmark is
cut into blocks of a stated size, each sent to all executors; documents are
never shuffled.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import BYTE, pieces, span_names, texts, words

#: Bytes of benchmark text in one block.
BLOCK_BYTES = 32 << 20
#: Tokens are runs of ASCII letters and digits and of all characters beyond ASCII.
TOKEN = np.zeros(256, bool)
TOKEN[48:58] = TOKEN[97:123] = TOKEN[128:] = True


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Names of the lower-cased tokens of each text and where each text's begin."""
    raw, offs = texts(pc.utf8_lower(column))
    starts, ends, text = words(raw, offs, TOKEN[raw])
    return span_names(BYTE[raw], starts, ends), np.searchsorted(text, np.arange(offs.size))


def running(names: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of k tokens, from one prefix sum whatever k is."""
    first = np.arange(max(names.size - k + 1, 0))
    return span_names(names, first, first + k)


def tile(doc: np.ndarray, item: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in doc, start in item, length), the longest first.

    Each pass looks up the unmarked runs of the search length of the item in
    a table of those of the document, extends them, marks the longest that
    still fit and goes on with a smaller length.
    """
    used_d, used_i, out = np.zeros(doc.size, bool), np.zeros(item.size, bool), []
    length = min(doc.size, item.size)
    while length >= min_match:
        free_d = np.flatnonzero(_free(used_d, length))
        free_i = np.flatnonzero(_free(used_i, length))
        hash_d, hash_i = running(doc, length)[free_d], running(item, length)[free_i]
        order = np.argsort(hash_d, kind="stable")
        left, right = np.searchsorted(hash_d[order], hash_i, "left"), np.searchsorted(hash_d[order], hash_i, "right")
        if not np.any(right > left):
            # the next length that can match: halve while nothing matches, then close in
            low, high = min_match, length - 1
            if high < low or not _any(doc, item, used_d, used_i, low):
                break
            while low < high:
                mid = (low + high + 1) // 2
                low, high = (mid, high) if _any(doc, item, used_d, used_i, mid) else (low, mid - 1)
            length = low
            continue
        for i, x, y in zip(free_i.tolist(), left.tolist(), right.tolist(), strict=True):
            if used_i[i : i + length].any():
                continue
            for d in free_d[order[x:y]].tolist():
                if not used_d[d : d + length].any() and np.array_equal(doc[d : d + length], item[i : i + length]):
                    used_d[d : d + length] = used_i[i : i + length] = True
                    out.append((d, i, length))
                    break
        length -= 1
    return out


def _free(used: np.ndarray, k: int) -> np.ndarray:
    """Where k tokens in a row are unmarked."""
    c = np.concatenate([[0], np.cumsum(used)])
    return c[k:] == c[:-k] if used.size >= k else np.zeros(0, bool)


def _any(doc, item, used_d, used_i, k) -> bool:
    return bool(np.isin(running(item, k)[_free(used_i, k)], running(doc, k)[_free(used_d, k)]).any())


def index_block(rows: list[tuple[int | None, str]], min_match: int) -> tuple:
    """(ids, token names of items, seeds by length with the items that have them): plain arrays, to be broadcast."""
    names, at = tokens(pa.array([r[1] or "" for r in rows], pa.string()))
    items = [names[at[i] : at[i + 1]] for i in range(len(rows))]
    # an item shorter than min_match is one seed of its own length
    seeds: dict[int, list[np.ndarray]] = defaultdict(list)
    places: dict[int, list[np.ndarray]] = defaultdict(list)
    for i, x in enumerate(items):
        k = min(min_match, x.size)
        if k:
            s = running(x, k)
            seeds[k].append(s)
            places[k].append(np.stack([np.full(s.size, i), np.arange(s.size)]))
    index = {}
    for k in seeds:
        s, o = np.concatenate(seeds[k]), np.concatenate(places[k], 1)
        order = np.argsort(s, kind="stable")
        index[k] = (s[order], o[0][order], o[1][order])
    return [r[0] for r in rows], items, index


def promise(doc: np.ndarray, items: list[np.ndarray], index: dict) -> list[tuple[float, int]]:
    """(most that tiles can cover of it, item) for items that share a seed with a document, the most first.

    Tiles cover only tokens that a shared seed covers, so an item that cannot
    beat the best so far is never tiled: a common phrase costs a few array
    operations an item and no tiling.
    """
    most: dict[int, int] = {}
    for k, (seeds, owners, places) in index.items():
        h = np.unique(running(doc, k))
        left, right = np.searchsorted(seeds, h, "left"), np.searchsorted(seeds, h, "right")
        n = right - left
        if not n.sum():
            continue
        at = np.repeat(left - np.cumsum(n) + n, n) + np.arange(n.sum())
        order = np.lexsort((places[at], owners[at]))
        o, p = owners[at][order], places[at][order]
        own = np.full(o.size, k)
        same = o[1:] == o[:-1]
        own[:-1][same] = np.minimum(p[1:] - p[:-1], k)[same]
        ids, where = np.unique(o, return_inverse=True)
        most.update(zip(ids.tolist(), np.bincount(where, own).astype(int).tolist(), strict=True))
    return sorted(((c / items[i].size, i) for i, c in most.items()), reverse=True)


def _scan(shared, min_match: int, keep_text: bool = False):
    """Judges row, text by one block; what another block found comes as item_id, tokens_covered, coverage and stays if it is not beaten."""

    def run(batches):
        ids, items, index = shared.value
        rank = lambda x: (x[0], -(x[2] if x[2] is not None else 2**63))
        for batch in batches:
            for part in pieces(batch, "text"):
                names, at = tokens(part.column("text"))
                seen: set[int] = set()
                for k, (seeds, *_) in index.items():
                    h = running(names, k)
                    pos = np.arange(h.size)
                    text = np.searchsorted(at, pos, "right") - 1
                    slot = np.minimum(np.searchsorted(seeds, h), seeds.size - 1)
                    seen |= set(text[(seeds[slot] == h) & (pos + k <= at[text + 1])].tolist())
                rows = []
                before = [part.column(c).to_pylist() for c in ("coverage", "tokens_covered", "item_id")] if "coverage" in part.schema.names else None
                for t in range(part.num_rows):
                    best = (before[0][t], before[1][t], before[2][t]) if before else (0.0, 0, None)
                    doc = names[at[t] : at[t + 1]]
                    for most, i in promise(doc, items, index) if t in seen else ():
                        if most < best[0]:
                            break
                        item = items[i]
                        covered = sum(n for _, _, n in tile(doc, item, min(min_match, item.size)))
                        best = max(best, (covered / item.size, covered, ids[i]), key=rank)
                    rows.append(best)
                own = ["row", "text"] if keep_text else ["row"]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in own), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([float(r[0]) for r in rows])], names=[*own, "item_id", "tokens_covered", "coverage"])

    return run


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> list[list[tuple[int | None, str]]]:
    """The benchmark, a fixed query set, in lists of at most ``block_bytes``."""
    out, size = [[]], 0
    for r in benchmark.select(id_col, text_col).dropDuplicates().orderBy(id_col, text_col).toLocalIterator():
        n = len((r[1] or "").encode())
        if out[-1] and size + n > block_bytes:
            out.append([])
            size = 0
        out[-1].append((r[0], r[1]))
        size += n
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_match: int = 5, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Returns a row per input row: id, contaminated, item_id, coverage, tokens_covered.

    item_id is the item that the document's tiles cover most (the smallest of
    equals, one without id last), null if no tile is found or the item has no
    id; coverage is the share of its tokens
    that is covered; contaminated is coverage >= ``threshold``.  Tokens are
    lower-cased runs of letters and digits; a tile has ``min_match`` of them
    at least, an item with fewer counts if all of it is there.  Null texts
    are empty and a text of any length is read whole; items without tokens
    match nothing.  Null ids stay null; rows that share an id are judged
    apart, and repeated rows each get their row; other columns, whatever their
    names, are ignored; empty tables give an empty result or no contamination.
    """
    src = docs.select(docs[id_col].cast("long").alias("row"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    found = src
    parts = blocks(benchmark, text_col="text", block_bytes=block_bytes)
    for k, part in enumerate(parts):
        shared = docs.sparkSession.sparkContext.broadcast(index_block(part, min_match))
        # rows go through all blocks in turn, so none is found again by its id
        more = k + 1 < len(parts)
        found = found.mapInArrow(_scan(shared, min_match, more), f"row long, {'text string, ' if more else ''}item_id long, tokens_covered long, coverage double")
    return found.select(F.col("row").alias(id_col), (F.col("coverage") >= threshold).alias("contaminated"), "item_id", "coverage", "tokens_covered")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = 5, threshold: float = 0.5, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, with all their columns; no shuffle."""
    out = docs
    for part in blocks(benchmark, block_bytes=block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(index_block(part, min_match))

        def run(batches, shared=shared):
            scan = _scan(shared, min_match)
            for batch in batches:
                for p in pieces(batch, text_col):
                    view = pa.RecordBatch.from_arrays([pa.array(np.arange(p.num_rows)), p.column(text_col).fill_null("")], names=["row", "text"])
                    bad = np.concatenate([np.asarray(b.column("coverage")) for b in scan([view])] or [np.zeros(0)]) >= threshold
                    yield p.filter(pa.array(~bad))

        out = out.mapInArrow(run, docs.schema)
    return out
