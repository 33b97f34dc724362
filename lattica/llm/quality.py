"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting fits shallow trees to one feature (later to one pair) at a
time; their sum is a lookup table a feature or pair.  A score is the sigmoid of
an intercept and one table entry a feature and pair: bin numbers and additions,
vectorised over documents.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import BYTE, LOWER, SPACE, mix, pieces, span_names, texts, words

#: Labelled documents that a model is fitted on at most, those with the smallest hash of their id.
MAX_TRAIN = 20_000
FEATURES = ("log_words", "word_bytes", "upper", "symbols", "digits", "distinct_words", "repeated_next", "symbol_ends", "no_letters", "lines_per_word", "short_words", "exclamations", "non_ascii", "distinct_pairs", "full_stops", "pipes")

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARKS = ~(_LETTER | _DIGIT | SPACE)
_MARKS[[ord(c) for c in ".,'-"]] = False


def features(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of :data:`FEATURES` a text; a text without words has zeros only."""
    n_text = offs.size - 1

    def count(flag: np.ndarray, at: np.ndarray) -> np.ndarray:
        c = np.zeros(flag.size + 1, np.int64)
        np.cumsum(flag, out=c[1:])
        return (c[at[1:]] - c[at[:-1]]).astype(float)

    starts, ends, text = words(raw, offs)
    at = np.searchsorted(text, np.arange(n_text + 1))
    n = np.diff(at).astype(float)
    w, size = np.maximum(n, 1), np.maximum(np.diff(offs), 1).astype(float)
    names = span_names(BYTE[LOWER[raw]], starts, ends)
    same_text = text[1:] == text[:-1]
    follows = np.zeros(text.size, bool)
    follows[1:] = same_text & (names[1:] == names[:-1])
    pair = mix(names[:-1] * np.uint64(3) + names[1:])[same_text]

    def distinct(values: np.ndarray, of: np.ndarray) -> np.ndarray:
        if not values.size:
            return np.zeros(n_text)
        order = np.lexsort((values, of))
        v, o = values[order], of[order]
        new = np.ones(v.size, bool)
        new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
        return np.bincount(o[new], minlength=n_text).astype(float)

    letters = np.zeros(raw.size + 1, np.int64)
    np.cumsum(_LETTER[raw], out=letters[1:])
    last = raw[ends - 1] if ends.size else np.zeros(0, np.uint8)
    n_letters = np.maximum(count(_LETTER[raw], offs), 1)
    out = np.stack([
        np.log1p(n), count(ends - starts, at) / w, count(_UPPER[raw], offs) / n_letters, count(_MARKS[raw], offs) / size, count(_DIGIT[raw], offs) / size,
        distinct(names, text) / w, count(follows, at) / w, count(_MARKS[last], at) / w, count(letters[ends] == letters[starts], at) / w, count(raw == 10, offs) / w,
        count(ends - starts <= 3, at) / w, count(raw == 33, offs) / w, count(raw >= 128, offs) / size, distinct(pair, text[1:][same_text]) / w, count(last == 46, at) / w, count(raw == 124, offs) / w,
    ], 1)
    out[n == 0] = 0
    return out


@dataclass
class Gam:
    """Bin edges and lookup tables."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += table[np.searchsorted(edges, x[:, f], "right")]
        for f, g, ef, eg, table in self.pairs:
            z += table[np.searchsorted(ef, x[:, f], "right"), np.searchsorted(eg, x[:, g], "right")]
        return 1 / (1 + np.exp(-z))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins))


def _gain(g, h):
    return g * g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf values over bins of the tree that reduces the loss most, split by split."""
    out = np.full(g.size, -g.sum() / (h.sum() + 1.0))
    if depth and g.size > 1:
        gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gain = _gain(gl, hl) + _gain(g.sum() - gl, h.sum() - hl)
        gain[(hl < 1e-3) | (h.sum() - hl < 1e-3)] = -np.inf
        k = int(np.argmax(gain))
        if gain[k] > _gain(g.sum(), h.sum()) + 1e-9:
            out[: k + 1], out[k + 1 :] = _tree(g[: k + 1], h[: k + 1], depth - 1), _tree(g[k + 1 :], h[k + 1 :], depth - 1)
    return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.2, bins: int = 48, n_pairs: int = 6, pair_rounds: int = 40, pair_bins: int = 8) -> Gam:
    """Fits by cyclic boosting; the same rows give the same model.  Without both labels the model is the share of label 1 (0.5 without rows)."""
    share = (y.sum() + 0.5) / (y.size + 1)
    model = Gam(float(np.log(share / (1 - share))))
    if y.size == 0 or y.min() == y.max():
        return model
    model.edges = [_edges(x[:, f], bins) for f in range(x.shape[1])]
    model.tables = [np.zeros(e.size + 1) for e in model.edges]
    at = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(model.edges)]
    z = np.full(y.size, model.intercept)

    def slopes():
        p = 1 / (1 + np.exp(-z))
        return p - y, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for f, table in enumerate(model.tables):
            g, h = slopes()
            step = rate * _tree(np.bincount(at[f], g, table.size), np.bincount(at[f], h, table.size))
            table += step
            z += step[at[f]]
    # pairs: the best single cut in each of the two features, on the residual
    coarse = [_edges(x[:, f], pair_bins) for f in range(x.shape[1])]
    cat = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(coarse)]

    def grid(f, k, v):
        n, m = coarse[f].size + 1, coarse[k].size + 1
        return np.bincount(cat[f] * m + cat[k], v, n * m).reshape(n, m)

    def quadrants(f, k):
        """The cut whose four quadrants reduce the loss most: gain and leaf values over the grid."""
        g, h = slopes()
        a, b = grid(f, k, g), grid(f, k, h)
        if min(a.shape) < 2:
            return -1.0, np.zeros(a.shape)
        ca, cb = a.cumsum(0).cumsum(1), b.cumsum(0).cumsum(1)
        q = lambda c: (c[:-1, :-1], c[:-1, -1:] - c[:-1, :-1], c[-1:, :-1] - c[:-1, :-1], c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + c[:-1, :-1])
        qa, qb = q(ca), q(cb)
        gain = sum(_gain(i, j) for i, j in zip(qa, qb, strict=True))
        i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
        leaf, v = np.zeros(a.shape), [-qa[t][i, j] / (qb[t][i, j] + 1.0) for t in range(4)]
        leaf[: i + 1, : j + 1], leaf[: i + 1, j + 1 :], leaf[i + 1 :, : j + 1], leaf[i + 1 :, j + 1 :] = v
        return float(gain[i, j]), leaf

    every = [(f, k) for f in range(x.shape[1]) for k in range(f + 1, x.shape[1])]
    best = sorted(every, key=lambda p: (-quadrants(*p)[0], p))[:n_pairs]
    tables = {p: np.zeros((coarse[p[0]].size + 1, coarse[p[1]].size + 1)) for p in best}
    for _ in range(pair_rounds):
        for p in best:
            _, leaf = quadrants(*p)
            tables[p] += rate * leaf
            z += rate * leaf[cat[p[0]], cat[p[1]]]
    model.pairs = [(f, k, coarse[f], coarse[k], tables[f, k]) for f, k in best]
    return model


def _rows(make):
    """A mapInArrow function from a function of (features, part of the batch) to a record batch."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                yield make(features(*texts(part.column("text"))), part)

    return run


def held_out(id_col: str, fold: int = 5, rest: int = 0):
    """True where crc32 of the id as text leaves ``rest``; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % fold == rest, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN) -> Gam:
    """Fits a model on at most ``max_train`` labelled documents outside the held-out fold.

    Of an id labelled twice the larger label counts, null labels don't; of
    rows that share an id the one whose features sort first counts, so the
    driver gets one row an id.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("double").alias("y"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(max_train)
    src = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    # the side is bounded by max_train rows of two numbers
    table = src.join(F.broadcast(known), "id").select("id", "y", "text")
    seen = table.mapInArrow(_rows(lambda x, part: pa.RecordBatch.from_arrays([part.column("id"), part.column("y"), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "y", "x"])), "id long, y double, x array<double>")
    got = seen.groupBy("id").agg(F.min(F.struct("x", "y")).alias("r")).select("id", "r.y", "r.x").toPandas()
    x = np.array(got["x"].tolist(), float).reshape(len(got), len(FEATURES))
    order = np.lexsort((*x.T, got["id"].to_numpy())) if len(got) else []
    return fit(x[order], (got["y"].to_numpy(float)[order] > 0).astype(float))


def score_quality(docs: DataFrame, model: Gam, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Returns a row per input row: id, held_out, score (probability of label 1), predicted.

    A null text counts as empty; an empty text has all features zero and gets
    the score the model has for that; a text of any length is read whole.  A
    null id is never held out; rows that share an id and repeated rows each
    get their row; equal scores stay equal, nothing is ranked; other columns,
    whatever their names, are ignored; an empty table gives an empty result.
    """
    src = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    out = src.mapInArrow(_rows(lambda x, part: pa.RecordBatch.from_arrays([part.column("id"), pa.array(model.score(x))], names=["id", "score"])), "id long, score double")
    return out.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def quality_filter(docs: DataFrame, model: Gam, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is at least ``threshold``, with all their columns."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, text_col):
                yield part.filter(pa.array(model.score(features(*texts(part.column(text_col)))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
