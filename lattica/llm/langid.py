"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  A trigram is the product
(binding) of its letters' vectors, permuted by their place; a text is the sum
(bundle) of its trigrams; a language's prototype is the sum of its texts'
normalised vectors.  A text has the language whose prototype has the largest
cosine with it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import pieces, texts

#: Length of all vectors.
DIM = 512
#: Letters: 0 is any run of other characters, 1-26 are a-z, the rest of Unicode's letters share 101 more.
SYMBOLS = 128
_SCALE = 1 << 20
#: Trigrams whose vectors are held at once: 8 MB.
GRAMS = 4096


def letter_vectors() -> np.ndarray:
    return (np.random.default_rng(7).integers(0, 2, (SYMBOLS, DIM)) * 2 - 1).astype(np.int8)


def symbols(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the characters of lower-cased UTF-8, and the byte at which each begins."""
    starts = np.flatnonzero((raw & 0xC0) != 0x80)
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    out = np.zeros(points.size, np.int64)
    latin = (points >= 97) & (points <= 122)
    out[latin] = points[latin] - 96
    other = np.flatnonzero(points >= 128)
    if other.size:
        values, where = np.unique(points[other], return_inverse=True)
        code = np.array([27 + (int(v) * 40503 >> 4) % (SYMBOLS - 27) if chr(v).isalpha() else 0 for v in values], np.int64)
        out[other] = code[where]
    return out, starts[: points.size]


def bundles(raw: np.ndarray, offs: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vector of each lower-cased text, and whether it has a letter."""
    n = offs.size - 1
    sym, starts = symbols(raw)
    text = np.searchsorted(offs, starts, "right") - 1
    has = np.bincount(text, sym > 0, n) > 0 if sym.size else np.zeros(n, bool)
    # one 0 before, between and after words; texts never meet
    keep = np.ones(sym.size, bool)
    keep[1:] = (sym[1:] > 0) | (sym[:-1] > 0) | (text[1:] != text[:-1])
    sym, text = sym[keep], text[keep]
    edge = np.flatnonzero(np.diff(text)) + 1
    at = np.sort(np.concatenate([[0], edge, edge, [sym.size]])) if sym.size else np.zeros(0, np.int64)
    owner = np.insert(text, at, np.concatenate([[text[0]], np.repeat(text[edge], 2) - np.tile([1, 0], edge.size) * np.repeat(np.diff(text)[edge - 1], 2), [text[-1]]])) if sym.size else text
    sym = np.insert(sym, at, 0) if sym.size else sym
    once = np.ones(sym.size, bool)
    once[1:] = (sym[1:] > 0) | (sym[:-1] > 0) | (owner[1:] != owner[:-1])
    sym, owner = sym[once], owner[once]
    ok = owner[2:] == owner[:-2]
    ok &= (sym[:-2] + sym[1:-1] + sym[2:]) > 0
    key = (owner[2:] << 21 | sym[:-2] << 14 | sym[1:-1] << 7 | sym[2:])[ok]
    out = np.zeros((n, DIM), np.float32)
    if key.size:
        key, count = np.unique(key, return_counts=True)
        gram, where = np.unique(key & (1 << 21) - 1, return_inverse=True)
        owner = key >> 21
        order = np.argsort(where, kind="stable")
        for first in range(0, gram.size, GRAMS):
            some = gram[first : first + GRAMS]
            v = np.roll(letters, 2, 1)[some >> 14] * np.roll(letters, 1, 1)[some >> 7 & 127] * letters[some & 127]
            v = v.astype(np.float32)
            own = np.sort(order[slice(*np.searchsorted(where[order], [first, first + some.size]))])
            for begin in range(0, n, 64):
                k = own[slice(*np.searchsorted(owner[own], [begin, begin + 64]))]
                if k.size:
                    table = np.zeros((min(64, n - begin), some.size), np.float32)
                    table[owner[k] - begin, where[k] - first] = count[k]
                    out[begin : begin + 64] += table @ v
    return out, has


def _each(batches):
    letters = letter_vectors()
    for batch in batches:
        for part in pieces(batch, "text"):
            raw, offs = texts(pc.utf8_lower(part.column("text")))
            v, has = bundles(raw, offs, letters)
            yield part, v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9), has


def _learn(batches):
    total: dict[str, np.ndarray] = {}
    for part, v, _ in _each(batches):
        langs = np.array(part.column("lang").to_pylist(), object)
        for lang in set(langs):
            # integers, so that the order of additions doesn't matter
            total[lang] = total.get(lang, 0) + np.rint(v[langs == lang] * _SCALE).astype(np.int64).sum(0)
    for lang, x in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * DIM), pa.array(np.arange(DIM, dtype=np.int32)), pa.array(x)], names=["lang", "i", "x"])


def learn_languages(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> dict[str, np.ndarray]:
    """Unit prototypes by language from all given rows; rows without language or text don't count.  What reaches the driver is DIM numbers a language."""
    src = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    got = src.mapInArrow(_learn, "lang string, i int, x long").groupBy("lang", "i").agg(F.sum("x").alias("x")).collect()
    out: dict[str, np.ndarray] = {}
    for r in got:
        out.setdefault(r["lang"], np.zeros(DIM))[r["i"]] = r["x"]
    return {k: out[k] / np.linalg.norm(out[k]) for k in sorted(out) if np.any(out[k])}


def identify_languages(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns a row per input row: id, lang_pred, score (cosine, 0 at least).

    A null text or one without a letter is ``und`` with score 0, as is every
    text if there is no prototype; ties go to the language that sorts first.
    A text of any length is read whole, with the vectors of GRAMS trigrams in
    memory at once.  Null ids stay null; rows that share an id and repeated
    rows each get their row; other columns, whatever their names, are ignored;
    an empty table gives an empty result.
    """
    names = sorted(prototypes)
    shared = docs.sparkSession.sparkContext.broadcast((names, np.array([prototypes[k] for k in names], np.float32).reshape(len(names), DIM)))

    def run(batches):
        names, table = shared.value
        for part, v, has in _each(batches):
            cos = v @ table.T if names else np.zeros((len(has), 1), np.float32)
            best = cos.argmax(1)
            known = has & bool(names)
            lang = np.where(known, np.array([*names, "und"], object)[best], "und")
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(lang, pa.string()), pa.array(np.where(known, np.clip(cos.max(1), 0, 1), 0).astype(float))], names=["id", "lang_pred", "score"])

    src = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    return src.mapInArrow(run, "id long, lang_pred string, score double").withColumnRenamed("id", id_col)
