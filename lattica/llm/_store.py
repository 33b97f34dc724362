"""Keys of rows, joins that survive frequent keys, and the shared folder."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import cut, made, release, shared_dir

__all__ = ["NO_ID", "cut", "keyed", "made", "release", "shared_dir", "unkeyed"]

#: Stands for a null id inside the operators: a null id precedes every other.
NO_ID = -(2**63)
#: A key is frequent if it has more than one row in so many; there are fewer such keys than this, so their table is broadcast.
FREQUENT = 1000
#: Rows of keys that any one task can have.
TASK_ROWS = 10_000
#: Bytes of a bit table that is broadcast, at most, and its rows.
SIEVE_BYTES, SIEVE_ROWS = 64 << 20, 256


def keyed(df: DataFrame, id_col: str = "doc_id", name: str = "d") -> Column:
    """The id as a column that is never null."""
    return F.coalesce(df[id_col].cast("long"), F.lit(NO_ID)).alias(name)


def content(df: DataFrame, text_col: str = "text", name: str = "t") -> Column:
    """A hash of the text: with the id it tells rows that share an id (or have none) apart; rows equal in both are one document."""
    return F.xxhash64(F.coalesce(df[text_col], F.lit(""))).alias(name)


def unkeyed(col: Column) -> Column:
    """Undoes :func:`keyed`."""
    return F.nullif(col, F.lit(NO_ID))


def frequent(table: DataFrame, on: list[str], total: int, count: str) -> list[int]:
    """Hashes of the keys that more than one in FREQUENT of ``total`` rows have, so fewer than FREQUENT; ``count`` has the rows of a key.  Of few rows none is: one task can have them all."""
    if total <= TASK_ROWS:
        return []
    return [r[0] for r in table.where(F.col(count) * FREQUENT > total).select(F.xxhash64(*on)).collect()]


def dealt_join(rows: DataFrame, table: DataFrame, on: list[str], hot: list[int], how: str = "inner") -> DataFrame:
    """Joins ``rows`` with ``table``, which has one row a key.

    Rows of the ``hot`` keys (of :func:`frequent`) meet their part of the
    table by broadcast, so no key's rows are gathered in one task.
    """
    if not hot:
        return rows.join(table, on, how)
    is_hot = F.xxhash64(*on).isin(hot)
    return rows.where(is_hot).join(F.broadcast(table.where(is_hot)), on, how).unionByName(rows.where(~is_hot).join(table.where(~is_hot), on, how))


def _place(key: Column, words: int) -> tuple[Column, Column, Column]:
    """Row, word and bit of a key in a bit table."""
    return F.pmod(key, F.lit(SIEVE_ROWS)).cast("int"), F.pmod(F.shiftright(key, 16), F.lit(words)).cast("int"), F.shiftrightunsigned(key, 58).cast("int")


class Sieve:
    """A bit table of hashed keys: tells most rows whose key is not among them without a shuffle.

    About 16 bits a key, up to a table of ``limit`` bytes, however many keys
    there are.  One foreign key in 16 passes while the table has room; with n
    keys in b bits it is 1 - exp(-n / b): one in six at 10**8 keys in 64 MB.  No
    key is ever missed, and what passes has to be joined with the keys
    themselves, so a full table costs a larger shuffle and changes no result.
    """

    def __init__(self, table: DataFrame, words: int):
        self.table, self.words = table, words

    @classmethod
    def of(cls, keys: DataFrame, limit: int = SIEVE_BYTES) -> Sieve:
        """From a DataFrame with one long column of hashes."""
        keys = keys.toDF("k")
        words = min(-(-keys.count() * 16 // 64 // SIEVE_ROWS), limit // 8 // SIEVE_ROWS)
        words = max(1, words)

        def dense(pdf: pd.DataFrame) -> pd.DataFrame:
            out = np.zeros(words, np.int64)
            out[pdf["word"].to_numpy()] = pdf["bits"].to_numpy()
            return pd.DataFrame({"sieve_row": pdf["sieve_row"].iloc[:1], "sieve_bits": [out]})

        row, word, bit = _place(F.col("k"), words)
        placed = keys.select(row.alias("sieve_row"), word.alias("word"), bit.alias("bit"))
        bits = placed.groupBy("sieve_row", "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
        return cls(cut(bits.groupBy("sieve_row").applyInPandas(dense, "sieve_row int, sieve_bits array<long>")), words)

    def split(self, rows: DataFrame, key: Column) -> tuple[DataFrame, DataFrame]:
        """The rows whose key may be among the keys, and those whose key isn't."""
        row, word, bit = _place(key, self.words)
        placed = rows.withColumns({"sieve_row": row, "sieve_word": word, "sieve_bit": bit}).join(F.broadcast(self.table), "sieve_row", "left")
        found = F.expr("shiftrightunsigned(coalesce(get(sieve_bits, sieve_word), 0L), sieve_bit) & 1L = 1L")
        return placed.where(found).select(*rows.columns), placed.where(~found).select(*rows.columns)


def with_key(docs: DataFrame, **key: Column) -> DataFrame:
    """The key's columns and the whole row in ``row``, whatever its columns are called."""
    return docs.select(*[c.alias(k) for k, c in key.items()], F.struct(*docs.columns).alias("row"))


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """``rows`` (of :func:`with_key`) whose key is not in ``gone``, a table of keys; only rows that may go are shuffled."""
    on = gone.columns
    gone = cut(gone)
    sieve = Sieve.of(gone.select(F.xxhash64(*on)))
    maybe, free = sieve.split(rows, F.xxhash64(*on))
    left = maybe.join(gone, on, "left_anti")
    return free.unionByName(left.select(*rows.columns)).select("row.*")
