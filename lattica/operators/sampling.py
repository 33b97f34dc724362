"""Samples that are the same on every run and for any partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .selection import order_statistics

_PARTS = 1 << 20


def hashed_sample(df: DataFrame, key: Sequence[str], numerator: int, denominator: int, seed: int = 0) -> DataFrame:
    """About numerator/denominator of the rows, chosen by a hash of ``key``: no shuffle, no random state."""
    return df.where(F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(_PARTS)) < F.lit(_PARTS * numerator // denominator))


def hash_number(key: Sequence[str], seed: int = 0) -> Column:
    """A number below 2**52 for each row: the first 13 digits of the MD5 of its key's texts and the seed, with bars between them."""
    texts = [F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("null")) for k in key]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *texts, F.lit(str(seed))).cast("binary")), 1, 13), 16, 10).cast("double")


def bottom_k(df: DataFrame, k: int, key: Sequence[str] | None = None, seed: int = 0) -> DataFrame:
    """Exactly ``k`` rows (all, if there are fewer), those with the smallest hashes of ``key`` (by default, of all columns).

    The bound of the hashes is found by counting, so neither is anything
    sorted nor is the sample gathered; of rows that share the bound's hash,
    which are equal or nearly always few, the first in the order of all
    columns are taken.
    """
    if k <= 0:
        return df.limit(0)
    key, name = list(key or df.columns), "_hash"
    while name in df.columns:
        name += "_"
    rows = df.withColumn(name, hash_number(key, seed))
    h = F.col(name)
    n, lo, hi = rows.agg(F.count(h), F.min(h), F.max(h)).first()
    if n <= k:
        return df
    bound = order_statistics(rows, {"h": h}, {"h": (lo, hi)}, {"h": [k - 1]})["h"][k - 1]
    below = rows.where(h < F.lit(bound))
    rest = rows.where(h == F.lit(bound)).orderBy(*[f"`{c}`" for c in df.columns]).limit(k - below.count())
    return below.unionByName(rest).select(*[f"`{c}`" for c in df.columns])
