"""Order statistics, distinct values and frequent values from bounded states.

States of a group (a KLL sketch for ranks, a HyperLogLog sketch for distinct
values) merge in any order, so they can be kept by file or batch, as the states
of :mod:`.states`.  Each figure comes with the bound of its error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .profile import PERCENTILES, TOP, as_values, finite, numeric_columns, percentile_name

#: Size of the rank sketch, and binary logarithm of the registers of the other.
RANK_K, LOG_REGISTERS = 400, 12
#: Values that are followed when frequent ones are sought.
TRACKED = 10_000


def rank_error(k: int = RANK_K) -> float:
    """Share of all values by which the rank of a quantile may be off, with a confidence of 99 %, as published for the sketch."""
    return 2.296 / k**0.9723


def distinct_error(log_registers: int = LOG_REGISTERS) -> float:
    """Three relative standard errors of the number of distinct values."""
    return 3 * 1.04 / 2 ** (log_registers / 2)


def sketch_states(df: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None, k: int = RANK_K, log_registers: int = LOG_REGISTERS) -> DataFrame:
    """(keys, column, finite, ranks, values): two sketches of the finite values of each group, combined on the map side."""
    names = [c for c in columns or numeric_columns(df) if columns or c not in keys]
    per = [F.struct(F.lit(c).alias("column"), (finite(v) + F.lit(0.0)).alias("x")) for c, v in zip(names, as_values(df, names).values(), strict=True)]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in keys], F.lit(0).alias("_")).alias("g"), F.inline(F.array(*per)))
    # doubles are told apart by all their digits
    made = rows.groupBy("g", "column").agg(F.count("x").alias("finite"), F.kll_sketch_agg_double("x", k).alias("ranks"), F.hll_sketch_agg(F.col("x").cast("string"), log_registers).alias("values"))
    return made.select(*[F.col(f"g.`{c}`") for c in keys], "column", "finite", "ranks", "values")


def merge_sketches(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The states of all rows behind the states; ``keys`` may be fewer than the states have."""
    g = F.struct(*[F.col(f"`{c}`") for c in keys], F.lit(0).alias("_")).alias("g")
    made = states.groupBy(g, "column").agg(F.sum("finite").alias("finite"), F.kll_merge_agg_double("ranks").alias("ranks"), F.hll_union_agg("values").alias("values"))
    return made.select(*[F.col(f"g.`{c}`") for c in keys], "column", "finite", "ranks", "values")


def quantile_of(sketch: Column, n: Column, p: float) -> Column:
    return F.when(n > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(float(p))))


def finish_sketches(states: DataFrame, k: int = RANK_K, log_registers: int = LOG_REGISTERS, ps: Sequence[float] = PERCENTILES) -> DataFrame:
    """Estimates: a column for each percentile and ``rank_error``, ``distinct`` and ``distinct_error``."""
    n = F.col("finite")
    made = {percentile_name(p): quantile_of(F.col("ranks"), n, p / 100) for p in ps}
    made |= {"rank_error": F.lit(rank_error(k)), "distinct": F.hll_sketch_estimate("values"), "distinct_error": F.lit(distinct_error(log_registers))}
    return states.withColumns(made).drop("ranks", "values")


def heavy_values(df: DataFrame, value: Column, k: int = TOP, tracked: int = TRACKED) -> DataFrame:
    """(value, count): the k most frequent finite values, smaller first among equals, with exact counts, however many distinct values there are.

    A sketch of ``tracked`` counters finds the candidates in one scan: it misses
    no value with more than four rows in ``tracked``.  A second scan counts the
    candidates, and only counts above that bound are told, so what is told is
    right and complete above it.
    """
    x = df.select((finite(value.cast("double")) + F.lit(0.0)).alias("value")).where("value is not null")
    found = x.agg(F.expr(f"approx_top_k(value, {tracked}, {tracked})").alias("top"), F.count(F.lit(1)).alias("n"))
    # as many rows as counters, which bounds the broadcast
    likely = found.select(F.explode("top").alias("t"), "n").select((F.col("t.item") + F.lit(0.0)).alias("value"), "n")
    counted = x.join(F.broadcast(likely), "value").groupBy("value", "n").agg(F.count(F.lit(1)).alias("count"))
    return counted.where(F.col("count") > 4.0 * F.col("n") / tracked).orderBy(F.desc("count"), "value").limit(k).select("value", "count")
