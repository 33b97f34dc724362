"""Sums and means of doubles that do not depend on the order of additions.

A double is a whole number of units of a power of two.  Values of one magnitude
are summed as whole numbers, which is exact in any order and under any
partitioning; a figure is rounded once, when the few sums of a column are put
together.  :func:`.profile.profile` adds doubles as they come, which is faster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .profile import as_values, finite, numeric_columns

#: Binary digits of a value below its magnitude: 52 and one more, as the logarithm may be one too high.
DIGITS = 53


def _power(n: Column) -> Column:
    return F.pow(F.lit(2.0), n)


def sum_states(df: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """(keys, column, magnitude, n, units): the finite values of one magnitude count units * 2 ** (magnitude - 53) in sum.

    One scan, combined on the map side.  A group has a state for each magnitude
    that occurs, some 2,100 at most; zeros have the null magnitude, and a
    group without finite values is left out.  Units hold 10**15 values of one
    magnitude.
    """
    names = [c for c in columns or numeric_columns(df) if columns or c not in keys]
    if not names:
        raise ValueError("there is no column to sum up")
    per = [F.struct(F.lit(c).alias("column"), finite(v).alias("x")) for c, v in zip(names, as_values(df, names).values(), strict=True)]
    rows = df.select(F.struct(*[F.col(f"`{k}`") for k in keys], F.lit(0).alias("_")).alias("g"), F.inline(F.array(*per))).where("x is not null")
    rows = rows.withColumn("magnitude", F.when(F.col("x") != 0, F.floor(F.log2(F.abs("x"))).cast("int")))
    # in two steps, as one factor could be beyond the largest double
    shift = F.lit(DIGITS) - F.col("magnitude")
    half = F.floor(shift / 2)
    units = F.coalesce((F.col("x") * _power(half) * _power(shift - half)).cast("long"), F.lit(0)).cast("decimal(22,0)")
    made = rows.groupBy("g", "column", "magnitude").agg(F.count("x").alias("n"), F.sum(units).alias("units"))
    return made.select(*[F.col(f"g.`{k}`") for k in keys], "column", "magnitude", "n", F.col("units").cast("decimal(38,0)").alias("units"))


def merge_sum_states(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The states of all rows behind the states; ``keys`` may be fewer than the states have."""
    g = F.struct(*[F.col(f"`{k}`") for k in keys], F.lit(0).alias("_")).alias("g")
    made = states.groupBy(g, "column", "magnitude").agg(F.sum("n").alias("n"), F.sum("units").alias("units"))
    return made.select(*[F.col(f"g.`{k}`") for k in keys], "column", "magnitude", "n", "units")


def rounded_quotient(magnitudes: Sequence[int], units: Sequence[int], n: int = 1) -> float:
    """The double nearest to the sum of units * 2 ** (magnitude - 53), divided by ``n``; infinite beyond the largest."""
    low = min(magnitudes, default=DIGITS)
    whole, away = sum(u << (m - low) for m, u in zip(magnitudes, units, strict=True)), low - DIGITS
    try:
        # division of whole numbers is rounded once
        return (whole << max(away, 0)) / (n << max(-away, 0))
    except OverflowError:
        return float("inf") if whole > 0 else float("-inf")


def finish_sums(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, column, finite, sum, mean) from states, each figure rounded once."""

    def figures(batches):
        import pyarrow as pa

        for batch in batches:
            rows = list(zip(batch.column("s").to_pylist(), batch.column("finite").to_pylist(), strict=True))
            parts = [([x["magnitude"] for x in s], [int(x["units"]) for x in s], n) for s, n in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column("g"), batch.column("column"), batch.column("finite"), pa.array([rounded_quotient(m, u) for m, u, _ in parts], pa.float64()), pa.array([rounded_quotient(m, u, n) for m, u, n in parts], pa.float64())],
                names=["g", "column", "finite", "sum", "mean"],
            )

    g = F.struct(*[F.col(f"`{k}`") for k in keys], F.lit(0).alias("_")).alias("g")
    one = states.groupBy(g, "column").agg(F.sum("n").alias("finite"), F.collect_list(F.when(F.col("magnitude").isNotNull(), F.struct("magnitude", "units"))).alias("s"))
    kinds = one.select("g", "column", "finite", F.lit(0.0).alias("sum"), F.lit(0.0).alias("mean")).schema
    return one.mapInArrow(figures, kinds).select(*[F.col(f"g.`{k}`") for k in keys], "column", "finite", "sum", "mean")


def exact_sums(df: DataFrame, keys: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """(keys, column, finite, sum, mean) of numeric columns by group, the same to the last bit however the rows are dealt.

    Null, NaN and infinite values are left out; a group and column without
    finite values has no row, and nulls of a key are a group.
    """
    return finish_sums(sum_states(df, keys, columns), keys)
