"""Kept partial profiles: states of counts, extrema and moments that merge without their rows.

:func:`partial_states` sums up rows by group; :func:`merge_states` puts states
of one group together, or those of several groups to a coarser one;
:func:`finish_states` makes the figures of the profile.  Central moments are
merged about the common mean, so the result is that of one scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .profile import as_values, basic_aggregates, finite, numeric_columns

#: Fields of a state that add up, besides mean, m2, m3, m4 (central sums), min, max and integral.
ADDED = ("total", "finite", "nulls", "nan", "pos_inf", "neg_inf", "zeros", "negatives", "positives", "sum", "l1", "squares")
FIELDS = (*ADDED, "mean", "m2", "m3", "m4", "min", "max", "integral")


def partial_states(df: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """(keys, column, state): one scan, combined on the map side; nulls of a key are a group."""
    names = [c for c in columns or numeric_columns(df) if columns or c not in keys]
    if not names:
        raise ValueError("there is no column to sum up")
    per = [F.struct(F.lit(c).alias("column"), v.alias("v"), finite(v).alias("x")) for c, v in zip(names, as_values(df, names).values(), strict=True)]
    x = F.col("x")
    a = basic_aggregates(F.col("v"), x)
    n, m2 = F.count(x), F.var_pop(x) * F.count(x)
    made = {k: a[k] for k in (*ADDED[:-1], "mean", "min", "max", "integral")}
    made |= {"squares": F.coalesce(F.sum(x * x), F.lit(0.0)), "m2": m2, "m3": F.when(m2 > 0, F.skewness(x) * F.pow(m2, F.lit(1.5)) / F.sqrt(n)).otherwise(F.when(n > 0, 0.0)), "m4": F.when(m2 > 0, (F.kurtosis(x) + 3) * m2 * m2 / n).otherwise(F.when(n > 0, 0.0))}
    return df.select(F.struct(*[F.col(f"`{k}`") for k in keys], F.lit(0).alias("_")).alias("g"), F.inline(F.array(*per))).groupBy("g", "column").agg(*[made[f].alias(f) for f in FIELDS]).select(*[F.col(f"g.`{k}`") for k in keys], "column", *FIELDS)


def merge_states(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, column, state) of all rows behind the states; ``keys`` may be fewer than the states have."""
    own = states.select(F.struct(*[F.col(f"`{k}`") for k in keys], F.lit(0).alias("_")).alias("g"), "column", *FIELDS)
    n = F.col("finite")
    whole = own.groupBy("g", "column").agg(*[F.sum(f).alias(f) for f in ADDED], (F.sum(n * F.col("mean")) / F.nullif(F.sum(n), F.lit(0))).alias("mean"), F.min("min").alias("min"), F.max("max").alias("max"), F.bool_and("integral").alias("integral"))
    d = F.col("mean") - F.col("common")
    met = own.join(whole.select("g", "column", F.col("mean").alias("common")), ["g", "column"])
    about = met.groupBy("g", "column").agg(
        F.sum(F.col("m2") + n * d * d).alias("m2"),
        F.sum(F.col("m3") + 3 * d * F.col("m2") + n * d * d * d).alias("m3"),
        F.sum(F.col("m4") + 4 * d * F.col("m3") + 6 * d * d * F.col("m2") + n * d * d * d * d).alias("m4"),
    )
    return whole.join(about, ["g", "column"]).select(*[F.col(f"g.`{k}`") for k in keys], "column", *FIELDS)


def finish_states(states: DataFrame) -> DataFrame:
    """The figures of the profile that states hold: everything but order statistics, distinct values and histogram."""
    n, m2 = F.col("finite"), F.col("m2")
    some, spread = n > 0, F.col("max") - F.col("min")
    variance = F.when(some, F.when(n > 1, m2 / (n - 1)).otherwise(0.0))
    std = F.sqrt(variance)
    made = {
        "range": spread, "variance": variance, "std": std, "sem": F.when(n > 1, std / F.sqrt(n)).otherwise(F.when(some, 0.0)),
        "skewness": F.when(some, F.when((n < 3) | (m2 == 0), 0.0).otherwise(F.sqrt(n) * F.try_divide(F.col("m3"), F.pow(m2, F.lit(1.5))))),
        "kurtosis": F.when(some, F.when((n < 4) | (m2 == 0), 0.0).otherwise(n * F.try_divide(F.col("m4"), m2 * m2) - 3)),
        "cv": F.when((F.col("min") >= 0) & (F.col("mean") > 1e-12), std / F.col("mean")), "l2": F.sqrt("squares"), "sparsity": F.try_divide(F.col("zeros"), F.col("total")),
        "unit_range": F.coalesce((spread > 0) & (F.col("min") >= 0) & (F.col("max") <= 1) & ~F.col("integral"), F.lit(False)), "excluded_non_finite": F.col("total") - n,
    }
    return states.withColumns(made).drop("m2", "m3", "m4", "squares")
