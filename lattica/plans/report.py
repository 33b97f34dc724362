"""Reports: the ordered facts that describe an array, as (section, key, value) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.profile import DISTINCT_CAP, PERCENTILES, percentile_name


def _rows(df: DataFrame, facts: list[tuple[str, str, Column]], key: str) -> DataFrame:
    items = F.array(*[F.struct(F.lit(s).alias("section"), F.lit(k).alias("key"), v.cast("string").alias("value")) for s, k, v in facts])
    return df.select(key, F.posexplode(items).alias("position", "x")).select(key, "position", "x.section", "x.key", "x.value")


def stats_report(stats: DataFrame, key: str = "column") -> DataFrame:
    """Tiles, percentiles, composition and moments of a profile row."""
    c, num = F.col, X.number
    beyond = F.concat(F.lit("more than "), F.format_number(F.lit(DISTINCT_CAP), 0))
    facts = [("overview", "Elements", X.count(c("total"))), ("overview", "Mean", num(c("mean"))), ("overview", "Std", num(c("std"))), ("overview", "Min", num(c("min"))), ("overview", "Median", num(c("median"))), ("overview", "Max", num(c("max"))), ("overview", "Distinct", F.when(c("unique_exact"), X.count(c("distinct"))).otherwise(beyond))]
    facts += [("percentiles", f"{p:g}%", num(c(percentile_name(p)))) for p in PERCENTILES]
    facts += [("composition", k, F.concat(X.count(c(f)), F.lit(" ("), X.percent(c(f), c("total")), F.lit(")"))) for k, f in (("Finite", "finite"), ("NaN", "nan"), ("+Inf", "pos_inf"), ("-Inf", "neg_inf"), ("Zeros", "zeros"), ("Negative", "negatives"), ("Positive", "positives"))]
    facts += [("moments", "Variance", num(c("variance"))), ("moments", "Standard error", num(c("sem"))), ("moments", "Skewness", F.concat(num(c("skewness")), F.lit(" — "), X.skewness_label(c("skewness")))), ("moments", "Excess kurtosis", F.concat(num(c("kurtosis")), F.lit(" — "), X.kurtosis_label(c("kurtosis")))), ("moments", "Coefficient of variation", F.coalesce(num(c("cv")), F.lit("—"))), ("moments", "MAD", num(c("mad"))), ("moments", "L1 norm", num(c("l1"))), ("moments", "L2 norm", num(c("l2"))), ("moments", "Outliers", X.count(c("outliers")))]
    return _rows(stats, facts, key)


def axis_report(axes: DataFrame, key: str = "label") -> DataFrame:
    """The table of an axis: for each channel or column its count, extrema, mean, deviation, NaN and zeros."""
    c, num = F.col, X.number
    return _rows(axes, [("axis", "Count", X.count(c("count"))), ("axis", "Min", num(c("min"))), ("axis", "Max", num(c("max"))), ("axis", "Mean", num(c("mean"))), ("axis", "Std", num(c("std"))), ("axis", "NaN", X.count(c("nan"))), ("axis", "Zeros", X.count(c("zeros")))], key)


def array_report(meta: DataFrame, key: str = "name") -> DataFrame:
    """Header facts of a detected array."""
    c = F.col
    items = F.aggregate("shape", F.lit(1).cast("long"), lambda a, x: a * x)
    return _rows(meta, [("array", "Type", c("dtype")), ("array", "Shape", X.shape(c("shape"))), ("array", "Dimensions", F.size("shape")), ("array", "Elements", X.count(items)), ("array", "Memory", X.size(items * c("itemsize"))), ("array", "Order", F.when(c("fortran_order"), "Fortran").otherwise("C")), ("layout", "Reads as", c("semantic")), ("layout", "Why", c("reason")), ("layout", "View", c("primary")), ("layout", "Frames", X.count(c("frames")))], key)


def histogram_bars(bins: DataFrame) -> DataFrame:
    """Height (share of the tallest bin) and share of finite values of each bin; a histogram has 256 rows at most."""
    w = Window.partitionBy()
    return bins.withColumns({"height": F.try_divide(F.col("count").cast("double"), F.max("count").over(w).cast("double")), "share": F.try_divide(F.col("count").cast("double"), F.sum("count").over(w).cast("double"))})


def frequency_bars(top: DataFrame, finite: Column) -> DataFrame:
    """Width (2 % at least) and share of finite values of each frequent value."""
    return top.withColumns({"width": F.greatest(F.lit(0.02), F.col("count").cast("double") / F.max("count").over(Window.partitionBy())), "share": F.try_divide(F.col("count").cast("double"), finite.cast("double"))})


def shade(window: DataFrame) -> DataFrame:
    """Min-max position of each cell of a table window (100 x 40 cells)."""
    w = Window.partitionBy()
    low, high = F.min("value").over(w), F.max("value").over(w)
    return window.withColumn("shade", F.when(high > low, (F.col("value") - low) / F.nullif(high - low, F.lit(0.0))).otherwise(0.5))
