"""The descriptive profile of numeric columns.

One scan gives counts, moments, norms and extrema for all columns at once; two
or three more give exact percentiles, and with them the distinct values of
columns that have few; two more the median absolute deviation, and one the
histogram and outliers.  :func:`percentiles` and :func:`spread` make the scans
for their part only.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sampling import bottom_k
from .selection import Bins, exact_quantiles

#: Fixed values of the profile: percentiles, the cap on distinct values, how many top values, extents of groups.
PERCENTILES = (0.1, 1, 5, 10, 25, 50, 75, 90, 95, 99, 99.9)
DISTINCT_CAP = 8192
TOP = 12
MAX_GROUPS = 512
DEFAULT_BINS = 64

INF = float("inf")


def percentile_name(p: float) -> str:
    return "p" + f"{p:g}".replace(".", "_")


_FIELDS = [("total", "long"), ("finite", "long"), ("nulls", "long"), ("nan", "long"), ("pos_inf", "long"), ("neg_inf", "long"), ("zeros", "long"), ("negatives", "long"), ("positives", "long")]
_FIELDS += [(k, "double") for k in ("min", "max", "range", "sum", "mean", "variance", "std", "sem", "skewness", "kurtosis", "cv", "l1", "l2", "sparsity")]
_FIELDS += [(percentile_name(p), "double") for p in PERCENTILES]
_FIELDS += [(k, "double") for k in ("median", "iqr", "lower_fence", "upper_fence")]
_FIELDS += [("outliers", "long"), ("mad", "double"), ("distinct", "long"), ("unique_exact", "boolean"), ("integral", "boolean"), ("unit_range", "boolean"), ("approximate", "boolean"), ("sample_size", "long"), ("excluded_non_finite", "long")]
STATS_SCHEMA = T.StructType([T.StructField("column", T.StringType()), *[T.StructField(k, {"long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}[t]) for k, t in _FIELDS]])
STATS_SCHEMA.add("top_values", T.ArrayType(T.StructType().add("value", "double").add("count", "long")))
STATS_SCHEMA.add("histogram", T.StructType().add("bin_edges", T.ArrayType(T.DoubleType())).add("counts", T.ArrayType(T.LongType())).add("excluded_non_finite", "long"))


def is_finite(v: Column) -> Column:
    """Neither null nor NaN nor infinite."""
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(INF))


def finite(v: Column) -> Column:
    """The value if it is finite, else null, which every aggregate skips."""
    return F.when(is_finite(v), v)


def basic_aggregates(v: Column, x: Column | None = None) -> dict[str, Column]:
    """Counts, extrema, moments and norms of a double column, as aggregates of one pass.

    Variance has one degree of freedom less and is 0 for fewer than two
    values; skewness and excess kurtosis are those of the population, 0 for a
    constant and for fewer than three or four values.  ``x`` is the finite
    value if it is a column already: moments repeat it many times, and the
    code generated for a plain column stays small enough to be compiled.
    """
    x = finite(v) if x is None else x
    n, m2 = F.count(x), F.coalesce(F.var_pop(x), F.lit(0.0))
    # one central moment serves variance, deviation and error: each would keep buffers of its own
    variance = F.when(n > 1, m2 * n / (n - 1)).otherwise(0.0)
    std = F.sqrt(variance)
    low, high, mean = F.min(x), F.max(x), F.avg(x)
    integral = F.coalesce(F.bool_and(x == F.floor(x).cast("double")), F.lit(True))
    return {
        "total": F.count(v),
        "finite": n,
        "nulls": F.count_if(v.isNull()),
        "nan": F.count_if(F.isnan(v)),
        "pos_inf": F.count_if(v == F.lit(INF)),
        "neg_inf": F.count_if(v == F.lit(-INF)),
        "zeros": F.count_if(x == 0),
        "negatives": F.count_if(x < 0),
        "positives": F.count_if(x > 0),
        "min": low,
        "max": high,
        "range": high - low,
        "sum": F.coalesce(F.sum(x), F.lit(0.0)),
        "mean": mean,
        "variance": F.when(n > 0, variance),
        "std": F.when(n > 0, std),
        "sem": F.when(n > 0, F.when(n > 1, std / F.sqrt(n)).otherwise(0.0)),
        "skewness": F.when(n > 0, F.when((n < 3) | (m2 == 0), 0.0).otherwise(F.skewness(x))),
        "kurtosis": F.when(n > 0, F.when((n < 4) | (m2 == 0), 0.0).otherwise(F.kurtosis(x))),
        "cv": F.when((low >= 0) & (mean > 1e-12), std / mean),
        "l1": F.coalesce(F.sum(F.abs(x)), F.lit(0.0)),
        "l2": F.coalesce(F.sqrt(F.sum(x * x)), F.lit(0.0)),
        "sparsity": F.try_divide(F.count_if(x == 0), F.count(v)),
        "integral": integral,
        "unit_range": (high > low) & (low >= 0) & (high <= 1) & ~integral,
        "excluded_non_finite": F.count(v) - n,
    }


def histogram_plan(low: float, high: float, integral: bool, bins: int = DEFAULT_BINS) -> tuple[float, float, int]:
    """First edge, width and number of bins: one a whole number if they fit, else ``bins`` equal ones; a constant is padded on both sides."""
    k = bins
    if integral and high > low and high - low + 1 <= bins:
        k, low, high = int(high - low) + 1, low - 0.5, high + 0.5
    if not high > low:
        pad = max(abs(low) * 1e-9, 0.5)
        low, high = low - pad, high + pad
    return low, (high - low) / k, k


def bin_of(v: Column, first: Column, width: Column, k: Column) -> Column:
    """Bin number of a finite value; the last bin holds its right edge."""
    return F.least(F.greatest(F.coalesce(F.floor((v - first) / width), F.lit(0)), F.lit(0)), k - 1).cast("int")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.NumericType, T.BooleanType))]


def as_values(df: DataFrame, columns: Sequence[str]) -> dict[str, Column]:
    """Numeric views as doubles; booleans are 0 and 1."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return {c: (F.col(f"`{c}`").cast("int") if isinstance(kinds[c], T.BooleanType) else F.col(f"`{c}`")).cast("double") for c in columns}


def summarise(df: DataFrame, values: Mapping[str, Column]) -> dict[str, dict]:
    """Basic aggregates of all columns from one scan, by column."""
    if not values:
        return {}
    # one row a column and value: the code for one column is small enough to be compiled, that for many is not
    per = [F.struct(F.lit(i).alias("c"), v.alias("v"), finite(v).alias("x")) for i, v in enumerate(values.values())]
    wanted = [e.alias(k) for k, e in basic_aggregates(F.col("v"), F.col("x")).items()]
    if len(per) == 1:
        return {next(iter(values)): df.select(per[0].alias("s")).select("s.*").agg(*wanted).first().asDict()}
    found = {r["c"]: r.asDict() for r in df.select(F.inline(F.array(*per))).groupBy("c").agg(*wanted).collect()}
    names = list(basic_aggregates(F.lit(0.0)))
    empty = {"integral": True, "unit_range": False} | dict.fromkeys(("total", "finite", "nulls", "nan", "pos_inf", "neg_inf", "zeros", "negatives", "positives", "excluded_non_finite"), 0) | dict.fromkeys(("sum", "l1", "l2"), 0.0)
    return {c: {k: found[i][k] if i in found else empty.get(k) for k in names} for i, c in enumerate(values)}


def value_counts(df: DataFrame, values: Mapping[str, Column]) -> DataFrame:
    """(column, value, count) of finite values; -0.0 counts as 0.0."""
    per = [F.struct(F.lit(c).alias("column"), (finite(v) + F.lit(0.0)).alias("value")) for c, v in values.items()]
    return df.select(F.inline(F.array(*per))).where("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))


def distinct_values(df: DataFrame, values: Mapping[str, Column], bins: Mapping[str, Bins]) -> dict[str, tuple[int, list[tuple[float, int]]]]:
    """Number of distinct values and the most frequent ones, of columns that have at most DISTINCT_CAP.

    ``bins`` are what a scan has counted already: where each bin has one value
    they are the answer, and where they have too many there is none.  Only
    other columns are estimated and, if few are likely, grouped by value.
    """
    out, open_ = {}, {}
    for c, v in values.items():
        own = bins.get(c)
        if own and own.single:
            if own.bins <= DISTINCT_CAP:
                out[c] = (own.bins, [(x + 0.0, n) for x, n in own.top[:TOP]])
        elif not own or own.at_least <= DISTINCT_CAP:
            open_[c] = v
    if open_:
        guess = df.agg(*[F.approx_count_distinct(finite(v), 0.02).alias(f"g{i}") for i, v in enumerate(open_.values())]).first()
        few = {c: v for i, (c, v) in enumerate(open_.items()) if guess[i] <= DISTINCT_CAP * 1.2}
        if few:
            table = value_counts(df, few).groupBy("column").agg(F.count(F.lit(1)).alias("distinct"), F.slice(F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("k"), "value"))), 1, TOP).alias("top"))
            out |= {r["column"]: (r["distinct"], [(t["value"], -t["k"]) for t in r["top"]]) for r in table.collect() if r["distinct"] <= DISTINCT_CAP}
    return out


def percentiles(df: DataFrame, value: Column, ps: Sequence[float] = PERCENTILES) -> DataFrame:
    """(percentile, value) of the finite values, exact: one scan for count and bounds and two or three for the ranks, nothing else."""
    x = finite(value.cast("double"))
    df = df.select(x.alias("x"))
    n, lo, hi = df.agg(F.count("x"), F.min("x"), F.max("x")).first()
    got = exact_quantiles(df, {"x": F.col("x")}, {"x": (lo, hi)}, {"x": n}, [p / 100 for p in ps])["x"] if n else [None] * len(ps)
    return df.sparkSession.createDataFrame([(percentile_name(p), v) for p, v in zip(ps, got, strict=True)], "percentile string, value double")


def spread(df: DataFrame, value: Column) -> DataFrame:
    """One row: lower_fence, upper_fence, outliers and mad of the finite values, exact; scans for these alone."""
    x = finite(value.cast("double"))
    df = df.select(x.alias("x"))
    n, lo, hi = df.agg(F.count("x"), F.min("x"), F.max("x")).first()
    row = (None, None, 0, None)
    if n:
        q1, m, q3 = exact_quantiles(df, {"x": F.col("x")}, {"x": (lo, hi)}, {"x": n}, [0.25, 0.5, 0.75])["x"]
        low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        mad = exact_quantiles(df, {"x": F.abs(F.col("x") - F.lit(m))}, {"x": (0.0, max(m - lo, hi - m))}, {"x": n}, [0.5])["x"][0]
        row = (low, high, df.where((F.col("x") < low) | (F.col("x") > high)).count(), mad)
    return df.sparkSession.createDataFrame([row], "lower_fence double, upper_fence double, outliers long, mad double")


def profile(df: DataFrame, columns: Sequence[str] | None = None, bins: int = DEFAULT_BINS, exact_limit: int | None = None, seed: int = 0, sample_key: Sequence[str] | None = None) -> DataFrame:
    """One row of statistics for each column, in the order given.

    Everything is exact unless ``exact_limit`` is set and a column has more
    values: then percentiles, MAD, outliers and histogram come from a sample of
    that many rows (1000 at least), those with the smallest hashes of
    ``sample_key`` or of all columns, counts are scaled and ``approximate`` is
    true.
    NaN and infinities are counted and otherwise left out; nulls are counted
    apart and are not part of ``total``.
    """
    values = as_values(df, columns or numeric_columns(df))
    if not values:
        return df.sparkSession.createDataFrame([], STATS_SCHEMA)
    base = summarise(df, values)
    total = max((b["total"] for b in base.values()), default=0)
    sampled = exact_limit is not None and total > max(exact_limit, 1000)
    source = bottom_k(df, max(exact_limit, 1000), sample_key, seed) if sampled else df
    order = summarise(source, values) if sampled else base
    x = {c: finite(v) for c, v in values.items()}
    live = {c: (o["min"], o["max"]) for c, o in order.items() if o["finite"]}
    counts = {c: order[c]["finite"] for c in live}
    ps = [p / 100 for p in PERCENTILES]
    seen: dict[str, Bins] = {}
    quantiles = exact_quantiles(source, {c: x[c] for c in live}, live, counts, ps, seen)
    plans = {c: histogram_plan(*live[c], order[c]["integral"], bins) for c in live}
    fences = {c: (q[4] - 1.5 * (q[6] - q[4]), q[6] + 1.5 * (q[6] - q[4])) for c, q in quantiles.items()}
    # deviations lie between 0 and that of the farther bound
    far = {c: (0.0, max(quantiles[c][5] - live[c][0], live[c][1] - quantiles[c][5])) for c in live}
    mad = exact_quantiles(source, {c: F.abs(x[c] - F.lit(quantiles[c][5])) for c in live}, far, counts, [0.5])
    hist, outliers = histogram_counts(source, {c: x[c] for c in live}, plans, fences) if live else ({}, {})
    tops = distinct_values(df, {c: values[c] for c in live}, {} if sampled else {c: seen.get(c, Bins(1, True, 1, [(live[c][0], counts[c])])) for c in live})
    rows = []
    for c, b in base.items():
        row = {"column": c, **b, "approximate": sampled, "sample_size": order[c]["total"], "outliers": None, "mad": None, "distinct": None, "unique_exact": True, "top_values": None, "histogram": None}
        row["unit_range"] = bool(row["unit_range"])
        if c in live:
            q = quantiles[c]
            scale = b["finite"] / counts[c]
            row |= {percentile_name(p): v for p, v in zip(PERCENTILES, q, strict=True)}
            row |= {"median": q[5], "iqr": q[6] - q[4], "lower_fence": fences[c][0], "upper_fence": fences[c][1], "mad": mad[c][0], "outliers": math.floor(outliers[c] * scale + 0.5)}
            first, width, k = plans[c]
            n = [hist[c].get(i, 0) for i in range(k)]
            row["histogram"] = ([first + width * i for i in range(k + 1)], [math.floor(v * scale + 0.5) for v in n] if scale > 1.0001 else n, b["excluded_non_finite"])
            distinct, top = tops.get(c, (None, None))
            row |= {"unique_exact": distinct is not None, "distinct": distinct, "top_values": top}
        else:
            row |= {"distinct": 0, "outliers": 0}
        rows.append(tuple(row.get(f.name) for f in STATS_SCHEMA.fields))
    return df.sparkSession.createDataFrame(rows, STATS_SCHEMA)


def histogram_counts(df: DataFrame, values: Mapping[str, Column], plans: Mapping[str, tuple[float, float, int]], fences: Mapping[str, tuple[float, float]]) -> tuple[dict[str, dict[int, int]], dict[str, int]]:
    """Counts by column and bin, and values outside the fences, from one scan; at most 512 rows a column reach the driver."""
    df = df.select(*[v.alias(f"v{i}") for i, v in enumerate(values.values())])
    values = {c: F.col(f"v{i}") for i, c in enumerate(values)}
    per = [F.struct(F.lit(c).alias("c"), F.when(v.isNotNull(), bin_of(v, F.lit(plans[c][0]), F.lit(plans[c][1]), F.lit(plans[c][2]))).alias("b"), ((v < fences[c][0]) | (v > fences[c][1])).alias("out")) for c, v in values.items()]
    out: dict[str, dict[int, int]] = {c: {} for c in values}
    outside = dict.fromkeys(values, 0)
    for r in df.select(F.inline(F.array(*per))).where("b is not null").groupBy("c", "b", "out").count().collect():
        out[r["c"]][r["b"]] = out[r["c"]].get(r["b"], 0) + r["count"]
        outside[r["c"]] += r["count"] * r["out"]
    return out, outside


def composition(df: DataFrame, value: Column) -> DataFrame:
    """Counts by kind of value and sparsity, one row."""
    a = basic_aggregates(value.cast("double"))
    keys = ("total", "finite", "nulls", "nan", "pos_inf", "neg_inf", "zeros", "negatives", "positives", "sparsity", "excluded_non_finite")
    return df.agg(*[a[k].alias(k) for k in keys])


def histogram(df: DataFrame, value: Column, bins: int = DEFAULT_BINS) -> DataFrame:
    """(bin, left, right, count) with empty bins; lazily, bounds first and a broadcast of that one row."""
    x = finite(value.cast("double"))
    plan = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.coalesce(F.bool_and(x == F.floor(x).cast("double")), F.lit(True)).alias("integral")).where("lo is not null")
    whole = F.col("integral") & (F.col("hi") > F.col("lo")) & (F.col("hi") - F.col("lo") + 1 <= bins)
    pad = F.greatest(F.abs("lo") * 1e-9, F.lit(0.5))
    constant = ~(F.col("hi") > F.col("lo"))
    plan = plan.select(F.when(whole, (F.col("hi") - F.col("lo") + 1).cast("int")).otherwise(bins).alias("k"), F.when(whole, F.col("lo") - 0.5).when(constant, F.col("lo") - pad).otherwise(F.col("lo")).alias("first"), F.when(whole, F.col("hi") + 0.5).when(constant, F.col("hi") + pad).otherwise(F.col("hi")).alias("last"))
    plan = plan.withColumn("width", (F.col("last") - F.col("first")) / F.col("k"))
    counted = df.select(x.alias("x")).where("x is not null").crossJoin(F.broadcast(plan)).groupBy(bin_of(F.col("x"), F.col("first"), F.col("width"), F.col("k")).alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    every = plan.select("first", "width", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("bin"))
    return every.join(F.broadcast(counted), "bin", "left").select("bin", (F.col("first") + F.col("width") * F.col("bin")).alias("left"), (F.col("first") + F.col("width") * (F.col("bin") + 1)).alias("right"), F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def top_values(df: DataFrame, value: Column, k: int = TOP, cap: int = DISTINCT_CAP) -> DataFrame:
    """The k most frequent finite values, smaller first among equals; none if there are more than ``cap`` distinct ones."""
    counts = df.select((finite(value.cast("double")) + F.lit(0.0)).alias("value")).where("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("count"))
    within = counts.limit(cap + 1).agg((F.count(F.lit(1)) <= cap).alias("within"))
    return counts.orderBy(F.desc("count"), "value").limit(k).crossJoin(F.broadcast(within)).where("within").drop("within")


def distinct_capped(df: DataFrame, value: Column, cap: int = DISTINCT_CAP) -> DataFrame:
    """(distinct, unique_exact): the number of distinct finite values, null beyond ``cap``."""
    n = df.select((finite(value.cast("double")) + F.lit(0.0)).alias("value")).where("value is not null").distinct().limit(cap + 1).agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.when(F.col("n") <= cap, F.col("n")).alias("distinct"), (F.col("n") <= cap).alias("unique_exact"))


def axis_stats(df: DataFrame, group: Column, value: Column, name: str = "Channel") -> DataFrame:
    """Statistics by channel or column: index, label, count, min, max, mean, std, nan, zeros."""
    a = basic_aggregates(value.cast("double"))
    out = df.where(group.isNotNull()).groupBy(group.cast("long").alias("index")).agg(a["finite"].alias("count"), *[a[k].alias(k) for k in ("min", "max", "mean", "std", "nan", "zeros")])
    return out.select("index", F.concat(F.lit(name + " "), F.col("index").cast("string")).alias("label"), "count", "min", "max", "mean", "std", "nan", "zeros")


def axes_stats(df: DataFrame, groups: Mapping[str, Column], value: Column) -> DataFrame:
    """:func:`axis_stats` along several axes (name and index of each) in one scan and one shuffle: axis, index, label and the figures."""
    names = {f"a{i}": name for i, name in enumerate(groups)}
    rows = df.select(*[g.cast("long").alias(c) for c, g in zip(names, groups.values(), strict=True)], value.cast("double").alias("v"))
    a = basic_aggregates(F.col("v"))
    figures = [a["finite"].alias("count"), *[a[k].alias(k) for k in ("min", "max", "mean", "std", "nan", "zeros")]]
    own = [F.when(F.grouping(c) == 0, F.struct(F.lit(n).alias("axis"), F.col(c).alias("index"))) for c, n in names.items()]
    out = rows.groupingSets([[F.col(c)] for c in names], *map(F.col, names)).agg(F.coalesce(*own).alias("at"), *figures).where("at.index is not null")
    return out.select("at.axis", "at.index", F.concat("at.axis", F.lit(" "), F.col("at.index").cast("string")).alias("label"), "count", "min", "max", "mean", "std", "nan", "zeros")


def grouped_by_axis(elements: DataFrame, stride: int, extent: int, name: str = "Channel", pos: str = "pos", value: str = "value") -> DataFrame | None:
    """Statistics along one axis of an array's elements; None for a single group or more than 512."""
    if extent <= 1 or extent > MAX_GROUPS:
        return None
    return axis_stats(elements, F.pmod(F.floor(F.col(pos) / stride), F.lit(extent)), F.col(value), name)
