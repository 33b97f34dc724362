"""Exact profiles of many groups at once.

One row of statistics for each group and column, in a number of scans that does
not depend on how many groups there are, and without a row on the driver.  The
table itself is read twice: for moments, and for the distinct values of each
group with their counts, which are stored; all other figures come from those.
Groups of few distinct values are ranked by one shuffle.  In larger ones the
values of the wanted ranks are found by refined histograms as in
:mod:`.selection`, but the open intervals are a table that rows meet by group
and the bin of the scan before: broadcast while it is small, else joined with a
salt, so that no group's rows meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..store import cut
from .profile import DEFAULT_BINS, DISTINCT_CAP, PERCENTILES, STATS_SCHEMA, TOP, as_values, basic_aggregates, bin_of, finite, numeric_columns, percentile_name
from .selection import BINS, EVEN, FAR, LIST, image

#: Entries of a table of groups that is broadcast; a larger one is joined by group and salt.
BROADCAST, SALTS = 200_000, 64


def _salted(rows: DataFrame, table: DataFrame, keys: Sequence[str], entries: int, broadcast: int) -> DataFrame:
    """``rows`` joined with ``table``, which has one row for each of its ``keys`` and ``entries`` rows in all."""
    if entries <= broadcast:
        return rows.join(F.broadcast(table), [*keys])
    salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("x"), F.lit(SALTS)).cast("int")).join(salted, [*keys, "salt"]).drop("salt")


def counted_by(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(g, c, x, n): how often each finite value occurs in a group and column (its number); -0.0 counts as 0.0."""
    return _counted(_long(df, keys, columns))


def _long(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    per = [F.struct(F.lit(i).alias("c"), v.alias("v"), finite(v).alias("x")) for i, v in enumerate(as_values(df, columns).values())]
    return df.select(F.struct(*[F.col(f"`{k}`") for k in keys]).alias("g"), F.inline(F.array(*per)))


def _counted(rows: DataFrame) -> DataFrame:
    return rows.where("x is not null").groupBy("g", "c", (F.col("x") + F.lit(0.0)).alias("x")).agg(F.count(F.lit(1)).alias("n"))


def _cut_into_bins(intervals: DataFrame) -> DataFrame:
    """Open intervals with the ends, kind and number of their bins."""
    lo, hi = F.col("lo"), F.col("hi")
    even = (F.signum(lo) * F.signum(hi) > 0) & (F.greatest(F.abs(lo), F.abs(hi)) <= EVEN * F.least(F.abs(lo), F.abs(hi)))
    # equal bins suit most columns at first; what then holds too many values is cut by the image
    by_image = ~even & ~(F.col("first") & ((lo * hi <= 0) | (F.greatest(F.abs(lo), F.abs(hi)) <= FAR * F.least(F.abs(lo), F.abs(hi)))))
    bins = F.least(F.lit(BINS), F.greatest(F.lit(1024), F.floor(F.col("m") / 16))).cast("int")
    return intervals.withColumns({"from": F.when(by_image, image(lo)).otherwise(lo / 2), "to": F.when(by_image, image(hi)).otherwise(hi / 2), "by_image": by_image, "bins": bins})


def ranked(rows: DataFrame, wanted: DataFrame, list_limit: int = LIST, broadcast: int = BROADCAST) -> DataFrame:
    """(g, c, found): the values of the given 0-based ranks in each group, as a map.

    ``rows`` are (g, c, x, n) with a group, a column number, a finite double and
    how often it occurs; a double may have several rows.  ``wanted`` has one
    row (g, c, m, lo, hi, ranks) for each group with values: the number of its
    rows, their bounds and the ranks.
    """
    zero, one_value, small = F.lit(0.0), F.col("lo") == F.col("hi"), F.col("m") <= list_limit
    # rows meet intervals by group at first, then by the interval and bin that the last scan gave them
    own, rows = ["g", "c"], rows.select("g", "c", "x", "n")
    held = wanted.select(*own, "m", (F.col("lo") + zero).alias("lo"), (F.col("hi") + zero).alias("hi"), "ranks", F.lit(0).cast("long").alias("below"), F.lit(True).alias("first"))
    settled, listed = [], []
    while True:
        settled.append(held.where(one_value).select("g", "c", F.explode("ranks").alias("rank"), F.col("lo").alias("value")))
        open_ = held.where(~one_value).withColumn("at", F.col("lo"))
        few, large = open_.agg(F.count_if(small), F.count_if(~small)).first()
        if few:
            listed.append(_salted(rows, open_.where(small).select(*own, "at", "below", "ranks"), own, few, broadcast).select("g", "c", "at", "x", "n", "below", "ranks"))
        if not large:
            break
        intervals = _cut_into_bins(open_.where(~small))
        place = F.when(F.col("by_image"), image(F.col("x"))).otherwise(F.col("x") / 2)
        bin_ = F.least(F.floor((place - F.col("from")) / (F.col("to") - F.col("from")) * F.col("bins")), F.col("bins") - 1)
        rows = _salted(rows, intervals.select(*own, "at", "from", "to", "by_image", "bins"), own, large, broadcast).select("g", "c", F.col("at").alias("within"), bin_.alias("bin"), "x", "n")
        own = ["g", "c", "within", "bin"]
        counted = rows.groupBy(*own).agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        earlier = Window.partitionBy("g", "c", "within").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        placed = counted.join(intervals.select("g", "c", F.col("at").alias("within"), "below", "ranks"), ["g", "c", "within"]).withColumn("below", F.col("below") + F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        held = cut(placed.select(*own, "m", "lo", "hi", _held("below").alias("ranks"), "below", F.lit(False).alias("first")).where(F.size("ranks") > 0))
    # what is left has few values each: small groups in whole, of large ones the listed intervals
    earlier = Window.partitionBy("g", "c", "at").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    for part in listed:
        placed = part.withColumn("below", F.col("below") + F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        # the test of single values is compiled, the other is not
        hit = placed.where((F.col("n") > 1) | F.array_contains("ranks", F.col("below")))
        settled.append(hit.select("g", "c", F.explode(_held("below")).alias("rank"), F.col("x").alias("value")))
    return reduce(DataFrame.unionByName, settled).groupBy("g", "c").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("found"))


def _held(below: str) -> Column:
    """Those of ``ranks`` that fall into ``n`` values after ``below`` others."""
    return F.filter("ranks", lambda r: (r >= F.col(below)) & (r < F.col(below) + F.col("n")))


def _place(n: Column, p: float) -> Column:
    return (n - 1) * F.lit(p)


def _ranks(n: Column, ps: Sequence[float]) -> Column:
    return F.array_distinct(F.array(*[f(_place(n, p)).cast("long") for p in ps for f in (F.floor, F.ceil)]))


def _quantile(found: Column, n: Column, p: float) -> Column:
    at = _place(n, p)
    low, high = found[F.floor(at).cast("long")], found[F.ceil(at).cast("long")]
    return low + (high - low) * (at - F.floor(at))


def middle_by(counts: DataFrame, list_limit: int = LIST, broadcast: int = BROADCAST) -> DataFrame:
    """(g, c, median, mad) of each group of :func:`counted_by` rows."""
    bounds = cut(counts.groupBy("g", "c").agg(F.sum("n").alias("finite"), F.count(F.lit(1)).alias("m"), F.min("x").alias("min"), F.max("x").alias("max")))
    n = F.col("finite")
    found = ranked(counts, bounds.select("g", "c", "m", F.col("min").alias("lo"), F.col("max").alias("hi"), _ranks(n, [0.5]).alias("ranks")), list_limit, broadcast)
    stats = cut(bounds.join(found, ["g", "c"]).select("g", "c", "finite", "m", "min", "max", _quantile(F.col("found"), n, 0.5).alias("p50")))
    deviations = _deviations(_salted(counts, stats.select("g", "c", "p50"), ["g", "c"], stats.count(), broadcast), stats, list_limit, broadcast)
    return stats.join(deviations, ["g", "c"]).select("g", "c", F.col("p50").alias("median"), _quantile(F.col("found"), n, 0.5).alias("mad"))


def _deviations(met: DataFrame, stats: DataFrame, list_limit: int, broadcast: int) -> DataFrame:
    """The ranks around the middle of the distances from each group's median."""
    far = F.greatest(F.col("p50") - F.col("min"), F.col("max") - F.col("p50"))
    return ranked(met.select("g", "c", F.abs(F.col("x") - F.col("p50")).alias("x"), "n"), stats.select("g", "c", "m", F.lit(0.0).alias("lo"), far.alias("hi"), _ranks(F.col("finite"), [0.5]).alias("ranks")), list_limit, broadcast)


def profile_by(df: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None, bins: int = DEFAULT_BINS, list_limit: int = LIST, broadcast: int = BROADCAST, counts: DataFrame | None = None) -> DataFrame:
    """One row of statistics for each combination of ``keys`` (nulls are a group) and column: the keys, then the fields of the profile.

    All figures are exact and defined as in :func:`lattica.operators.profile.profile`.
    An array file's elements are profiled by file with key ``path``.  ``counts``
    are the stored :func:`counted_by` rows of the same table, keys and columns,
    where they are there already.
    """
    names = [c for c in columns or numeric_columns(df) if columns or c not in keys]
    if not names:
        raise ValueError("there is no column to profile")
    rows = _long(df, keys, names)
    counts = cut(_counted(rows)) if counts is None else counts
    wanted = {k: e.alias(k) for k, e in basic_aggregates(F.col("v"), F.col("x")).items()}
    base = cut(rows.groupBy("g", "c").agg(*wanted.values()).join(counts.groupBy("g", "c").agg(F.count(F.lit(1)).alias("m")), ["g", "c"], "left"))
    ps, n = [p / 100 for p in PERCENTILES], F.col("finite")
    live = base.where("finite > 0")
    found = ranked(counts, live.select("g", "c", "m", F.col("min").alias("lo"), F.col("max").alias("hi"), _ranks(n, ps).alias("ranks")), list_limit, broadcast)
    stats = live.join(found, ["g", "c"]).select("g", "c", "finite", "m", "min", "max", "integral", *[_quantile(F.col("found"), n, p).alias(percentile_name(q)) for p, q in zip(ps, PERCENTILES, strict=True)])
    iqr = F.col("p75") - F.col("p25")
    span = F.col("max") - F.col("min")
    fits = F.col("integral") & (span > 0) & (span + 1 <= bins)
    pad = F.when(span > 0, 0.0).otherwise(F.greatest(F.abs("min") * 1e-9, F.lit(0.5)))
    k = F.when(fits, (span + 1).cast("int")).otherwise(bins)
    first, last = (F.when(fits, F.col(e) + s * 0.5).otherwise(F.col(e) + s * pad) for e, s in (("min", -1), ("max", 1)))
    stats = cut(stats.withColumns({"lower_fence": F.col("p25") - 1.5 * iqr, "upper_fence": F.col("p75") + 1.5 * iqr, "k": k, "edge": first, "width": (last - first) / k}))
    groups = stats.count()

    # deviations, bins and outliers need their group's figures: values meet them once
    met = _salted(counts, stats.select("g", "c", "p50", "edge", "width", "k", "lower_fence", "upper_fence"), ["g", "c"], groups, broadcast)
    if groups > broadcast:
        met = cut(met)
    deviations = _deviations(met, stats, list_limit, broadcast)
    outside = (F.col("x") < F.col("lower_fence")) | (F.col("x") > F.col("upper_fence"))
    binned = met.groupBy("g", "c", bin_of(F.col("x"), F.col("edge"), F.col("width"), F.col("k")).alias("bin")).agg(F.sum("n").alias("n"), F.sum(F.when(outside, F.col("n")).otherwise(0)).alias("out"))
    binned = binned.groupBy("g", "c").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("counts"), F.sum("out").alias("outliers"))

    distinct = stats.where(F.col("m") <= DISTINCT_CAP).select("g", "c", F.col("m").alias("distinct"))
    values = _salted(counts, distinct.select("g", "c"), ["g", "c"], groups, broadcast).select("g", "c", F.col("x").alias("value"), F.col("n").alias("count"))
    place = F.row_number().over(Window.partitionBy("g", "c").orderBy(F.desc("count"), "value"))
    top = values.withColumn("place", place).where(F.col("place") <= TOP).groupBy("g", "c").agg(F.array_sort(F.collect_list(F.struct("place", "value", "count"))).alias("top"))

    out = base.drop("m").join(stats.drop("finite", "m", "min", "max", "integral"), ["g", "c"], "left").join(deviations, ["g", "c"], "left").join(binned, ["g", "c"], "left").join(distinct, ["g", "c"], "left").join(top, ["g", "c"], "left")
    some = F.col("finite") > 0
    edges = F.transform(F.sequence(F.lit(0), F.col("k")), lambda i: F.col("edge") + F.col("width") * i)
    counts = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: F.coalesce(F.col("counts")[i], F.lit(0)).cast("long"))
    made = {
        "column": F.element_at(F.array(*map(F.lit, names)), F.col("c") + 1),
        "median": F.col("p50"), "iqr": F.col("p75") - F.col("p25"), "mad": _quantile(F.col("found"), n, 0.5),
        "outliers": F.when(some, F.col("outliers")).otherwise(0), "distinct": F.when(some, F.col("distinct")).otherwise(0), "unique_exact": ~some | F.col("distinct").isNotNull(),
        "top_values": F.when(F.col("distinct").isNotNull(), F.transform("top", lambda t: F.struct(t["value"].alias("value"), t["count"].alias("count")))),
        "histogram": F.when(some, F.struct(edges.alias("bin_edges"), counts.alias("counts"), F.col("excluded_non_finite").alias("excluded_non_finite"))),
        "unit_range": F.coalesce("unit_range", F.lit(False)), "approximate": F.lit(False), "sample_size": F.col("total"),
    }
    return out.select("g.*", *[made.get(f.name, F.col(f.name)).cast(f.dataType if not isinstance(f.dataType, T.StringType) else "string").alias(f.name) for f in STATS_SCHEMA.fields])
