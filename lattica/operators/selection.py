"""Exact order statistics by refined histograms.

The value of rank r is found without sorting: one scan counts values in equal
bins between a column's bounds and keeps each bin's own smallest and largest
value; the bin that holds the rank becomes the next interval, until it holds
few enough values to list or only one.  Each scan is combined on the map side
and sends a bounded number of rows (bins x intervals) whatever the input, so
no column is ever gathered or sorted, unlike ``percentile``, whose state is
every distinct value in one task.  Bins and listed values are ranked where
they are, by windows of at most BINS or LIST rows; the driver gets a row for
each rank that is asked for.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins of an interval in one scan.
BINS = 8192
#: Values of a bin that are listed rather than refined.
LIST = 20_000
#: Ends of an interval on one side of zero may differ by this factor and still be cut into equal bins; those of a whole column by the second.
EVEN, FAR = 4.0, 2.0**40

#: Bins of the first scan that are told, those with the most values.
TOLD = 12

#: Smallest and largest exponents of a double.
_LEAST, _MOST = -1074, 1023


def image(x: Column) -> Column:
    """A piecewise linear logarithm with sign: grows with the double, and bins of equal width in it are as fine at 1e-300 as at 1e300."""
    a = F.abs(x)
    e = F.least(F.greatest(F.floor(F.log2(a)), F.lit(_LEAST)), F.lit(_MOST)).cast("double")
    return F.when(x == 0, 0.0).otherwise(F.signum(x) * (e - _LEAST + a / F.pow(F.lit(2.0), e)))



def _bin(value: Column, lo: float, hi: float, whole: bool) -> Column:
    """Bin of a value between two bounds: equal ones, or equal in the image where an interval spans magnitudes.

    Equal bins suit most ``whole`` columns; what then holds too many values near
    zero is cut by the image.  After that an interval is even, so each scan adds
    13 binary digits: five settle any column.
    """
    apart = max(abs(lo), abs(hi)) > (FAR if whole else EVEN) * min(abs(lo), abs(hi)) if lo * hi > 0 else not whole
    # halves, as a span may be too large for a double
    at, a, b = (image(value), image(F.lit(lo)), image(F.lit(hi))) if apart else (value / 2, F.lit(lo / 2), F.lit(hi / 2))
    return F.least(F.floor((at - a) / (b - a) * BINS), F.lit(BINS - 1))


def _code(value: Column, intervals: list[tuple[float, float]], whole: bool = False) -> Column:
    """interval * BINS + bin of a value, null outside all intervals (which don't overlap)."""
    # halving by comparisons: about log2(n) of them a value, in one expression that is compiled
    order = sorted(range(len(intervals)), key=lambda i: intervals[i])

    def within(own: list[int]) -> Column:
        if len(own) > 1:
            half = len(own) // 2
            return F.when(value < F.lit(intervals[own[half]][0]), within(own[:half])).otherwise(within(own[half:]))
        lo, hi = intervals[own[0]]
        return F.when((value >= F.lit(lo)) & (value <= F.lit(hi)), _bin(value, lo, hi, whole) + own[0] * BINS)

    return within(order).cast("int")


class Bins(NamedTuple):
    """What the first scan tells of a column: bins with values, whether each has one value, distinct values at least, and (value, count) of the TOLD largest bins if so."""

    bins: int
    single: bool
    at_least: int
    top: list[tuple[float, int]]


def _ranked(counted: DataFrame, keys: Sequence[str], by: str, wanted: DataFrame) -> DataFrame:
    """Rows of ``counted`` with ``start``, the values before them among those of their keys, and ``own``, the ranks of ``wanted`` (keys, ranks) that fall into them."""
    before = Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.join(F.broadcast(wanted), list(keys)).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return placed.withColumn("own", F.expr("filter(ranks, r -> r >= start and r < start + n)"))


def order_statistics(df: DataFrame, columns: Mapping[str, Column], bounds: Mapping[str, tuple[float, float]], ranks: Mapping[str, Sequence[int]], seen: dict[str, Bins] | None = None) -> dict[str, dict[int, float]]:
    """Values of the given 0-based ranks among the finite values of each column.

    ``columns`` are double expressions, null where there is no finite value;
    ``bounds`` their smallest and largest value.  ``seen`` gets what the first
    scan tells of a column that it bins; where all bins have one value these
    are all values of the column.
    """
    spark = df.sparkSession
    df = df.select(*[v.alias(f"v{i}") for i, v in enumerate(columns.values())])
    columns = {c: F.col(f"v{i}") for i, c in enumerate(columns)}
    found: dict[str, dict[int, float]] = {c: {} for c in columns}
    # intervals: column -> (lo, hi, count of values below lo, ranks inside)
    work = {c: [(lo, hi, 0, sorted(set(ranks[c])))] for c, (lo, hi) in bounds.items() if ranks.get(c)}
    whole = True
    while work:
        names = list(work)
        for c in names:
            for lo, hi, _, rs in work[c]:
                if lo == hi:
                    found[c].update(dict.fromkeys(rs, lo))
            work[c] = [w for w in work[c] if w[0] != w[1]]
        names = [c for c in names if work[c]]
        if not names:
            break
        codes = {c: _code(columns[c], [(w[0], w[1]) for w in work[c]], whole) for c in names}
        per = [F.struct(F.lit(k).alias("c"), codes[c].alias("p"), columns[c].alias("v")) for k, c in enumerate(names)]
        rows = df.select(F.inline(F.array(*per)) if len(per) > 1 else per[0].alias("x"))
        rows = (rows if len(per) > 1 else rows.select("x.*")).where("p is not null")
        asked = [(k, i, [r - below for r in rs]) for k, c in enumerate(names) for i, (_, _, below, rs) in enumerate(work[c])]
        counted = rows.groupBy("c", "p").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        binned = _ranked(counted.withColumn("i", F.floor(F.col("p") / BINS).cast("int")), ["c", "i"], "p", spark.createDataFrame(asked, "c int, i int, ranks array<long>"))
        chosen = F.size("own") > 0
        if seen is not None and whole:
            # a column has one interval yet, so these windows are of the same rows
            own, most = Window.partitionBy("c", "i"), Window.partitionBy("c", "i").orderBy(F.desc("n"), "lo")
            binned = binned.withColumns({"bins": F.count(F.lit(1)).over(own), "single": F.bool_and(F.col("lo") == F.col("hi")).over(own), "at_least": F.sum(F.when(F.col("lo") == F.col("hi"), 1).otherwise(2)).over(own), "place": F.row_number().over(most)})
            chosen |= F.col("single") & (F.col("place") <= TOLD)
        got = binned.where(chosen).drop("ranks").collect()
        if seen is not None and whole:
            for k, c in enumerate(names):
                own = sorted((r for r in got if r["c"] == k), key=lambda r: r["place"])
                top = [(r["lo"], r["n"]) for r in own if r["place"] <= TOLD] if own[0]["single"] else []
                seen[c] = Bins(own[0]["bins"], own[0]["single"], own[0]["at_least"], top)
        whole = False
        todo: dict[str, list] = {}
        listed: list[tuple[int, int, list[int]]] = []
        begins: dict[tuple[int, int], int] = {}
        for r in sorted((r for r in got if r["own"]), key=lambda r: (r["c"], r["p"])):
            c = names[r["c"]]
            below = work[c][r["i"]][2]
            at = [below + x for x in r["own"]]
            if r["lo"] == r["hi"]:
                found[c].update(dict.fromkeys(at, r["lo"]))
            elif r["n"] <= LIST:
                begins[r["c"], r["p"]] = below + r["start"]
                listed.append((r["c"], r["p"], [x - r["start"] for x in r["own"]]))
            else:
                todo.setdefault(c, []).append((r["lo"], r["hi"], below + r["start"], at))
        if listed:
            # the same bins again: a lookup in a small set picks those to list
            picked = None
            for k in range(len(names)):
                if own := [p for j, p, _ in listed if j == k]:
                    one = (F.col("c") == k) & F.col("p").isin(own)
                    picked = one if picked is None else picked | one
            values = rows.where(picked).groupBy("c", "p", "v").agg(F.count(F.lit(1)).alias("n"))
            for r in _ranked(values, ["c", "p"], "v", spark.createDataFrame(listed, "c int, p int, ranks array<long>")).where(F.size("own") > 0).collect():
                found[names[r["c"]]].update({begins[r["c"], r["p"]] + x: r["v"] for x in r["own"]})
        work = todo
    return found


def interpolation_ranks(n: int, p: float) -> tuple[int, int, float]:
    """Neighbouring ranks of quantile p among n values, and the weight of the upper."""
    at = (n - 1) * min(max(p, 0.0), 1.0)
    return int(math.floor(at)), int(math.ceil(at)), at - math.floor(at)


def exact_quantiles(df: DataFrame, columns: Mapping[str, Column], bounds: Mapping[str, tuple[float, float]], counts: Mapping[str, int], probabilities: Sequence[float], seen: dict[str, Bins] | None = None) -> dict[str, list[float]]:
    """Linearly interpolated quantiles of each column's finite values."""
    where = {c: [interpolation_ranks(counts[c], p) for p in probabilities] for c in bounds}
    values = order_statistics(df, columns, bounds, {c: [r for lo, hi, _ in w for r in (lo, hi)] for c, w in where.items()}, seen)
    return {c: [values[c][lo] + (values[c][hi] - values[c][lo]) * f for lo, hi, f in where[c]] for c in where}
