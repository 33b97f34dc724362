"""Registered queries over layouts, types, texts and array files that are made from the given tables.

Shapes, type descriptors and figures are derived from keys; array files are
written from whole tables by executors and read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import color as C
from .functions import dtype as D
from .functions import text as X
from .operators import exact_sums as E
from .operators import grouped as G
from .operators import slices as S
from .plans import insights as I
from .plans import layout as L
from .plans import report as R
from .queries import _ROW, _flat, _matrix, _plane_values, _profile_sql, _ramp_sql, _rounded, _t, query
from .sources.npy import read_file_block, read_npy
from .sources.pictures import read_png, write_png
from .sources.sinks import write_csv_files, write_npy
from .store import new_folder

# ------------------------------------------------------- shapes, frames, ranges


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 1 THEN '1 ' || a || ' ' || a * b ELSE b * 3 || ' 3 1' END AS strides FROM (SELECT o_orderkey, o_custkey % 7 + 1 AS a, o_orderkey % 5 + 1 AS b FROM orders)
""")
def array_strides(spark, d):
    o = _t(spark, d, "orders")
    return o.select("o_orderkey", F.array_join(S.strides(F.expr("array(o_custkey % 7 + 1, o_orderkey % 5 + 1, 3L)"), F.col("o_orderkey") % 2 == 1).cast("array<string>"), " ").alias("strides"))


@query("SELECT event_id AS frame, '[' || (event_id // 7) % 1000 || ', ' || event_id % 7 || ', :, :]' AS label FROM events")
def frame_labels(spark, d):
    at = S.frame_indices(F.col("event_id"), F.expr("array(1000L, 7L)"))
    return _t(spark, d, "events").select(F.col("event_id").alias("frame"), S.frame_label(at, F.expr("array(0, 1)"), F.lit(4)).alias("label"))


@query(f"""
WITH b AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part), ramps AS ({" UNION ALL ".join(_ramp_sql(n) for n in C.RAMPS)}),
p AS (SELECT p_partkey, CAST(least(greatest(floor((p_retailprice - lo) / (hi - lo) * 255 + 0.5), 0), 255) AS INTEGER) AS i FROM part, b)
SELECT p_partkey, ramp, r, g, b FROM p JOIN ramps USING (i)
""")
def colour_ramps(spark, d):
    """The price of each part in the colours of all ramps."""
    part = _t(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("v"))
    at = part.crossJoin(F.broadcast(part.agg(F.min("v").alias("lo"), F.max("v").alias("hi")))).select("p_partkey", C.ramp_index(C.normalise(F.col("v"), F.col("lo"), F.col("hi"))).alias("i"))
    ramps = None
    for n in C.RAMPS:
        one = C.ramp(spark, n).select(F.lit(n).alias("ramp"), "i", "r", "g", "b")
        ramps = one if ramps is None else ramps.unionByName(one)
    return at.join(F.broadcast(ramps), "i").select("p_partkey", "ramp", "r", "g", "b")


@query("""
SELECT l_suppkey, CASE k WHEN 0 THEN '0 1' WHEN 1 THEN '0 255' WHEN 2 THEN CASE WHEN lo >= 0 THEN '0 1' END ELSE CASE WHEN lo < 0 AND lo >= -1.05 AND hi <= 1.05 THEN '-1 1' END END AS range
FROM (SELECT l_suppkey, l_suppkey % 4 AS k, min(l_discount) - CASE WHEN l_suppkey % 3 = 0 THEN 0.5 ELSE 0 END AS lo, max(l_tax) + CASE WHEN l_suppkey % 5 = 0 THEN 1 ELSE 0 END AS hi FROM lineitem GROUP BY 1)
""")
def display_ranges(spark, d):
    k, key = F.col("l_suppkey") % 4, F.col("l_suppkey")
    b = _t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.min("l_discount").alias("a"), F.max("l_tax").alias("b"))
    lo, hi = F.col("a") - F.when(key % 3 == 0, 0.5).otherwise(0.0), F.col("b") + F.when(key % 5 == 0, 1.0).otherwise(0.0)
    kind = F.when(k == 0, "bool").when(k == 1, "uint").otherwise("float")
    shown = C.display_range(kind, F.when(k == 1, 1).otherwise(4), (k == 2) & (lo >= 0), k == 3, lo, hi)
    return b.select("l_suppkey", F.array_join(shown.cast("array<int>").cast("array<string>"), " ").alias("range"))


@query("""
WITH b AS (SELECT o_custkey, floor(min(o_totalprice)) AS lo, floor(max(o_totalprice)) AS hi FROM orders GROUP BY 1),
s AS (SELECT o_custkey, o_custkey % 4 AS m, lo, hi, lo + 1 AS p1, hi - 1 AS p99, lo + 2 AS bl, CASE WHEN o_custkey % 5 = 0 THEN lo + 2 ELSE hi + 3 END AS bh FROM b),
r AS (SELECT *, CASE WHEN bh > bl THEN [bl, bh] WHEN hi > lo THEN [lo, hi] ELSE [0, 1] END AS auto FROM s)
SELECT o_custkey, CASE m WHEN 0 THEN '0 255' WHEN 1 THEN CAST(lo AS BIGINT) || ' ' || CAST(hi AS BIGINT) ELSE CASE WHEN m = 2 AND p99 > p1 THEN CAST(p1 AS BIGINT) || ' ' || CAST(p99 AS BIGINT) ELSE CAST(auto[1] AS BIGINT) || ' ' || CAST(auto[2] AS BIGINT) END END AS range FROM r
""")
def shown_ranges(spark, d):
    b = _t(spark, d, "orders").groupBy("o_custkey").agg(F.floor(F.min("o_totalprice")).cast("double").alias("lo"), F.floor(F.max("o_totalprice")).cast("double").alias("hi"))
    m, lo, hi = F.col("o_custkey") % 4, F.col("lo"), F.col("hi")
    fixed = F.when(m == 0, F.array(F.lit(0.0), F.lit(255.0)))
    block = lo + 2, F.when(F.col("o_custkey") % 5 == 0, lo + 2).otherwise(hi + 3)
    shown = C.shown_range(F.when(m < 2, "dtype").when(m == 2, "robust").otherwise("auto"), fixed, lo, hi, lo + 1, hi - 1, *block)
    return b.select("o_custkey", F.array_join(shown.cast("array<bigint>").cast("array<string>"), " ").alias("range"))


# --------------------------------------------------------------------- layouts

#: Extents and types that orders pick by their keys.
_EXTENTS, _TYPES = (3, 1, 64, 4, 16, 200, 28, 10, 500, 8, 2, 32, 0), ("|u1", "<f4", "<f8", "|b1", "<i8", "<U11", "|O", "<M8[D]")
_AXIS = "((o_orderkey // 6 + {i} * (o_custkey % 11 + 1)) % 13)"


def _metas(spark: SparkSession, d: str) -> DataFrame:
    """A header for each order: up to five axes, their extents and the type by its keys."""
    extents, types = F.array(*[F.lit(x).cast("long") for x in _EXTENTS]), F.array(*map(F.lit, _TYPES))
    at = lambda i: (F.floor(F.col("o_orderkey") / 6) + i * (F.col("o_custkey") % 11 + 1)) % 13
    shape = F.slice(F.array(*[F.get(extents, at(i).cast("int")) for i in range(5)]), 1, (F.col("o_orderkey") % 6).cast("int"))
    v = _t(spark, d, "orders").select("o_orderkey", "o_custkey", F.get(types, (F.col("o_custkey") % 8).cast("int")).alias("descr"), shape.alias("shape"))
    k = D.descr_columns(F.col("descr"))
    return v.withColumns({"dtype": k["name"], "kind": k["kind"], "itemsize": k["itemsize"], "numeric": k["numeric"], "readable": k["readable"], "fortran_order": F.lit(False)})


_PICK = "[" + ", ".join(map(str, _EXTENTS)) + "][" + _AXIS + " + 1]"
_GRAY = lambda h, w: f"({h} >= 8 AND {w} >= 8 AND CASE WHEN t = 0 THEN greatest({h}, {w}) / least({h}, {w}) <= 12 ELSE greatest({h}, {w}) / least({h}, {w}) <= 4 AND {h} * {w} >= 256 END)"
_BAND = lambda b, h, w: f"(least({h}, {w}) >= 16 AND 4 * {b} < least({h}, {w}))"
#: Axes of rows, columns and channels, their alternates, frames, extents of the plane, and whether it reads as a picture, by rule.
_RULES = f"""
k AS (SELECT o_orderkey, o_custkey, o_custkey % 8 AS t, o_orderkey % 6 AS n, {", ".join(f"CASE WHEN o_orderkey % 6 > {i} THEN {_PICK.format(i=i)} ELSE 0 END AS d{i}" for i in range(5))} FROM orders),
r AS (SELECT *, CASE WHEN t = 6 THEN 1 WHEN t = 5 THEN 2 WHEN n > 0 AND list_contains([d0, d1, d2, d3, d4][:n], 0) THEN 3 WHEN n = 0 THEN 4 WHEN n = 1 THEN 5 WHEN n = 2 THEN 6
  WHEN n = 3 AND d2 IN (3, 4) AND d0 >= 2 AND d1 >= 2 THEN 7 WHEN n = 3 AND d0 IN (3, 4) AND d1 >= 2 AND d2 >= 2 THEN 8 WHEN n = 3 AND d2 = 1 THEN 9 WHEN n = 3 AND {_BAND("d2", "d0", "d1")} THEN 10 WHEN n = 3 THEN 11
  WHEN n = 4 AND d3 IN (1, 3, 4) AND NOT (d1 IN (1, 3, 4) AND d3 = 1) THEN 12 WHEN n = 4 AND d1 IN (1, 3, 4) THEN 13 WHEN n = 4 AND {_BAND("d3", "d1", "d2")} THEN 14 WHEN n = 4 THEN 15 ELSE 16 END AS rule FROM k),
a AS (SELECT *, CASE WHEN rule IN (5, 6, 7, 9, 10) THEN 0 WHEN rule IN (8, 11, 12, 14) THEN 1 WHEN rule IN (13, 15) THEN 2 WHEN rule = 16 THEN 3 END AS row_axis, CASE WHEN rule IN (5, 6, 7, 9, 10) THEN 1 WHEN rule IN (8, 11, 12, 14) THEN 2 WHEN rule IN (13, 15) THEN 3 WHEN rule = 16 THEN 4 END AS col_axis,
  CASE rule WHEN 7 THEN 2 WHEN 8 THEN 0 WHEN 9 THEN 2 WHEN 12 THEN 3 WHEN 13 THEN 1 END AS channel_axis,
  CASE WHEN rule = 7 AND d0 IN (3, 4) THEN [1, 2, 0] WHEN rule = 8 THEN [0, 1, NULL] WHEN rule IN (9, 10) THEN [1, 2, NULL] WHEN rule = 12 AND d1 IN (1, 3, 4) THEN [2, 3, 1] WHEN rule = 13 AND d3 IN (1, 3, 4) THEN [1, 2, 3] WHEN rule = 14 THEN [2, 3, NULL] END AS other,
  CASE WHEN rule BETWEEN 5 AND 9 THEN 1 WHEN rule = 10 THEN d2 WHEN rule IN (11, 12, 13) THEN d0 WHEN rule = 14 THEN d0 * d3 WHEN rule = 15 THEN d0 * d1 WHEN rule = 16 THEN d0 * d1 * d2 END AS frames,
  CASE rule WHEN 5 THEN 1 WHEN 8 THEN d1 WHEN 11 THEN d1 WHEN 12 THEN d1 WHEN 14 THEN d1 WHEN 13 THEN d2 WHEN 15 THEN d2 WHEN 16 THEN d3 ELSE d0 END AS h, CASE rule WHEN 5 THEN d0 WHEN 8 THEN d2 WHEN 11 THEN d2 WHEN 12 THEN d2 WHEN 14 THEN d2 WHEN 13 THEN d3 WHEN 15 THEN d3 WHEN 16 THEN d4 ELSE d1 END AS w,
  CASE WHEN rule IN (7, 8, 12, 13) THEN true WHEN rule IN (6, 9, 10) THEN {_GRAY("d0", "d1")} WHEN rule IN (11, 14) THEN {_GRAY("d1", "d2")} WHEN rule = 15 THEN {_GRAY("d2", "d3")} ELSE false END AS image_like FROM r),
f AS (SELECT *, CASE WHEN rule <= 3 THEN 'text' WHEN rule = 4 THEN 'scalar' WHEN rule = 5 THEN 'line' WHEN image_like THEN CASE WHEN frames > 1 THEN 'grid' ELSE 'image' END WHEN frames <= 1 AND h * w <= 400 THEN 'table' WHEN h = 1 OR w = 1 THEN 'line' WHEN frames > 1 THEN 'grid' ELSE 'heatmap' END AS shown FROM a)
"""


@query(f'WITH {_RULES} SELECT o_orderkey, shown AS "primary", row_axis, col_axis, channel_axis, CAST(frames AS BIGINT) AS frames, image_like FROM f')
def layout_detected(spark, d):
    return L.detect(_metas(spark, d)).select("o_orderkey", "primary", "row_axis", "col_axis", "channel_axis", "frames", "image_like")


@query(f"WITH {_RULES} SELECT o_orderkey, CASE WHEN row_axis IS NOT NULL AND frames > 1 THEN 'grid' WHEN shown IN ('line', 'heatmap') THEN shown ELSE 'image' END AS view FROM f")
def saved_views(spark, d):
    """The saved view is a grid; arrays of one frame fall back to their own."""
    return L.detect(_metas(spark, d)).select("o_orderkey", L.view_mode(F.lit("grid")).alias("view"))


@query(f"WITH {_RULES} SELECT o_orderkey, CASE WHEN other IS NULL THEN row_axis ELSE other[1] END AS row_axis, CASE WHEN other IS NULL THEN col_axis ELSE other[2] END AS col_axis, CASE WHEN other IS NULL THEN channel_axis ELSE other[3] END AS channel_axis, CASE WHEN n = 2 AND NOT image_like AND d1 <= 512 THEN 1 END AS columns FROM f")
def axes_chosen(spark, d):
    """Alternate axes where there are some, and the axis whose columns are described one by one."""
    return L.choose(L.detect(_metas(spark, d)), True).select("o_orderkey", "row_axis", "col_axis", "channel_axis", L.column_axis(F.col("shape"), F.col("image_like")).alias("columns"))


@query(f"""
WITH {_RULES}, s AS (SELECT *, list_aggregate([d0, d1, d2, d3, d4][:n], 'product') AS total, o_orderkey % 3 - 1 AS lo, 1 + 40 * (o_orderkey // 7 % 2) AS hi, o_orderkey // 11 % 40 AS u, row_axis IS NOT NULL AS known FROM f),
c AS (SELECT *, o_orderkey % 13 = 0 AS empty, known AND image_like AND NOT (o_orderkey % 13 = 0) AND lo < 0 AND hi > 1.05 AS signed FROM s)
SELECT o_orderkey, CASE WHEN signed AND shown = 'image' THEN 'heatmap' ELSE shown END AS "primary", image_like AND NOT empty AND NOT signed AS image_like,
  CASE WHEN signed AND shown = 'image' THEN 'Signed field — ' || array_to_string([d0, d1, d2, d3, d4][:n], ' x ') WHEN known AND n = 1 AND t IN (0, 4) AND lo >= 0 AND u BETWEEN 2 AND 1000 AND total >= 4 * u THEN 'Label vector — ' || u || ' distinct classes'
  WHEN known AND n = 2 AND t IN (0, 4) AND lo >= 0 AND hi <= 1 AND d1 <= 4096 THEN 'One-hot matrix — ' || d1 || ' classes' END AS said FROM c
""")
def layout_refined(spark, d):
    """Layouts after a profile whose figures are derived from the keys, and what it changed."""
    k = F.col("o_orderkey")
    total = F.aggregate("shape", F.lit(1).cast("long"), lambda a, x: a * x)
    v = _metas(spark, d).withColumns({"total": total, "finite": F.when(k % 13 == 0, 0).otherwise(total), "min": (k % 3 - 1).cast("double"), "max": (1 + 40 * (F.floor(k / 7) % 2)).cast("double"), "negatives": F.when(k % 3 == 0, 5).otherwise(0), "distinct": F.floor(k / 11) % 40, "unit_range": F.lit(False)})
    found = L.detect(v)
    refined = L.refine(found.withColumn("before", F.col("semantic")))
    return refined.select("o_orderkey", "primary", "image_like", F.when(F.col("semantic") != F.col("before"), F.col("semantic")).alias("said"))


@query()
def layout_described(spark, d):
    return R.array_report(L.detect(_metas(spark, d)), "o_orderkey")


@query("""
WITH s AS (SELECT l_suppkey AS k, count(*) AS n, l_suppkey % 2 = 0 AS cut, l_suppkey % 7 = 0 AS none, l_suppkey % 4 AS nan, CASE WHEN l_suppkey % 3 = 1 THEN 1 ELSE 0 END AS inf, l_suppkey % 11 > 0 AS live, l_suppkey % 3 = 0 AS bytes, l_suppkey % 5 = 0 AS fortran, l_suppkey % 6 = 1 AS sampled FROM lineitem GROUP BY ALL),
t AS (SELECT k, list_filter([CASE WHEN cut THEN 'File is truncated' END, CASE WHEN none THEN 'No numeric statistics' END, CASE WHEN NOT none AND nan > 0 THEN nan || ' NaN value' || CASE WHEN nan = 1 THEN '' ELSE 's' END END, CASE WHEN NOT none AND inf > 0 THEN inf || ' infinite values' END,
  CASE WHEN NOT none AND NOT live THEN 'No finite values' END, CASE WHEN NOT none AND live AND bytes THEN 'Standard 8-bit image data' END, CASE WHEN NOT none AND live AND bytes THEN 'Channels differ noticeably' END, CASE WHEN NOT none AND live AND fortran THEN 'Fortran (column-major) order' END,
  CASE WHEN NOT none AND live AND sampled THEN 'Quantiles are estimated' END, CASE WHEN NOT none AND live AND nan + inf = 0 THEN 'No missing values' END], lambda x: x IS NOT NULL) AS told FROM s)
SELECT k AS l_suppkey, CAST(unnest(range(len(told))) AS INTEGER) AS position, unnest(told) AS title FROM t
""")
def observations_of_files(spark, d):
    """Rules that depend on the file rather than on its values: one file a supplier, its flags by the key."""
    k = F.col("l_suppkey")
    s = _t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    has, some = k % 7 != 0, k % 11 > 0
    known = lambda v: F.when(has & some, F.lit(v))
    flags = {"truncated": k % 2 == 0, "unsupported": F.when(~has, "Statistics do not apply."), "kind": F.when(k % 3 == 0, "uint").otherwise("float"), "itemsize": F.when(k % 3 == 0, 1).otherwise(8), "image_like": k % 3 == 0, "fortran_order": k % 5 == 0, "total": F.when(has, F.col("n")), "finite": F.when(some, F.col("n")).otherwise(0), "nan": k % 4, "pos_inf": F.when(k % 3 == 1, 1).otherwise(0), "channel_means": F.when(k % 3 == 0, F.array(F.lit(10.0), F.lit(90.0)))}
    figures = {"neg_inf": F.lit(0), "min": known(1.0), "max": known(250.0), "mean": known(60.0), "median": known(60.0), "std": known(70.0), "skewness": known(0.3), "kurtosis": known(0.1), "sparsity": known(0.0), "zeros": F.lit(0), "integral": F.lit(False), "unit_range": F.lit(False), "distinct": F.lit(None).cast("long"), "outliers": F.lit(0), "lower_fence": known(-9.0), "upper_fence": known(300.0)}
    rest = {"approximate": k % 6 == 1, "sample_size": F.col("n"), "top_values": F.lit(None).cast("array<struct<value:double,count:bigint>>"), "declared_bytes": F.col("n") * 8, "data_bytes": F.col("n") * 7}
    return I.insights(s.withColumns(flags | figures | rest), "l_suppkey").select("l_suppkey", "position", "title")


# -------------------------------------------------------------- types and texts


@query("""
WITH e AS (SELECT event_id, unnest(['short', 'tick', 'duration', 'skewness', 'kurtosis', 'ticks']) AS kind FROM events)
SELECT event_id, kind, CASE kind WHEN 'short' THEN format('{:,}', event_id * 1000) WHEN 'tick' THEN CASE WHEN event_id % 100000 = 0 THEN '0' ELSE format('{:,}', event_id % 100000) END WHEN 'duration' THEN CASE WHEN event_id * 10 < 1000 THEN event_id * 10 || ' ms' ELSE printf('%.2f s', event_id / 100.0::DOUBLE) END
  WHEN 'skewness' THEN CASE WHEN event_id % 9 = 4 THEN 'roughly symmetric' WHEN event_id % 9 > 4 THEN 'right tail' ELSE 'left tail' END WHEN 'kurtosis' THEN CASE WHEN event_id % 9 > 6 THEN 'heavier tails than normal' WHEN event_id % 9 < 2 THEN 'lighter tails than normal' ELSE 'near-normal tails' END ELSE CAST(event_id AS VARCHAR) END AS text FROM e
""")
def labels_shown(spark, d):
    k, half = F.col("event_id"), (F.col("event_id") % 9 - 4) / 2
    made = {"short": X.short_number((k * 1000).cast("double")), "tick": X.tick((k % 100000).cast("double")), "duration": X.duration((k * 10).cast("double")), "skewness": X.skewness_label(half), "kurtosis": X.kurtosis_label(half), "ticks": X.number(D.tick_value(k))}
    return _t(spark, d, "events").select("event_id", F.explode(F.create_map(*[x for n, c in made.items() for x in (F.lit(n), c)])).alias("kind", "text"))


_ORDERS, _LETTERS, _DIGITS = ("<", ">", "|", "=", ""), "biufcSUVOMm", ("1", "2", "4", "8", "16", "12", "3", "")


@query(f"""
WITH p AS (SELECT p_partkey, {list(_ORDERS)}[p_partkey % 5 + 1] AS o, substr('{_LETTERS}', p_partkey // 5 % 11 + 1, 1) AS l, {list(_DIGITS)}[p_partkey // 55 % 8 + 1] AS g FROM part),
q AS (SELECT *, CASE WHEN l IN ('M', 'm') AND p_partkey % 2 = 1 THEN '[ns]' ELSE '' END AS u, coalesce(TRY_CAST(g AS INTEGER), 0) AS n, {{'b': 'bool', 'i': 'int', 'u': 'uint', 'f': 'float', 'c': 'complex', 'S': 'bytes', 'U': 'str', 'V': 'struct', 'O': 'object', 'M': 'datetime', 'm': 'timedelta'}}[l] AS kind FROM p),
w AS (SELECT *, NOT (l IN ('i', 'u') AND n NOT IN (1, 2, 4, 8) OR l = 'f' AND n NOT IN (2, 4, 8, 16) OR l = 'c' AND n NOT IN (8, 16)) AS ok FROM q)
SELECT p_partkey, o || l || g || u AS descr, CASE WHEN ok THEN kind END AS kind, CASE WHEN ok THEN CASE WHEN l = 'b' THEN 'bool' WHEN l IN ('i', 'u', 'f', 'c') THEN kind || 8 * n WHEN l IN ('S', 'U') THEN kind || n WHEN l IN ('M', 'm') THEN kind || '64' || u WHEN l = 'V' THEN 'void' || n ELSE 'object' END END AS name,
  CASE WHEN ok THEN CASE WHEN l = 'b' THEN greatest(n, 1) WHEN l = 'U' THEN 4 * n WHEN l IN ('M', 'm') THEN 8 WHEN l = 'O' AND n = 0 THEN 8 ELSE n END END AS itemsize, CASE WHEN ok THEN o <> '>' END AS little_endian,
  CASE WHEN ok THEN l IN ('b', 'i', 'u', 'f', 'c', 'M', 'm') AND NOT (l = 'f' AND n = 16) END AS "numeric", CASE WHEN ok THEN l <> 'O' AND NOT (l = 'f' AND n = 16) END AS readable FROM w
""".replace("{'b'", "MAP {'b'"))
def dtype_parsed(spark, d):
    k = F.col("p_partkey")
    pick = lambda values, at: F.get(F.array(*map(F.lit, values)), at.cast("int"))
    letter = pick(_LETTERS, F.floor(k / 5) % 11)
    unit = F.when(letter.isin("M", "m") & (k % 2 == 1), "[ns]").otherwise("")
    v = _t(spark, d, "part").select("p_partkey", F.concat(pick(_ORDERS, k % 5), letter, pick(_DIGITS, F.floor(k / 55) % 8), unit).alias("descr"))
    return v.select("p_partkey", "descr", *[c.alias(n) for n, c in D.descr_columns(F.col("descr")).items()])


@query("""
WITH b AS (SELECT o_orderkey, o_orderkey * 13 % 65536 AS b FROM orders), p AS (SELECT o_orderkey, CASE WHEN b >= 32768 THEN -1 ELSE 1 END AS s, (b >> 10) & 31 AS e, b & 1023 AS f FROM b)
SELECT o_orderkey, CASE WHEN e = 31 THEN CASE WHEN f > 0 THEN 'NaN' WHEN s > 0 THEN 'inf' ELSE '-inf' END END AS odd, CASE WHEN e < 31 THEN s * CASE WHEN e = 0 THEN f * pow(2.0::DOUBLE, -24) ELSE (f + 1024) * pow(2.0::DOUBLE, e - 25) END END + 0.0 AS value FROM p
""")
def half_decoded(spark, d):
    v = D.half_value((F.col("o_orderkey") * 13 % 65536).cast("int"))
    finite = ~F.isnan(v) & (F.abs(v) < float("inf"))
    return _t(spark, d, "orders").select("o_orderkey", F.when(~finite, X.number(v)).alias("odd"), (F.when(finite, v) + 0.0).alias("value"))


@query("""
SELECT event_id, CASE event_id % 5 WHEN 0 THEN strftime(epoch_ms(event_id % 20000 * 86400000), '%Y-%m-%d %H:%M:%S.%g') WHEN 1 THEN strftime(epoch_ms((event_id * 977 - 100000) * 1000), '%Y-%m-%d %H:%M:%S.%g') WHEN 2 THEN strftime(epoch_ms(event_id * 100003), '%Y-%m-%d %H:%M:%S.%g') WHEN 3 THEN CAST(event_id AS VARCHAR) ELSE 'NaT' END AS text FROM events
""")
def ticks_shown(spark, d):
    k = F.col("event_id")
    unit = F.get(F.array(*map(F.lit, ("D", "s", "ms", "25us", "D"))), (k % 5).cast("int"))
    ticks = F.when(k % 5 == 0, k % 20000).when(k % 5 == 1, k * 977 - 100000).when(k % 5 == 2, k * 100003).when(k % 5 == 3, k).otherwise(F.lit(D.NAT))
    return _t(spark, d, "events").select("event_id", D.ticks_text(ticks, unit).alias("text"))


@query(r"""
WITH v AS (SELECT l_orderkey, l_linenumber, l_quantity / 7 * [1e0, 1e-6, 1e10][l_linenumber % 3 + 1] AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN v = floor(v) AND abs(v) < 1e15 THEN CAST(CAST(v AS BIGINT) AS VARCHAR) WHEN abs(v) < 1e-4 OR abs(v) >= 1e9 THEN regexp_replace(printf('%.4e', v), 'e([+-])0(\d)', 'e\1\2') ELSE printf('%.7g', v) END AS text FROM v
""")
def numbers_shown(spark, d):
    scale = F.get(F.array(F.lit(1e0), F.lit(1e-6), F.lit(1e10)), (F.col("l_linenumber") % 3).cast("int"))
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.number(F.col("l_quantity") / 7 * scale).alias("text"))


@query("""
WITH e AS (SELECT event_id, user_id, event_id % 997 AS a, CASE WHEN event_id % 10 = 0 THEN 9976979 WHEN event_id % 10 = 1 THEN 99700 ELSE 997 END AS b FROM events)
SELECT event_id, CASE WHEN a = 0 THEN '0%' WHEN a / b < 1e-4 THEN '<0.01%' WHEN a / b < 0.01 THEN printf('%.3f', a / b::DOUBLE * 100) || '%' ELSE printf('%.2f', a / b::DOUBLE * 100) || '%' END AS share,
  CASE event_id % 3 WHEN 0 THEN '()' WHEN 1 THEN '(' || user_id || ',)' ELSE '(' || user_id || ', ' || event_id % 5 || ')' END AS shape FROM e
""")
def shares_and_shapes(spark, d):
    k = F.col("event_id")
    whole = F.when(k % 10 == 0, 9976979).when(k % 10 == 1, 99700).otherwise(997)
    dims = F.slice(F.array(F.col("user_id"), k % 5), 1, (k % 3).cast("int"))
    return _t(spark, d, "events").select("event_id", X.percent(k % 997, whole).alias("share"), X.shape(dims).alias("shape"))


@query("""
WITH c AS (SELECT l_suppkey, 'l_discount' AS "column", l_discount AS v, count(*) AS n FROM lineitem GROUP BY ALL UNION ALL SELECT l_suppkey, 'l_extendedprice', l_extendedprice, count(*) FROM lineitem GROUP BY ALL)
SELECT l_suppkey, "column", max(n) > 1 AND count(*) >= 2 AND 2 * count(*) <= sum(n) AS shown FROM c GROUP BY ALL
""")
def frequency_rule(spark, d):
    p = G.profile_by(_t(spark, d, "lineitem"), ["l_suppkey"], ["l_discount", "l_extendedprice"])
    return p.select("l_suppkey", "column", X.shows_frequencies(F.col("distinct"), F.col("finite"), F.get("top_values", F.lit(0))["count"]).alias("shown"))


# ------------------------------------------------------------------ array files

#: Rows of a matrix file, and of the other files.
_MATRIX_ROWS, _FILE_ROWS = 100, 2000
_CELLS = f"(SELECT r, CAST(unnest(embedding) AS DOUBLE) AS v, unnest(range(len(embedding))) AS c FROM {_ROW})"


def _matrices(spark: SparkSession, d: str) -> str:
    """``embeddings`` as files of 100 rows: little-endian floats, and every second one of big-endian doubles in Fortran order."""
    folder = new_folder(spark, "arrays")
    e, plane = _matrix(spark, d)
    width = plane.shape[1]
    at = F.floor(F.col("pos") / (width * _MATRIX_ROWS))
    rows = e.select(F.concat(F.lit("e"), at.cast("string")).alias("file"), F.col("pos").alias("at"), "value", (at % 2 == 1).alias("odd"))
    write_npy(rows.where("not odd").drop("odd"), folder, "<f4", width)
    write_npy(rows.where("odd").drop("odd"), folder, ">f8", width, fortran=True)
    return folder


def _name() -> F.Column:
    return F.regexp_extract("path", "([a-z]+[0-9]+)[.]npy$", 1).alias("name")


def _filed(df: DataFrame, key: str, letter: str, *values: F.Column) -> DataFrame:
    return df.select(F.concat(F.lit(letter), F.floor(F.col(key) / _FILE_ROWS).cast("string")).alias("file"), F.col(key).alias("at"), *values)


_FILED = "SELECT '{letter}' || {key} // 2000 AS name, row_number() OVER (PARTITION BY {key} // 2000 ORDER BY {key}) - 1 AS pos, count(*) OVER (PARTITION BY {key} // 2000) AS n, * FROM {table}"


@query(f"""
SELECT 'e' || r // 100 AS name, CASE WHEN r // 100 % 2 = 0 THEN 'float32' ELSE 'float64' END AS dtype, count(*) || ' 64' AS shape, r // 100 % 2 = 1 AND count(*) > 1 AS fortran_order, false AS truncated, '1.0' AS npy_version, true AS aligned FROM (SELECT row_number() OVER () - 1 AS r FROM embeddings) GROUP BY r // 100
UNION ALL SELECT 'p' || p_partkey // 2000, 'record[4 fields]', CAST(count(*) AS VARCHAR), false, false, '1.0', true FROM part GROUP BY p_partkey // 2000
""")
def npy_meta(spark, d):
    folder = _matrices(spark, d)
    _records(spark, d, folder)
    meta = read_npy(spark, folder, "meta")
    return meta.select(_name(), "dtype", F.array_join(F.col("shape").cast("array<string>"), " ").alias("shape"), "fortran_order", "truncated", "npy_version", (F.col("header_bytes") % 64 == 0).alias("aligned"))


@query(f"""
SELECT 'e' || r // 100 AS name, r % 100 * 64 + c AS pos, v AS value FROM {_CELLS}
UNION ALL SELECT name, pos, round(sqrt(value * value + CAST(user_id AS DOUBLE) * user_id), 6) FROM ({_FILED.format(letter="c", key="event_id", table="events")})
UNION ALL SELECT name, pos, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) FROM ({_FILED.format(letter="d", key="o_orderkey", table="orders")})
""")
def npy_elements(spark, d):
    """All elements of files in C and Fortran order, big and little-endian, of four types."""
    folder = _matrices(spark, d)
    write_npy(_filed(_t(spark, d, "events"), "event_id", "c", F.col("value"), F.col("user_id").cast("double")), folder, "<c16")
    write_npy(_filed(_t(spark, d, "orders"), "o_orderkey", "d", F.unix_date(F.to_date("o_orderdate")).alias("day")), folder, "<M8[D]")
    rows = read_npy(spark, folder, partition_bytes=1 << 16).select(_name(), "pos", "value")
    return rows.withColumn("value", F.when(F.col("name").startswith("c"), F.round("value", 6)).otherwise(F.col("value")))


@query(f"SELECT name, pos, CAST(1152921504606846976 + o_orderkey AS VARCHAR) AS exact FROM ({_FILED.format(letter='i', key='o_orderkey', table='orders')})")
def npy_exact(spark, d):
    folder = new_folder(spark, "arrays")
    write_npy(_filed(_t(spark, d, "orders"), "o_orderkey", "i", (F.col("o_orderkey") + (1 << 60)).alias("v")), folder, "<i8")
    return read_npy(spark, folder, exact=True).select(_name(), "pos", "exact")


@query(f"SELECT name, pos, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') || ' 00:00:00.000' AS exact FROM ({_FILED.format(letter='d', key='o_orderkey', table='orders')})")
def npy_dates(spark, d):
    folder = new_folder(spark, "arrays")
    write_npy(_filed(_t(spark, d, "orders"), "o_orderkey", "d", F.unix_date(F.to_date("o_orderdate")).alias("day")), folder, "<M8[D]")
    return read_npy(spark, folder, exact=True).select(_name(), "pos", "exact")


@query(f"SELECT 'e' || r // 100 AS name, r % 100 * 64 + c AS pos, v AS value FROM {_CELLS} WHERE r % 100 BETWEEN 35 AND 44 AND c BETWEEN 20 AND 25")
def npy_window(spark, d):
    """The same window of every file, in either order; only its bytes are read."""
    return read_npy(spark, _matrices(spark, d), window="35:45, 20:26").select(_name(), "pos", "value")


@query(f"SELECT r AS frame, c // 8 // 2 AS row, c % 8 // 2 AS col, v AS value FROM {_CELLS} WHERE r BETWEEN 2 AND 4 AND c // 8 % 2 = 0 AND c % 8 % 2 = 0")
def npy_block(spark, d):
    """A decimated block of three frames of a stack of 8 x 8 planes; only every second row is read."""
    folder = new_folder(spark, "arrays")
    e, plane = _matrix(spark, d)
    write_npy(e.select(F.concat(F.lit("s"), F.floor(F.col("pos") / (64 * _FILE_ROWS)).cast("string")).alias("file"), F.col("pos").alias("at"), "value"), folder, "<f4", 64)
    # 64 columns are a plane of 8 x 8
    cells = read_npy(spark, folder, window="2:5, :").where(F.col("path").endswith("s0.npy")).select("pos", "value")
    return S.read_block(cells, S.Plane((min(plane.shape[0], _FILE_ROWS), 8, 8), 1, 2), [2, 3, 4], max_side=4).select("frame", "row", "col", "value")


@query(f"SELECT name, pos, CASE WHEN pos < 2 * n // 3 THEN CAST(user_id AS VARCHAR) ELSE '--' END AS text FROM ({_FILED.format(letter='t', key='event_id', table='events')})")
def npy_truncated(spark, d):
    """Files that end after two thirds of their elements: a window shows what is missing."""
    whole, cut = new_folder(spark, "arrays"), new_folder(spark, "arrays")
    write_npy(_filed(_t(spark, d, "events"), "event_id", "t", F.col("user_id")), whole, "<i8")
    sizes = read_npy(spark, whole, "meta").select("path", "header_bytes", "size")
    files = spark.read.format("binaryFile").load(whole).select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "content")
    kept = sizes.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), (F.col("header_bytes") + 8 * F.floor(F.col("size") * 2 / 3)).cast("int").alias("bytes"))

    def save(batches):
        from .sources.npy import create

        for b in batches:
            for name, data, n in zip(b.column("name").to_pylist(), b.column("content").to_pylist(), b.column("bytes").to_pylist(), strict=True):
                create(f"{cut}/{name}", data[:n])
            yield b.select(["name"])

    files.join(kept, "name").mapInArrow(save, "name string").count()
    return read_npy(spark, cut, exact=True, window=":").select(_name(), "pos", F.col("exact").alias("text"))


@query(_profile_sql(f"SELECT 'e' || r // 100 AS \"column\", v FROM {_CELLS}"))
def npy_profile(spark, d):
    """The profile of every file."""
    return _flat(G.profile_by(read_npy(spark, _matrices(spark, d), columns=["path", "value"]), ["path"], ["value"]).withColumn("column", _name()))


def _records(spark: SparkSession, d: str, folder: str) -> None:
    size = F.col("p_size")
    fields = [("id", "<i4"), ("score", "<f8"), ("colour", "u1", (3,)), ("label", "S12")]
    write_npy(_filed(_t(spark, d, "part"), "p_partkey", "p", F.col("p_partkey").cast("int").alias("id"), F.col("p_retailprice").alias("score"), F.array(size, size + 1, size + 2).alias("colour"), F.col("p_brand").alias("label")), folder, fields)


@query(f"SELECT name, pos, CAST(p_partkey AS INTEGER) AS id, p_retailprice AS score, p_size || ' ' || (p_size + 1) || ' ' || (p_size + 2) AS colour, p_brand AS label FROM ({_FILED.format(letter='p', key='p_partkey', table='part')})")
def npy_records(spark, d):
    folder = new_folder(spark, "arrays")
    _records(spark, d, folder)
    return read_npy(spark, folder, "records").select(_name(), "pos", "id", "score", F.array_join(F.col("colour").cast("array<string>"), " ").alias("colour"), "label")


# --------------------------------------------------- pictures, CSV files, sums


@query(f"""
WITH w AS (SELECT r, c, v FROM {_CELLS}), b AS (SELECT min(v) AS lo, max(v) AS hi FROM w), ramp AS ({_ramp_sql("magma")})
SELECT w.r // 100 AS frame, w.r % 100 AS row, c AS col, ramp.r, ramp.g, ramp.b, 255 AS a FROM w, b JOIN ramp ON ramp.i = least(greatest(CAST(floor((v - lo) / (hi - lo) * 255 + 0.5) AS INTEGER), 0), 255)
""")
def picture_files(spark, d):
    """All cells as PNG files of 100 rows, drawn in strips, written and read back."""
    folder = new_folder(spark, "pictures")
    drawn = C.colour(_plane_values(spark, d), F.col("v"), F.col("lo"), F.col("hi"), "magma")
    write_png(drawn.withColumns({"frame": F.floor(F.col("row") / _MATRIX_ROWS), "row": F.col("row") % _MATRIX_ROWS}), folder)
    return read_png(spark, folder)


@query("SELECT CAST(c_nationkey AS VARCHAR) AS file, c_custkey, c_name, c_mktsegment, c_acctbal FROM customer")
def csv_files(spark, d):
    """``customer`` as a CSV file for each nation, read back."""
    folder = new_folder(spark, "csv")
    write_csv_files(_t(spark, d, "customer"), folder, ["c_name", "c_mktsegment", "c_acctbal"], "c_custkey", "c_nationkey")
    back = spark.read.csv(folder, "c_custkey long, c_name string, c_mktsegment string, c_acctbal double", header=True, escape='"', multiLine=True)
    return back.select(F.regexp_extract(F.col("_metadata.file_name"), "(.*)[.]csv$", 1).alias("file"), *back.columns)


@query("""
WITH c AS (SELECT l_suppkey, 'l_extendedprice' AS "column", CAST(round(l_extendedprice * 100) AS HUGEINT) AS v FROM lineitem UNION ALL SELECT l_suppkey, 'l_discount', CAST(round(l_discount * 100) AS HUGEINT) FROM lineitem)
SELECT l_suppkey, "column", count(*) AS finite, round(CAST(sum(v) AS DOUBLE) / 100, 2) AS sum, round(CAST(sum(v) AS DOUBLE) / 100 / count(*), 6) AS mean FROM c GROUP BY ALL
""")
def exact_sums(spark, d):
    s = E.exact_sums(_t(spark, d, "lineitem"), ["l_suppkey"], ["l_extendedprice", "l_discount"])
    return s.withColumns({"sum": F.round("sum", 2), "mean": F.round("mean", 6)})
