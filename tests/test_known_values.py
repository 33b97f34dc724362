"""Known answers: fixed inputs with the rows that DuckDB makes of the fixed outputs."""

from collections.abc import Callable

import duckdb
import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import color as C
from lattica.functions import dtype as D
from lattica.functions import text as X
from lattica.operators import slices as S
from lattica.plans import insights as I
from lattica.plans import layout as L
from lattica.plans import report as R
from lattica.queries import _flat_profile, _profile_sql, _ramp_sql

from .test_queries import plain

def _values(spark: SparkSession, sql_values: str, names: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {sql_values} AS t({names})")


def _sql(v) -> str:
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)


KNOWN: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ANSWERS: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        KNOWN[f.__name__] = f
        if sql is not None:
            ANSWERS[f.__name__] = sql
        return f

    return add


@query("SELECT * FROM (VALUES ('c', '12 4 1'), ('f', '1 2 6'), ('one', '1'), ('none', '')) AS t(name, strides)")
def array_strides(spark, d):
    v = _values(spark, "('c', array(2L, 3L, 4L), false), ('f', array(2L, 3L, 4L), true), ('one', array(9L), true), ('none', cast(array() as array<bigint>), false)", "name, shape, fortran")
    return v.select("name", F.array_join(S.strides(F.col("shape"), F.col("fortran")).cast("array<string>"), " ").alias("strides"))


@query("SELECT * FROM (VALUES (0, '[0, 0, :, :]'), (4, '[0, 4, :, :]'), (7, '[1, 0, :, :]'), (13, '[1, 6, :, :]')) AS t(frame, label)")
def frame_labels(spark, d):
    v = _values(spark, "(0), (4), (7), (13)", "frame")
    at = S.frame_indices(F.col("frame"), F.expr("array(2L, 7L)"))
    return v.select("frame", S.frame_label(at, F.expr("array(0, 1)"), F.lit(4)).alias("label"))


@query(" UNION ALL ".join(_ramp_sql(n) for n in C.RAMPS))
def colour_ramps(spark, d):
    out = None
    for n in C.RAMPS:
        one = C.ramp(spark, n).select(F.lit(n).alias("ramp"), "i", "r", "g", "b")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT * FROM (VALUES ('bool', '0 1'), ('byte', '0 255'), ('unit', '0 1'), ('signed', '-1 1'), ('wide', NULL)) AS t(name, range)")
def display_ranges(spark, d):
    v = _values(spark, "('bool', 'bool', 1, false, true, 0D, 1D), ('byte', 'uint', 1, false, true, 3D, 90D), ('unit', 'float', 4, true, true, 0.1D, 0.9D), ('signed', 'float', 4, false, true, -1.0D, 0.7D), ('wide', 'float', 4, false, true, -9D, 9D)", "name, kind, itemsize, unit, image, lo, hi")
    return v.select("name", C.display_range(F.col("kind"), F.col("itemsize"), F.col("unit"), F.col("image"), F.col("lo"), F.col("hi")).cast("array<int>").cast("array<string>").alias("range")).withColumn("range", F.array_join("range", " "))


@query("SELECT * FROM (VALUES ('dtype', '0 255'), ('robust', '2 98'), ('auto', '10 20'), ('flat', '1 99')) AS t(name, range)")
def shown_ranges(spark, d):
    v = _values(spark, "('dtype', 'dtype', array(0D, 255D), 10D, 20D), ('robust', 'robust', array(0D, 255D), 10D, 20D), ('auto', 'auto', null, 10D, 20D), ('flat', 'auto', null, 5D, 5D)", "name, mode, fixed, blo, bhi")
    shown = C.shown_range(F.col("mode"), F.col("fixed"), F.lit(1.0), F.lit(99.0), F.lit(2.0), F.lit(98.0), F.col("blo"), F.col("bhi"))
    return v.select("name", F.array_join(shown.cast("array<int>").cast("array<string>"), " ").alias("range"))


# fixed values: name, type, shape; then the view, axes, frames and whether it reads as a picture
SHAPES = [
    ("rgb", "|u1", (240, 320, 3), "image", (0, 1, 2), 1, True), ("rgba", "|u1", (128, 128, 4), "image", (0, 1, 2), 1, True), ("gray", "|u1", (256, 256), "image", (0, 1, None), 1, True), ("chw", "<f4", (3, 240, 320), "image", (1, 2, 0), 1, True),
    ("digits", "|u1", (64, 28, 28), "grid", (1, 2, None), 64, True), ("nhwc", "|u1", (48, 32, 32, 3), "grid", (1, 2, 3), 48, True), ("nchw", "<f4", (24, 3, 40, 40), "grid", (2, 3, 1), 24, True), ("terrain", "<f4", (200, 300), "image", (0, 1, None), 1, True),
    ("correlation", "<f8", (12, 12), "table", (0, 1, None), 1, False), ("wave", "<f4", (48000,), "line", (0, 1, None), 1, False), ("onehot", "|u1", (500, 10), "heatmap", (0, 1, None), 1, False), ("features", "<f8", (2000, 24), "heatmap", (0, 1, None), 1, False),
    ("volume", "<f4", (32, 64, 64), "grid", (1, 2, None), 32, True), ("cube", "<f4", (128, 128, 24), "grid", (0, 1, None), 24, True), ("attention", "<f4", (2, 6, 16, 16), "grid", (2, 3, None), 12, True), ("rank5", "<f4", (2, 3, 4, 24, 24), "grid", (3, 4, None), 24, False),
    ("mask", "|b1", (128, 128), "image", (0, 1, None), 1, True), ("complex", "<c16", (1024,), "line", (0, 1, None), 1, False), ("dates", "<M8[D]", (365,), "line", (0, 1, None), 1, False), ("strings", "<U11", (300,), "text", (None, None, None), None, False),
    ("objects", "|O", (40,), "text", (None, None, None), None, False), ("scalar", "<f8", (), "scalar", (None, None, None), None, False), ("empty", "<f8", (0, 8), "text", (None, None, None), None, False), ("sparse", "<f4", (640, 96), "heatmap", (0, 1, None), 1, False), ("decimated", "<f4", (1536, 1536), "image", (0, 1, None), 1, True),
]


def _metas(spark) -> DataFrame:
    rows = ", ".join(f"('{n}', '{t}', {'cast(array() as array<bigint>)' if not s else 'array(' + ', '.join(f'{x}L' for x in s) + ')'})" for n, t, s, *_ in SHAPES)
    v = _values(spark, rows, "name, descr, shape")
    k = D.descr_columns(F.col("descr"))
    return v.withColumns({"dtype": k["name"], "kind": k["kind"], "itemsize": k["itemsize"], "numeric": k["numeric"], "readable": k["readable"], "fortran_order": F.lit(False)})


@query("SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(_sql(x) for x in (n, p, *axes, f, i)) + ")" for n, _, _, p, axes, f, i in SHAPES) + ") AS t(name, \"primary\", row_axis, col_axis, channel_axis, frames, image_like)")
def layout_detected(spark, d):
    return L.detect(_metas(spark)).select("name", "primary", "row_axis", "col_axis", "channel_axis", F.col("frames").cast("int").alias("frames"), "image_like")


@query("SELECT * FROM (VALUES ('digits', 'grid'), ('wave', 'line'), ('features', 'heatmap'), ('rgb', 'image')) AS t(name, view)")
def saved_views(spark, d):
    """The saved view is a grid; arrays of one frame fall back to their own."""
    found = L.detect(_metas(spark)).where(F.col("name").isin("digits", "wave", "features", "rgb"))
    return found.select("name", L.view_mode(F.lit("grid")).alias("view"))


@query()
def layout_described(spark, d):
    return R.array_report(L.detect(_metas(spark)))


@query("SELECT * FROM (VALUES ('field', 'heatmap', 'Signed field — 32 x 32', false), ('labels', 'line', 'Label vector — 3 distinct classes', false), ('hot', 'heatmap', 'One-hot matrix — 10 classes', false), ('floats', 'line', 'Vector of 75 values', false)) AS t(name, \"primary\", semantic, image_like)")
def layout_refined(spark, d):
    v = _values(spark, "('field', 'float64', 'float', 8, array(32L, 32L), 1024L, 1024L, -50D, 50D, 512L, 2L, false), ('labels', 'int64', 'int', 8, array(75L), 75L, 75L, 0D, 2D, 0L, 3L, false), ('hot', 'uint8', 'uint', 1, array(500L, 10L), 5000L, 5000L, 0D, 1D, 0L, 2L, false), ('floats', 'float64', 'float', 8, array(75L), 75L, 75L, 0D, 2D, 0L, 3L, false)", "name, dtype, kind, itemsize, shape, total, finite, min, max, negatives, distinct, unit_range")
    v = v.withColumns({"numeric": F.lit(True), "readable": F.lit(True), "fortran_order": F.lit(False)})
    return L.refine(L.detect(v)).select("name", "primary", "semantic", "image_like")


# fixed values: what a file and its profile say, and the titles that follow
_FLAGGED = [("cut", "truncated, 10 elements, 1 NaN", ["File is truncated", "1 NaN value"]), ("none", "no statistics", ["No numeric statistics"]), ("empty", "2 NaN, 1 inf", ["2 NaN values", "1 infinite values", "No finite values"]), ("bytes", "picture of bytes", ["Standard 8-bit image data", "Channels differ noticeably", "No missing values"]), ("sampled", "column-major, sampled", ["Fortran (column-major) order", "Quantiles are estimated", "No missing values"])]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{c}', {i}, '{t}')" for c, _, ts in _FLAGGED for i, t in enumerate(ts)) + ") AS t(\"column\", position, title)")
def observations_of_files(spark, d):
    """Rules that depend on the file rather than on its values."""
    rows = [("cut", True, None, "float", 8, False, False, 10, 9, 1, 0, None), ("none", False, "Statistics do not apply.", "str", 4, False, False, None, 0, 0, 0, None), ("empty", False, None, "float", 8, False, False, 3, 0, 2, 1, None), ("bytes", False, None, "uint", 1, True, False, 900, 900, 0, 0, [10.0, 90.0]), ("sampled", False, None, "float", 8, False, True, 900, 900, 0, 0, None)]
    kinds = "column string, truncated boolean, unsupported string, kind string, itemsize int, image_like boolean, fortran_order boolean, total long, finite long, nan long, pos_inf long, channel_means array<double>"
    df = spark.createDataFrame(rows, kinds)
    some = lambda v: F.when(F.col("finite") > 0, F.lit(v))
    df = df.withColumns({"neg_inf": F.lit(0), "min": some(1.0), "max": some(250.0), "mean": some(60.0), "median": some(60.0), "std": some(70.0), "skewness": some(0.3), "kurtosis": some(0.1), "sparsity": some(0.0), "zeros": F.lit(0), "integral": F.lit(False), "unit_range": F.lit(False), "distinct": F.lit(None).cast("long"), "outliers": F.lit(0), "lower_fence": some(-9.0), "upper_fence": some(300.0)})
    df = df.withColumns({"approximate": F.col("column") == "sampled", "sample_size": F.col("total"), "top_values": F.lit(None).cast("array<struct<value:double,count:bigint>>"), "declared_bytes": F.lit(80).cast("long"), "data_bytes": F.lit(72).cast("long")})
    return I.insights(df).select("column", "position", "title")


_LABELLED = [("short", 1234567.25, "1,234,570"), ("short", 0.1234567, "0.123457"), ("short", 2.5e-9, "2.500e-9"), ("tick", 0.25, "0.25"), ("tick", 2500000.0, "2.5e6"), ("tick", 0.00001, "1.0e-5"), ("tick", 0.0, "0"), ("duration", 12.0, "12 ms"), ("duration", 1234.0, "1.23 s"), ("skewness", 0.2, "roughly symmetric"), ("skewness", -2.0, "left tail"), ("kurtosis", 4.0, "heavier tails than normal"), ("kurtosis", 0.0, "near-normal tails"), ("ticks", 7.0, "7")]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', CAST({v} AS DOUBLE), '{t}')" for k, v, t in _LABELLED) + ") AS t(kind, v, text)")
def labels_shown(spark, d):
    v = _values(spark, ", ".join(f"('{k}', CAST({v} AS DOUBLE))" for k, v, _ in _LABELLED), "kind, v")
    text = F.lit(None).cast("string")
    for k, c in (("short", X.short_number(F.col("v"))), ("tick", X.tick(F.col("v"))), ("duration", X.duration(F.col("v"))), ("skewness", X.skewness_label(F.col("v"))), ("kurtosis", X.kurtosis_label(F.col("v"))), ("ticks", X.number(D.tick_value(F.col("v").cast("long"))))):
        text = F.when(F.col("kind") == k, c).otherwise(text)
    return v.select("kind", "v", text.alias("text"))


@query("SELECT * FROM (VALUES ('rgb', 0, 1, 2, NULL), ('wave', 0, 1, NULL, NULL), ('features', 0, 1, NULL, 1), ('rgba3', 1, 2, 0, NULL)) AS t(name, row_axis, col_axis, channel_axis, columns)")
def axes_chosen(spark, d):
    """Alternate axes where there are some, and the axis whose columns are described one by one."""
    odd = _metas(spark).where("name = 'rgb'").withColumns({"name": F.lit("rgba3"), "shape": F.expr("array(3L, 50L, 4L)")})
    both = _metas(spark).where(F.col("name").isin("rgb", "wave", "features")).unionByName(odd)
    found = L.detect(both)
    return L.choose(found, True).select("name", "row_axis", "col_axis", "channel_axis", L.column_axis(F.col("shape"), F.col("image_like")).alias("columns"))


# fixed values: descriptor, kind, name, bytes, little-endian, numeric, readable
DESCRIPTORS = [("<f8", "float", "float64", 8, True, True, True), (">i4", "int", "int32", 4, False, True, True), ("|u1", "uint", "uint8", 1, True, True, True), ("|b1", "bool", "bool", 1, True, True, True), ("<f2", "float", "float16", 2, True, True, True), ("<f16", "float", "float128", 16, True, False, False), ("<c16", "complex", "complex128", 16, True, True, True), ("|S12", "bytes", "bytes12", 12, True, False, True), ("<U11", "str", "str11", 44, True, False, True), ("<M8[D]", "datetime", "datetime64[D]", 8, True, True, True), ("<m8[ns]", "timedelta", "timedelta64[ns]", 8, True, True, True), ("|V5", "struct", "void5", 5, True, False, True), ("|O", "object", "object", 8, True, False, False), ("<i3", None, None, None, None, None, None), ("x9", None, None, None, None, None, None)]


@query("SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(_sql(str(x).lower() if isinstance(x, bool) else x) for x in r) + ")" for r in DESCRIPTORS) + ") AS t(descr, kind, name, itemsize, little_endian, numeric, readable)")
def dtype_parsed(spark, d):
    v = _values(spark, ", ".join(f"('{r[0]}')" for r in DESCRIPTORS), "descr")
    flags = ("little_endian", "numeric", "readable")
    return v.select("descr", *[(c.cast("string") if k in flags else c).alias(k) for k, c in D.descr_columns(F.col("descr")).items()])


_HALF = [(0, "0"), (0x3C00, "1"), (0xC000, "-2"), (0x3555, "0.333252"), (0x7C00, "inf"), (0xFC00, "-inf"), (0x7E00, "NaN"), (1, "5.9605e-8"), (0x7BFF, "65504")]


@query("SELECT * FROM (VALUES " + ", ".join(f"({b}, '{t if b != 0x3555 else '0.333252'}')" for b, t in _HALF) + ") AS t(bits, text)")
def half_decoded(spark, d):
    v = _values(spark, ", ".join(f"({b})" for b, _ in _HALF), "bits")
    return v.select("bits", X.number(D.half_value(F.col("bits"))).alias("text"))


@query("SELECT * FROM (VALUES ('D', 365, '1971-01-01 00:00:00.000'), ('ms', 1500, '1970-01-01 00:00:01.500'), ('s', -1, '1969-12-31 23:59:59.000'), ('25us', 7, '7'), ('D', 9000000000000, '9000000000000'), ('D', NULL, NULL)) AS t(unit, ticks, text)")
def ticks_shown(spark, d):
    v = _values(spark, "('D', 365L), ('ms', 1500L), ('s', -1L), ('25us', 7L), ('D', 9000000000000L), ('D', cast(null as bigint))", "unit, ticks")
    return v.select("unit", "ticks", D.ticks_text(F.col("ticks"), F.col("unit")).alias("text"))


_NUMBERS = [("1", "1"), ("-0.5", "-0.5"), ("0.1", "0.1"), ("1234567.891", "1234568"), ("123456789012", "123456789012"), ("0.000012345678", "1.2346e-5"), ("2500000000.5", "2.5000e+9"), ("6.02214076E23", "6.0221e+23"), ("3.14159265358979", "3.141593"), ("100.25", "100.25")]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, (_, t) in enumerate(_NUMBERS)) + ") AS t(i, text)")
def numbers_shown(spark, d):
    v = _values(spark, ", ".join(f"({i}, CAST('{n}' AS DOUBLE))" for i, (n, _) in enumerate(_NUMBERS)), "i, v")
    return v.select("i", X.number(F.col("v")).alias("text"))


@query("SELECT * FROM (VALUES (0, '0%', '()'), (1, '0%', '(7,)'), (2, '<0.01%', '(2, 3)'), (3, '50.00%', '(1, 2, 3)'), (4, '0.500%', '(9,)')) AS t(i, share, shape)")
def shares_and_shapes(spark, d):
    v = _values(spark, "(0, 0, 100, cast(array() as array<bigint>)), (1, 1, 0, array(7L)), (2, 1, 1000000, array(2L, 3L)), (3, 50, 100, array(1L, 2L, 3L)), (4, 5, 1000, array(9L))", "i, a, b, s")
    return v.select("i", X.percent(F.col("a"), F.col("b")).alias("share"), X.shape(F.col("s")).alias("shape"))


@query("SELECT * FROM (VALUES ('many', true), ('unique', false), ('half', false), ('none', false)) AS t(name, shown)")
def frequency_rule(spark, d):
    v = _values(spark, "('many', 1000L, 10L, 400L), ('unique', 1000L, 1000L, 1L), ('half', 1000L, 600L, 2L), ('none', 1000L, cast(null as bigint), 5L)", "name, finite, distinct, top")
    return v.select("name", X.shows_frequencies(F.col("distinct"), F.col("finite"), F.col("top")).alias("shown"))


def _files(spark: SparkSession) -> str:
    """Small arrays in the shared folder; SQL knows their values by formula."""
    import io

    import numpy as np

    from lattica.store import put

    field = (np.arange(1200) * 0.5 - 100).reshape(40, 30)
    cube = (np.arange(6 * 20 * 16) % 251).reshape(6, 20, 16)
    arrays = {
        "field": np.asfortranarray(field.astype(">f8")), "cube": cube.astype("<f4"), "counts": 2**60 + np.arange(500), "complex": np.arange(50) * (3 + 4j), "half": (np.arange(200) / 8).astype("<f2"),
        "days": np.arange(100).astype("M8[D]"), "rec": np.array([(i, i / 2, (i, i + 1, i + 2), b"r%d" % i) for i in range(30)], [("id", "<i4"), ("score", "<f8"), ("colour", "u1", (3,)), ("label", "S12")]),
    }
    files = {}
    for name, a in arrays.items():
        out = io.BytesIO()
        np.save(out, a)
        files[f"{name}.npy"] = out.getvalue()
    files["cut.npy"] = files["half.npy"][:-100]  # 50 of 200 values are missing
    return put(spark, files)


def _read(spark: SparkSession, name: str, *a, **kw) -> DataFrame:
    from lattica.sources.npy import read_npy

    return read_npy(spark, f"{_files(spark)}/{name}.npy", *a, **kw)


# fixed values: name, type, shape, order, truncated; the header of records is longer
_META = [("complex", "complex128", "50", False, False), ("counts", "int64", "500", False, False), ("cube", "float32", "6 20 16", False, False), ("cut", "float16", "200", False, True), ("days", "datetime64[D]", "100", False, False), ("field", "float64", "40 30", True, False), ("half", "float16", "200", False, False), ("rec", "record[4 fields]", "30", False, False)]


@query("SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(_sql(x) for x in r) + f", '1.0', {192 if r[0] == 'rec' else 128})" for r in _META) + ") AS t(name, dtype, shape, fortran_order, truncated, npy_version, header_bytes)")
def npy_meta(spark, d):
    from lattica.sources.npy import read_npy

    meta = read_npy(spark, _files(spark), "meta")
    return meta.select(F.regexp_extract("path", "([a-z]+)[.]npy$", 1).alias("name"), "dtype", F.array_join(F.col("shape").cast("array<string>"), " ").alias("shape"), "fortran_order", "truncated", "npy_version", F.col("header_bytes").cast("int").alias("header_bytes"))


_ELEMENTS = {"field": "i * 0.5::DOUBLE - 100", "cube": "CAST(i % 251 AS DOUBLE)", "complex": "i * 5.0::DOUBLE", "half": "i / 8.0::DOUBLE", "days": "CAST(i AS DOUBLE)"}


_SIZES = {"field": 1200, "cube": 1920, "complex": 50, "half": 200, "days": 100}


@query(" UNION ALL ".join(f"SELECT '{n}' AS name, i AS pos, {v} AS value FROM range({_SIZES[n]}) AS t(i)" for n, v in _ELEMENTS.items()))
def npy_elements(spark, d):
    """All elements of arrays in C and Fortran order, big and little-endian, of five types."""
    from lattica.sources.npy import read_npy

    folder = _files(spark)
    every = read_npy(spark, ",".join(f"{folder}/{n}.npy" for n in _ELEMENTS), partition_bytes=2048)
    return every.select(F.regexp_extract("path", "([a-z]+)[.]npy$", 1).alias("name"), "pos", "value")


@query("SELECT i AS pos, CAST(1152921504606846976 + i AS VARCHAR) AS exact FROM range(500) AS t(i)")
def npy_exact(spark, d):
    return _read(spark, "counts", exact=True).select("pos", "exact")


@query("SELECT i AS pos, strftime(DATE '1970-01-01' + CAST(i AS INTEGER), '%Y-%m-%d') || ' 00:00:00.000' AS exact FROM range(100) AS t(i)")
def npy_dates(spark, d):
    return _read(spark, "days", exact=True).select("pos", "exact")


@query("SELECT r AS row, c AS col, (r * 30 + c) * 0.5::DOUBLE - 100 AS value FROM range(40) AS a(r), range(30) AS b(c) WHERE r BETWEEN 35 AND 44 AND c BETWEEN 20 AND 25")
def npy_window(spark, d):
    """A page of a Fortran-ordered file, clipped to it; only its bytes are read."""
    from lattica.sources.npy import read_file_window

    return read_file_window(spark, f"{_files(spark)}/field.npy", S.Plane((40, 30), 0, 1), row0=35, col0=20, rows=10, cols=6).select("row", "col", "value")


@query("SELECT f AS frame, r // 3 AS row, c // 2 AS col, CAST((f * 320 + r * 16 + c) % 251 AS DOUBLE) AS value FROM range(6) AS x(f), range(20) AS a(r), range(16) AS b(c) WHERE f BETWEEN 2 AND 4 AND r % 3 = 0 AND c % 2 = 0")
def npy_block(spark, d):
    """A decimated block of three frames; only every third row is read."""
    from lattica.sources.npy import read_file_block

    return read_file_block(spark, f"{_files(spark)}/cube.npy", S.Plane((6, 20, 16), 1, 2), [2, 3, 4], max_side=8).select("frame", "row", "col", "value")


@query("SELECT CAST(0 AS BIGINT) AS row, i AS col, CASE WHEN i < 150 THEN CAST(CAST(i / 8.0 AS DOUBLE) AS VARCHAR) ELSE '--' END AS text FROM range(200) AS t(i) WHERE i BETWEEN 141 AND 160 AND (i % 8 > 0 OR i >= 150)")
def npy_truncated(spark, d):
    """Around the end of a file that is cut; whole numbers are left to ``npy_exact``."""
    from lattica.sources.npy import read_file_window

    page = read_file_window(spark, f"{_files(spark)}/cut.npy", S.vector_plane(200), col0=141, cols=20)
    return page.where("col % 8 > 0 or col >= 150").select("row", "col", "text")


@query(_profile_sql("SELECT 'value' AS \"column\", i * 0.5::DOUBLE - 100 AS v FROM range(1200) AS t(i)"))
def npy_profile(spark, d):
    return _flat_profile(_read(spark, "field").select("value"), ["value"])


@query("SELECT i AS pos, CAST(i AS INTEGER) AS id, i / 2.0::DOUBLE AS score, i || ' ' || (i + 1) || ' ' || (i + 2) AS colour, 'r' || i AS label FROM range(30) AS t(i)")
def npy_records(spark, d):
    return _read(spark, "rec", "records").select("pos", "id", "score", F.array_join(F.col("colour").cast("array<string>"), " ").alias("colour"), "label")


@pytest.mark.parametrize("name", sorted(ANSWERS))
def test_known_answers(spark, name):
    df, want = KNOWN[name](spark, ""), duckdb.connect().execute(ANSWERS[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert plain([[r[c] for c in df.columns] for r in df.collect()], df.columns) == plain(want.fetchall(), names)


def test_layouts_are_described(spark):
    assert {r["key"] for r in KNOWN["layout_described"](spark, "").collect()} >= {"Type", "Shape", "Reads as", "Why"}
