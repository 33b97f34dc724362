"""Statistics, slices, layout, observations, text and colours against known answers and NumPy."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lattica.functions import color as C
from lattica.functions import dtype as D
from lattica.functions import text as X
from lattica.operators import profile as P
from lattica.operators import slices as S
from lattica.operators.sampling import hashed_sample
from lattica.operators.selection import exact_quantiles, order_statistics
from lattica.plans import insights as I
from lattica.plans import layout as L
from lattica.plans import report as R

NAN, INF = float("nan"), float("inf")


def values(spark, xs, parts=3):
    return spark.createDataFrame([(None if x is None else float(x),) for x in xs], "v double").repartition(parts)


def one(spark, xs, **kw):
    return P.profile(values(spark, xs), ["v"], **kw).first()


@pytest.mark.parametrize(
    ("xs", "want"),
    [
        ([2, 4, 4, 4, 5, 5, 7, 9], dict(total=8, mean=5, min=2, max=9, sum=40, median=4.5, std=2.138089935, integral=True, approximate=False, skewness=0.65625, kurtosis=-0.21875)),
        ([1, 2, NAN, INF, -INF, 3], dict(total=6, finite=3, nan=1, pos_inf=1, neg_inf=1, mean=2, max=3, distinct=3, excluded_non_finite=3)),
        ([0, 0, 0, -1, 2], dict(zeros=3, negatives=1, positives=1, sparsity=0.6)),
        ([1, 2, 3, 4, 5, 6, 7], dict(mad=2)),
        ([1, 2, 3, 4], dict(mad=1)),
        ([9], dict(mad=0, std=0, sem=0, skewness=0, kurtosis=0)),
        ([3, NAN, 1, INF, 5, -INF, 2, 4], dict(median=3, p25=2, p75=4, mad=1, min=1, max=5)),
        ([-5, 0, 5], dict(cv=None)),
        ([2, 4, 6], dict(cv=0.5)),
        ([7, 7, 7, 7], dict(std=0, skewness=0, kurtosis=0)),
        ([NAN, INF], dict(total=2, finite=0, min=None, mean=None, median=None, distinct=0)),
        ([None, 1.0, None], dict(total=1, nulls=2)),
        ([-0.0, 0.0], dict(distinct=1, zeros=2)),
    ],
)
def test_known_answers(spark, xs, want):
    got = one(spark, [None if x is None else float(x) for x in xs])
    for k, v in want.items():
        assert got[k] is None if v is None else got[k] == pytest.approx(v), k


def test_empty_columns(spark):
    got = P.profile(values(spark, [1.0]).where("false"), ["v"]).first()
    assert got["total"] == 0 and got["median"] is None and got["histogram"] is None
    assert P.profile(spark.createDataFrame([("a",)], "s string")).count() == 0


@pytest.mark.parametrize("kind", ["normal", "lognormal", "ties", "wide", "tiny"])
@pytest.mark.parametrize("parts", [1, 7])
def test_quantiles_equal_numpy(spark, kind, parts):
    rng = np.random.default_rng(3)
    x = {"normal": rng.normal(size=3000), "lognormal": rng.lognormal(3, 2, 3000), "ties": rng.integers(0, 4, 3000).astype(float), "wide": np.append(rng.normal(size=2000), [1e300, -1e300]), "tiny": rng.normal(size=2000) * 1e-300}[kind]
    got = P.profile(values(spark, x.tolist(), parts), ["v"]).first()
    for p in P.PERCENTILES:
        assert got[P.percentile_name(p)] == pytest.approx(np.percentile(x, p), rel=1e-12), p
    assert got["mad"] == pytest.approx(np.median(np.abs(x - np.median(x))), rel=1e-9)
    q1, q3 = np.percentile(x, [25, 75])
    assert got["outliers"] == int(((x < q1 - 1.5 * (q3 - q1)) | (x > q3 + 1.5 * (q3 - q1))).sum())
    assert sum(got["histogram"]["counts"]) == len(x)


def test_selection_refines(spark, monkeypatch):
    """Bins too full to list are refined until they are not."""
    from lattica.operators import selection

    monkeypatch.setattr(selection, "LIST", 5)
    monkeypatch.setattr(selection, "BINS", 16)
    rng = random.Random(1)
    x = sorted(rng.expovariate(1) ** 6 for _ in range(800))
    got = order_statistics(values(spark, x), {"v": F.col("v")}, {"v": (x[0], x[-1])}, {"v": [0, 1, 200, 399, 400, 700, 780, 798, 799]})
    assert got["v"] == {r: x[r] for r in (0, 1, 200, 399, 400, 700, 780, 798, 799)}
    y = sorted(rng.random() for _ in range(800))
    got = order_statistics(values(spark, y), {"v": F.col("v")}, {"v": (y[0], y[-1])}, {"v": range(0, 800, 53)})
    assert got["v"] == {r: y[r] for r in range(0, 800, 53)}


def test_few_rows_of_a_column_reach_the_driver(spark, monkeypatch):
    """Bins and listed values are ranked in Spark: the driver gets a few dozen rows a column and scan, whatever the values."""
    rows = []
    rng = np.random.default_rng(5)
    x = {"even": rng.random(20_000), "steep": np.exp(rng.normal(size=20_000) * 50), "few": rng.integers(0, 3000, 20_000).astype(float), "signed": np.where(rng.random(20_000) < 0.5, -0.0, rng.normal(size=20_000))}
    df = spark.createDataFrame(pd.DataFrame(x)).repartition(7)
    collect = type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: rows.append(len(out := collect(self))) or out)
    ps = [p / 100 for p in P.PERCENTILES]
    bounds = {c: (float(v.min()), float(v.max())) for c, v in x.items()}
    seen = {}
    got = exact_quantiles(df, {c: F.col(c) for c in x}, bounds, dict.fromkeys(x, 20_000), ps, seen)
    for c, v in x.items():
        assert got[c] == pytest.approx(np.percentile(v, P.PERCENTILES).tolist(), rel=1e-12), c
    assert max(rows) <= len(x) * (2 * len(ps) + 12) and len(rows) <= 10
    values, counts = np.unique(x["few"], return_counts=True)
    assert seen["few"].single and seen["few"].bins == len(values) and not seen["even"].single
    assert seen["few"].top == [(values[i], counts[i]) for i in np.lexsort((values, -counts))[:12]]


def test_histograms(spark):
    assert [r["count"] for r in P.histogram(values(spark, [1.0, 2, 3, 4, 5, 5, 5]), F.col("v")).orderBy("bin").collect()] == [1, 1, 1, 1, 3]
    huge = P.histogram(values(spark, [6.02214076e23] * 3), F.col("v"))
    assert huge.agg(F.sum("count")).first()[0] == 3
    sines = values(spark, [math.sin(i) for i in range(1000)])
    assert P.histogram(sines, F.col("v"), 16).agg(F.sum("count"), F.count("bin")).first() == (1000, 16)
    assert P.histogram(values(spark, [NAN]), F.col("v")).count() == 0


def test_distinct_cap_and_top(spark):
    few, many = values(spark, [float(i % 5) for i in range(100)]), values(spark, [float(i) for i in range(50)])
    assert P.distinct_capped(few, F.col("v"), 5).first() == (5, True)
    assert P.distinct_capped(many, F.col("v"), 49).first() == (None, False)
    assert [tuple(r) for r in P.top_values(few, F.col("v"), 2).collect()] == [(0.0, 20), (1.0, 20)]
    assert P.top_values(many, F.col("v"), 3, 49).collect() == []


def test_sample_is_flagged_and_stable(spark):
    x = np.random.default_rng(1).normal(size=6000).tolist()
    a, b = one(spark, x, exact_limit=2000), P.profile(values(spark, x, 9), ["v"], exact_limit=2000).first()
    assert a["approximate"] and 1500 < a["sample_size"] < 2500 and a["total"] == 6000
    assert a["median"] == b["median"] and abs(a["median"]) < 0.2
    df = spark.range(5000)
    assert hashed_sample(df, ["id"], 1, 10).count() == hashed_sample(df.repartition(5), ["id"], 1, 10).count()


def test_axis_groups(spark):
    e = spark.range(24).select(F.col("id").alias("pos"), F.col("id").cast("double").alias("value"))
    got = P.grouped_by_axis(e, 1, 3, "Column").orderBy("index").collect()
    assert [(r["label"], r["count"], r["min"], r["max"]) for r in got] == [("Column 0", 8, 0, 21), ("Column 1", 8, 1, 22), ("Column 2", 8, 2, 23)]
    assert P.grouped_by_axis(e, 1, 1) is None and P.grouped_by_axis(e, 1, 513) is None


def grid(spark, shape):
    n = math.prod(shape)
    return spark.range(n).select(F.col("id").alias("pos"), F.col("id").cast("double").alias("value"))


def test_decimated_block(spark):
    b = S.read_block(grid(spark, (4, 4)), S.Plane((4, 4), 0, 1), max_side=2).orderBy("row", "col")
    assert [r["value"] for r in b.collect()] == [0, 2, 8, 10]
    frames = S.read_block(grid(spark, (5, 5, 6)), S.Plane((5, 5, 6), 1, 2), frames=[3])
    assert S.block_bounds(frames).first() == (90, 119)
    assert S.block_steps(S.Plane((1, 4000, 4000), 1, 2), 1, 1600, 2_000_000) == (5, 5) or S.block_steps(S.Plane((1, 4000, 4000), 1, 2), 1, 1600, 2_000_000)[0] >= 3


def test_block_encoding(spark):
    import base64

    b = S.read_block(grid(spark, (2, 3)), S.Plane((2, 3), 0, 1))
    assert np.frombuffer(base64.b64decode(S.encode_block(b).first()["data"]), "<f4").tolist() == [0, 1, 2, 3, 4, 5]
    assert base64.b64decode(S.encode_block(b, as_bytes=True).first()["data"]) == bytes(range(6))


def test_windows(spark):
    w = S.table_window(grid(spark, (10, 6)), S.Plane((10, 6), 0, 1), row0=8, col0=4)
    assert [(r["row"], r["col"], r["value"]) for r in w.orderBy("row", "col").collect()] == [(8, 4, 52), (8, 5, 53), (9, 4, 58), (9, 5, 59)]
    rgb = S.table_window(grid(spark, (2, 2, 3)), S.Plane((2, 2, 3), 0, 1, 2)).orderBy("row", "col").first()
    assert rgb["text"] == "0.0, 1.0, 2.0" and rgb["value"] == 0
    short = S.table_window(grid(spark, (2, 2)).where("pos < 3"), S.Plane((2, 2), 0, 1)).orderBy("row", "col").collect()
    assert short[3]["text"] == "--" and short[3]["value"] is None
    assert S.wide(w, [4, 5]).orderBy("row").first()["4"] == "52.0"


def test_envelope_and_numbers(spark):
    df = values(spark, [float(i) for i in range(103)], 5).withColumn("k", F.col("v"))
    n = S.numbered(df, "v")
    assert n.where("pos != v").count() == 0
    got = S.line_envelope(n, F.col("pos"), F.when(F.col("v") == 5, NAN).otherwise(F.col("v")), 103, 10).orderBy("bucket").collect()
    for r in got:
        inside = [i for i in range(r["bucket"] * 103 // 10, (r["bucket"] + 1) * 103 // 10) if i != 5]
        assert (r["low"], r["high"]) == (min(inside), max(inside))


def test_frames(spark):
    df = spark.createDataFrame([(f,) for f in (0, 4, 7, 13)], "f long")
    got = df.select(S.frame_indices(F.col("f"), F.expr("array(2L, 7L)")).alias("i")).collect()
    assert [r["i"] for r in got] == [[0, 0], [0, 4], [1, 0], [1, 6]]


def test_insights_fire_and_stay_quiet(spark):
    told = lambda xs: {r["rule"] for r in I.insights(P.profile(values(spark, xs), ["v"])).collect()}
    rng = np.random.default_rng(2)
    assert "I8" in told(rng.normal(size=500).tolist()) and "I8" not in told((rng.normal(size=500) * 5).tolist())
    assert told([NAN, 1.0, 2.0]) >= {"I3"} and "I20" not in told([NAN, 1.0, 2.0])
    assert told([NAN, INF]) == {"I3", "I4", "I5"}
    assert "I6" in told([4.0] * 5) and "I6" not in told([4.0, 5.0])
    assert "I7" in told([0.0] * 8 + [1.5, 2]) and "I11" in told([0.0, 1.0] * 10)
    assert "I9" in told(rng.random(200).tolist())
    rows = {r["rule"]: r for r in I.insights(P.profile(values(spark, [1.0] * 85 + [2.0] * 10 + [3.0] * 5), ["v"])).collect()}
    assert rows["I12"]["level"] == "warn" and "85.0%" in rows["I12"]["detail"]
    assert {"I13", "I14", "I16"} <= told(rng.lognormal(3, 3, 800).tolist())


def test_insights_of_files(spark):
    p = P.profile(values(spark, [1.0, 2.0, 4.0]), ["v"]).withColumns({"truncated": F.lit(True), "declared_bytes": F.lit(5 << 20), "data_bytes": F.lit(999), "fortran_order": F.lit(True), "kind": F.lit("uint"), "itemsize": F.lit(1), "image_like": F.lit(True), "channel_means": F.array(F.lit(1.0), F.lit(9.0))})
    rows = {r["rule"]: r for r in I.insights(p).collect()}
    assert {"I1", "I10", "I17", "I18"} <= set(rows)
    assert "5.00 MB" in rows["I1"]["detail"] and "999 B" in rows["I1"]["detail"]


def test_layout_details(spark):
    rows = [("a", "float32", "float", 4, True, True, [24, 3, 40, 40]), ("b", "float64", "float", 8, True, True, [1, 9]), ("c", "uint8", "uint", 1, True, True, [3, 50, 4])]
    df = spark.createDataFrame(rows, "name string, dtype string, kind string, itemsize int, numeric boolean, readable boolean, shape array<bigint>").withColumn("fortran_order", F.lit(False))
    got = {r["name"]: r for r in L.detect(df).collect()}
    assert got["a"]["semantic"] == "Batch of 24 images (NCHW)" and got["a"]["alternate"] is None and got["a"]["frames"] == 24 and got["a"]["height"] == 40
    assert got["b"]["available"] == ["image", "heatmap", "line", "table"] and got["b"]["primary"] == "table"
    assert got["c"]["channel_axis"] == 2 and tuple(got["c"]["alternate"]) == (1, 2, 0)
    swapped = {r["name"]: r for r in L.choose(L.detect(df), True).collect()}
    assert swapped["c"]["row_axis"] == 1 and swapped["a"]["row_axis"] == 2
    assert R.array_report(L.detect(df)).where("name = 'b' and key = 'Shape'").first()["value"] == "(1, 9)"


@pytest.mark.parametrize(("n", "want"), [(999, "999 B"), (1024, "1.00 KB"), (5 << 20, "5.00 MB"), (11 << 30, "11.0 GB")])
def test_sizes(spark, n, want):
    assert spark.range(1).select(X.size(F.lit(n).cast("long"))).first()[0] == want


def test_texts(spark):
    row = spark.range(1).select(X.percent(F.lit(1), F.lit(10**6)), X.percent(F.lit(50), F.lit(100)), X.percent(F.lit(1), F.lit(0)), X.duration(F.lit(250)), X.duration(F.lit(1500)), X.short_number(F.lit(1234567.5)), X.tick(F.lit(0.00002)), X.tick(F.lit(2500000.0)), X.complex_text(F.lit(1.5), F.lit(-2.5))).first()
    assert list(row) == ["<0.01%", "50.00%", "0%", "250 ms", "1.50 s", "1,234,570", "2.0e-5", "2.5e6", "1.5-2.5j"]


def test_normalise(spark):
    n = lambda v, lo, hi, s="linear": spark.range(1).select(C.normalise(F.lit(float(v)), F.lit(float(lo)), F.lit(float(hi)), s)).first()[0]
    assert (n(0, 0, 10), n(5, 0, 10), n(10, 0, 10), n(7, 7, 7), n(7, 7, 7, "log")) == (0, 0.5, 1, 0.5, 0.5)
    assert n(math.sqrt(1000), 1, 1000, "log") == pytest.approx(0.5) and n(0, 0, 2400, "log") == 0 and n(2400, 0, 2400, "log") == 1
    assert n(0, -100, 100, "symlog") == 0.5 and n(100, -100, 100, "symlog") > 0.9 and n(-100, -100, 100, "symlog") < 0.1


def test_colours(spark):
    a, b = C.ramp(spark, "nosuch").collect(), C.ramp(spark, "viridis").collect()
    assert a == b and tuple(a[0])[1:] == (0x44, 1, 0x54) and tuple(a[255])[1:] == (0xFD, 0xE7, 0x25)
    px = spark.createDataFrame([(0, 0, 0, 0, 0.0), (0, 0, 0, 1, 1.0), (0, 0, 0, 2, 0.0), (0, 0, 0, 3, 0.5), (0, 0, 1, 0, NAN), (0, 0, 1, 1, 1.0), (0, 0, 1, 2, 1.0), (0, 0, 1, 3, 1.0)], "frame long, row long, col long, channel long, value double")
    got = C.render_rgb(px, True).orderBy("col").collect()
    assert tuple(got[0])[3:] == (0, 255, 0, 128) and got[1]["a"] == 0
    png = C.png_planes(C.render_rgb(px, True)).first()
    assert (png["width"], png["height"]) == (2, 1) and bytes(png["png"]).startswith(b"\x89PNG")
    assert C.gradient_css("gray") == "linear-gradient(to right, #000000 0%, #ffffff 100%)"
    lit = C.colour(values(spark, [NAN, 0.0, -5.0, 5.0]), F.col("v"), F.lit(0.0), F.lit(1.0), "gray")
    assert {(r["a"], r["r"]) for r in lit.collect()} == {(0, 0), (255, 0), (255, 255)}


def test_descriptors():
    assert D.parse_descr("<U11").itemsize == 44 and D.parse_descr(">f8").little_endian is False
    rec = D.parse_descr([("id", "<i4"), ("score", "<f8"), ("colour", "|u1", (3,)), ("label", "|S12")])
    assert rec.itemsize == 27 and [f.offset for f in rec.fields] == [0, 4, 12, 15] and rec.name == "record[4 fields]"
    for bad in ("<i3", "q8", "", [("a", [("b", "<i4")])]):
        with pytest.raises(ValueError):
            D.parse_descr(bad)


def test_half_bits_equal_numpy(spark):
    bits = list(range(0, 65536, 37))
    got = spark.createDataFrame([(b,) for b in bits], "b int").select("b", D.half_value(F.col("b")).alias("v")).collect()
    with np.errstate(all="ignore"):
        for r in got:
            want = float(np.array(r["b"], np.uint16).view(np.float16))
            assert r["v"] == want or (math.isnan(r["v"]) and math.isnan(want))


def test_report(spark):
    rows = {r["key"]: r["value"] for r in R.stats_report(P.profile(values(spark, [1.0, 2, 3, NAN]), ["v"])).collect()}
    assert rows["Mean"] == "2" and rows["NaN"] == "1 (25.00%)" and rows["50%"] == "2"


def test_shared_tables_are_cleared(spark):
    import os

    from lattica.store import clear, cut

    df = cut(spark.range(5))
    path = df.inputFiles()[0].removeprefix("file://")
    assert df.count() == 5 and os.path.exists(path)
    assert clear(spark) >= 1 and not os.path.exists(path) and clear(spark) == 0


def test_cells_of_whole_texts(spark, tmp_path):
    from lattica import queries as Q

    late = "x" * 70 + ',<b> & "q"\n' + "y" * 300
    spark.createDataFrame([(1, late), (2, "z" * 90), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    csv = {r["doc_id"]: r["cell"] for r in Q.QUERIES["csv_cells"](spark, str(tmp_path)).collect()}
    assert csv == {1: '"' + late.replace('"', '""') + '"', 2: "z" * 90, 3: None}
    cut = {r["doc_id"]: (r["cell"], r["html"]) for r in Q.QUERIES["cut_cells"](spark, str(tmp_path)).collect()}
    assert cut == {1: (late[:197] + "...", late.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")), 2: ("z" * 90, "z" * 90), 3: (None, None)}


def test_planes_whole(spark, tmp_path):
    import zlib

    from lattica import queries as Q

    spark.createDataFrame([(i, [float(i), -float(i)]) for i in range(50)], "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = Q.QUERIES["normalised"](spark, str(tmp_path)).collect()
    assert {(r["row"], r["col"]): r["linear"] for r in got} == {(i, k): round((i * (1 - 2 * k) + 49) / 98, 9) for i in range(50) for k in range(2)}
    assert Q.QUERIES["rendered_plane"](spark, str(tmp_path)).count() == 100
    e, _ = Q._matrix(spark, str(tmp_path))
    cells = e.selectExpr("0L as frame", "pos div 64 as row", "pos % 64 as col", "int(pmod(value, 256)) as r", "7 as g", "int(col) as b", "255 as a")
    drawn = C.png_planes(cells).first()
    data = bytes(drawn["png"])
    at = data.index(b"IDAT")
    lines = zlib.decompress(data[at + 4 : at + 4 + int.from_bytes(data[at - 4 : at], "big")])
    assert data.endswith(b"IEND\xaeB`\x82") and len(lines) == drawn["height"] * (1 + 4 * drawn["width"])
    assert sorted(map(tuple, C.png_pixels(C.png_planes(cells)).collect())) == sorted(map(tuple, cells.collect()))


@pytest.mark.parametrize("k", [0, 1, 7, 999, 5000])
def test_bottom_k_has_exactly_k_rows(spark, k):
    from lattica.operators.sampling import bottom_k

    df = spark.range(1000).select((F.col("id") % 200).alias("key"), F.when(F.col("id") % 3 > 0, F.col("id") % 2).alias("x"))
    pick = lambda d: sorted(map(repr, map(tuple, bottom_k(d, k, ["key"], seed=4).collect())))
    rows = pick(df)
    assert len(rows) == min(k, 1000) and rows == pick(df.repartition(7)) and not set(map(tuple, bottom_k(df, k).collect())) - set(map(tuple, df.collect()))
