"""Array files, sinks, streams and control."""

import io
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.functions import color as C
from lattica.operators import control
from lattica.operators.profile import profile
from lattica.operators import slices as S
from lattica.plans.analysis import analyse
from lattica.sources import npy, sinks
from lattica.sources.npy import NpyError, parse_header, read_npy, read_npy_binary
from lattica.streaming.profiles import profile_arrivals, running_profile, windowed_profile


def saved(tmp_path, name, a, **kw):
    np.save(f"{tmp_path}/{name}.npy", a, **kw)
    return f"{tmp_path}/{name}.npy"


@pytest.mark.parametrize("dtype", ["<f8", ">f8", "<f4", "<f2", "|b1", "|i1", "<i2", ">i4", "<i8", "|u1", "<u2", "<u4", "<u8"])
@pytest.mark.parametrize("order", ["C", "F"])
def test_elements_equal_numpy(spark, tmp_path, dtype, order):
    a = np.asarray(np.random.default_rng(1).integers(0, 100, (7, 5, 3)).astype(dtype), order=order)
    df = read_npy(spark, saved(tmp_path, "a", a), partition_bytes=64)
    assert df.rdd.getNumPartitions() > 1 or a.nbytes <= 64
    got = [r["value"] for r in df.orderBy("pos").collect()]
    assert got == np.ascontiguousarray(a).ravel().astype(float).tolist()


def test_exact_text(spark, tmp_path):
    def texts(name, a):
        return [r["exact"] for r in read_npy(spark, saved(tmp_path, name, a), exact=True).orderBy("pos").collect()]

    assert texts("big", np.array([9007199254740993])) == ["9007199254740993"]
    assert texts("u", np.array([2**64 - 1], np.uint64)) == ["18446744073709551615"]
    assert texts("c", np.array([1.5 - 2.5j])) == ["1.5-2.5j"]
    assert texts("s", np.array([b"ab", b"\xe9"])) == ["ab", "é"]
    assert texts("w", np.array(["ab", "日本"])) == ["ab", "日本"]
    assert texts("d", np.array(["2020-01-02", "NaT"], "M8[D]")) == ["2020-01-02 00:00:00.000", "NaT"]
    assert texts("t", np.array([5, -7], "m8[ns]")) == ["5 ns", "-7 ns"]
    assert texts("b", np.array([True, False])) == ["True", "False"]
    nat = read_npy(spark, f"{tmp_path}/d.npy").orderBy("pos").collect()
    assert nat[1]["value"] != nat[1]["value"]
    z = read_npy(spark, saved(tmp_path, "z", np.array([3 + 4j]))).first()
    assert z["value"] == 5


def test_records(spark, tmp_path):
    a = np.array([(1, 0.5, (1, 2, 3), b"x"), (2, 1.5, (4, 5, 6), b"yz")], [("id", "<i4"), ("score", "<f8"), ("colour", "u1", (3,)), ("label", "S12")])
    got = read_npy(spark, saved(tmp_path, "r", a), "records").orderBy("pos").drop("path", "pos").collect()
    assert [tuple(r) for r in got] == [(1, 0.5, [1, 2, 3], "x"), (2, 1.5, [4, 5, 6], "yz")]


def test_meta_and_folder(spark, tmp_path):
    saved(tmp_path, "a", np.zeros((2, 3), order="F"))
    saved(tmp_path, "b", np.zeros((0, 8)))
    np.save(f"{tmp_path}/o.npy", np.array([{}, 1], object), allow_pickle=True)
    rows = {r["path"][-5:-4]: r for r in read_npy(spark, str(tmp_path), "meta").collect()}
    assert rows["a"]["fortran_order"] and rows["a"]["shape"] == [2, 3] and rows["a"]["unsupported"] is None
    assert rows["b"]["unsupported"] == "The array is empty." and rows["o"]["readable"] is False
    assert "exact" not in read_npy(spark, f"{tmp_path}/a.npy").columns
    assert read_npy(spark, f"{tmp_path}/a.npy", columns=["value"]).columns == ["value"] and read_npy(spark, f"{tmp_path}/a.npy", columns=["value"]).count() == 6
    open(f"{tmp_path}/x.npy", "wb").write(b"no array")
    bad = read_npy(spark, str(tmp_path), "meta").where("dtype is null").collect()
    assert len(bad) == 1 and bad[0]["path"].endswith("x.npy") and "magic" in bad[0]["unsupported"] and bad[0]["file_bytes"] == 8
    for name in ("o", "x"):
        with pytest.raises(Exception, match=f"{name}.npy"):
            read_npy(spark, f"{tmp_path}/{name}.npy").count()
    assert read_npy(spark, str(tmp_path), problems="skip").count() == 6


@pytest.mark.parametrize("dtype", ["<f8", ">i4", "|u1", "<c8"])
@pytest.mark.parametrize("order", ["C", "F"])
@pytest.mark.parametrize("window", ["", "2:5", "::3, 1:4", "4, :, ::2", "-1", ":, 2, 1:2", "1:9:4, ::2, -2:", "5:2", "::2, ::2, ::2"])
def test_windows_equal_numpy(spark, tmp_path, dtype, order, window):
    a = np.asarray(np.random.default_rng(1).integers(0, 100, (9, 6, 5)).astype(dtype), order=order)
    path = saved(tmp_path, "a", a)
    keep = tuple(slice(int(p), int(p) + 1 or None) if p and ":" not in p else slice(*[int(x) if x else None for x in p.split(":")]) if p else slice(None) for p in (w.strip() for w in window.split(",")))
    want = np.arange(a.size).reshape(a.shape)[keep].ravel()
    with open(path, "rb") as f:
        h = parse_header(f.read(500), 10**6)
    selection = npy.Selection(h, npy.parse_window(window, h.shape))
    places = selection.places(0, selection.size)
    assert np.all(np.diff(places) > 0) and sorted(npy.logical_positions(places, h).tolist()) == want.tolist()
    if window in ("::3, 1:4", "4, :, ::2"):
        df = read_npy(spark, path, window=window, partition_bytes=64).orderBy("pos")
        assert [(r["pos"], r["value"]) for r in df.collect()] == [(i, float(abs(a.ravel()[i]))) for i in want.tolist()]


def test_window_reads_bytes_in_proportion(tmp_path):
    """A 100 x 40 page and a decimated block of a 64 MB file."""
    path = saved(tmp_path, "big", np.zeros((4096, 4096), np.float32))
    h, read = npy.read_header(path), []

    class Counted:
        def __init__(self, f):
            self.f = f

        def seek(self, at):
            self.f.seek(at)

        def read(self, n):
            read.append(n)
            return self.f.read(n)

    for window, most in (("1000:1100, 2000:2040", 100 * 40 * 4), ("::64, ::64", 64 * 4096 * 4 + 64), ("7", 4096 * 4), (":, 5", 4096 * 4)):
        read.clear()
        selection = npy.Selection(h, npy.parse_window(window, h.shape))
        with open(path, "rb") as f:
            assert not npy._gather(Counted(f), h, selection.places(0, selection.size)).any()
        assert sum(read) <= most


def test_blocks_and_pages_of_files(spark, tmp_path):
    a = np.random.default_rng(2).normal(size=(6, 50, 40))
    for order in "CF":
        path = saved(tmp_path, order, np.asarray(a, order=order))
        plane = S.Plane(a.shape, 1, 2)
        got = {(r["frame"], r["row"], r["col"]): r["value"] for r in npy.read_file_block(spark, path, plane, [1, 2], max_side=10).collect()}
        assert got == {(f, i, j): a[f, i * 5, j * 4] for f in (1, 2) for i in range(10) for j in range(10)}
        page = npy.read_file_window(spark, path, plane, frame=3, row0=45, col0=38).collect()
        assert {(r["row"], r["col"]): r["value"] for r in page} == {(i, j): a[3, i, j] for i in range(45, 50) for j in (38, 39)}
    v = saved(tmp_path, "v", np.arange(30.0))
    assert sorted(r["value"] for r in npy.read_file_window(spark, v, S.vector_plane(30), col0=28).collect()) == [28, 29]
    block = S.read_block(npy.read_npy(spark, v), S.vector_plane(30))
    assert [r["value"] for r in S.decode_block(S.encode_block(block)).orderBy("i").collect()] == list(range(30))
    assert [r["value"] for r in S.decode_block(S.encode_block(block, True), True).orderBy("i").collect()] == list(range(30))


def test_truncated_file(spark, tmp_path):
    path = saved(tmp_path, "t", np.arange(10.0))
    data = open(path, "rb").read()
    open(path, "wb").write(data[:-24])
    assert read_npy(spark, path).count() == 7
    assert read_npy(spark, path, "meta").first()["truncated"]
    past = read_npy(spark, path, window="5:9", exact=True).orderBy("pos").collect()
    assert [r["exact"] for r in past] == ["5", "6", "--", "--"] and all(np.isnan(r["value"]) for r in past[2:])
    assert sum(np.isnan(r["value"]) for r in npy.read_file_block(spark, path, S.vector_plane(10)).collect()) == 3


def test_binary_reader(spark, tmp_path):
    a = np.asfortranarray(np.arange(12.0).reshape(3, 4))
    saved(tmp_path, "a", a)
    open(f"{tmp_path}/junk.npy", "wb").write(b"no array")
    got = read_npy_binary(spark, str(tmp_path), problems="skip").orderBy("pos").collect()
    assert [r["value"] for r in got] == list(range(12))
    with pytest.raises(Exception, match="junk"):
        read_npy_binary(spark, str(tmp_path)).collect()


def header(descr="'<f8'", shape="(3,)", major=1, extra="", fortran="False"):
    d = f"{{'descr': {descr}, 'fortran_order': {fortran}, 'shape': {shape}, {extra}}}\n".encode()
    return b"\x93NUMPY" + bytes([major, 0]) + struct.pack("<H" if major == 1 else "<I", len(d)) + d


def test_headers():
    for major in (1, 2, 3):
        assert parse_header(header(major=major), 1000).shape == (3,)
    assert parse_header(header(shape="()"), 100).size == 1
    b = io.BytesIO()
    np.lib.format.write_array(b, np.zeros(4, ">i2"), version=(2, 0))
    assert parse_header(b.getvalue(), len(b.getvalue())).dtype.name == "int16"
    for bad in (b"", b"nonsense", header(major=9), header()[:20], header(shape="__import__('os')"), header(descr="'<i3'"), header(shape="(-1,)")):
        with pytest.raises(NpyError):
            parse_header(bad, 100)


def test_profile_of_a_file(spark, tmp_path):
    a = np.random.default_rng(4).normal(size=(50, 40))
    p = profile(read_npy(spark, saved(tmp_path, "p", np.asfortranarray(a))), ["value"]).first()
    assert p["median"] == pytest.approx(np.median(a)) and p["l2"] == pytest.approx(np.linalg.norm(a))


def test_analysis_of_files(spark, tmp_path):
    rng = np.random.default_rng(7)
    image = saved(tmp_path, "image", rng.integers(0, 256, (40, 30, 3)).astype("u1"))
    a = analyse(spark, image, histogram_bins=32, image_max_side=10, auto_normalize=False)
    assert a.layout.first()["semantic"] == "RGB image" and a.axes.count() == 3 and len(a.stats.first()["histogram"]["counts"]) == 32
    assert {"I10", "I20"} <= {r["rule"] for r in a.insights.collect()}
    assert a.block().agg(F.max("row"), F.max("col")).first()[:] == (9, 9)
    assert a.window(row0=39).where("col = 0").first()["text"].count(",") == 2
    assert C.unpng(bytes(a.picture().first()["png"]))[:2] == (10, 10)
    matrix = analyse(spark, saved(tmp_path, "m", rng.normal(size=(70, 5))))
    assert matrix.axes.orderBy("index").first()["label"] == "Column 0" and not matrix.stats.first()["approximate"]
    assert analyse(spark, saved(tmp_path, "big", rng.normal(size=5000)), exact_limit=1000).stats.first()["approximate"]
    for name, array, why in (("empty", np.zeros((0, 3)), "empty"), ("text", np.array(["a", "b"]), "do not apply")):
        told = analyse(spark, saved(tmp_path, name, array))
        assert [r["rule"] for r in told.insights.collect()] == ["I2"] and why in told.insights.first()["detail"] and told.stats.first()["total"] is None
    open(f"{tmp_path}/junk.npy", "wb").write(b"junk")
    assert "magic" in analyse(spark, f"{tmp_path}/junk.npy").insights.first()["detail"]
    with pytest.raises(ValueError):
        analyse(spark, image, nonsense=1)


def test_results_are_capped(spark):
    df = spark.createDataFrame([("é" * 5,)], "t string")
    assert df.select(control.capped(F.col("t"), 10).alias("t")).first()["t"] == "é" * 5
    with pytest.raises(Exception, match="more than 9 bytes"):
        df.select(control.capped(F.col("t"), 9)).collect()


def test_csv_and_json(spark, tmp_path):
    df = spark.createDataFrame([(0, 'a"b', "x,y"), (1, "plain", None)], "i int, a string, b string")
    assert sinks.csv_text(df, ["a", "b"], "i").first()["text"] == ',a,b\n0,"a""b","x,y"\n1,plain,'
    sinks.write_csv(df, f"{tmp_path}/out", ["a", "b"], "i")
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/out").collect()] == ['0,"a""b","x,y"', "1,plain,"]
    j = sinks.json_result(spark.createDataFrame([(float("nan"), 1.5)], "a double, b double")).first()["json"]
    assert j == '{"a":null,"b":1.5}'


def test_streams(spark, tmp_path):
    schema = "k string, t timestamp, v double"
    rows = [("a", "2024-01-01 00:10:00", 1.0), ("a", "2024-01-01 00:20:00", float("nan")), ("b", "2024-01-01 02:00:00", 5.0)]
    spark.createDataFrame(rows, "k string, t string, v double").withColumn("t", F.to_timestamp("t")).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/in")

    def run(df, mode):
        q = df.writeStream.format("memory").queryName("out").outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table("out").collect()

    got = {r["k"]: r for r in run(running_profile(stream(), "k", "v"), "complete")}
    assert got["a"]["nan"] == 1 and got["a"]["mean"] == 1 and got["b"]["max"] == 5
    assert {r["total"] for r in run(windowed_profile(stream(), "t", "v"), "update")} == {2, 1}
    profile_arrivals(stream().select("v"), f"{tmp_path}/sink", f"{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/sink").first()["total"] == 3


def test_control(spark):
    seen = []
    assert control.watch(spark, lambda: spark.range(1000, numPartitions=8).selectExpr("sum(id)").first()[0], seen.append) == 499500
    assert seen == sorted(seen) and seen[-1] == 1.0 and all(0 <= x <= 1 for x in seen)
    slow = F.udf(lambda x: __import__("time").sleep(30) or x, "long")
    with pytest.raises(control.Cancelled):
        control.with_timeout(spark, lambda: spark.range(4).select(slow("id")).collect(), 1.0)
    assert control.options(histogram_bins=1000)["histogram_bins"] == 256
    with pytest.raises(ValueError):
        control.options(nosuch=1)
    assert {r["key"] for r in control.engine_info(spark).collect()} >= {"spark", "python"}


def test_a_folder_is_analysed_file_by_file(spark, tmp_path):
    from lattica.plans.analysis import analyse_all

    rng = np.random.default_rng(4)
    image = rng.integers(0, 256, (20, 30, 3)).astype("u1")
    arrays = {"small": np.arange(100.0).reshape(10, 10), "large": np.asfortranarray(np.arange(600.0).reshape(20, 30) + 1000), "image": image, "flat": np.full(7, 2.5), "text": np.array(["a", "b"]), "none": np.zeros((0, 3))}
    for name, array in arrays.items():
        saved(tmp_path, name, array)
    (tmp_path / "junk.npy").write_bytes(b"no array at all")
    with pytest.raises(ValueError, match="several files"):
        analyse(spark, str(tmp_path))
    found = analyse_all(spark, str(tmp_path), histogram_bins=16)
    stem = lambda r: r["path"].rsplit("/", 1)[1][:-4]
    assert {stem(r) for r in found.meta.collect()} == {*arrays, "junk"}
    stats = {stem(r): r for r in found.stats.collect()}
    assert set(stats) == {"small", "large", "image", "flat"}
    told, axes, layouts = {}, {}, {}
    for r in found.insights.orderBy("position").collect():
        told.setdefault(stem(r), []).append((r["rule"], r["title"], r["detail"]))
    for r in found.axes.collect():
        axes.setdefault(stem(r), {})[r["index"]] = r
    for r in found.layout.collect():
        layouts[stem(r)] = (r["primary"], r["semantic"])
    for name in ("small", "large", "image", "flat"):
        one = analyse(spark, f"{tmp_path}/{name}.npy", histogram_bins=16)
        want = one.stats.first()
        for f in want.asDict():
            assert f == "column" or stats[name][f] == want[f] or abs(stats[name][f] - want[f]) <= 1e-9 * abs(want[f]), (name, f)
        assert told[name] == [(r["rule"], r["title"], r["detail"]) for r in one.insights.orderBy("position").collect()]
        assert layouts[name] == tuple(one.layout.select("primary", "semantic").first())
        assert (one.axes is None) == (name not in axes)
        for r in one.axes.collect() if one.axes else []:
            assert axes[name][r["index"]]["mean"] == pytest.approx(r["mean"]) and axes[name][r["index"]]["count"] == r["count"]
    assert all(told[name][0][0] == "I2" for name in ("text", "none", "junk"))
