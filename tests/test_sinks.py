"""Files put together from pieces: pictures of many strips, CSV files, writes that fail."""

import glob
import os
import zlib

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lattica.functions import color as C
from lattica.sources import files, pictures, sinks

NAMES = ["frame", "row", "col", "r", "g", "b", "a"]


def plane(spark, frame, height, width):
    at = F.col("id")
    byte = lambda k: (F.abs(F.xxhash64(at, F.lit(k))) % 256).cast("int")
    rows = spark.range(height * width).select(F.lit(frame).cast("long").alias("frame"), F.floor(at / width).cast("long").alias("row"), (at % width).alias("col"), *[byte(k).alias(c) for k, c in enumerate("rgba")])
    return rows


def rows_of(df):
    return sorted(df.select(*NAMES).collect(), key=str)


@pytest.mark.parametrize("strip", [1, 700, 1 << 18])
def test_pictures_come_back(spark, tmp_path, strip):
    both = plane(spark, 0, 23, 310).union(plane(spark, 7, 41, 5)).union(plane(spark, None, 2, 3))
    pictures.write_png(both, f"{tmp_path}/out", strip_pixels=strip)
    assert sorted(os.listdir(tmp_path / "out")) == ["frame-0.png", "frame-7.png", "frame-null.png"]
    assert rows_of(pictures.read_png(spark, f"{tmp_path}/out")) == rows_of(both)
    # a plain reader of the whole file checks lengths and the joined checksum
    w, h, raw = C.unpng((tmp_path / "out" / "frame-7.png").read_bytes())
    want = sorted((r["row"], r["col"], r["r"], r["g"], r["b"], r["a"]) for r in both.where("frame = 7").collect())
    assert (w, h) == (5, 41) and raw == bytes(x for r in want for x in r[2:])


def test_missing_pixels_and_empty_input(spark, tmp_path):
    lone = spark.createDataFrame([(3, 40, 2, 9, 8, 7, 255)], "frame long, row long, col long, r int, g int, b int, a int")
    pictures.write_png(lone, f"{tmp_path}/lone", strip_pixels=6)
    w, h, raw = C.unpng((tmp_path / "lone" / "frame-3.png").read_bytes())
    assert (w, h) == (3, 41) and raw[-4:] == bytes([9, 8, 7, 255]) and not any(raw[:-4])
    pictures.write_png(lone.where("false"), f"{tmp_path}/none")
    assert glob.glob(f"{tmp_path}/none/*") == []


@pytest.mark.parametrize("cuts", [[0], [5], [0, 1, 70000, 3], [65521, 65522]])
def test_checksums_join(spark, cuts):
    rng = np.random.default_rng(3)
    parts = [rng.integers(0, 256, n, dtype=np.uint8).tobytes() for n in cuts]
    df = spark.createDataFrame([([(zlib.adler32(p), len(p)) for p in parts],)], "s array<struct<adler:long,size:long>>")
    assert df.select(pictures.joined_adler(F.col("s")).alias("x")).first()["x"] == zlib.adler32(b"".join(parts))


def test_many_strips_of_one_picture(spark, tmp_path):
    """A picture of two million pixels is drawn by many small groups."""
    big = plane(spark, 1, 1000, 2000)
    pieces = pictures.png_pieces(big, 1 << 14)
    sizes = pieces.where("part between 0 and 1000").select(F.octet_length("data").alias("n")).collect()
    assert len(sizes) == 125 and max(r["n"] for r in sizes) < (1 << 17)
    pictures.write_png(big, str(tmp_path), strip_pixels=1 << 14)
    got = pictures.read_png(spark, str(tmp_path)).agg(F.count("*"), F.sum(F.xxhash64(*NAMES).cast("decimal(38)")))
    assert got.first() == big.agg(F.count("*"), F.sum(F.xxhash64(*NAMES).cast("decimal(38)"))).first()


def test_a_failed_write_leaves_the_folder_as_it_was(spark, tmp_path):
    old = spark.createDataFrame([("a.bin", 0, b"old")], "file string, part long, data binary")
    files.write_pieces(old, str(tmp_path))
    bad = spark.range(200).selectExpr("concat(id % 9, '.bin') as file", "id as part", "cast(if(id = 150, raise_error('no'), 'x') as binary) as data")
    with pytest.raises(PySparkException):
        files.write_pieces(bad, str(tmp_path), "overwrite")
    for name in ("../up.bin", "", None):
        with pytest.raises(PySparkException):
            files.write_pieces(spark.createDataFrame([(name, 0, b"x")], "file string, part long, data binary"), str(tmp_path))
    assert [os.path.relpath(os.path.join(d, f), tmp_path) for d, _, fs in os.walk(tmp_path) for f in fs] == ["a.bin"]
    assert (tmp_path / "a.bin").read_bytes() == b"old" and os.listdir(tmp_path.parent).count("up.bin") == 0


def test_pieces_in_order_replace_and_overwrite(spark, tmp_path):
    df = spark.range(3000).selectExpr("concat('d/', id % 4, '.bin') as file", "-id as part", "cast(concat(id, ',') as binary) as data")
    files.write_pieces(df.repartition(6), str(tmp_path))
    for k in range(4):
        assert (tmp_path / "d" / f"{k}.bin").read_text() == "".join(f"{i}," for i in range(2999, -1, -1) if i % 4 == k)
    files.write_pieces(df.where("part > -4").withColumn("data", F.lit(None).cast("binary")), str(tmp_path))
    assert [(tmp_path / "d" / f"{k}.bin").stat().st_size > 0 for k in range(4)] == [False] * 4
    files.write_pieces(df.where("part = 0"), str(tmp_path), "overwrite")
    assert os.listdir(tmp_path / "d") == ["0.bin"] and (tmp_path / "d" / "0.bin").read_text() == "0,"


def test_csv_files(spark, tmp_path):
    rows = [(3, "x", 'a "b"'), (1, "x", "plain, more"), (2, "y", None), (4, None, "two\nlines")]
    df = spark.createDataFrame(rows, "i int, k string, t string")
    sinks.write_csv_files(df, str(tmp_path), ["t"], "i", "k", "p-")
    assert (tmp_path / "p-x.csv").read_text() == 'i,t\n1,"plain, more"\n3,"a ""b"""\n'
    assert (tmp_path / "p-y.csv").read_text() == "i,t\n2,\n" and (tmp_path / "p-null.csv").read_text() == 'i,t\n4,"two\nlines"\n'
