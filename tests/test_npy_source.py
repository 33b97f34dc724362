"""Planning without opening files, pushed filters, and streams of array files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.sources import npy
from lattica.sources.npy import NpyReader, read_npy, stream_npy


def values(df) -> dict:
    out: dict = {}
    for r in df.collect():
        out.setdefault(r["path"].rsplit("/", 1)[1], {})[r["pos"]] = r["value"]
    return out


def plain(a) -> dict:
    return dict(enumerate(np.ascontiguousarray(a).ravel().astype(float).tolist()))


@pytest.fixture
def many(tmp_path):
    """More files than are planned from their headers: of both orders, one cut off, one that is no array."""
    rng = np.random.default_rng(3)
    arrays = {f"f{i}.npy": rng.normal(size=(rng.integers(1, 9), 7)) for i in range(npy.FEW_FILES + 20)}
    for i, (name, a) in enumerate(arrays.items()):
        np.save(tmp_path / name, np.asfortranarray(a) if i % 2 else a)
    return tmp_path, arrays


def test_no_file_is_opened_while_planning_many(spark, many, monkeypatch):
    path, arrays = many
    monkeypatch.setattr(npy._Files, "open", lambda p: pytest.fail(f"opened {p}"))
    for mode in ("elements", "meta"):
        parts = NpyReader(None, {"path": str(path), "mode": mode, "partition_bytes": "200"}).partitions()
        named = {p[0].rsplit("/", 1)[1] for part in parts for p in part.pieces}
        assert named == set(arrays) and len(parts) > 1
    small = NpyReader(None, {"path": str(path)}).partitions()
    assert len(small) < len(arrays) / 4


def test_many_files_are_read_whole(spark, many):
    path, arrays = many
    for size in (100, npy.PARTITION_BYTES):
        assert values(read_npy(spark, str(path), partition_bytes=size)) == {k: plain(a) for k, a in arrays.items()}
    assert read_npy(spark, str(path), "meta").agg(F.sum("size")).first()[0] == sum(a.size for a in arrays.values())
    got = values(read_npy(spark, str(path), window="0:2, ::3", partition_bytes=100))
    assert got == {k: {r * 7 + c: a[r, c] for r in range(min(2, len(a))) for c in (0, 3, 6)} for k, a in arrays.items()}


def test_problems_of_many_files(spark, many):
    path, arrays = many
    (path / "junk.npy").write_bytes(b"nothing")
    whole = (path / "f0.npy").read_bytes()
    (path / "f0.npy").write_bytes(whole[:-12])
    with pytest.raises(Exception, match="magic"):
        read_npy(spark, str(path)).count()
    got = values(read_npy(spark, str(path), problems="skip"))
    assert set(got) == set(arrays) and len(got["f0.npy"]) == arrays["f0.npy"].size - 2
    told = {r["path"].rsplit("/", 1)[1]: r for r in read_npy(spark, str(path), "meta").collect()}
    assert "magic" in told["junk.npy"]["unsupported"] and told["junk.npy"]["file_bytes"] == 7 and told["f0.npy"]["truncated"]


@pytest.fixture
def pushing(spark):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield spark
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


FILTERS = ["pos between 10 and 20", "pos = 5", "pos > 30", "pos >= 30 and pos < 33", "pos in (1, 17, 40, 400)", "pos in (2, 3) and pos > 2", "pos < 0", "pos <= 3 or pos > 50", "pos is null", "value > 0 and pos < 9", "path like '%b.npy'", "path like '%/a%' and pos = 4"]


@pytest.mark.parametrize("few", [64, 0])
def test_filters_select_the_same_rows(pushing, tmp_path, monkeypatch, few):
    rng = np.random.default_rng(few)
    arrays = {"a.npy": rng.normal(size=(6, 9)), "b.npy": rng.normal(size=70), "c.npy": rng.normal(size=(5, 4, 3))}
    for name, a in arrays.items():
        np.save(tmp_path / name, np.asfortranarray(a) if name != "c.npy" else a)
    want = pushing.createDataFrame([(f"{tmp_path}/{k}", i, v) for k, a in arrays.items() for i, v in plain(a).items()], "path string, pos long, value double")
    rows = lambda df: sorted(map(tuple, df.select("path", "pos", "value").collect()))
    for f in FILTERS if few else FILTERS[:3]:
        assert rows(read_npy(pushing, str(tmp_path), partition_bytes=80).where(f)) == rows(want.where(f)), f
    windowed = read_npy(pushing, f"{tmp_path}/a.npy", window="1:5, ::2", partition_bytes=80)
    inside = want.where("path like '%a.npy' and pos between 9 and 44 and pos % 9 % 2 = 0")
    for f in FILTERS[:4] if few else []:
        assert rows(windowed.where(f)) == rows(inside.where(f)), f


def test_a_pushed_range_is_read_in_proportion(pushing, tmp_path):
    np.save(tmp_path / "long.npy", np.arange(100_000.0))
    df = read_npy(pushing, f"{tmp_path}/long.npy", partition_bytes=8000).where("pos between 50000 and 50999 and path is not null")
    assert df.rdd.getNumPartitions() <= 2
    assert [r["value"] for r in df.orderBy("pos").collect()] == list(np.arange(50_000.0, 51_000.0))
    plan = df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "50000" in plan.split("PushedFilters")[1].split("]")[0]
    reader = npy.NpyFilteringReader(None, {"path": f"{tmp_path}/long.npy", "partition_bytes": "8000"})
    list(reader.pushFilters([npy.GreaterThanOrEqual(("pos",), 50_000), npy.LessThan(("pos",), 50_010)]))
    assert [(p.start, p.count) for p in reader.partitions()] == [(50_000, 10)]


def test_a_stream_takes_new_and_grown_files_once(spark, tmp_path):
    src, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    src.mkdir()

    def run() -> int:
        q = stream_npy(spark, str(src), problems="skip", partition_bytes=256).writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema("path string, pos long, value double").parquet(out).count()

    a, b, c = np.arange(100.0), np.arange(60.0).reshape(6, 10) * 2, np.arange(30.0) - 5
    np.save(src / "a.npy", a)
    np.save(tmp_path / "b.npy", np.asfortranarray(b))
    np.save(tmp_path / "c.npy", c)
    whole, late = (tmp_path / "b.npy").read_bytes(), (tmp_path / "c.npy").read_bytes()
    (src / "b.npy").write_bytes(whole[: 128 + 8 * 20 + 3])
    (src / "c.npy").write_bytes(late[:50])
    assert run() == 120
    assert run() == 120
    (src / "b.npy").write_bytes(whole[: 128 + 8 * 41])
    (src / "c.npy").write_bytes(late[:60])
    assert run() == 141
    (src / "b.npy").write_bytes(whole)
    (src / "c.npy").write_bytes(late)
    assert run() == 190
    assert values(spark.read.parquet(out)) == {"a.npy": plain(a), "b.npy": plain(b), "c.npy": plain(c)}


@pytest.mark.parametrize("most", [200, 1 << 16, npy.PARTITION_BYTES, 4 * npy.PARTITION_BYTES])
def test_tasks_do_not_grow_with_small_files(most):
    pieces = [(f"f{i}", 0, None, 20_000 + i % 9) for i in range(8000)]
    parts = npy._packed(pieces, most)
    assert [p for part in parts for p in part.pieces] == pieces
    # a task costs as much as some hundred small files
    assert len(parts) <= 8000 / 100
    # large pieces do not share one, however many there are
    large = [(f"f{i}", a, a + most, 1 << 40) for i in range(100) for a in range(0, 40 * most, most)]
    assert all(len(p.pieces) == 1 or sum(b - a for _, a, b, _ in p.pieces) <= max(most, npy.PARTITION_BYTES) for p in npy._packed(large, most))
    # few files still make tasks of their own
    assert len(npy._packed(pieces[:64], 200)) == 64
