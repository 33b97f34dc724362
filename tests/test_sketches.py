"""Sketches within their bounds, and scans of columns that span magnitudes."""

import bisect
import random

from pyspark.sql import functions as F

from lattica.operators import sketches as K
from lattica.operators.profile import PERCENTILES, percentile_name, percentiles
from lattica.operators.selection import order_statistics
from lattica.streaming.profiles import running_profile


def off(values: list, estimate: float, p: float) -> float:
    """How far an estimate's ranks are from the wanted one, as a share."""
    lo, hi = bisect.bisect_left(values, estimate) / len(values), bisect.bisect_right(values, estimate) / len(values)
    return max(lo - p, p - hi, 0.0)


def test_sketches_stay_within_their_bounds_in_any_order(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", None]), rng.randrange(9), rng.lognormvariate(0, 3) if rng.random() < 0.7 else float(rng.randrange(50))) for _ in range(30_000)] + [("none", 1, float("nan"))]
    df = spark.createDataFrame(rows, "k string, part int, x double").repartition(5)
    states = K.sketch_states(df, ["k", "part"], ["x"])
    for merged in (K.merge_sketches(states, ["k"]), K.merge_sketches(K.merge_sketches(states.orderBy(F.desc("part")), ["part", "k"]), ["k"]), K.sketch_states(df, ["k"], ["x"])):
        for r in K.finish_sketches(merged).collect():
            own = sorted(x for k, _, x in rows if k == r["k"] and x == x)
            assert r["finite"] == len(own)
            if not own:
                assert r["p50"] is None and r["distinct"] == 0
                continue
            for p in PERCENTILES:
                assert off(own, r[percentile_name(p)], p / 100) <= r["rank_error"]
            assert abs(r["distinct"] - len(set(own))) <= r["distinct_error"] * len(set(own))


def test_heavy_values_are_exact_above_the_bound(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 5 == 0, F.col("id") % 7).otherwise(F.col("id")).cast("double").alias("x"))
    got = [tuple(r) for r in K.heavy_values(df, F.col("x"), tracked=1000).collect()]
    counts = df.groupBy("x").count().where("count > 80").orderBy(F.desc("count"), "x").limit(12).collect()
    assert got == [tuple(r) for r in counts] and len(got) == 7
    assert K.heavy_values(df.where("x < 0"), F.col("x")).count() == 0


def test_columns_of_any_range_need_few_scans(spark, monkeypatch):
    """Over 600 decades of both signs, at subnormal steps, and at values that differ in their last digits."""
    from lattica.operators import selection

    monkeypatch.setattr(selection, "LIST", 30)
    rng = random.Random(7)
    columns = {
        "decades": [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300) for _ in range(4000)],
        "tiny": [5e-324 * rng.randrange(1 << 20) for _ in range(4000)],
        "last": [1.0 + 2.0**-52 * rng.randrange(1 << 30) for _ in range(4000)],
        "spike": [0.0] * 2000 + [rng.gauss(0, 1) ** 9 for _ in range(2000)],
        "huge": [rng.choice([-1, 1]) * rng.uniform(1e307, 1.7e308) for _ in range(4000)],
    }
    for name, values in columns.items():
        df = spark.createDataFrame([(v,) for v in values], "x double").repartition(3).cache()
        spark.sparkContext.setJobGroup(name, "")
        ranks = [0, 7, 1000, 1999, 2000, 2001, 3500, 3999]
        before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
        calls = []
        real = selection._code
        monkeypatch.setattr(selection, "_code", lambda *a, real=real, calls=calls: calls.append(1) or real(*a))
        found = order_statistics(df, {"x": F.col("x")}, {"x": (min(values), max(values))}, {"x": ranks})["x"]
        monkeypatch.setattr(selection, "_code", real)
        assert found == {r: sorted(values)[r] for r in ranks}, name
        assert len(calls) <= 6 and before == 0, (name, len(calls))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    wide = spark.createDataFrame([(v,) for v in columns["decades"]], "x double")
    assert percentiles(wide, F.col("x")).count() == len(PERCENTILES)


def test_running_profile_has_percentiles(spark, tmp_path):
    rng = random.Random(1)
    values = [rng.gauss(5, 2) for _ in range(3000)]
    for i in range(3):
        spark.createDataFrame([("a", v) for v in values[i::3]], "k string, x double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k string, x double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = running_profile(stream, "k", "x", [5, 50, 95]).writeStream.outputMode("complete").format("memory").queryName("running_sketch").trigger(availableNow=True).start()
    q.awaitTermination()
    row = spark.table("running_sketch").first()
    for p in (5, 50, 95):
        assert off(sorted(values), row[percentile_name(p)], p / 100) <= K.rank_error()
    assert row["total"] == 3000
