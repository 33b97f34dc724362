"""Profiles by group against the profile of each group."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lattica.operators import grouped as G
from lattica.operators.profile import profile
from lattica.store import cut


def near(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12) or (a != a and b != b)
    if isinstance(a, (list, tuple)) and isinstance(b, (list, tuple)):
        return len(a) == len(b) and all(map(near, a, b))
    return a == b


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(5)
    rows = []
    for g in [*range(12), None]:
        for _ in range(1 + 70 * ((g or 0) % 5)):
            rows.append((g, "a" if rng.random() < 0.5 else None, rng.gauss(0, 3), rng.choice([1, 2, 3]), g != 3))
    rows += [(20, "a", 10.0 ** rng.uniform(-300, 300) * rng.choice([-1, 1]), 5, True) for _ in range(600)]
    rows += [(21, "a", math.nan, None, None), (21, "a", math.inf, None, None), (22, "a", 7.0, 7, True), (23, "a", -0.0, 0, True), (23, "a", 0.0, 0, False), (24, "a", 1e308, 1, True), (24, "a", -1e308, 2, True), (24, "a", 5e-324, 2, True)]
    return spark.createDataFrame(rows, "g int, k string, x double, n int, b boolean").repartition(4).cache()


@pytest.mark.parametrize(("list_limit", "broadcast"), [(20_000, 200_000), (5, 3)])
def test_equals_the_profile_of_each_group(spark, table, list_limit, broadcast):
    got = {(r["g"], r["column"]): r for r in G.profile_by(table, ["g"], ["x", "n", "b"], list_limit=list_limit, broadcast=broadcast).collect()}
    groups = [r["g"] for r in table.select("g").distinct().collect()]
    assert len(got) == 3 * len(groups)
    for g in [0, 4, 20, 21, 23, 24, None] if list_limit == 5 else [20]:
        for want in profile(table.where(F.col("g").eqNullSafe(F.lit(g))), ["x", "n", "b"]).collect():
            mine = got[g, want["column"]]
            for f in want.asDict():
                assert near(mine[f], want[f]), (g, want["column"], f, mine[f], want[f])


def test_several_keys_and_no_columns(spark, table):
    got = G.profile_by(table, ["k", "g"], ["x"]).select("k", "g", "total").collect()
    want = table.groupBy("k", "g").agg(F.count("x").alias("total")).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(tuple, want)))
    with pytest.raises(ValueError):
        G.profile_by(table.select("k"), ["k"])
    assert G.profile_by(table.limit(0), ["g"], ["x"]).count() == 0


def test_the_image_keeps_the_order_of_doubles(spark):
    rng = random.Random(2)
    values = sorted({0.0, 5e-324, -5e-324, 1e-323, 1.7976931348623157e308, *(s * 2.0**e * m for e in range(-1074, 1023, 7) for m in (1.0, 1.0 - 2**-53, 1.0 + 2**-52, 1.5) for s in (1, -1)), *(rng.gauss(0, 1) for _ in range(200))})
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").coalesce(1).select(G.image(F.col("x"))).collect()]
    assert got == sorted(got)


def test_scans_do_not_depend_on_groups_or_range(spark, monkeypatch):
    def tables(df) -> int:
        made = []
        monkeypatch.setattr(G, "cut", lambda t: made.append(1) or cut(t))
        G.profile_by(df, ["g"], ["x"], list_limit=50).collect()
        return len(made)

    wide = spark.range(4000).select((F.col("id") % 4).alias("g"), F.pow(F.lit(10.0), F.col("id") / 7 - 300).alias("x"))
    many = spark.range(4000).select((F.col("id") % 40).alias("g"), F.sin("id").alias("x"))
    # four tables, and one for each of at most five refinements of values and of deviations
    assert tables(wide) <= 14 and tables(many) <= 10


def test_repeated_values_are_counted_once_and_not_scanned_again(spark, monkeypatch):
    made = []
    monkeypatch.setattr(G, "cut", lambda t: made.append(1) or cut(t))
    df = spark.range(6000).select((F.col("id") % 2).alias("g"), (F.col("id") * 7 % 60 / 4 - 3).alias("x"))
    got = {r["g"]: r for r in G.profile_by(df, ["g"], ["x"], list_limit=100).collect()}
    # counted values, moments and ranks: no interval is refined, as a group has 30 values in 3000 rows
    assert len(made) == 3
    want = profile(df.where("g = 1"), ["x"]).first()
    assert all(near(got[1][f], want[f]) for f in want.asDict())


@pytest.mark.parametrize(("list_limit", "broadcast"), [(20_000, 200_000), (4, 1)])
def test_middles_of_merged_counts_are_those_of_all_rows(spark, list_limit, broadcast):
    rows = [(i % 3, [-0.0, 0.0, 1.5, 1e-300, -7.0, 2.0**60, math.nan, None][i * i % 8] if i % 5 else i / 9) for i in range(400)]
    df = spark.createDataFrame(rows, "g int, x double")
    every = G.counted_by(df, ["g"], ["x"]).groupBy(F.struct(F.lit("all")).alias("g"), "c", "x").agg(F.sum("n").alias("n"))
    got, want = G.middle_by(every, list_limit, broadcast).first(), profile(df, ["x"]).first()
    assert near((got["median"], got["mad"]), (want["median"], want["mad"]))
