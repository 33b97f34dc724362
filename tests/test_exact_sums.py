"""Exact sums against fractions, and the same bits for any partitioning."""

import math
import random
from fractions import Fraction

import pytest

from lattica.operators import exact_sums as E


def nearest(x: Fraction) -> float:
    try:
        return x.numerator / x.denominator
    except OverflowError:
        return math.inf if x > 0 else -math.inf


TINY, HUGE = 5e-324, 1.7976931348623157e308
CASES = {
    "cancel": [1e308, 1.0, -1e308, TINY, -1.0],
    "small": [TINY] * 7 + [2.2250738585072014e-308, -2.225073858507201e-308],
    "powers": [s * 2.0**e for e in range(-1074, 1024, 3) for s in (1, -1)] + [3.0],
    "below powers": [math.nextafter(2.0**e, 0) for e in range(-1000, 1023, 7)] + [math.nextafter(2.0**e, math.inf) for e in range(-1000, 1023, 7)],
    "overflow": [HUGE, HUGE],
    "back from overflow": [HUGE, HUGE, -HUGE],
    "zeros": [0.0, -0.0, 0.0],
    "cents": [0.1] * 1000 + [0.01] * 333,
    "random": [random.Random(5).uniform(-1, 1) * 10.0 ** random.Random(i).randint(-300, 300) for i in range(2000)],
}


@pytest.mark.parametrize("name", CASES)
def test_sums_are_rounded_once(spark, name):
    x = CASES[name]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    r = E.exact_sums(df).first()
    whole = sum(map(Fraction, x))
    assert (r["finite"], r["sum"], r["mean"]) == (len(x), nearest(whole), nearest(whole / len(x)))


def test_any_partitioning_gives_the_same_bits(spark):
    rng = random.Random(11)
    rows = [(rng.choice(["a", "b", None]), rng.gauss(0, 1) * 10 ** rng.randint(-12, 12), rng.choice([None, math.nan, math.inf, 2.5])) for _ in range(4000)]
    seen = set()
    for parts in (1, 3, 8, 17):
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "k string, x double, y double").repartition(parts)
        seen.add(tuple(sorted((str(r["k"]), r["column"], r["finite"], r["sum"].hex(), r["mean"].hex()) for r in E.exact_sums(df, ["k"]).collect())))
    assert len(seen) == 1 and len(next(iter(seen))) == 6
    assert {(k, c): s for k, c, _, s, _ in next(iter(seen))}[("a", "x")] == math.fsum(v for k, v, _ in rows if k == "a").hex()


def test_states_merge(spark):
    df = spark.range(5000).selectExpr("id % 7 as k", "id % 3 as j", "pow(-1.1, id % 900) as x", "cast(id % 2 = 0 as boolean) as b")
    states = E.sum_states(df.where("id % 2 = 0"), ["k", "j"], ["x", "b"]).union(E.sum_states(df.where("id % 2 = 1"), ["k", "j"], ["x", "b"]))
    order = lambda d: sorted(map(str, d.collect()))
    assert order(E.finish_sums(E.merge_sum_states(states, ["k"]), ["k"])) == order(E.exact_sums(df, ["k"], ["x", "b"]))
    assert E.exact_sums(df.where("false"), [], ["x"]).collect() == [] and E.exact_sums(df.selectExpr("cast(null as double) as x")).collect() == []
    with pytest.raises(ValueError, match="no column"):
        E.sum_states(df.select("k"), ["k"])
