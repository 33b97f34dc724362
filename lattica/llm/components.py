"""Connected components of links that stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import cut, dealt_join, frequent, made, release


def _least(edges: DataFrame) -> DataFrame:
    """Each end's smallest neighbour, itself included; combined before the shuffle."""
    return edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def _state(edges: DataFrame) -> tuple:
    """How many edges there are and a sum of their hashes."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 64) -> DataFrame:
    """(node, component) for every end of a link; the component is its smallest node.

    Alternates large-star and small-star steps (Kiveris et al., 2014), each
    a minimum by node and a join, until no link changes; a path of n nodes
    takes about log n rounds.  Nodes with very many links meet their minimum
    by broadcast.
    """
    begun = made()
    e = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct())
    state = _state(e)
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hubs = frequent(both.groupBy("u").agg(F.count(F.lit(1)).alias("links")), ["u"], 2 * state[0], "links")
        large = dealt_join(both, _least(both), ["u"], hubs).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = _least(large)
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        e = cut(small)
        release(links.sparkSession, begun, e)
        now = _state(e)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component")))
