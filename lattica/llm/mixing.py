"""Mixing sources to target weights.

Each document gets a hash-random key.  Rows are range-sorted by source and key
into buckets, the sizes of the buckets give distributed prefix sums, and
a source is cut at its exact budget: whole epochs first, then documents by key
up to the remainder, of which the last is taken in part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import cut

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The order of rows within a source.
ORDER = ("key", "id", "size", "place")


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds to each row the sums over all rows before it, without one task for all.

    Rows are range-partitioned and kept in the shared folder; the sums of the
    partitions, one row each, give every partition its start.  ``order`` must
    tell all rows apart.
    """
    dealt = cut(df.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    ranges = dealt.groupBy("range").agg(*[F.sum(c).alias(f"{k}_own") for k, c in sums.items()])
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("range", *[F.coalesce(F.sum(f"{k}_own").over(before), F.lit(0)).alias(f"{k}_start") for k in sums])
    inside = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(F.broadcast(starts), "range")
    return out.select(*df.columns, *[(F.col(f"{k}_start") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(k) for k, c in sums.items()])


def in_buckets(rows: DataFrame) -> DataFrame:
    """Adds the number of the range of (source, :data:`ORDER`) that a row is in."""
    return rows.repartitionByRange(F.col("source").asc_nulls_last(), *ORDER).withColumn("bucket", F.spark_partition_id())


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: float = 3) -> DataFrame:
    """Budgets of sources from (source, source_size).

    Sources by code point, null last, weigh ``weights``, repeating, and share
    100 % of all sizes.  A target stops at ``most`` times the source's size and
    the excess is shared by weight among the rest: with sources in the order
    of most * size / weight, a source is held exactly if its share of what the
    held ones before it leave is above its limit.  Sources may be many: their
    order and sums are distributed.
    """
    by_name = [F.col("source").asc_nulls_last()]
    table = F.array(*[F.lit(w) for w in weights])
    w = running_sums(sizes, by_name, {"number": F.lit(1)})
    w = w.select("source", "source_size", F.get(table, F.pmod("number", F.lit(len(weights))).cast("int")).cast("long").alias("weight"), (F.lit(most).cast("double") * F.col("source_size")).alias("held_at"))
    w = running_sums(w, [F.col("held_at") / F.col("weight"), *by_name], {"size_before": F.col("held_at"), "weight_before": F.col("weight")})
    everything = w.agg(F.sum("source_size").alias("all_sizes"), F.sum("weight").alias("all_weights"))
    w = cut(w.crossJoin(F.broadcast(everything)).select("source", "source_size", "weight", "held_at", (F.col("all_sizes") - F.col("size_before")).alias("left"), (F.col("all_weights") - F.col("weight_before")).alias("left_weight")))
    held = F.col("left") * F.col("weight") / F.col("left_weight") > F.col("held_at")
    # the first source that isn't held fixes the rate of all that aren't
    rate = w.where(~held).agg(F.min(F.struct(F.col("held_at") / F.col("weight"), "left", "left_weight")).alias("r")).select(F.col("r.left").alias("rate"), F.col("r.left_weight").alias("per"))
    return w.crossJoin(F.broadcast(rate)).select("source", "source_size", F.when(held, F.col("held_at")).otherwise(F.coalesce(F.col("rate") * F.col("weight") / F.col("per"), F.lit(0.0))).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Returns (id, size, source_size, target, taken) for every row.

    size counts the words of the text (null: 0); taken is how many words of
    the document the mix takes, repeats counted, at most ``most`` times size;
    each source's taken words sum up to the floor of its target.  A null
    source is a source of its own, the last.  Rows are ordered by md5 of seed
    and id, then by size, so reruns agree; rows that are equal in these are told
    apart by their place in a stored table alone, so which of them gives the last
    words is open but the figures are not, and a group of copies of any size is
    split between buckets.
    Texts without words take nothing; the words of a text of any length are
    counted.  Null ids stay null and have one key.  Other columns, whatever
    their names, are ignored; an empty table gives an empty result.
    """
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(docs[id_col].cast("string"), F.lit("null"))).cast("binary"))
    slim = docs.select(docs[id_col].alias("id"), docs[source_col].alias("source"), F.coalesce(F.regexp_count(docs[text_col], F.lit(WORD)), F.lit(0)).cast("long").alias("size"), key.alias("key"))
    # a few bytes a row, kept so that the words are counted once; a row's place in the table splits equal rows
    slim = cut(slim).withColumn("place", F.monotonically_increasing_id())
    slim = cut(in_buckets(slim))
    buckets = slim.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    goal = targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, most)
    goal = goal.withColumns({"epochs": F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")})
    goal = goal.withColumn("rest", F.floor(F.col("target")).cast("long") - F.col("epochs") * F.col("source_size"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)))
    plan = buckets.alias("b").join(goal.alias("g"), F.col("b.source").eqNullSafe(F.col("g.source"))).select("b.source", "bucket", "bucket_start", "source_size", "target", "epochs", "rest")
    # a bucket is one range partition: neither a source nor a key is ever one group
    joined = slim.alias("s").join(plan.alias("p"), F.col("s.source").eqNullSafe(F.col("p.source")) & (F.col("s.bucket") == F.col("p.bucket"))).select("s.id", "s.source", "s.bucket", "size", "key", "place", "bucket_start", "source_size", "target", "epochs", "rest")
    inner = Window.partitionBy("source", "bucket").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("bucket_start") + F.coalesce(F.sum("size").over(inner), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - start))
    return joined.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))


ORACLE = """
WITH slim AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key FROM {docs}),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM slim GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
             3.0::DOUBLE * source_size AS held_at FROM sizes),
l AS (SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(held_at) OVER o, 0) AS "left",
             CAST(sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS BIGINT) AS left_weight FROM w
      WINDOW o AS (ORDER BY held_at / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT *, "left" * weight / left_weight > held_at AS held FROM l),
rate AS (SELECT "left" AS l1, left_weight AS w1 FROM h WHERE NOT held ORDER BY held_at / weight, "left", left_weight LIMIT 1),
goal AS (SELECT source, source_size, CASE WHEN held THEN held_at ELSE coalesce(l1 * weight / w1, 0) END AS target FROM h LEFT JOIN rate ON true),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM goal)
SELECT s.doc_id, s.size, e.source_size, e.target,
       CAST(epochs * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - epochs * source_size
         - coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS taken
FROM slim s JOIN e ON s.source IS NOT DISTINCT FROM e.source
"""
