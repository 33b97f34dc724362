"""Job: exact profiles of table columns by group, and which groups lie apart from their table.

    spark-submit jobs/column_profiles.py SOURCE OUT [--config FILE] [--tables NAME ...]

Each table of the configuration is SOURCE/NAME.parquet.  OUT/profiles gets a
row for each group and column, partitioned by table: only the partitions of
the tables that are run are replaced, so one of them can be run again.  A
group's ``shift`` is the distance of its median from that of the whole table,
in median absolute deviations of the table; ``apart`` says that it exceeds the
configured one.
"""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from lattica.operators.grouped import counted_by, middle_by, profile_by  # noqa: E402
from lattica.store import cut, made, release  # noqa: E402

log = logging.getLogger("column_profiles")
CONFIG = os.path.splitext(os.path.abspath(__file__))[0] + ".json"

COUNTS = ("total", "finite", "nulls", "zeros", "outliers", "distinct")
MOMENTS = ("mean", "std", "skewness", "kurtosis")
ORDERED = ("min", "max", "median", "iqr", "mad", "lower_fence", "upper_fence", "p5", "p95")


def profiles(table: DataFrame, name: str, by: list[str], columns: dict[str, str], config: dict) -> DataFrame:
    """The rows of one table."""
    label = F.array_join(F.array(*[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("null")) for k in by]), "/")
    rows = table.select(label.alias("group"), *[F.expr(e).cast("double").alias(c) for c, e in columns.items()])
    # the figures of the whole table come from the counted values of its groups
    counts = cut(counted_by(rows, ["group"], list(columns)))
    by_group = profile_by(rows, ["group"], list(columns), config["bins"], counts=counts)
    every = counts.groupBy(F.struct(F.lit("all")).alias("g"), "c", "x").agg(F.sum("n").alias("n"))
    whole = middle_by(cut(every)).select(F.element_at(F.array(*map(F.lit, columns)), F.col("c") + 1).alias("column"), F.col("median").alias("common"), F.col("mad").alias("scale"))
    r = lambda c: F.round(c, config["decimals"])
    shift = F.try_divide(F.abs(F.col("median") - F.col("common")), F.col("scale"))
    # one row a column of the configuration: its number bounds the broadcast
    return by_group.join(F.broadcast(whole), "column", "left").select(
        F.lit(name).alias("table"), "group", "column", *COUNTS, *[F.round(f, config["moment_decimals"]).alias(f) for f in MOMENTS], *[r(f).alias(f) for f in ORDERED],
        F.transform("histogram.bin_edges", r).alias("edges"), F.col("histogram.counts").alias("counts"),
        r(shift).alias("shift"), F.coalesce(shift > config["shift"], F.lit(False)).alias("apart"),
    )


def run(spark: SparkSession, source: str, out: str, config: dict, tables: list[str] | None = None) -> dict[str, dict[str, int]]:
    """Renews the profiles of the tables (by default, all of the configuration); returns what was read and written of each."""
    done, path = {}, f"{out}/profiles"
    for name in tables or config["tables"]:
        known, begun = config["tables"][name], made()
        rows = profiles(spark.read.parquet(f"{source}/{name}.parquet"), name, known["by"], known["columns"], config)
        rows.write.partitionBy("table").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
        release(spark, begun)
        written = spark.read.schema(rows.schema).parquet(path).where(F.col("table") == name)
        first = next(iter(known["columns"]))
        n, read = written.agg(F.count(F.lit(1)), F.sum(F.when(F.col("column") == first, F.col("total") + F.col("nulls")))).first()
        done[name] = {"rows_read": read or 0, "rows_written": n}
        log.info("%s: read %d rows, wrote %d profiles", name, read or 0, n)
    return done


def main() -> None:
    at = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    at.add_argument("source")
    at.add_argument("out")
    at.add_argument("--config", default=CONFIG)
    at.add_argument("--tables", nargs="*")
    given = at.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    with open(given.config) as f:
        config = json.load(f)
    spark = SparkSession.builder.appName("column profiles").getOrCreate()
    try:
        run(spark, given.source, given.out, config, given.tables)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
