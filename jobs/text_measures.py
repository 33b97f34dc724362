"""Job: profiles of text measures by language and source, kept up to date as files arrive.

    spark-submit jobs/text_measures.py SOURCE OUT CHECKPOINT [--config FILE]

SOURCE is a folder of Parquet files with texts, or a pattern of folders and
files.  A file stream takes the files that CHECKPOINT has not seen, in batches;
each batch leaves its partial profile under OUT/states/batch=N, which a batch
that is run again replaces.
Then all states, not the texts, are merged to OUT/report, one partition for
each level of the configuration.  A run without new files gives the same
report.  OUT and CHECKPOINT belong together.
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
from lattica.operators.states import finish_states, merge_states, partial_states  # noqa: E402

log = logging.getLogger("text_measures")
CONFIG = os.path.splitext(os.path.abspath(__file__))[0] + ".json"

#: Figures of the report: whole numbers and rounded ones.
COUNTS = ("total", "finite", "nulls", "zeros")
FIGURES = ("min", "max", "mean", "std", "skewness", "kurtosis", "cv", "sparsity")


def measured(texts: DataFrame, config: dict) -> DataFrame:
    """The keys and a double for each measure; a null text has null measures."""
    return texts.select(*config["keys"], *[F.expr(e).cast("double").alias(m) for m, e in config["measures"].items()])


def _replace(df: DataFrame, path: str, by: str) -> None:
    df.write.partitionBy(by).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def run(spark: SparkSession, source: str, out: str, checkpoint: str, config: dict) -> dict[str, int]:
    """Takes what is new in ``source`` and renews the report; returns what was read and written."""
    keys, measures, states = config["keys"], list(config["measures"]), f"{out}/states"
    schema = spark.read.parquet(source).schema
    # a table without rows tells the columns of the states and lets a first run without input pass
    none = partial_states(measured(spark.createDataFrame([], schema), config), keys, measures).withColumn("batch", F.lit(0).cast("long"))
    none.write.partitionBy("batch").mode("append").parquet(states)
    taken = {"rows_read": 0, "batches": 0}

    def each(batch: DataFrame, number: int) -> None:
        _replace(partial_states(measured(batch, config), keys, measures).withColumn("batch", F.lit(number).cast("long")), states, "batch")
        own = spark.read.schema(none.schema).parquet(states).where((F.col("batch") == number) & (F.col("column") == measures[0]))
        n = own.agg(F.coalesce(F.sum(F.col("total") + F.col("nulls")), F.lit(0))).first()[0]
        taken.update(rows_read=taken["rows_read"] + n, batches=taken["batches"] + 1)
        log.info("batch %d: %d texts of %s", number, n, source)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(source)
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    finest = merge_states(spark.read.schema(none.schema).parquet(states), keys)
    report = None
    for level in config["levels"]:
        figures = finish_states(finest if level == keys else merge_states(finest, level))
        own = figures.select(F.lit("+".join(level) or "all").alias("level"), *[F.col(k) if k in level else F.lit(None).cast(schema[k].dataType).alias(k) for k in keys], F.col("column").alias("measure"), *COUNTS, *[F.round(f, config["decimals"]).alias(f) for f in FIGURES])
        report = own if report is None else report.unionByName(own)
    _replace(report.coalesce(1), f"{out}/report", "level")
    taken["rows_written"] = spark.read.schema(report.schema).parquet(f"{out}/report").count()
    log.info("read %(rows_read)d texts in %(batches)d batches, wrote a report of %(rows_written)d rows", taken)
    return taken


def main() -> None:
    at = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    at.add_argument("source")
    at.add_argument("out")
    at.add_argument("checkpoint")
    at.add_argument("--config", default=CONFIG)
    given = at.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    with open(given.config) as f:
        config = json.load(f)
    spark = SparkSession.builder.appName("text measures").getOrCreate()
    try:
        run(spark, given.source, given.out, given.checkpoint, config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
