"""Progress, cancellation, time limits and facts about the engine."""

from __future__ import annotations

import platform
import threading
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from typing import Any

import pyspark
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seconds a probe and an analysis may take, bytes of one text result, and the options with their defaults (exact_limit: values beyond which percentiles come from a sample; None: never).
PROBE_SECONDS, ANALYSIS_SECONDS, OUTPUT_BYTES = 15, 180, 64 << 20
OPTIONS = {"exact_limit": None, "histogram_bins": 64, "max_elements": 2_000_000, "image_max_side": 1600, "colormap": "viridis", "auto_normalize": True}
#: Progress is reported in steps of this much.
STEP = 0.02


def options(**given: Any) -> dict[str, Any]:
    """Options with their defaults; bins are held between 8 and 256."""
    unknown = set(given) - set(OPTIONS)
    if unknown:
        raise ValueError(f"unknown options {sorted(unknown)}")
    out = OPTIONS | given
    out["histogram_bins"] = min(max(int(out["histogram_bins"]), 8), 256)
    return out


def capped(text: Column, limit: int = OUTPUT_BYTES) -> Column:
    """A text result; one of more than ``limit`` bytes is an error, as it would be gathered in one row."""
    return F.when(F.octet_length(text) <= limit, text).when(text.isNotNull(), F.raise_error(F.concat(F.lit(f"the result has more than {limit} bytes: "), F.octet_length(text).cast("string"))))


class Cancelled(RuntimeError):
    """The work was interrupted; there is no partial result."""


@contextmanager
def cancellable(spark: SparkSession):
    """Jobs started inside carry a tag; the value given is a function that interrupts them."""
    tag = f"work-{uuid.uuid4().hex}"
    sc = spark.sparkContext
    sc.addJobTag(tag)
    try:
        yield lambda: sc.cancelJobsWithTag(tag)
    finally:
        sc.removeJobTag(tag)


def with_timeout(spark: SparkSession, work: Callable[[], Any], seconds: float = ANALYSIS_SECONDS) -> Any:
    """The result of ``work``; jobs that run longer than ``seconds`` are interrupted and :class:`Cancelled` is raised."""
    hit = threading.Event()
    with cancellable(spark) as cancel:
        timer = threading.Timer(seconds, lambda: (hit.set(), cancel()))
        timer.start()
        try:
            return work()
        except Exception as e:
            if hit.is_set():
                raise Cancelled(f"no result within {seconds:g} seconds") from e
            raise
        finally:
            timer.cancel()


def progress(spark: SparkSession, group: str) -> float:
    """Share of tasks done among the jobs of a group, between 0 and 1."""
    status = spark.sparkContext.statusTracker()
    done = total = 0
    for job in status.getJobIdsForGroup(group):
        info = status.getJobInfo(job)
        for stage in info.stageIds if info else ():
            s = status.getStageInfo(stage)
            if s:
                done, total = done + s.numCompletedTasks, total + s.numTasks
    return done / total if total else 0.0


def watch(spark: SparkSession, work: Callable[[], Any], report: Callable[[float], None], interval: float = 0.1) -> Any:
    """Runs ``work`` and reports its progress, never backwards and in steps of 2 %, ending with 1."""
    group, stop, last = f"work-{uuid.uuid4().hex}", threading.Event(), [0.0]

    def poll():
        while not stop.wait(interval):
            now = progress(spark, group)
            if now - last[0] > STEP:
                last[0] = now
                report(now)

    thread = threading.Thread(target=poll, daemon=True)
    spark.sparkContext.setJobGroup(group, "watched work", True)
    thread.start()
    try:
        out = work()
    finally:
        stop.set()
        thread.join()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    report(1.0)
    return out


def engine_info(spark: SparkSession) -> DataFrame:
    """(key, value): versions and settings that results depend on."""
    facts = [("engine", "Spark"), ("spark", spark.version), ("pyspark", pyspark.__version__), ("python", platform.python_version()), ("shuffle_partitions", spark.conf.get("spark.sql.shuffle.partitions"))]
    return spark.createDataFrame(facts, "key string, value string")
