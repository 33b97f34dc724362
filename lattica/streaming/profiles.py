"""Running profiles of streams of values.

The mergeable part of a profile (counts, extrema, moments) is kept up to date
as files or events arrive; order statistics are made for each arriving batch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.profile import basic_aggregates, finite, percentile_name
from ..operators.sketches import RANK_K, quantile_of

#: Aggregates that partial results can be merged into.
RUNNING = ("total", "finite", "nan", "pos_inf", "neg_inf", "zeros", "min", "max", "sum", "mean", "std")


def running_profile(stream: DataFrame, key: str, value: str, percentiles: Sequence[float] = ()) -> DataFrame:
    """Counts, extrema and moments by key over everything seen so far; for output mode ``complete`` or ``update``.

    ``percentiles`` are estimated from a sketch in the state, within
    :func:`lattica.operators.sketches.rank_error` of their rank.
    """
    v = F.col(value).cast("double")
    a, sketch = basic_aggregates(v), F.kll_sketch_agg_double(finite(v), RANK_K)
    return stream.groupBy(key).agg(*[a[k].alias(k) for k in RUNNING], *[quantile_of(sketch, a["finite"], p / 100).alias(percentile_name(p)) for p in percentiles])


def windowed_profile(stream: DataFrame, time: str, value: str, window: str = "1 hour", late: str = "1 hour", key: str | None = None) -> DataFrame:
    """The same by tumbling window of event time; rows later than ``late`` are left out."""
    a = basic_aggregates(F.col(value).cast("double"))
    groups = [F.window(time, window)] + ([F.col(key)] if key else [])
    return stream.withWatermark(time, late).groupBy(*groups).agg(*[a[k].alias(k) for k in RUNNING])


def profile_arrivals(stream: DataFrame, sink: str, checkpoint: str, columns: list[str] | None = None) -> StreamingQuery:
    """Profiles each batch of arriving rows in full and appends the rows to Parquet."""
    from ..operators.profile import profile

    def each(batch: DataFrame, number: int) -> None:
        profile(batch, columns).withColumn("batch", F.lit(number)).write.mode("append").parquet(sink)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
