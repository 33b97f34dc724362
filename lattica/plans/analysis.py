"""One call for a file, or for all files of a folder: header, layout, profile, observations, preview."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color as C
from ..operators.control import options
from ..operators.grouped import profile_by
from ..operators.profile import MAX_GROUPS, STATS_SCHEMA, basic_aggregates, grouped_by_axis, profile
from ..operators.slices import PAGE_FRAMES, Plane, block_bounds, vector_plane
from ..sources.npy import read_file_block, read_file_window, read_npy
from ..store import cut
from . import insights as I
from . import layout as L


@dataclass
class Analysis:
    """What is known about an array; tables are lazy but for the profile, which is made once."""

    spark: SparkSession
    path: str
    options: dict[str, Any]
    #: Header facts, one row; ``unsupported`` has the reason if there are no statistics.
    meta: DataFrame
    #: The layout, sharpened by the profile, one row.
    layout: DataFrame
    #: The profile, one row without numbers if there are none.
    stats: DataFrame
    #: Statistics by channel or column, or None.
    axes: DataFrame | None
    insights: DataFrame
    #: The view of planes, None for an array that has none.
    plane: Plane | None

    def block(self, page: int = 0) -> DataFrame:
        """One page of frames, decimated to ``image_max_side`` and ``max_elements``; reads only what it shows."""
        first = page * PAGE_FRAMES
        frames = list(range(first, min(first + PAGE_FRAMES, self.plane.frames)))
        return read_file_block(self.spark, self.path, self.plane, frames, self.options["image_max_side"], self.options["max_elements"])

    def window(self, frame: int = 0, row0: int = 0, col0: int = 0) -> DataFrame:
        """One page of exact cells; reads only these."""
        return read_file_window(self.spark, self.path, self.plane, frame, row0, col0)

    def picture(self, page: int = 0) -> DataFrame:
        """PNG of each frame of a page in the ramp of option ``colormap``; stretched over the block's values if ``auto_normalize``, else over the type's range."""
        block = self.block(page)
        seen = block_bounds(block).select(F.col("block_min").alias("lo"), F.col("block_max").alias("hi"))
        if not self.options["auto_normalize"]:
            known = self.layout.first()["display_range"]
            if known:
                seen = self.spark.createDataFrame([tuple(known)], "lo double, hi double")
        cells = block.where("channel = 0").withColumnRenamed("value", "v").crossJoin(F.broadcast(seen))
        return C.png_planes(C.colour(cells, F.col("v"), F.col("lo"), F.col("hi"), self.options["colormap"]))


_FACTS = ["dtype", "kind", "itemsize", "numeric", "readable", "shape", "fortran_order", "truncated", "unsupported", "data_bytes"]


def _declared() -> Column:
    """Bytes that the array takes by its header."""
    return F.aggregate("shape", F.lit(1).cast("long"), lambda a, x: a * x) * F.col("itemsize")


def analyse(spark: SparkSession, path: str, **given: Any) -> Analysis:
    """Everything about one ``.npy`` file (of a folder, see :func:`analyse_all`); ``given`` are the options of :func:`lattica.operators.control.options`.

    An array without statistics (empty, no numbers, not readable, no array at
    all) has a profile row of nulls, and the reason is its one observation.
    """
    o = options(**given)
    meta = read_npy(spark, path, "meta")
    heads = meta.take(2)
    if len(heads) != 1:
        raise ValueError(f"{path} holds {'several files' if heads else 'no file'}; analyse_all takes folders")
    head = heads[0]
    unsupported = head["unsupported"]
    axes, plane = None, None
    if unsupported is None:
        detected = L.detect(meta).first()
        shape = tuple(head["shape"])
        if detected["row_axis"] is not None:
            plane = vector_plane(shape[0]) if len(shape) == 1 else Plane(shape, detected["row_axis"], detected["col_axis"], detected["channel_axis"])
        cells = read_npy(spark, path, columns=["pos", "value"])
        stats = profile(cells if o["exact_limit"] else read_npy(spark, path, columns=["value"]), ["value"], o["histogram_bins"], o["exact_limit"])
        axis = detected["channel_axis"]
        name = "Channel"
        if axis is None and len(shape) == 2 and not detected["image_like"]:
            axis, name = 1, "Column"
        if axis is not None:
            stride = 1
            for d in shape[axis + 1 :]:
                stride *= d
            axes = grouped_by_axis(cells, stride, shape[axis], name)
    else:
        stats = spark.createDataFrame([("value", *[None] * (len(STATS_SCHEMA) - 1))], STATS_SCHEMA)
    about = stats.crossJoin(F.broadcast(meta.select(*_FACTS, _declared().alias("declared_bytes"))))
    found = L.refine(L.detect(about)) if head["shape"] is not None else about.withColumns({"image_like": F.lit(False), "display_range": F.lit(None).cast("array<double>")})
    if axes is not None and name == "Channel":
        means = axes.agg(F.collect_list("mean").alias("channel_means"))
        found = found.crossJoin(F.broadcast(means))
    layout = found.drop(*[c for c in stats.columns if c != "column"], "channel_means")
    return Analysis(spark, path, o, meta, layout, stats, axes, I.insights(found), plane)


@dataclass
class Catalogue:
    """What is known about many arrays: tables with a column ``path``."""

    #: Header facts, a row for each file, unreadable ones with the reason in ``unsupported``.
    meta: DataFrame
    #: The layout of each array, sharpened by its profile.
    layout: DataFrame
    #: The profile of each array that has numbers.
    stats: DataFrame
    #: Statistics of each array by channel or column: path, name, index, and the figures.
    axes: DataFrame
    insights: DataFrame


def analyse_all(spark: SparkSession, path: str, **given: Any) -> Catalogue:
    """Everything about all ``.npy`` files below a folder; the number of scans does not depend on how many there are.

    Files are grouped by path: one that is no array, or has no numbers, has a row
    of its header or of the reason, and an observation that says so.  Profiles are
    exact, so there is no ``exact_limit``; the other options are as for one file.
    """
    o = options(**given)
    if o["exact_limit"]:
        raise ValueError("profiles of many files are exact")
    meta = cut(read_npy(spark, path, "meta"))
    read = lambda *columns: read_npy(spark, path, columns=list(columns), problems="skip")
    stats = cut(profile_by(read("path", "value").where("value is not null"), ["path"], ["value"], o["histogram_bins"]))
    known = meta.where("unsupported is null")
    about = known.select("path", *_FACTS, _declared().alias("declared_bytes")).join(stats, "path", "left")
    detected = L.detect(known.select("path", *_FACTS))
    by_column = F.col("channel_axis").isNull() & (F.size("shape") == 2) & ~F.col("image_like")
    axis = F.when(by_column, 1).otherwise(F.col("channel_axis"))
    chosen = detected.select("path", "shape", axis.alias("axis"), F.when(by_column, "Column").otherwise("Channel").alias("name")).where("axis is not null")
    inner = F.aggregate(F.slice("shape", F.col("axis") + 2, F.size("shape")), F.lit(1).cast("long"), lambda a, x: a * x)
    chosen = chosen.select("path", "name", inner.alias("inner"), F.get("shape", F.col("axis")).alias("extent")).where(F.col("extent").between(2, MAX_GROUPS))
    a = basic_aggregates(F.col("value"))
    cells = read("path", "pos", "value").join(chosen, "path").withColumn("index", F.pmod(F.floor(F.col("pos") / F.col("inner")), F.col("extent")))
    axes = cut(cells.groupBy("path", "name", "index").agg(a["finite"].alias("count"), *[a[k].alias(k) for k in ("min", "max", "mean", "std", "nan", "zeros")]))
    means = axes.where("name = 'Channel'").groupBy("path").agg(F.collect_list("mean").alias("channel_means"))
    found = L.refine(L.detect(about)).join(means, "path", "left")
    refused = meta.where("unsupported is not null").select("path", *_FACTS, _declared().alias("declared_bytes"))
    told = found.unionByName(refused, allowMissingColumns=True)
    told = told.withColumn("image_like", F.coalesce("image_like", F.lit(False)))
    return Catalogue(meta, found.drop(*[c for c in stats.columns if c != "path"], "channel_means"), stats, axes, I.insights(told, "path"))
