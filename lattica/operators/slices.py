"""Frames, windows, decimated blocks and previews of arrays in element form (pos, value)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import cut

#: Rows and columns of previews, items of a subarray, rows and columns of a table page, frames of a thumbnail page.
PREVIEW_ROWS, PREVIEW_COLUMNS, SUBARRAY_ITEMS = 500, 32, 8
PAGE_ROWS, PAGE_COLUMNS, PAGE_FRAMES = 100, 40, 64


def strides(shape: Column, fortran: Column) -> Column:
    """Item strides of a shape (array of long) in C or Fortran order."""
    size = F.size(shape)

    def product(part: Column) -> Column:
        return F.aggregate(part, F.lit(1).cast("long"), lambda a, x: a * x)

    c = F.transform(shape, lambda _, i: product(F.slice(shape, i + 2, F.greatest(size - i - 1, F.lit(0)))))
    f = F.transform(shape, lambda _, i: product(F.slice(shape, 1, i)))
    return F.when(fortran, f).otherwise(c)


def unravel(pos: Column, shape: list[int]) -> list[Column]:
    """Index along each axis of a C-order position."""
    out, stride = [], 1
    for extent in reversed(shape):
        out.insert(0, F.pmod(F.floor(pos / stride), F.lit(max(extent, 1))).cast("long"))
        stride *= max(extent, 1)
    return out


def frame_indices(frame: Column, frame_shape: Column) -> Column:
    """Mixed-radix digits of a frame number, the last frame axis fastest; an extent of 0 counts as 1."""
    n = F.size(frame_shape)
    radix = F.transform(frame_shape, lambda x: F.greatest(x, F.lit(1).cast("long")))

    def below(i: Column) -> Column:
        return F.aggregate(F.slice(radix, i + 2, F.greatest(n - i - 1, F.lit(0))), F.lit(1).cast("long"), lambda a, x: a * x)

    return F.transform(radix, lambda r, i: F.pmod(F.floor(frame / below(i)), r))


def frame_label(indices: Column, frame_axes: Column, ndim: Column) -> Column:
    """A frame as an index expression such as ``[2, 0, :, :]``."""
    index = lambda a: F.get(indices, (F.array_position(frame_axes, a) - 1).cast("int")).cast("string")
    part = F.transform(F.sequence(F.lit(0), ndim - 1), lambda a: F.when(F.array_contains(frame_axes, a), index(a)).otherwise(":"))
    return F.concat(F.lit("["), F.array_join(part, ", "), F.lit("]"))


@dataclass(frozen=True)
class Plane:
    """Axes of rows, columns and channels; the others number the frames, outermost first."""

    shape: tuple[int, ...]
    row: int
    col: int
    channel: int | None = None
    #: A one-dimensional array, seen as one row.
    vector: bool = False

    @property
    def frame_axes(self) -> list[int]:
        return [a for a in range(len(self.shape)) if a not in (self.row, self.col, self.channel)]

    def extent(self, axis: int | None) -> int:
        return 1 if axis is None else self.shape[axis]

    @property
    def frames(self) -> int:
        n = 1
        for a in self.frame_axes:
            n *= self.shape[a]
        return n

    def columns(self, pos: Column) -> dict[str, Column]:
        """frame, row, col and channel of a C-order position."""
        at = unravel(pos, list(self.shape))
        frame = F.lit(0).cast("long")
        for a in self.frame_axes:
            frame = frame * F.lit(max(self.shape[a], 1)) + at[a]
        return {"frame": frame, "row": at[self.row], "col": at[self.col], "channel": at[self.channel] if self.channel is not None else F.lit(0).cast("long")}


def vector_plane(n: int) -> Plane:
    return Plane((1, n), 0, 1, vector=True)


def block_steps(plane: Plane, frames: int, max_side: int, max_elements: int) -> tuple[int, int]:
    """Steps along rows and columns: sides of at most ``max_side``, halved until the block fits ``max_elements``."""
    h, w, c = plane.extent(plane.row), plane.extent(plane.col), plane.extent(plane.channel)
    side = max(max_side, 1)
    while True:
        steps = max(1, -(-h // side)), max(1, -(-w // side))
        if side == 1 or frames * -(-h // steps[0]) * -(-w // steps[1]) * c <= max_elements:
            return steps
        side = max(1, side // 2)


def read_block(elements: DataFrame, plane: Plane, frames: list[int] | None = None, max_side: int = 1600, max_elements: int = 2_000_000) -> DataFrame:
    """Every step-th sample of the wanted frames: frame, row, col (in the block), channel, value."""
    wanted = list(range(plane.frames)) if frames is None else frames
    rs, cs = block_steps(plane, len(wanted), max_side, max_elements)
    placed = elements.withColumns(plane.columns(F.col("pos")))
    keep = (F.pmod("row", F.lit(rs)) == 0) & (F.pmod("col", F.lit(cs)) == 0)
    if frames is not None:
        keep &= F.col("frame").isin(wanted)
    return placed.where(keep).select("frame", F.floor(F.col("row") / rs).alias("row"), F.floor(F.col("col") / cs).alias("col"), "channel", "value")


def block_bounds(block: DataFrame) -> DataFrame:
    """(block_min, block_max) without NaN; bounds that are not finite count as 0."""
    v = F.when(~F.isnan("value"), F.col("value"))
    inf = F.lit(float("inf"))
    return block.agg(*[F.coalesce(F.when(F.abs(m) != inf, m), F.lit(0.0)).alias(k) for k, m in (("block_min", F.min(v)), ("block_max", F.max(v)))])


def encode_block(block: DataFrame, as_bytes: bool = False) -> DataFrame:
    """One row: base64 of the block's samples in frame, row, col, channel order; float32 little-endian, or one byte each."""
    order = F.sort_array(F.collect_list(F.struct("frame", "row", "col", "channel", "value")))
    if as_bytes:
        text = F.transform(order, lambda x: F.substring(F.concat(F.lit("0"), F.hex(x["value"].cast("int"))), -2, 2))
        return block.agg(F.base64(F.unhex(F.array_join(text, ""))).alias("data"), F.count(F.lit(1)).alias("n"))

    def run(batches):
        import base64

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            data = [base64.b64encode(np.asarray(x.as_py(), "<f4").tobytes()).decode() for x in batch.column("values")]
            yield pa.RecordBatch.from_arrays([pa.array(data), batch.column("n")], names=["data", "n"])

    # a block has at most max_elements samples, so one row holds it
    return block.agg(F.transform(order, lambda x: x["value"]).alias("values"), F.count(F.lit(1)).alias("n")).mapInArrow(run, "data string, n long")


def table_window(elements: DataFrame, plane: Plane, frame: int = 0, row0: int = 0, col0: int = 0, rows: int = PAGE_ROWS, cols: int = PAGE_COLUMNS) -> DataFrame:
    """Exact cells of a window, clipped to the plane: row, col, text (channels joined by a comma), value (channel 0).

    Predicates on row and col, never OFFSET; ``text`` uses the column
    ``exact`` if the elements have one.  Cells past the end of a truncated
    file read ``--``.
    """
    h, w = plane.extent(plane.row), plane.extent(plane.col)
    r1, c1 = min(row0 + rows, h), min(col0 + cols, w)
    exact = F.col("exact") if "exact" in elements.columns else F.col("value").cast("string")
    placed = elements.withColumns(plane.columns(F.col("pos"))).where((F.col("frame") == frame) & F.col("row").between(row0, r1 - 1) & F.col("col").between(col0, c1 - 1))
    cells = placed.groupBy("row", "col").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("channel", exact.alias("t")))), lambda x: x["t"]), ", ").alias("text"), F.max(F.when(F.col("channel") == 0, F.col("value"))).alias("value"))
    spark = elements.sparkSession
    grid = spark.range(max(r1 - row0, 0)).select((F.col("id") + row0).alias("row")).select("row", F.explode(F.sequence(F.lit(col0).cast("long"), F.lit(max(c1 - 1, col0)).cast("long"))).alias("col")) if c1 > col0 else spark.range(0).select(F.col("id").alias("row"), F.col("id").alias("col"))
    return grid.join(cells, ["row", "col"], "left").select("row", "col", F.coalesce("text", F.lit("--")).alias("text"), "value")


def decode_block(encoded: DataFrame, as_bytes: bool = False) -> DataFrame:
    """(i, value) from the base64 of :func:`encode_block`, i in its order: the inverse up to float32."""

    def run(batches):
        import base64

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for text in batch.column("data").to_pylist():
                values = np.frombuffer(base64.b64decode(text or ""), np.uint8 if as_bytes else np.dtype("<f4")).astype(float)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(values.size)), pa.array(values)], names=["i", "value"])

    return encoded.select("data").mapInArrow(run, "i long, value double")


def wide(window: DataFrame, cols: list[int]) -> DataFrame:
    """A window as one row for each array row, one string column for each array column."""
    return window.groupBy("row").pivot("col", cols).agg(F.first("text"))


def text_preview(df: DataFrame, order: str, columns: list[str], rows: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows as text, at most 32 columns; subarrays show their first eight items."""
    kinds = dict(df.dtypes)

    def show(c: str) -> Column:
        if kinds[c].startswith("array"):
            cut = F.transform(F.slice(F.col(c), 1, SUBARRAY_ITEMS), lambda x: x.cast("string"))
            return F.concat(F.lit("["), F.array_join(cut, ", "), F.when(F.size(c) > SUBARRAY_ITEMS, ", …").otherwise(""), F.lit("]"))
        return F.col(c).cast("string")

    return df.orderBy(order).limit(rows).select(F.col(order).cast("string").alias("index"), *[show(c).alias(c) for c in columns[:PREVIEW_COLUMNS]])


def line_envelope(df: DataFrame, position: Column, value: Column, n: int, width: int) -> DataFrame:
    """(bucket, low, high): smallest and largest finite value of each pixel column; a bucket without finite values is a gap (nulls).

    Bucket c covers positions floor(c*n/k) to floor((c+1)*n/k) - 1.
    """
    k = max(1, min(round(width), n))
    v = F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)
    # the inverse of the floor formula, in whole numbers
    bucket = F.floor(((position.cast("long") + 1) * k - 1) / F.lit(n)).cast("long")
    found = df.groupBy(bucket.alias("bucket")).agg(F.min(v).alias("low"), F.max(v).alias("high"))
    return df.sparkSession.range(k).withColumnRenamed("id", "bucket").join(F.broadcast(found), "bucket", "left")


def box_marks(stats: DataFrame) -> DataFrame:
    """Five marks of a box plot from a profile row."""
    return stats.select("column", F.greatest("min", "lower_fence").alias("whisker_low"), F.col("p25").alias("q1"), "median", F.col("p75").alias("q3"), F.least("max", "upper_fence").alias("whisker_high"))


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """Consecutive positions in a given order, from 0, without a single-task window.

    Rows are range-partitioned by ``order`` and kept in the shared folder,
    since two readers of a range exchange could see different bounds;
    partition sizes give each partition its first number.
    """
    dealt = cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sizes = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    first = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__part", first.alias("__first"))
    at = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return dealt.join(F.broadcast(starts), "__part").withColumn("pos", (F.col("__first") + at).cast("long")).drop("__part", "__first")


def scalar(elements: DataFrame) -> DataFrame:
    """The value of an array without dimensions: exact text and number."""
    exact = F.col("exact") if "exact" in elements.columns else F.col("value").cast("string")
    return elements.where("pos = 0").select(exact.alias("exact"), "value").limit(1)


def clamp_index(value: int, count: int) -> int:
    """An index held inside a range of ``count``."""
    return max(0, min(count - 1, value))


def frame_page(plane: Plane, page: int, size: int = PAGE_FRAMES) -> list[int]:
    """Frame numbers of one page of thumbnails; pages append to each other."""
    first = page * size
    return list(range(first, max(first, min(first + size, plane.frames))))


def thumbnails(elements: DataFrame, plane: Plane, page: int, side: int = 128) -> DataFrame:
    """The block of one page of frames."""
    return read_block(elements, plane, frame_page(plane, page), max_side=side)


def source_cell(row: Column, col: Column, steps: tuple[int, int]) -> tuple[Column, Column]:
    """Row and column of the array behind a cell of a decimated block."""
    return row * steps[0], col * steps[1]


def inspect(block: DataFrame, steps: tuple[int, int]) -> DataFrame:
    """``[row, col] = values`` for each cell of a block, channels joined by a comma."""
    from ..functions.text import short_number

    row, col = source_cell(F.col("row"), F.col("col"), steps)
    values = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("channel", "value"))), lambda x: short_number(x["value"])), ", ")
    cells = block.groupBy("frame", "row", "col").agg(values.alias("values"))
    return cells.select("frame", "row", "col", F.concat(F.lit("["), F.format_number(row, 0), F.lit(", "), F.format_number(col, 0), F.lit("] = "), "values").alias("text"))
