"""Normalisation, colour ramps and rendered planes."""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: anchor colours of the ramps
RAMPS = {
    "viridis": "440154 482878 3e4a89 31688e 26828e 1f9e89 35b779 6dcd59 fde725",
    "magma": "000004 180f3d 440f76 721f81 9e2f7f cd4071 f1605d fd9668 fcfdbf",
    "inferno": "000004 1b0c41 4a0c6b 781c6d a52c60 cf4446 ed6925 fca50a fcffa4",
    "plasma": "0d0887 46039f 7201a8 9c179e bd3786 d8576b ed7953 fa9e3b f0f921",
    "cividis": "00224e 123570 3b496c 575d6d 707173 8a8678 a59c74 c3b369 fdea45",
    "turbo": "30123b 4145ab 4675ed 39a2fc 1bcfd4 24eca6 61fc6c a4fc3b d1e834 f3c53a fe9b2d ec5f21 7a0403",
    "gray": "000000 ffffff",
    "coolwarm": "3b4cc0 7b9ff9 dddddd f49a7b b40426",
}
DIVERGING = ("coolwarm",)
#: Without a positive minimum the log scale begins this many times below the maximum.
LOG_DECADES = 1e4


def anchors(name: str) -> list[tuple[int, int, int]]:
    return [tuple(bytes.fromhex(h)) for h in RAMPS.get(name, RAMPS["viridis"]).split()]


def ramp(spark: SparkSession, name: str) -> DataFrame:
    """(i, r, g, b): 256 colours between the anchors, halves rounded to even; an unknown name is viridis."""
    a = anchors(name)
    at = F.col("i") / 255.0 * (len(a) - 1)
    k = F.least(F.floor(at), F.lit(len(a) - 2)).cast("int")
    table = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in a])
    mix = lambda j: F.rint(F.get(F.get(table, k), F.lit(j)) + (F.get(F.get(table, k + 1), F.lit(j)) - F.get(F.get(table, k), F.lit(j))) * (at - k)).cast("int")
    return spark.range(256).select(F.col("id").cast("int").alias("i")).select("i", mix(0).alias("r"), mix(1).alias("g"), mix(2).alias("b"))


def gradient_css(name: str) -> str:
    """The ramp as a CSS gradient of its anchors."""
    a = RAMPS.get(name, RAMPS["viridis"]).split()
    return "linear-gradient(to right, " + ", ".join(f"#{h} {100 * i / (len(a) - 1):g}%" for i, h in enumerate(a)) + ")"


def normalise(v: Column, low: Column, high: Column, scale: str = "linear") -> Column:
    """Position of a value in [low, high] by a linear, log or symlog scale; 0.5 where there is no span."""
    if scale == "log":
        lo = F.when(low > 0, low).otherwise(high / LOG_DECADES)
        ok = (lo > 0) & (high > lo)
        a = F.ln(F.when(ok, lo))
        return F.when(ok, (F.ln(F.greatest(v, lo)) - a) / (F.ln(F.when(ok, high)) - a)).otherwise(F.lit(0.5))
    if scale == "symlog":
        bound = F.greatest(F.abs(low), F.abs(high), F.lit(1e-12))
        return (F.signum(v) * F.log1p(F.abs(v)) / F.log1p(bound) + 1) / 2
    return F.when(high > low, (v - low) / F.nullif(high - low, F.lit(0.0))).otherwise(F.lit(0.5))


def ramp_index(t: Column) -> Column:
    """Index into a ramp of 256 colours, clamped."""
    return F.least(F.greatest(F.floor(t * 255 + 0.5), F.lit(0)), F.lit(255)).cast("int")


def colour(df: DataFrame, value: Column, low: Column, high: Column, name: str = "viridis", scale: str = "linear") -> DataFrame:
    """Adds r, g, b and a; values that are not finite are transparent.  The ramp has 256 rows and is broadcast."""
    ok = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))
    i = F.when(ok, ramp_index(normalise(value, low, high, scale))).otherwise(0)
    lut = F.broadcast(ramp(df.sparkSession, name))
    return df.withColumns({"i": i, "a": F.when(ok, 255).otherwise(0)}).join(lut, "i").drop("i")


def render_rgb(df: DataFrame, unit_range: bool) -> DataFrame:
    """frame, row, col, r, g, b, a from elements with channels; the alpha is the fourth channel or opaque."""
    v = F.col("value") * 255 if unit_range else F.col("value")
    byte = F.least(F.greatest(F.rint(v), F.lit(0.0)), F.lit(255.0))
    of = lambda k: F.max(F.when(F.col("channel") == k, F.when(F.isnan(byte), None).otherwise(byte)).cast("int"))
    bad = F.max((F.isnan("value") | (F.abs("value") == F.lit(float("inf")))).cast("int"))
    out = df.groupBy("frame", "row", "col").agg(of(0).alias("r"), of(1).alias("g"), of(2).alias("b"), of(3).alias("alpha"), bad.alias("bad"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return out.select("frame", "row", "col", zero("r"), zero("g"), zero("b"), F.when(F.col("bad") == 1, 0).otherwise(F.coalesce("alpha", F.lit(255))).alias("a"))


def display_range(kind: Column, itemsize: Column, unit_range: Column, image_like: Column, low: Column, high: Column) -> Column:
    """Bounds shown by default, from the type or the values; null means the data's own."""
    pair = lambda a, b: F.array(F.lit(float(a)), F.lit(float(b)))
    return F.when(kind == "bool", pair(0, 1)).when((kind == "uint") & (itemsize == 1), pair(0, 255)).when(unit_range, pair(0, 1)).when(image_like & (low >= -1.05) & (high <= 1.05) & (low < 0), pair(-1, 1))


def centred(low: Column, high: Column) -> tuple[Column, Column]:
    """Bounds around zero for a diverging ramp."""
    m = F.greatest(F.abs(low), F.abs(high))
    return -m, m


def png(width: int, height: int, rgba: bytes) -> bytes:
    """A PNG of 8-bit RGBA rows."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = b"".join(b"\0" + rgba[4 * width * y : 4 * width * (y + 1)] for y in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines, 6)) + chunk(b"IEND", b"")


def png_planes(pixels: DataFrame) -> DataFrame:
    """(frame, width, height, png) from frame, row, col, r, g, b, a; a frame is at most a preview block."""

    def draw(table):
        import numpy as np
        import pyarrow as pa

        row, col = (table.column(c).to_numpy() for c in ("row", "col"))
        h, w = int(row.max()) + 1, int(col.max()) + 1
        out = np.zeros((h, w, 4), np.uint8)
        for k, c in enumerate("rgba"):
            out[row, col, k] = table.column(c).to_numpy()
        return pa.table({"frame": [table.column("frame")[0].as_py()], "width": [w], "height": [h], "png": [png(w, h, out.tobytes())]}, pa.schema([("frame", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("png", pa.binary())]))

    cols = ["frame", "row", "col", "r", "g", "b", "a"]
    return pixels.select(*cols).groupBy("frame").applyInArrow(draw, "frame long, width int, height int, png binary")


def unpng(data: bytes) -> tuple[int, int, bytes]:
    """Width, height and RGBA rows of a picture that :func:`png` made."""
    at, parts, width, height = 8, [], 0, 0
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IHDR":
            width, height = struct.unpack(">II", data[at + 8 : at + 16])
        elif kind == b"IDAT":
            parts.append(data[at + 8 : at + 8 + n])
        at += n + 12
    lines, step = zlib.decompress(b"".join(parts)), 4 * width + 1
    return width, height, b"".join(lines[y * step + 1 : (y + 1) * step] for y in range(height))


def png_lines(data: bytes, most: int = 1 << 22):
    """Width, first line and RGBA lines of runs of lines of such a picture, about ``most`` bytes at a time."""
    import numpy as np

    at, width, line, rest, opened = 8, 0, 0, b"", zlib.decompressobj()
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IHDR":
            width = struct.unpack(">I", data[at + 8 : at + 12])[0]
        packed = data[at + 8 : at + 8 + n] if kind == b"IDAT" else b""
        while packed:
            rest += opened.decompress(packed, most)
            packed = opened.unconsumed_tail
            k = len(rest) // (4 * width + 1)
            if k:
                whole = np.frombuffer(rest, np.uint8, k * (4 * width + 1)).reshape(k, -1)
                yield width, line, whole[:, 1:].reshape(k, width, 4)
                line, rest = line + k, rest[k * (4 * width + 1) :]
        at += n + 12


def png_pixels(pictures: DataFrame) -> DataFrame:
    """frame, row, col, r, g, b, a of pictures (frame, png) that this library made, some lines at a time."""

    def read(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for frame, data in zip(batch.column("frame").to_pylist(), batch.column("png"), strict=True):
                for w, first, rgba in png_lines(memoryview(data.as_buffer())):
                    row, col = np.divmod(np.arange(w * len(rgba)), w)
                    flat = rgba.reshape(-1, 4).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array([frame], pa.int64()).take(pa.array(np.zeros(row.size, np.int8))), pa.array(row + first), pa.array(col), *(pa.array(flat[:, k]) for k in range(4))], names=["frame", "row", "col", *"rgba"])

    return pictures.select("frame", "png").mapInArrow(read, "frame long, row long, col long, r int, g int, b int, a int")


def shown_range(mode: Column, fixed: Column, low: Column, high: Column, p1: Column, p99: Column, block_low: Column, block_high: Column) -> Column:
    """Bounds that a ramp is stretched across.

    ``dtype``: the bounds of :func:`display_range`, else the data's own.
    ``robust``: percentiles 1 to 99 where they differ.  Otherwise, and where
    those do not apply: the visible block's, the data's, [0, 1].
    """
    unit = F.array(F.lit(0.0), F.lit(1.0))
    own = F.when(low.isNotNull() & (high > low), F.array(low, high)).otherwise(unit)
    block = F.when(block_low.isNotNull() & (block_high > block_low), F.array(block_low, block_high)).otherwise(own)
    lo, hi = F.coalesce(p1, low), F.coalesce(p99, high)
    by_type = F.coalesce(fixed, F.when(low.isNotNull(), F.array(low, high)).otherwise(unit))
    return F.when(mode == "dtype", by_type).when((mode == "robust") & (hi > lo), F.array(lo, hi)).otherwise(block)


def default_ramp(low: Column, high: Column, image_like: Column, chosen: Column) -> Column:
    """A diverging ramp for data on both sides of zero that is no picture, else the chosen one."""
    return F.when((low < 0) & (high > 0) & ~image_like, DIVERGING[0]).otherwise(chosen)
