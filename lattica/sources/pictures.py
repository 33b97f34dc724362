"""Pictures of any size: strips of lines are drawn and compressed apart, then put one after the other into a PNG file.

Each strip is a run of deflate blocks that ends at a byte, so strips join to one
compressed stream; its checksum comes from the strips' own.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.color import png_pixels
from ..store import cut
from .files import named, write_pieces

#: Pixels of a strip; a strip has one line at least.
STRIP_PIXELS = 1 << 18
#: Modulus of the checksum of a zlib stream.
ADLER = 65521
PIXEL = ["frame", "row", "col", "r", "g", "b", "a"]


def _be32(n: Column) -> Column:
    return F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0"))


def _chunk(kind: str, data: Column) -> Column:
    """A chunk of a PNG file: length, kind, data, checksum."""
    body = F.concat(F.lit(kind).cast("binary"), data)
    return F.concat(_be32(F.octet_length(data)), body, _be32(F.crc32(body)))


def _bytes(text: str) -> Column:
    return F.unhex(F.lit(text))


def joined_adler(strips: Column) -> Column:
    """The Adler-32 of the bytes of all strips, from an array of (adler, size) in their order."""
    start = F.struct(F.lit(1).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))

    def step(acc: Column, s: Column) -> Column:
        low, high = s["adler"].bitwiseAND(F.lit(0xFFFF)), F.shiftright(s["adler"], 16)
        grown = F.pmod(s["size"], F.lit(ADLER)) * (acc["a"] - 1)
        return F.struct(F.pmod(acc["a"] + low - 1, F.lit(ADLER)).alias("a"), F.pmod(acc["b"] + high + grown, F.lit(ADLER)).alias("b"))

    return F.aggregate(strips, start, step, lambda acc: acc["b"] * 65536 + acc["a"])


def strips_of(pixels: DataFrame, extents: DataFrame, lines: int) -> DataFrame:
    """(frame, strip, data, adler, size): the compressed strips of ``lines`` lines each; pixels that are missing are transparent."""

    def draw(table):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        strip, width, height = table.column("strip")[0].as_py(), pc.max(table.column("width")).as_py(), pc.max(table.column("height")).as_py()
        first = strip * lines
        # each line begins with the number of its filter, 0 for none
        out = np.zeros((min(lines, height - first), 1 + 4 * width), np.uint8)
        real = table.filter(pc.is_valid(table.column("row")))
        row, col = real.column("row").to_numpy() - first, 1 + 4 * real.column("col").to_numpy()
        for k, c in enumerate("rgba"):
            out[row, col + k] = real.column(c).to_numpy()
        raw = out.tobytes()
        packer = zlib.compressobj(6, zlib.DEFLATED, -15)
        data = packer.compress(raw) + packer.flush(zlib.Z_FULL_FLUSH)
        kinds = pa.schema([("frame", pa.int64()), ("strip", pa.int64()), ("data", pa.binary()), ("adler", pa.int64()), ("size", pa.int64())])
        return pa.table({"frame": [table.column("frame")[0].as_py()], "strip": [strip], "data": [data], "adler": [zlib.adler32(raw)], "size": [len(raw)]}, kinds)

    number = F.floor(F.col("row") / lines).cast("long").alias("strip")
    own = pixels.select(*[F.col(c).cast("long" if c in PIXEL[:3] else "int").alias(c) for c in PIXEL], F.lit(None).cast("long").alias("width"), F.lit(None).cast("long").alias("height"))
    own = own.select("*", number)
    # one row for each strip says how large the picture is, so strips without pixels are drawn, too
    every = extents.select("frame", "width", "height", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("height") - 1) / lines).cast("long"))).alias("strip"))
    return own.unionByName(every, allowMissingColumns=True).groupBy("frame", "strip").applyInArrow(draw, "frame long, strip long, data binary, adler long, size long")


def png_pieces(pixels: DataFrame, strip_pixels: int = STRIP_PIXELS) -> DataFrame:
    """(frame, part, data): the pieces of a PNG file for each frame of (frame, row, col, r, g, b, a) rows.

    A task draws one strip at a time: about ``strip_pixels`` pixels, or one line
    where a line has more.  The picture ends at its last row and column; of a
    pixel that is given twice, one is drawn.
    """
    extents = cut(pixels.groupBy(F.col("frame").cast("long").alias("frame")).agg((F.max("row") + 1).cast("long").alias("height"), (F.max("col") + 1).cast("long").alias("width")))
    widest = extents.agg(F.max("width")).first()[0]
    strips = cut(strips_of(pixels, extents, max(1, strip_pixels // (widest or 1))))
    sums = strips.groupBy("frame").agg(joined_adler(F.sort_array(F.collect_list(F.struct("strip", "adler", "size")))).alias("adler"))
    head = F.concat(_bytes("89504E470D0A1A0A"), _chunk("IHDR", F.concat(_be32(F.col("width")), _be32(F.col("height")), _bytes("0806000000"))), _chunk("IDAT", _bytes("789C")))
    tail = F.concat(_chunk("IDAT", F.concat(_bytes("0300"), _be32(F.col("adler")))), _chunk("IEND", _bytes("")))
    body = strips.select("frame", F.col("strip").alias("part"), _chunk("IDAT", F.col("data")).alias("data"))
    ends = sums.select("frame", F.lit(1 << 62).alias("part"), tail.alias("data"))
    return extents.select("frame", F.lit(-1).cast("long").alias("part"), head.alias("data")).unionByName(body).unionByName(ends)


def write_png(pixels: DataFrame, folder: str, prefix: str = "frame-", mode: str = "append", strip_pixels: int = STRIP_PIXELS) -> None:
    """Writes ``<prefix><frame>.png`` for each frame of (frame, row, col, r, g, b, a) rows; see :func:`png_pieces` and :func:`.files.write_pieces`."""
    write_pieces(png_pieces(pixels, strip_pixels).withColumn("file", named(prefix, F.col("frame"), ".png")), folder, mode)


def read_png(spark, folder: str, prefix: str = "frame-") -> DataFrame:
    """frame, row, col, r, g, b, a of the files that :func:`write_png` made, each below 2 GB."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"{prefix}*.png").load(folder)
    number = F.regexp_extract("path", rf"/\Q{prefix}\E(-?[0-9]+|null)[.]png$", 1).try_cast("long")
    return png_pixels(files.select(number.alias("frame"), F.col("content").alias("png")))
