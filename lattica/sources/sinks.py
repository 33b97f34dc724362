"""CSV, JSON, PNG and array file output."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.color import png_planes
from ..functions.text import csv_line
from ..operators.control import capped
from .files import named, write_pieces
from .npy import create


def csv_lines(df: DataFrame, columns: list[str], index: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """One line of CSV for each row (column ``line``), with the index first; :func:`csv_header` is the first line.  ``keep`` are columns beside it."""
    cells = [F.col(c).cast("string") for c in ([index] if index else []) + columns]
    return df.select(*([F.col(index)] if index and keep is None else []), *(keep or []), csv_line(cells).alias("line"))


def csv_header(columns: list[str], index: bool = True) -> str:
    return ",".join(([""] if index else []) + columns)


def csv_text(df: DataFrame, columns: list[str], index: str) -> DataFrame:
    """A window (a page of rows) as one CSV text, for the clipboard."""
    lines = csv_lines(df, columns, index)
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(index, "line"))), lambda x: x["line"]), "\n")
    return lines.agg(capped(F.concat(F.lit(csv_header(columns) + "\n"), body)).alias("text"))


def write_csv(df: DataFrame, path: str, columns: list[str], index: str) -> None:
    """Writes lines of CSV as text files, in index order across files."""
    csv_lines(df, columns, index).orderBy(index).select("line").write.mode("overwrite").text(path)


def write_csv_files(df: DataFrame, folder: str, columns: list[str], index: str, by: str, prefix: str = "", mode: str = "append") -> None:
    """Writes one CSV file with a header for each value of ``by``, ``<prefix><value>.csv``, its lines in order of ``index``.

    A file is streamed by one task, whose sort spills; :func:`write_csv` is for
    tables that need several tasks for one value.
    """
    name = named(prefix, F.col(by), ".csv").alias("file")
    rows = csv_lines(df.select("*", name, F.struct(F.lit(1).alias("section"), F.col(index).alias("at")).alias("part")), columns, index, keep=["file", "part"])
    kind = dict(df.dtypes)[index]
    heads = df.select(name).distinct().select("file", F.struct(F.lit(0).alias("section"), F.lit(None).cast(kind).alias("at")).alias("part"), F.lit(csv_header([index, *columns], False)).alias("line"))
    write_pieces(heads.unionByName(rows).select("file", "part", F.concat("line", F.lit("\n")).alias("data")), folder, mode)


def json_result(df: DataFrame) -> DataFrame:
    """Rows as JSON objects; numbers that are not finite become null, as JSON has none."""
    safe = [F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    return df.select(capped(F.to_json(F.struct(*safe), {"ignoreNullFields": "false"})).alias("json"))


def png_files(pixels: DataFrame) -> DataFrame:
    """Planes of r, g, b, a pixels as PNG binaries, one row for each frame."""
    return png_planes(pixels)


def write_npy(df: DataFrame, folder: str, descr, width: int | None = None, fortran: bool = False) -> int:
    """Writes one ``.npy`` file for each value of ``file``, in order of ``at``, from executors; returns how many.

    The other columns are the values: one for plain types, real and imaginary
    part for complex ones, one a field where ``descr`` is a list of fields.
    With ``width`` the array has that many columns.  A file is made by one task
    and has to fit in it; a task that runs again writes the same file.
    ``folder`` is a path that pyarrow opens.
    """
    import numpy as np
    import pandas as pd

    values = [c for c in df.columns if c not in ("file", "at")]

    def save(pdf: pd.DataFrame) -> pd.DataFrame:
        import io

        pdf = pdf.sort_values("at")
        kind = np.dtype(descr)
        if kind.fields:
            a = np.zeros(len(pdf), kind)
            for c in values:
                a[c] = pdf[c].tolist()
        elif kind.kind == "c":
            a = (pdf[values[0]].to_numpy(float) + 1j * pdf[values[1]].to_numpy(float)).astype(kind)
        else:
            own = pdf[values[0]].to_numpy()
            a = own.astype("i8").view(f"M8{kind.str[3:]}").astype(kind) if kind.kind == "M" else own.astype(kind)
        a = a if width is None else a.reshape(-1, width)
        out = io.BytesIO()
        np.save(out, np.asfortranarray(a) if fortran else a)
        create(f"{folder}/{pdf['file'].iloc[0]}.npy", out.getvalue())
        return pd.DataFrame({"n": [len(pdf)]})

    return df.groupBy("file").applyInPandas(save, "n long").count()
