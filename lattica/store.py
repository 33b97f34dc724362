"""Tables written to the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tables written by this process that :func:`clear` removes.
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where none is set, a temporary one, but only if driver and executors are one process."""
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if known:
        return known
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="lattica-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it again: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _MADE.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def made() -> int:
    """How many tables there are; for :func:`release`."""
    return len(_MADE)


def release(spark: SparkSession, since: int, *keep: DataFrame) -> None:
    """Removes the tables made after there were ``since``, but for those of ``keep``, once nothing else needs them."""
    stay = {k.cut_path for k in keep}
    _remove(spark, [p for p in _MADE[since:] if p not in stay])
    _MADE[since:] = [p for p in _MADE[since:] if p in stay]


def _remove(spark: SparkSession, paths: list[str]) -> None:
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def put(spark: SparkSession, files: dict[str, bytes]) -> str:
    """Writes small files to a new folder in the shared one, through Hadoop's file systems; returns the folder."""
    folder = f"{shared_dir(spark).rstrip('/')}/put-{uuid.uuid4().hex}"
    conf, path = spark.sparkContext._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    system = path(folder).getFileSystem(conf)
    for name, data in files.items():
        out = system.create(path(f"{folder}/{name}"))
        out.write(bytearray(data))
        out.close()
    _MADE.append(folder)
    return folder


def clear(spark: SparkSession) -> int:
    """Removes all tables that :func:`cut` has written in this process, once the results made from them are stored; returns how many."""
    n = len(_MADE)
    _remove(spark, _MADE)
    _MADE.clear()
    return n


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder in the shared one for tasks to write files to; :func:`clear` removes it."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path
