"""Files written from ordered pieces, each by one task that holds a batch of pieces at a time."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .npy import located


@dataclass
class _Written(WriterCommitMessage):
    """Where an attempt put its files, by their final names."""

    folder: str
    names: list[str] = field(default_factory=list)


class PieceWriter(DataSourceArrowWriter):
    """Each attempt of a task writes to a folder of its own below one of the job; files are moved out of it once all tasks are done."""

    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite = folder.rstrip("/"), overwrite
        self.pending = f"{self.folder}/_pending-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        done = _Written(f"{self.pending}/{uuid.uuid4().hex}")
        system, inner = located(done.folder)
        out = None
        try:
            for batch in iterator:
                for name, data in zip(batch.column("file"), batch.column("data"), strict=True):
                    name = name.as_py()
                    if not done.names or name != done.names[-1]:
                        if out is not None:
                            out.close()
                        if not name or {"", ".", ".."} & set(name.split("/")):
                            raise ValueError(f"not the name of a file: {name!r}")
                        system.create_dir(f"{inner}/{name}".rpartition("/")[0], recursive=True)
                        out = system.open_output_stream(f"{inner}/{name}")
                        done.names.append(name)
                    if data.is_valid:
                        out.write(data.as_buffer())
        finally:
            if out is not None:
                out.close()
        return done

    def commit(self, messages: list[_Written | None]) -> None:
        system, inner = located(self.folder)
        moves = [(m.folder, n) for m in messages if m is not None for n in m.names]
        if len({n for _, n in moves}) < len(moves):
            self.abort(messages)
            raise ValueError("pieces of one file were given to several tasks, or out of order")
        system.create_dir(inner, recursive=True)
        for folder, name in moves:
            target = f"{inner}/{name}"
            system.create_dir(target.rpartition("/")[0], recursive=True)
            system.move(f"{located(folder)[1]}/{name}", target)
        self._discard()
        if self.overwrite:
            self._remove_others({f"{inner}/{n}" for _, n in moves})

    def abort(self, messages: list[_Written | None]) -> None:
        self._discard()

    def _discard(self) -> None:
        from pyarrow import fs

        system, inner = located(self.pending)
        if system.get_file_info(inner).type == fs.FileType.Directory:
            system.delete_dir(inner)

    def _remove_others(self, keep: set[str]) -> None:
        from pyarrow import fs

        system, inner = located(self.folder)
        for f in system.get_file_info(fs.FileSelector(inner, recursive=True)):
            if f.is_file and f.path not in keep:
                system.delete_file(f.path)


class PieceSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pieces"

    def writer(self, schema, overwrite: bool) -> PieceWriter:
        return PieceWriter(self.options["path"], overwrite)


def write_pieces(pieces: DataFrame, folder: str, mode: str = "append") -> None:
    """Writes (file, part, data) rows as files: the data of each ``file``, a name below ``folder``, in order of ``part``.

    Pieces may be made by any number of tasks; a file is put together by one,
    which holds no more than a batch of its pieces.  Null data are empty.
    ``append`` replaces files of the same name and ``overwrite`` removes all
    others, too; a write that fails leaves the folder as it was.  ``folder`` is
    a path that pyarrow opens and that driver and executors share.
    """
    pieces.sparkSession.dataSource.register(PieceSink)
    dealt = pieces.repartition("file").sortWithinPartitions("file", "part")
    dealt.select("file", F.col("data").cast("binary").alias("data")).write.format("pieces").mode(mode).save(folder)


def named(prefix: str, key: Column, suffix: str) -> Column:
    """The name of a key's file; the null key has one, too."""
    return F.concat(F.lit(prefix), F.coalesce(key.cast("string"), F.lit("null")), F.lit(suffix))
