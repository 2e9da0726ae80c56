"""A sink that writes one file for each name and shows files only once the whole job has succeeded."""

from __future__ import annotations

import gzip
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from lowtide.sources.files import store

FORMAT = "grouped_files"
STAGING = "_staging-"


@dataclass
class Written(WriterCommitMessage):
    """(file name, its place in the staging folder) of what one task has written."""

    files: list[tuple[str, str]] = field(default_factory=list)


class GroupedFilesWriter(DataSourceArrowWriter):
    """Rows (name, value), those of a name together and in order, to one text file a name.

    A task writes to a folder of its own inside a staging folder. When all have succeeded, earlier files go where the
    mode is overwrite, and the files of the tasks that count are moved to their names; what failed or repeated attempts
    have left goes with the staging folder. After a failure the target is as it was.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.head, self.between, self.tail = options.get("head", ""), options.get("between", "\n"), options.get("tail", "\n")
        self.extension, self.zipped = options.get("extension", ""), options.get("compression", "none") == "gzip"
        self.staging = f"{STAGING}{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = store(self.path)
        folder = f"{root}/{self.staging}/{uuid.uuid4().hex}"
        done, name, out, sink = Written(), None, None, None

        def close() -> None:
            if out is not None:
                out.write(self.tail.encode())
                out.close()
                if sink is not out:
                    sink.close()

        try:
            for batch in iterator:
                columns = {n: batch.column(k).to_pylist() for k, n in enumerate(batch.schema.names)}
                for key, value in zip(columns["name"], columns["value"]):
                    if key is None:
                        raise ValueError("a file needs a name")
                    if key != name:
                        close()
                        out = None
                        if not done.files:
                            files.create_dir(folder, recursive=True)
                        place = f"{folder}/{len(done.files)}"
                        done.files.append((quote(key, safe=" +,=@") + self.extension, place))
                        sink = files.open_output_stream(place, compression=None)
                        out = gzip.GzipFile(fileobj=_Unclosed(sink), mode="wb", mtime=0) if self.zipped else sink
                        out.write(self.head.encode())
                        name = key
                    else:
                        out.write(self.between.encode())
                    out.write((value or "").encode())
        finally:
            close()
        return done

    def commit(self, messages: list[Written | None]) -> None:
        files, root = store(self.path)
        moved = [f for m in messages if m is not None for f in m.files]
        if len({name for name, _ in moved}) < len(moved):
            self.abort(messages)
            raise ValueError("rows of one file were in several tasks")
        files.create_dir(root, recursive=True)
        if self.overwrite:
            for info in files.get_file_info(arrow_fs.FileSelector(root)):
                if info.type == arrow_fs.FileType.File:
                    files.delete_file(info.path)
        for name, place in moved:
            files.move(place, f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        files, root = store(self.path)
        if files.get_file_info(f"{root}/{self.staging}").type == arrow_fs.FileType.Directory:
            files.delete_dir(f"{root}/{self.staging}")


class _Unclosed(io.RawIOBase):
    """Passes bytes on to an Arrow stream, which the writer closes itself."""

    def __init__(self, sink):
        self.sink = sink

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.sink.write(bytes(data))
        return len(data)


class GroupedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, value string"

    def writer(self, schema, overwrite: bool) -> GroupedFilesWriter:
        return GroupedFilesWriter(dict(self.options), overwrite)


def write_files(
    rows: DataFrame, path: str, name: Column, value: Column, order: list[str], mode: str = "overwrite",
    head: str = "", between: str = "\n", tail: str = "\n", extension: str = "", compression: str = "none",
) -> None:
    """One file for each ``name``, its values by ``order`` with ``between`` in between. Files appear when all are written;
    a second run gives the same files. A file is written by one task, as it streams by."""
    rows.sparkSession.dataSource.register(GroupedFiles)
    keyed = rows.select(name.cast("string").alias("name"), value.cast("string").alias("value"), *[F.col(c).alias(f"_by{k}") for k, c in enumerate(order)])
    ordered = keyed.repartition("name").sortWithinPartitions("name", *[f"_by{k}" for k in range(len(order))]).select("name", "value")
    options = {"head": head, "between": between, "tail": tail, "extension": extension, "compression": compression}
    ordered.write.format(FORMAT).mode(mode).options(**options).save(path)
