"""Files as a sink with commit and abort, and the headers of files as a source that reads by ranges.

`register(spark)` adds two formats. `tessera_files` writes (name, content) to `path`: each task to a
folder of its own in a staging folder, and the commit renames the folders of the tasks that
succeeded, one rename a task; retried tasks leave nothing behind and a failed job no file at all, also
if some of its tasks still run: only the driver makes the staging folder, and none can write once it's gone.
A null content writes no file; a name that a task has twice fails the job. `tessera_headers` gives
what the headers of the images under `path` say, and with option `metadata` what they carry: it
seeks from segment to segment and stops at the scan, so `bytes_read` doesn't grow with the images.
The driver only counts the files of each folder; a task gets shares of folders and lists them itself.
"""

from __future__ import annotations

import os
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tessera.sources.containers import FACTS, facts_in
from tessera.sources.metadata import METADATA, metadata_among

STAGING = "_staging-"
#: Segments that aren't metadata but tell what an image is.
FRAME_MARKERS = (0xFFC0, 0xFFC1, 0xFFDB)
METADATA_MARKERS = (0xFFE1, 0xFFE2)
#: Tasks that share one folder at most: each lists it whole, which is cheap beside reading a 32nd of its files.
SHARES = 32


class Written(WriterCommitMessage):
    """A task's folder."""

    def __init__(self, folder: str | None):
        self.folder = folder


class FileWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        """On the driver, as a job begins."""
        self.path, self.job = path.rstrip("/"), uuid.uuid4().hex
        fs, root = pafs.FileSystem.from_uri(self.staging)
        fs.create_dir(root, recursive=True)

    @property
    def staging(self) -> str:
        return f"{self.path}/{STAGING}{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        part = f"part-{uuid.uuid4().hex}"
        fs, root = pafs.FileSystem.from_uri(f"{self.staging}/{part}")
        names: set[str] = set()
        for batch in iterator:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if content is None:
                    continue
                if name in names or not name or "/" in name:
                    raise ValueError(f"no file can be named {name!r} here")
                if not names:
                    fs.create_dir(root, recursive=False)  # an error if the job has ended
                names.add(name)
                with fs.open_output_stream(f"{root}/{name}") as f:
                    f.write(content)
        return Written(part if names else None)

    def commit(self, messages: list) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        for m in messages:
            if m is not None and m.folder:
                fs.move(f"{root}/{STAGING}{self.job}/{m.folder}", f"{root}/{m.folder}")
        self.abort(messages)

    def abort(self, messages: list) -> None:
        fs, root = pafs.FileSystem.from_uri(self.staging)
        if fs.get_file_info(root).type == pafs.FileType.Directory:
            fs.move(root, f"{root}-ended")  # tasks that still run find no folder to write to
            fs.delete_dir(f"{root}-ended")


class Files(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tessera_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        if overwrite:
            raise ValueError("files are only added")
        return FileWriter(self.options["path"])


class Some(InputPartition):
    """(folder, k, n) each: the files right in the folder whose names fall into the k-th of n classes."""

    def __init__(self):
        self.shares: list[tuple[str, int, int]] = []


def entries(fs: pafs.FileSystem, folder: str) -> Iterator[tuple[str, bool]]:
    """(path, whether it's a folder) of the files and folders right in a folder, but staged ones; a local folder's aren't held at once."""
    if isinstance(fs, pafs.LocalFileSystem):
        with os.scandir(folder) as found:
            for x in found:
                if not x.name.startswith(STAGING) and ((is_folder := x.is_dir()) or x.is_file()):
                    yield x.path, is_folder
    else:
        for x in fs.get_file_info(pafs.FileSelector(folder)):
            if not x.base_name.startswith(STAGING) and x.type in (pafs.FileType.Directory, pafs.FileType.File):
                yield x.path, x.type == pafs.FileType.Directory


def segments_by_seeks(f, markers: tuple[int, ...]) -> tuple[list[tuple[int, int, bytes]], int]:
    """(place from 1, marker, payload) of segments with these markers up to the scan, and the bytes read."""
    size, read, found = f.size(), 0, []

    def take(at: int, n: int) -> bytes:
        nonlocal read
        data = f.read_at(min(n, max(0, size - at)), at)
        read += len(data)
        return data

    if take(0, 2) != b"\xff\xd8":
        return [], read
    at = 2
    while at < size and (some := take(at, 64)) and b"\xff" not in some:
        at += len(some)
    at += max(0, some.find(b"\xff")) if at < size else 0
    while at + 4 <= size:
        head = take(at, 4)
        marker, length = int.from_bytes(head[:2], "big"), int.from_bytes(head[2:], "big")
        if not 0xFF01 <= marker < 0xFFFF or length < 2 or at + 2 + length > size or marker == 0xFFDA:
            break
        if marker in markers:
            found.append((at + 1, marker, take(at + 4, length - 2)))
        at += 2 + length
    return found, read


class HeaderReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.files, self.metadata = options["path"].rstrip("/"), int(options.get("filesPerPartition", "1000")), options.get("metadata", "false").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        """What is held here grows with the folders and not with the files."""
        fs, root = pafs.FileSystem.from_uri(self.path)
        counts, folders = [], [root]
        while folders:
            folder, n = folders.pop(), 0
            for path, is_folder in entries(fs, folder):
                if is_folder:
                    folders.append(path)
                else:
                    n += 1
            if n:
                counts.append((folder, n))
        out, held = [], 0.0
        for folder, n in sorted(counts):
            parts = min(-(-n // self.files), SHARES)
            for k in range(parts):
                if not out or held + n / parts > self.files:
                    out.append(Some())
                    held = 0.0
                out[-1].shares.append((folder, k, parts))
                held += n / parts
        return out

    def read(self, partition: Some) -> Iterator[tuple]:
        fs, _ = pafs.FileSystem.from_uri(self.path)
        for folder, k, n in partition.shares if partition else ():
            for path, is_folder in entries(fs, folder):
                name = posixpath.basename(path)
                if is_folder or zlib.crc32(name.encode()) % n != k:
                    continue
                with fs.open_input_file(path) as f:
                    size = f.size()
                    found, read = segments_by_seeks(f, FRAME_MARKERS + (METADATA_MARKERS if self.metadata else ()))
                row = (path, name, size, read, *facts_in(found))
                yield (*row, *metadata_among(found)) if self.metadata else row


class Headers(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tessera_headers"

    def schema(self) -> str:
        more = ", ".join(f"{c} binary" for c in METADATA) if self.options.get("metadata", "false").lower() == "true" else ""
        return f"path string, name string, n_bytes long, bytes_read long, {FACTS}" + (f", {more}" if more else "")

    def reader(self, schema) -> HeaderReader:
        return HeaderReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Files)
    spark.dataSource.register(Headers)
