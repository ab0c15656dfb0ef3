"""Files as they are: a sink of exact bytes under any names and in any code page, a listing by folder, and whole contents.

Spark's own text writer makes a folder for each value of a column, ends every text with
a line end and writes UTF-8. Here tasks take rows of (file, text, encoding), those of one
file next to each other, and write each file as it is to be, into a folder of their own
attempt. When all tasks are through, other tasks move the files of the attempts that
counted to their names, so that a reader never sees a part of a failed run and an attempt
that is repeated leaves nothing behind. The driver sees a folder for each task, no file.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator, Sequence
from itertools import islice

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: A task that reads contents hands on about so many bytes at a time.
READ_BYTES = 4 << 20


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def _attempt(batches: Iterator[pa.RecordBatch], run: str) -> Iterator[pa.RecordBatch]:
    """Writes a task's files into a new folder, and names it."""
    fs, root = _place(run)
    folder = f"{root}/{uuid.uuid4().hex}"
    name, out, made = None, None, set()
    for batch in batches:
        for file, text, encoding in zip(*(batch.column(c).to_pylist() for c in ("file", "text", "encoding"))):
            if file != name:
                if out is not None:
                    out.close()
                target = f"{folder}/{file}"
                parent = target.rpartition("/")[0]
                if parent not in made:
                    fs.create_dir(parent, recursive=True)
                    made.add(parent)
                name, out = file, fs.open_output_stream(target, compression=None)
            out.write((text or "").encode(encoding or "utf-8"))
    if out is not None:
        out.close()
        yield pa.RecordBatch.from_pydict({"folder": [folder]})


def _moved(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Moves the files of attempts to their places. A task that runs again goes on where the first one ended."""
    fs, root = _place(path)
    for batch in batches:
        for folder in batch.column("folder").to_pylist():
            files = [f.path for f in fs.get_file_info(pafs.FileSelector(folder, recursive=True)) if f.type == pafs.FileType.File]
            names = [f[len(folder) + 1 :] for f in files]
            for parent in {n.rpartition("/")[0] for n in names}:
                fs.create_dir(f"{root}/{parent}" if parent else root, recursive=True)
            for file, name in zip(files, names):
                try:
                    fs.move(file, f"{root}/{name}")
                except FileNotFoundError:  # another attempt of this task has moved it
                    if fs.get_file_info(f"{root}/{name}").type != pafs.FileType.File:
                        raise
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(files)], pa.int64())})


def write_files(rows: DataFrame, path: str) -> None:
    """Rows (file, text, encoding) to the files they name under ``path``. The rows of a file have to lie next to each other in one task; of several rows the texts follow each other. A null encoding is UTF-8; a file of that name that exists is replaced."""
    path = path.rstrip("/")
    run = f"{path}/_temporary-{uuid.uuid4().hex}"
    spark = rows.sparkSession
    try:
        # What a failed or repeated attempt wrote isn't among the results.
        folders = [tuple(r) for r in rows.select("file", "text", "encoding").mapInArrow(lambda b: _attempt(b, run), "folder string").collect()]
        if folders:
            spark.createDataFrame(folders, "folder string").repartition(len(folders)).mapInArrow(lambda b: _moved(b, path), "n long").collect()
    finally:
        fs, root = _place(run)
        if fs.get_file_info(root).type == pafs.FileType.Directory:
            fs.delete_dir(root)


LISTING = "pagewright_listing"
LISTED = "path string, length long, modified timestamp"


def _files(fs: pafs.FileSystem, root: str, recursive: bool) -> Iterator[tuple[str, int, int]]:
    """path, size, time in ns of a folder's files. Entries of a local folder come one after the other; of other stores a folder's whole list is held."""
    if not isinstance(fs, pafs.LocalFileSystem):
        yield from ((f.path, f.size, f.mtime_ns) for f in fs.get_file_info(pafs.FileSelector(root, recursive=recursive)) if f.type == pafs.FileType.File)
        return
    folders = [root]
    while folders:
        folder = folders.pop()
        try:
            entries = os.scandir(folder)
        except FileNotFoundError:  # gone since its own folder was listed
            if folder == root:
                raise
            continue
        with entries:
            for entry in entries:
                if entry.is_dir():
                    folders += [entry.path] * recursive
                elif entry.is_file():
                    try:
                        at = entry.stat()
                    except FileNotFoundError:
                        continue
                    yield entry.path, at.st_size, at.st_mtime_ns


def _folders(fs: pafs.FileSystem, root: str) -> list[str]:
    """The folders in a folder; its files aren't kept."""
    if not isinstance(fs, pafs.LocalFileSystem):
        return [f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.type == pafs.FileType.Directory]
    with os.scandir(root) as entries:
        return [entry.path for entry in entries if entry.is_dir()]


class Folder(InputPartition):
    def __init__(self, path: str, recursive: bool):
        self.path, self.recursive = path, recursive


class ListingReader(DataSourceReader):
    """The driver lists the top folders alone; each folder below is walked by a task."""

    def __init__(self, paths: list[str], recursive: bool):
        self.paths, self.recursive = paths, recursive

    def partitions(self) -> list[Folder]:
        out = []
        for path in self.paths:
            fs, root = _place(path)
            base = path[: len(path) - len(root)]
            out.append(Folder(path, False))
            if self.recursive:
                out += [Folder(base + f, True) for f in _folders(fs, root)]
        return out

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        fs, root = _place(partition.path)
        found = _files(fs, root, partition.recursive)
        base = partition.path[: len(partition.path) - len(root)]
        while some := list(islice(found, 8192)):
            times = pa.array([ns // 1000 for *_, ns in some], pa.int64()).cast(pa.timestamp("us", "UTC"))
            yield pa.RecordBatch.from_pydict({"path": [base + path for path, *_ in some], "length": pa.array([size for _, size, _ in some], pa.int64()), "modified": times})


class Listing(DataSource):
    @classmethod
    def name(cls) -> str:
        return LISTING

    def schema(self) -> str:
        return LISTED

    def reader(self, schema: StructType) -> ListingReader:
        return ListingReader(json.loads(self.options["paths"]), self.options.get("recursive", "true") == "true")


def list_files(spark: SparkSession, paths: str | Sequence[str], recursive: bool = True) -> DataFrame:
    """path, length, modified of all files under some folders, empty ones too."""
    spark.dataSource.register(Listing)
    names = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.format(LISTING).option("paths", json.dumps([p.rstrip("/") for p in names])).option("recursive", str(recursive).lower()).load()


def spread(files: DataFrame) -> DataFrame:
    """A listing dealt out over all tasks by path, however few folders it comes from and however small its rows are."""
    return files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")


def open_file(path: str) -> pa.NativeFile:
    fs, root = _place(path)
    return fs.open_input_stream(root, compression=None)


def read_files(spark: SparkSession, paths: str | Sequence[str], recursive: bool = True) -> DataFrame:
    """path, length, content of all files under some folders, empty ones too. Tasks read them; Spark's own reader has the driver list every file and passes over empty ones."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[str] = []
        contents: list[bytes] = []
        size = 0

        def ready() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"path": pa.array(names, pa.string()), "length": pa.array([len(c) for c in contents], pa.int64()), "content": pa.array(contents, pa.binary())})

        for batch in batches:
            for path in batch.column("path").to_pylist():
                with open_file(path) as file:
                    contents.append(file.read())
                names.append(path)
                size += len(contents[-1]) + 200
                if size > READ_BYTES:
                    yield ready()
                    names, contents, size = [], [], 0
        yield ready()

    return spread(list_files(spark, paths, recursive).select("path")).mapInArrow(read, "path string, length long, content binary")
