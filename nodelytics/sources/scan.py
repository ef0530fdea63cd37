"""Trees and files as tables, listed and read by executors: nothing is listed at the driver, and an error is a row.

``walk`` goes down a tree in rounds.  A round's folders are a DataFrame, dealt over the executors, each of which
lists the folders it gets; the folders that it finds are the next round's.  So a tree of any size takes as many
rounds as it is deep.  Where the file system has them, device, inode and allocated bytes come with each entry.

``file_heads`` reads the first bytes of files and tells ``absent``, ``empty``, ``readable``, ``truncated`` and
``unreadable`` apart, where a reader of Spark fails the job; ``confirmed_gone`` and ``retained`` withdraw values only
when a source is confirmed absent or empty and never on an error.

Paths are those of ``pyarrow.fs``, for all executors alike.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .scratch import Scratch

ENTRY = "path string, is_dir boolean, is_regular boolean, size long, mtime timestamp, device long, inode long, alloc_bytes long, error string"
HEADS = "path string, state string, head string, size long, mtime timestamp, error string"


def _open(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)


def _table(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "timestamp": pa.timestamp("us", "UTC")}
    fields = [c.split() for c in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[t]) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


def _local(path: str) -> Iterator[tuple]:
    with os.scandir(path) as entries:
        for e in entries:
            try:
                s = e.stat(follow_symlinks=False)
                yield e.path, e.is_dir(follow_symlinks=False), e.is_file(follow_symlinks=False), s.st_size, s.st_mtime_ns // 1000, s.st_dev, s.st_ino, s.st_blocks * 512, None
            except OSError as x:
                yield e.path, False, False, None, None, None, None, None, type(x).__name__


def _listed(path: str) -> list[tuple]:
    fs, at = _open(path)
    try:
        if isinstance(fs, pyarrow.fs.LocalFileSystem):
            return list(_local(at))
        kind = pyarrow.fs.FileType
        return [(i.path, i.type == kind.Directory, i.type == kind.File, i.size, None if i.mtime_ns is None else i.mtime_ns // 1000, None, None, i.size, None) for i in fs.get_file_info(pyarrow.fs.FileSelector(at))]
    except OSError as x:
        return [(path, True, False, None, None, None, None, None, type(x).__name__)]


def walk(roots: DataFrame, column: str = "path", parts: int = 64) -> DataFrame:
    """``ENTRY`` of everything below the folders that ``roots`` names, links not followed.

    A folder that cannot be listed is a row with its error, and the rest is listed all the same.
    """
    spark = roots.sparkSession
    scratch = Scratch(spark, "walk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                if rows := _listed(path):
                    yield _table(rows, ENTRY)

    frontier = roots.select(F.col(column).alias("path")).filter("path is not null").distinct()
    depth = 0
    while True:
        made = scratch.write(frontier.repartition(parts, "path").mapInArrow(run, ENTRY), f"depth={depth}", ENTRY)
        frontier = made.filter("is_dir and error is null").select("path")
        depth += 1
        if frontier.isEmpty():
            return scratch.read("depth=*", ENTRY)


def file_heads(paths: DataFrame, n: int = 4096, column: str = "path", parts: int = 64, keep: Sequence[str] = ()) -> DataFrame:
    """``HEADS`` of each path that is not null, and the columns ``keep`` of its row, which so need no join by path."""

    def read(path: str) -> tuple:
        fs, at = _open(path)
        size = mtime = None
        try:
            info = fs.get_file_info(at)
            if info.type == pyarrow.fs.FileType.NotFound:
                gone = not (isinstance(fs, pyarrow.fs.LocalFileSystem) and os.path.lexists(at))  # a link to nothing is there
                return path, "absent" if gone else "unreadable", "", None, None, None if gone else "FileNotFoundError"
            size, mtime = info.size, None if info.mtime_ns is None else info.mtime_ns // 1000
            with fs.open_input_stream(at) as f:
                head = f.read(n + 1)
        except OSError as x:
            return path, "unreadable", "", size, mtime, type(x).__name__
        state = "empty" if not head else "truncated" if len(head) > n else "readable"
        return path, state, head[:n].decode("utf-8", "replace"), size, mtime, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                heads = _table([read(p) for p in batch.column(0).to_pylist()], HEADS)
                yield pa.RecordBatch.from_arrays([*heads.columns, *batch.columns[1:]], names=[*heads.schema.names, *keep])

    rows = paths.select(F.col(column).alias("path"), *keep).filter("path is not null")
    return rows.repartition(parts, "path").mapInArrow(run, StructType([*StructType.fromDDL(HEADS), *rows.schema[1:]]))


def confirmed_gone(states: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sources ``by`` of which every file is absent or empty; one that could not be read proves nothing."""
    gone = F.bool_and(F.col("state").isin("absent", "empty"))
    return states.groupBy(*by).agg(gone.alias("_gone")).filter("_gone").drop("_gone")


def retained(current: DataFrame, states: DataFrame, by: Sequence[str]) -> DataFrame:
    """``current`` without the values of sources that are confirmed gone."""
    return current.join(confirmed_gone(states, by), list(by), "left_anti")


def tree(spark: SparkSession, *roots: str, parts: int = 64) -> DataFrame:
    return walk(spark.createDataFrame([(r,) for r in roots], "path string"), parts=parts)
