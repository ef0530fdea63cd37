"""Hourly log files that still grow, as a stream: each committed line once.

The layout is ``<root>/<node>/<stream>/hourly/<YYYYMMDD>/<H>``.  An offset holds, per folder of a node's
stream, the size of its newest ``KEPT`` files, so it does not grow with history, and it is made of a
listing alone.  A batch is the bytes between two offsets.  A line belongs to the range in which its
newline stands: a task looks back from the start of its range for the start of the first line and
drops what follows the last newline, which the range of a later batch will hold.  So an unterminated
tail is held back until it is terminated, whatever batch or task a line crosses, and a batch that
is repeated after a failure gives the same lines.

* A file that is no longer among the newest is drained to its end; files that appeared and aged
  between two batches are read whole.  A tail that is then still unterminated is one reject.
* A file that became shorter, or whose first bytes differ, was replaced and is read from its start.
* A line of more than ``record_cap`` bytes is one reject; no more than that is held in memory.
* ``history``: ``skip`` takes what is there at the first start as read, ``replay`` reads it.
  Folders that appear later are read from their start.

Paths are those of ``pyarrow.fs`` (local, object stores, HDFS), for the driver and all executors alike.
A file that cannot be read fails the batch, which is then repeated; it is never skipped.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .readers import RECORD_CAP

SCHEMA = "node_id string, stream string, file_date string, file_hour int, file_path string, pos long, line string, reason string"
#: Newest files of a folder whose sizes are in an offset; bytes of one task; bytes of one read; first bytes that tell a file from its replacement.
KEPT, TASK_BYTES, READ_BYTES, HEAD = 2, 64 << 20, 1 << 20, 64
#: Lines of one Arrow batch; files of one task.
BATCH_LINES, TASK_FILES = 10_000, 256


@dataclass
class Range:
    """Bytes ``start`` to ``end`` of a file; ``closed``: the file ends there for good."""

    path: str
    node: str
    date: str
    hour: int
    start: int
    end: int
    closed: bool


@dataclass
class Ranges(InputPartition):
    """What one task reads: many small files, or a part of a large one."""

    parts: list[Range]


def packed(ranges: list[Range], task_bytes: int) -> list[Ranges]:
    made, held, size = [], [], 0
    for r in ranges:
        if held and (size + r.end - r.start > task_bytes or len(held) == TASK_FILES):
            made.append(Ranges(held))
            held, size = [], 0
        held, size = [*held, r], size + r.end - r.start
    return [*made, Ranges(held)] if held else made


def _line_start(f, start: int, cap: int) -> tuple[int, bytes | None]:
    """Where the line that crosses ``start`` begins, and its bytes up to there (None: more than the cap)."""
    at, held = start, b""
    while at:
        step = min(at, READ_BYTES)
        f.seek(at - step)
        part = f.read(step)
        cut = part.rfind(b"\n")
        at -= step - (cut + 1)
        if held is not None:
            held = part[cut + 1 :] + held
            held = held if len(held) <= cap else None
        if cut >= 0:
            break
    return at, held


def lines_of(f, start: int, end: int, cap: int) -> Iterator[tuple[int, bytes | None]]:
    """``(position, line)`` of the lines whose newline stands in ``[start, end)``; a line over the cap is None.

    Last comes the position of what is not terminated before ``end``.
    """
    held: list[bytes] | None = []  # pieces of the open line that stand in the range; None: over the cap
    size, begin, place = 0, None, start
    while place < end:
        f.seek(place)
        part = f.read(min(READ_BYTES, end - place))
        if not part:
            break
        place += len(part)
        at = place - len(part)
        for i, piece in enumerate(pieces := part.split(b"\n")):
            size, at = size + len(piece), at + len(piece)
            if size > cap:
                held = None
            elif held is not None:
                held.append(piece)
            if i == len(pieces) - 1:
                break
            line = None if held is None else b"".join(held)
            if begin is None:  # the first line of the range may begin before it
                begin, before = _line_start(f, start, cap)
                line = None if line is None or before is None or len(before) + len(line) > cap else before + line
            yield begin, line
            at += 1
            held, size, begin = [], 0, at
    yield _line_start(f, start, cap)[0] if begin is None else begin, None


class GrowingLines(DataSource):
    """``spark.readStream.format("growing_lines")`` with the options root, stream, history, record_cap, task_bytes."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return GrowingReader(dict(self.options))


class GrowingReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.stream = options["root"].rstrip("/"), options["stream"]
        self.history = options.get("history", "skip")
        self.cap, self.task_bytes = int(options.get("record_cap", RECORD_CAP)), int(options.get("task_bytes", TASK_BYTES))
        if self.history not in ("skip", "replay"):
            raise ValueError("history is skip or replay")

    def _open(self) -> tuple[pyarrow.fs.FileSystem, str]:
        return pyarrow.fs.FileSystem.from_uri(self.root) if "://" in self.root else (pyarrow.fs.LocalFileSystem(), self.root)

    @staticmethod
    def _listed(fs, path: str) -> list[pyarrow.fs.FileInfo]:
        return fs.get_file_info(pyarrow.fs.FileSelector(path, allow_not_found=True))

    def _hours(self, fs, folder: str, since: str = "") -> list[tuple[str, int, pyarrow.fs.FileInfo]]:
        """The hour files of a folder from a date on, oldest first."""
        dates = sorted(d.base_name for d in self._listed(fs, folder) if d.type == pyarrow.fs.FileType.Directory and d.base_name.isdigit() and d.base_name >= since)
        found = [(d, int(f.base_name), f) for d in dates for f in self._listed(fs, f"{folder}/{d}") if f.type == pyarrow.fs.FileType.File and f.base_name.isdigit()]
        return sorted(found, key=lambda x: x[:2])

    def _newest(self, fs, folder: str) -> list[tuple[str, int, pyarrow.fs.FileInfo]]:
        """The newest files of a folder, from as few dates as hold them."""
        dates = sorted((d.base_name for d in self._listed(fs, folder) if d.type == pyarrow.fs.FileType.Directory and d.base_name.isdigit()), reverse=True)
        found: list = []
        for d in dates:
            found += [(d, int(f.base_name), f) for f in self._listed(fs, f"{folder}/{d}") if f.type == pyarrow.fs.FileType.File and f.base_name.isdigit()]
            if len(found) >= KEPT:
                break
        return sorted(found, key=lambda x: x[:2])[-KEPT:]

    def latestOffset(self) -> dict:
        fs, root = self._open()

        def folder(node: str) -> tuple[str, dict]:
            files = {}
            for date, hour, info in self._newest(fs, f"{root}/{node}/{self.stream}/hourly"):
                head = -1
                if info.size >= HEAD:
                    with fs.open_input_file(info.path) as f:
                        head = zlib.crc32(f.read(HEAD))
                files[f"{date}/{hour}"] = {"size": info.size, "head": head}
            return node, files

        nodes = [d.base_name for d in self._listed(fs, root) if d.type == pyarrow.fs.FileType.Directory]
        with ThreadPoolExecutor(16) as pool:
            return {"nodes": {n: files for n, files in pool.map(folder, sorted(nodes)) if files}}

    def initialOffset(self) -> dict:
        return self.latestOffset() if self.history == "skip" else {"nodes": {}}

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        fs, root = self._open()
        made: list[Range] = []
        order = lambda name: (name.split("/")[0], int(name.split("/")[1]))
        for node, now in end["nodes"].items():
            folder = f"{root}/{node}/{self.stream}/hourly"
            before = start["nodes"].get(node, {})
            oldest = min(map(order, now))
            known = [order(n) for n in before]
            if not before or min(known) < oldest:
                # files that are not among the newest any more, and those that came and went in between
                for date, hour, info in self._hours(fs, folder, min(known)[0] if known else ""):
                    name = f"{date}/{hour}"
                    if (date, hour) < oldest and (not known or (date, hour) >= min(known)):
                        made += self._ranges(info.path, node, date, hour, before.get(name, {"size": 0})["size"], info.size, True)
            for name, is_ in now.items():
                was = before.get(name, {"size": 0, "head": -1})
                replaced = is_["size"] < was["size"] or (was["head"] != -1 and is_["head"] != was["head"])
                made += self._ranges(f"{folder}/{name}", node, *order(name), 0 if replaced else was["size"], is_["size"], False)
        return packed(made, self.task_bytes)

    def _ranges(self, path: str, node: str, date: str, hour: int, start: int, end: int, closed: bool) -> list[Range]:
        if start >= end and not closed:
            return []
        cuts = [*range(start, end, self.task_bytes), end] if start < end else [start, end]
        return [Range(path, node, date, hour, a, z, closed and z == end) for a, z in zip(cuts, cuts[1:], strict=False)]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        fs, _ = self._open()
        for part in partition.parts:
            yield from self._read(fs, part)

    def _read(self, fs, part: Range) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple[int, str | None, str | None]]) -> pa.RecordBatch:
            same = lambda value, kind: pa.array([value] * len(rows), kind)
            columns = [same(part.node, pa.string()), same(self.stream, pa.string()), same(part.date, pa.string()), same(part.hour, pa.int32()), same(part.path, pa.string())]
            kinds = (pa.int64(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([*columns, *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=[c.split()[0] for c in SCHEMA.split(", ")])

        rows: list = []
        with fs.open_input_file(part.path) as f:
            found = lines_of(f, part.start, part.end, self.cap)
            last = next(found)
            for following in found:
                at, line = last
                rows.append((at, None, "record_too_long") if line is None else (at, line.decode("utf-8", "replace"), None))
                last = following
                if len(rows) >= BATCH_LINES:
                    yield batch(rows)
                    rows = []
            if part.closed and last[0] < part.end:
                rows.append((last[0], None, "torn_tail"))
        if rows:
            yield batch(rows)


def read_growing(spark: SparkSession, root: str, stream: str, history: str = "skip", **options) -> tuple[DataFrame, DataFrame]:
    """Lines of growing hourly files as a stream ``(node_id, stream, file_date, file_hour, file_path, pos, line)``, and rejects ``(..., stage, reason)``."""
    spark.dataSource.register(GrowingLines)
    rows = spark.readStream.format("growing_lines").options(root=root, stream=stream, history=history, **options).load()
    return rows.filter("reason is null").drop("reason"), rows.filter("reason is not null").drop("line").withColumn("stage", F.lit("read"))
