"""Sinks.  Partitions of the metric table are replaced by one job; generations become visible by one rename."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import generations


def metric(df: DataFrame, name: str, kind: str, labels: list[str], value: Column, ts: str = "ts", node: str = "node_id") -> DataFrame:
    """Rows of the long metric table."""
    pairs = [x for label in labels for x in (F.lit(label), F.col(label).cast("string"))]
    made = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return df.select(F.lit(name).alias("metric"), F.lit(kind).alias("kind"), made.alias("labels"), F.col(ts).cast("timestamp").alias("ts"), value.cast("double").alias("value"), F.col(node).alias("node_id"))


def write_metrics(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Partitioned by metric and date; only the partitions of this generation are replaced."""
    df.withColumn("date", F.to_date("ts")).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("metric", "date").parquet(path)


def metrics_to(path: str):
    """For ``foreachBatch``: each batch is a generation of its own, of which a reader sees one; see ``generations``."""
    return generations.generations_to(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).json(path)


def write_validator_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """``ip,moniker,address,vp`` with a header; ``vp`` is left empty."""
    df.select("ip", "moniker", "address", F.lit("").alias("vp")).write.mode(mode).option("header", True).option("emptyValue", "").csv(path)


def write_lines(df: DataFrame, column: str, path: str, mode: str = "error") -> None:
    """One value a line; empty ones go."""
    df.select(F.col(column).cast("string")).filter(F.col(column).isNotNull() & (F.col(column) != "")).write.mode(mode).text(path)


#: Rows that one task puts in order for files of given names.
PIECE_ROWS = 500_000


def write_named_files(df: DataFrame, root: str, path: str = "path", line: str = "line", order: Sequence[str] = (), end: str | None = None) -> int:
    """Lines as files of given names below ``root``, as a node writes them; the number of files.

    Rows go to tasks by ranges of name and order, so a long file is put in order by many.  A task writes a file as its rows come,
    beside ``root``.  Names between its first and its last are whole and are moved into place at once; of those two other tasks may
    have more, so their pieces are then moved or copied to their names one after the other, and at most two a task are left for the
    driver to delete.  No file is held in memory, and a repeated task leaves whole files.  ``end`` is the column of what follows a
    line (a newline without it).
    """
    at = f"{root}-pieces-{uuid.uuid4().hex}"

    def opened() -> tuple[pyarrow.fs.FileSystem, str, str]:
        if "://" in root or root.startswith("file:"):
            fs, home = pyarrow.fs.FileSystem.from_uri(root)
            return fs, home, home + at.removeprefix(root)
        return pyarrow.fs.LocalFileSystem(), root, at

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, home, pieces = opened()
        own = uuid.uuid4().hex  # tasks that make files in one folder wait for each other
        fs.create_dir(f"{pieces}/{own}", recursive=True)
        now, out, cut, whole, folder = None, None, [], 0, None
        for batch in batches:
            for name, text, tail in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                if out is None or name != now:
                    if out is not None:
                        out.close()
                        if cut:
                            folder = place(fs, f"{pieces}/{piece}", f"{home}/{now}", folder)
                            whole += 1
                        else:
                            cut.append((now, piece))
                    now, piece = name, f"{own}/{uuid.uuid4().hex}"
                    out = fs.open_output_stream(f"{pieces}/{piece}")
                out.write((text or "").encode() + (tail or "").encode())
        if out is not None:
            out.close()
            cut.append((now, piece))
            names, made = zip(*cut, strict=True)
            part = [TaskContext.get().partitionId()] * len(cut)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(part, pa.int32()), pa.array(made, pa.string()), pa.array([0] * (len(cut) - 1) + [whole], pa.int64())], names=["path", "part", "piece", "whole"])

    def place(fs: pyarrow.fs.FileSystem, piece: str, file: str, made: str | None) -> str:
        """Moves a whole file to its name; its folder is made unless it is ``made``."""
        if (folder := file.rpartition("/")[0]) != made:
            fs.create_dir(folder, recursive=True)
        fs.move(piece, file)
        return folder

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, home, pieces = opened()
        for batch in batches:
            for name, parts in zip(*[batch.column(i).to_pylist() for i in range(2)], strict=True):
                whole = f"{pieces}/{uuid.uuid4().hex}"
                with fs.open_output_stream(whole) as out:
                    for p in parts:
                        with fs.open_input_stream(f"{pieces}/{p['piece']}") as f:
                            while chunk := f.read(1 << 22):
                                out.write(chunk)
                place(fs, whole, f"{home}/{name}", None)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows + sum(batch.column(2).to_pylist())], pa.int64())], names=["n"])

    rows = df.select(F.col(path).alias("path"), F.col(line).alias("line"), (F.col(end) if end else F.lit("\n")).alias("end"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(order)])
    by = ["path", *[f"_{i}" for i in range(len(order))]]
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // PIECE_ROWS))
    dealt = rows.repartitionByRange(tasks, *by).sortWithinPartitions(*by).select("path", "line", "end")
    cut = dealt.mapInArrow(write, "path string, part int, piece string, whole long")
    files = cut.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("part", "piece"))).alias("parts"), F.sum("whole").alias("whole"))
    n = files.mapInArrow(gather, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    fs, _, pieces = opened()
    if fs.get_file_info(pieces).type == pyarrow.fs.FileType.Directory:
        fs.delete_dir(pieces)
    return n
