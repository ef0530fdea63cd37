"""Complete snapshots of which a reader sees one: generations in folders of their own and a pointer.

A generation is written beside the others, and becomes the current one by the rename of a small pointer file over
the one before, which is one step of the file system.  A reader resolves the pointer once and reads that folder
only, so it never mixes generations, and a write that fails at any point changes nothing that a reader sees.
Folders that no pointer names are removed by ``prune``.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

POINTER = "_current"


def _files(spark: SparkSession, path: str):
    """Hadoop's path class and the file system of a path."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    return hadoop, at.getFileSystem(spark._jsc.hadoopConfiguration())


def current(spark: SparkSession, path: str) -> str | None:
    """The name of the current generation; None before the first commit."""
    hadoop, files = _files(spark, path)
    pointer = hadoop.Path(f"{path}/{POINTER}")
    if not files.exists(pointer):
        return None
    stream = files.open(pointer)
    try:
        return bytes(stream.readNBytes(4096)).decode()
    finally:
        stream.close()


def commit(spark: SparkSession, path: str, name: str) -> None:
    """Make a written generation the current one."""
    hadoop, files = _files(spark, path)
    fresh = hadoop.Path(f"{path}/{POINTER}.{uuid.uuid4().hex}")
    out = files.create(fresh, True)
    try:
        out.write(bytearray(name.encode()))
    finally:
        out.close()
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context = hadoop.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(context.makeQualified(fresh), context.makeQualified(hadoop.Path(f"{path}/{POINTER}")), options)


def write_generation(df: DataFrame, path: str, number: int) -> str:
    """Write ``df`` as generation ``number`` and make it current, unless a later one is; gives its folder's name."""
    spark = df.sparkSession
    name = f"g{number:020d}-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{name}")
    before = current(spark, path)
    if before is None or int(before[1:21]) <= number:  # a repeated batch replaces its own; a late one does not go back
        commit(spark, path, name)
    return name


def read_generation(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The rows of the generation that is current now; with ``schema``, no rows before the first."""
    name = current(spark, path)
    if name is None:
        if schema is None:
            raise FileNotFoundError(f"no generation is committed in {path}")
        return spark.createDataFrame([], schema)
    return spark.read.parquet(f"{path}/{name}")


def generations_to(path: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each batch that has rows is a generation."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            write_generation(batch, path, batch_id)

    return sink


def prune(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Remove all but the current generation and the newest ``keep - 1`` before it; a reader of a kept one is not disturbed.

    Folders later than the current one may still be written and stay.
    """
    hadoop, files = _files(spark, path)
    now = current(spark, path)
    names = sorted(s.getPath().getName() for s in files.listStatus(hadoop.Path(path)) if re.match(r"g\d{20}-", s.getPath().getName()))
    old = [n for n in names if now is not None and n != now and n[:21] <= now[:21]]
    gone = old[: max(0, len(old) - (keep - 1))]
    for n in gone:
        files.delete(hadoop.Path(f"{path}/{n}"), True)
    return gone
