"""Readers: logs, documents, inventories and captures as tables.  Paths are globs that Spark resolves, or folders that executors list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import path_date
from ..operators.joins import sent
from . import scan
from .scratch import Scratch

#: Longest record that is read; longer ones are rejected.
RECORD_CAP = 64 << 20


def _lines(df: DataFrame, node: str, pattern: str, names: list[str]) -> DataFrame:
    path = F.col("_metadata.file_path")
    parts = [F.nullif(F.regexp_extract(path, pattern, i + 1), F.lit("")).alias(n) for i, n in enumerate(names)]
    return df.select(F.regexp_extract(path, node, 1).alias("node_id"), path.alias("file_path"), F.col("_metadata.file_modification_time").alias("landed"), *parts, F.col("value").alias("line"))


def read_hourly_stream(spark: SparkSession, root: str, stream: str, streaming: bool = False, since: str | None = None, node: str = r"/([^/]+)/[^/]+/hourly/\d{8}/\d+$") -> DataFrame:
    """``<root>/<node>/<stream>/hourly/<YYYYMMDD>/<H>``: one row per line.

    ``since`` skips files that were written before (start without history).  Hours must be closed before they land.
    """
    reader = spark.readStream if streaming else spark.read
    reader = reader.option("recursiveFileLookup", "true")
    if since:
        reader = reader.option("modifiedAfter", since)
    return _lines(reader.format("text").load(f"{root}/*/{stream}/hourly"), node, r"/hourly/(\d{8})/(\d+)$", ["file_date", "file_hour"]).withColumn("stream", F.lit(stream))


def read_dated_logs(spark: SparkSession, path: str, node: str = r"/([^/]+)/[^/]+/\d{8}$") -> DataFrame:
    """Flat files named ``YYYYMMDD``."""
    return _lines(spark.read.text(path), node, r"/(\d{8})$", ["file_date"])


def read_runs(spark: SparkSession, path: str, runs: str = "all", node: str = r"/([^/]+)/[^/]+/[^/]+/\d{8}/\d+$") -> DataFrame:
    """``<run>/<date>/<height>`` with numeric heights; ``latest`` keeps the newest run of each node that has files."""
    rows = _lines(spark.read.option("recursiveFileLookup", "true").text(path), node, r"/([^/]+)/(\d{8})/(\d+)$", ["run", "file_date", "height"]).withColumn("height", F.col("height").cast("long"))
    if runs == "latest":
        newest = rows.groupBy("node_id").agg(F.max("run").alias("run"))
        rows = rows.join(newest, ["node_id", "run"], "left_semi")
    return rows


def split_long(lines: DataFrame, cap: int = RECORD_CAP) -> tuple[DataFrame, DataFrame]:
    """Lines up to the cap, and rejects."""
    long = F.octet_length("line") > cap
    return lines.filter(~long), lines.filter(long).withColumns({"stage": F.lit("read"), "reason": F.lit("record_too_long")})


def _few(df: DataFrame) -> DataFrame:
    """A table of a row a file or split, made once; it goes to every task if a count proves it small, so that a long file's lines stay where they are read."""
    return sent(Scratch(df.sparkSession, "files").write(df, "rows"))


def committed(spark: SparkSession, path: str) -> DataFrame:
    """``(file_path, mtime, line_no, line, last, torn)``: a file whose lines and their newlines add up to more than its size ends without one.

    Lines are read as lines, so a file may be of any size and is split over tasks; its order comes
    from the place of its splits and the lines' places in them.
    """
    text = spark.read.format("text").option("lineSep", "\n").option("recursiveFileLookup", "true").load(path)
    m = "_metadata"
    lines = text.select(F.col(f"{m}.file_path").alias("file_path"), F.col(f"{m}.file_modification_time").alias("mtime"), F.col(f"{m}.file_size").alias("size"), F.col(f"{m}.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    # one row a split
    blocks = lines.groupBy("file_path", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("line") + 1).alias("bytes"), F.max("size").alias("size"))
    within = Window.partitionBy("file_path")
    before = F.sum("n").over(within.orderBy("block")) - F.col("n")
    places = blocks.select("file_path", "block", (before - F.col("first")).alias("shift"), F.sum("n").over(within).alias("lines"), (F.sum("bytes").over(within) > F.max("size").over(within)).alias("torn"))
    numbered = lines.join(_few(places), ["file_path", "block"]).withColumn("line_no", F.col("at") + F.col("shift"))
    return numbered.select("file_path", "mtime", "line_no", "line", (F.col("line_no") == F.col("lines") - 1).alias("last"), "torn")


def torn_tails(spark: SparkSession, path: str) -> DataFrame:
    """Files whose last byte is no newline: their last line is not committed yet."""
    return committed(spark, path).filter("last and torn").select("file_path")


def drop_torn_tails(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(file_path, line_no, line)`` of committed lines, and as rejects the torn last lines and those over the record cap."""
    torn = F.col("last") & F.col("torn")
    long = F.octet_length("line") > RECORD_CAP
    rows = committed(spark, path)
    rejects = rows.filter(torn | long).select("file_path", "line", F.lit("read").alias("stage"), F.when(torn, "torn_line").otherwise("record_too_long").alias("reason"))
    return rows.filter(~torn & ~long).select("file_path", "line_no", "line"), rejects


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole JSON documents: path, modification time and VARIANT (null if it is no JSON)."""
    rows = spark.read.format("text").option("wholetext", "true").load(path)
    return rows.select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_modification_time").alias("mtime"), F.try_parse_json("value").alias("doc"))


def read_single_ints(spark: SparkSession, path: str) -> DataFrame:
    """Files of one integer; empty and negative ones are null."""
    rows = spark.read.format("text").option("wholetext", "true").load(path)
    n = F.trim(F.regexp_replace("value", r"\s+$", "")).try_cast("long")
    return rows.select(F.col("_metadata.file_path").alias("file_path"), F.when(n >= 0, n).alias("value"))


def file_inventory(spark: SparkSession, path: str, node_id: str) -> DataFrame:
    """Everything below a folder, listed by executors; contents are not read.  See ``scan.walk``."""
    return scan.tree(spark, path).select(F.lit(node_id).alias("node_id"), "*")


def read_file_heads(spark: SparkSession, path: str, n: int = 4096) -> DataFrame:
    """The first bytes of each file below a folder, or of one file, with its state: empty, readable, truncated or unreadable."""
    found = scan.tree(spark, path)
    files = found.filter(F.col("is_regular") | (F.col("error") == "NotADirectoryError")).select("path")
    return scan.file_heads(files, n).select("path", "mtime", "state", "head")


def read_marker_blocks(spark: SparkSession, path: str, marker: str, complete: str) -> DataFrame:
    """The newest block of lines after a line that matches ``marker`` that holds the completing text, per file.

    Files are read as lines; only lines with a marker or the completing text, and those of the chosen block, are gathered.
    """
    lines = committed(spark, path)
    starts, ends = F.col("line").rlike(marker), F.contains("line", F.lit(complete))
    marks = lines.filter(starts | ends).select("file_path", "line_no", starts.alias("starts"), ends.alias("ends"))
    before = Window.partitionBy("file_path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = marks.withColumn("start", F.max(F.when(F.col("starts"), F.col("line_no"))).over(before))
    chosen = spans.groupBy("file_path").agg(F.max(F.when(F.col("ends") & ~F.col("starts"), F.col("start"))).alias("start")).filter("start is not null")
    stop = spans.filter("starts").select("file_path", F.col("line_no").alias("next")).join(chosen, "file_path").groupBy("file_path", "start").agg(F.min(F.when(F.col("next") > F.col("start"), F.col("next"))).alias("stop"))
    inside = lines.join(stop, "file_path").filter("line_no > start and (stop is null or line_no < stop)")
    whole = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return inside.groupBy("file_path").agg(F.array_join(F.transform(whole, lambda x: x["line"]), "\n").alias("block"))


def latest_date_numeric(inventory: DataFrame, scope: list[str]) -> DataFrame:
    """The newest ``.../<YYYYMMDD>/<number>`` leaf of each scope, by date and then by number."""
    rows = inventory.withColumns({"date": path_date(F.regexp_extract("path", r"/(\d{8})/(\d+)$", 1)), "height": F.regexp_extract("path", r"/(\d{8})/(\d+)$", 2).try_cast("long")}).filter("date is not null and height is not null")
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*scope).orderBy(F.desc("date"), F.desc("height")))).filter("_r = 1").drop("_r")


#: fixed values: states of the kernel's socket tables
_SOCKET_STATES = {
    "01": "ESTABLISHED",
    "02": "SYN_SENT",
    "03": "SYN_RECV",
    "04": "FIN_WAIT1",
    "05": "FIN_WAIT2",
    "06": "TIME_WAIT",
    "07": "CLOSE",
    "08": "CLOSE_WAIT",
    "09": "LAST_ACK",
    "0A": "LISTEN",
    "0B": "CLOSING",
}


def read_socket_table(spark: SparkSession, path: str, node: str = r"/([^/]+)/[^/]+$") -> DataFrame:
    """Kernel socket tables: node, ports and state of each row; ``bad`` marks files whose header or any row does not parse.

    Files are read as lines; what is known of a whole file is one row a file.
    """
    states = F.create_map(*[F.lit(x) for kv in _SOCKET_STATES.items() for x in kv])
    shape = r"^\s*\d+: [0-9A-F]+:([0-9A-F]{4}) [0-9A-F]+:([0-9A-F]{4}) ([0-9A-F]{2})( |$)"
    lines = committed(spark, path).filter("line_no = 0 or line <> ''")
    wrong = F.when(F.col("line_no") == 0, ~F.trim("line").startswith("sl ")).otherwise(~F.col("line").rlike(shape))
    files = _few(lines.groupBy("file_path").agg(F.bool_or(wrong).alias("bad")))
    port = lambda i: F.conv(F.regexp_extract("line", shape, i), 16, 10).cast("int")
    rows = lines.filter("line_no > 0").join(files, "file_path")
    return rows.select(F.regexp_extract("file_path", node, 1).alias("node_id"), "file_path", "bad", port(1).alias("local_port"), port(2).alias("remote_port"), F.coalesce(states[F.regexp_extract("line", shape, 3)], F.lit("UNKNOWN")).alias("state"))


def stream_tail_status(spark: SparkSession, path: str) -> DataFrame:
    """Per file with a line: time of change, and whether its last line is committed and one JSON value."""
    last = committed(spark, path).filter("last")
    return last.select("file_path", "mtime", (~F.col("torn") & F.try_parse_json("line").isNotNull()).alias("valid"))
