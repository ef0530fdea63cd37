"""Readers and sinks over files that Spark makes of the driver's tables in the shared folder; SQL states the results on the tables.

Each query writes its files as a node writes them, reads them back through the reader, and returns what it read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import aggregates as A
from ..sources import generations, growing, readers, scan, sinks
from ..sources.scratch import shared_dir
from . import telemetry_jobs
from .chain_job_queries import NODE, node
from .registry import QUERIES, SQL, table
from .telemetry_job_queries import _SOCKETS

NODE_OF_PATH = r"/([^/]+)/[^/]+$"


def source_query(name: str, sql: str):
    """Register ``function(spark, t, root)``: ``t(name)`` reads a table, ``root`` is a fresh folder."""

    def add(function: Callable[[SparkSession, Callable[[str], DataFrame], str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: function(spark, lambda n: table(spark, sf_dir, n), f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
        SQL[name] = sql
        return function

    return add


def _event_lines(t) -> DataFrame:
    """Events as lines of an hour's file of their node."""
    ts = F.col("ts").cast("timestamp")
    e = t("events").select(node("user_id"), ts.alias("ts"), "event_id", F.concat_ws(" ", F.col("event_id").cast("string"), F.coalesce("event_type", F.lit("none"))).alias("line"))
    return e.withColumns({"date": F.date_format("ts", "yyyyMMdd"), "hour": F.hour("ts")})


_LINES = f"SELECT {NODE.format('user_id')} AS node_id, strftime(ts, '%Y%m%d') AS file_date, CAST(hour(ts) AS INTEGER) AS file_hour, event_id, CAST(event_id AS VARCHAR) || ' ' || coalesce(event_type, 'none') AS line FROM events"


# --- logs ------------------------------------------------------------------------------------


@source_query("read_hourly", f"SELECT node_id, file_date, file_hour, line FROM ({_LINES})")
def hourly(spark, t, root):
    e = _event_lines(t).withColumn("path", F.concat_ws("/", "node_id", F.lit("status/hourly"), "date", F.col("hour").cast("string")))
    sinks.write_named_files(e, root, order=["event_id"])
    return readers.read_hourly_stream(spark, root, "status").select("node_id", "file_date", F.col("file_hour").cast("int").alias("file_hour"), "line")


@source_query("read_dated", f"SELECT node_id, file_date, line FROM ({_LINES})")
def dated(spark, t, root):
    e = _event_lines(t).withColumn("path", F.concat_ws("/", "node_id", F.lit("times"), "date"))
    sinks.write_named_files(e, root, order=["event_id"])
    return readers.read_dated_logs(spark, f"{root}/*/times/*").select("node_id", "file_date", "line")


#: Orders as run files of their node: a run for each status, a date for each year, five heights.
_RUNS = f"SELECT {NODE.format('o_orderkey')} AS node_id, 'run' || o_orderstatus AS run, CAST(year(o_orderdate) AS VARCHAR) || '0101' AS file_date, o_orderkey % 5 * 7 AS height, CAST(o_orderkey AS VARCHAR) AS line FROM orders"


def _runs(t, root: str) -> None:
    o = t("orders").select(node("o_orderkey"), F.concat(F.lit("run"), "o_orderstatus").alias("run"), F.concat(F.year("o_orderdate"), F.lit("0101")).alias("date"), (F.col("o_orderkey") % 5 * 7).alias("height"), "o_orderkey")
    path = F.concat_ws("/", "node_id", F.lit("replica"), "run", "date", F.col("height").cast("string"))
    sinks.write_named_files(o.select(path.alias("path"), F.col("o_orderkey").cast("string").alias("line"), "o_orderkey"), root, order=["o_orderkey"])


@source_query("read_runs_latest", f"WITH r AS ({_RUNS}), n AS (SELECT node_id, max(run) AS run FROM r GROUP BY 1) SELECT r.* FROM r JOIN n USING (node_id, run)")
def runs(spark, t, root):
    _runs(t, root)
    return readers.read_runs(spark, f"{root}/*/replica", "latest", node=r"/([^/]+)/replica/[^/]+/\d{8}/\d+$").select("node_id", "run", "file_date", "height", "line")


@source_query("walk_tree", f"SELECT node_id, run, count(DISTINCT file_date || height) AS files, CAST(sum(len(line) + 1) AS BIGINT) AS bytes FROM ({_RUNS}) GROUP BY 1, 2")
def walked(spark, t, root):
    _runs(t, root)
    files = scan.tree(spark, root, parts=8).filter("is_regular")
    part = lambda i: F.element_at(F.split("path", "/"), i)
    return files.groupBy(part(-5).alias("node_id"), part(-3).alias("run")).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


@source_query("newest_leaf", f"SELECT node_id, arg_max(file_date, {{'a': file_date, 'b': height}}) AS file_date, arg_max(height, {{'a': file_date, 'b': height}}) AS height FROM ({_RUNS}) GROUP BY 1")
def newest(spark, t, root):
    _runs(t, root)
    files = scan.tree(spark, root, parts=8).filter("is_regular").withColumn("node_id", F.element_at(F.split("path", "/"), -5))
    return readers.latest_date_numeric(files, ["node_id"]).select("node_id", F.date_format("date", "yyyyMMdd").alias("file_date"), "height")


@source_query("markers_of_a_walk", "SELECT o_orderstatus AS node_id, count(DISTINCT CAST(o_orderdate AS DATE)) AS markers, CAST(max(CAST(o_orderdate AS DATE)) AS TIMESTAMP) AS newest_start FROM orders WHERE year(o_orderdate) = 1995 GROUP BY 1")
def marker_folders(spark, t, root):
    days = t("orders").filter(F.year("o_orderdate") == 1995).select("o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd'T'00:00:00'Z'").alias("start")).distinct()
    sinks.write_named_files(days.select(F.concat_ws("/", "o_orderstatus", "start", F.lit("f")).alias("path"), F.lit("x").alias("line")), root)
    dirs = scan.tree(spark, root, parts=8).withColumn("node_id", F.element_at(F.split("path", "/"), -2))
    return telemetry_jobs.markers(dirs)["run_marker"].select("node_id", "markers", "newest_start")


# --- documents and heads ---------------------------------------------------------------------


@source_query("read_documents", "SELECT CAST(c_nationkey AS BIGINT) AS nation, c_nationkey % 5 > 0 AS good, CASE WHEN c_nationkey % 5 > 0 THEN count(*) END AS n FROM customer GROUP BY 1, 2")
def documents(spark, t, root):
    per = t("customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    text = F.when(F.col("c_nationkey") % 5 == 0, F.lit('{"n":')).otherwise(F.to_json(F.struct("n")))
    sinks.write_named_files(per.select(F.concat(F.lit("state/"), F.col("c_nationkey").cast("string")).alias("path"), text.alias("line")), root)
    docs = readers.read_documents(spark, f"{root}/state")
    return docs.select(F.element_at(F.split("file_path", "/"), -1).cast("long").alias("nation"), F.col("doc").isNotNull().alias("good"), F.try_variant_get("doc", "$.n", "bigint").alias("n"))


@source_query("read_integers", "SELECT CAST(c_nationkey AS BIGINT) AS nation, CASE WHEN c_nationkey % 4 = 3 THEN sum(c_custkey) END::BIGINT AS value FROM customer GROUP BY c_nationkey")
def integers(spark, t, root):
    per = t("customer").groupBy("c_nationkey").agg(F.sum("c_custkey").alias("s"))
    k = F.col("c_nationkey") % 4
    text = F.when(k == 0, "  ").when(k == 1, F.concat(F.lit("-"), F.col("s"))).when(k == 2, "12x").otherwise(F.col("s").cast("string"))
    sinks.write_named_files(per.select(F.concat(F.lit("int/"), F.col("c_nationkey").cast("string")).alias("path"), text.alias("line")), root)
    return readers.read_single_ints(spark, f"{root}/int").select(F.element_at(F.split("file_path", "/"), -1).cast("long").alias("nation"), "value")


_HEAD_FILES = "SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'absent' WHEN p_partkey % 10 = 1 THEN 'empty' WHEN p_partkey % 10 = 2 THEN 'unreadable' WHEN len(p_name) > 12 THEN 'truncated' ELSE 'readable' END AS state, CASE WHEN p_partkey % 10 > 2 THEN left(p_name, 12) ELSE '' END AS head, p_brand FROM part"


def _heads(t, root: str) -> DataFrame:
    """Names of parts as files: a tenth is missing, a tenth empty, and in place of a tenth stands a folder."""
    k = F.col("p_partkey") % 10
    p = t("part").select("p_partkey", "p_brand", F.concat(F.lit("f/"), F.col("p_partkey").cast("string")).alias("path"), F.when(k == 1, "").otherwise(F.col("p_name")).alias("line"), k.alias("k"), F.lit("").alias("end"))
    n = sinks.write_named_files(p.filter("k <> 0").withColumn("path", F.when(F.col("k") == 2, F.concat("path", F.lit("/x"))).otherwise(F.col("path"))), root, end="end")
    named = p.select("p_partkey", "p_brand", F.concat(F.lit(f"{root}/"), "path").alias("path"))
    return scan.file_heads(named, 12, parts=max(8, n // 50_000), keep=["p_partkey", "p_brand"])


@source_query("file_states", f"SELECT p_partkey, state, head FROM ({_HEAD_FILES})")
def heads(spark, t, root):
    return _heads(t, root).select("p_partkey", "state", "head")


@source_query("withdrawn_when_confirmed", f"WITH h AS ({_HEAD_FILES}), g AS (SELECT p_brand, p_partkey % 3 AS k FROM h GROUP BY 1, 2 HAVING bool_and(state IN ('absent', 'empty'))) SELECT p_partkey FROM part WHERE (p_brand, p_partkey % 3) NOT IN (SELECT p_brand, k FROM g)")
def withdrawn(spark, t, root):
    key = F.col("p_partkey") % 3
    return scan.retained(t("part").withColumn("k", key), _heads(t, root).withColumn("k", key), ["p_brand", "k"]).select("p_partkey")


# --- text blocks, sockets, tails -------------------------------------------------------------


@source_query("marker_blocks", f"""
WITH e AS (SELECT *, {NODE.format('user_id')} AS node_id, row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id) AS n FROM events),
m AS (SELECT node_id, n AS a, coalesce(lead(n) OVER (PARTITION BY node_id ORDER BY n), 1000000000) AS z FROM e WHERE event_type = 'signup'),
c AS (SELECT m.node_id, max(a) AS a FROM m WHERE EXISTS (SELECT 1 FROM e WHERE e.node_id = m.node_id AND e.n > a AND e.n < z AND event_type = 'purchase') GROUP BY 1)
SELECT e.node_id, string_agg(event_id || ' ' || event_type, chr(10) ORDER BY event_id) AS block FROM c JOIN m USING (node_id, a) JOIN e ON e.node_id = c.node_id AND e.n > a AND e.n < z GROUP BY 1""")
def blocks(spark, t, root):
    e = _event_lines(t).withColumn("path", F.concat_ws("/", "node_id", F.lit("LOG")))
    sinks.write_named_files(e, root, order=["event_id"])
    return readers.read_marker_blocks(spark, root, "signup$", "purchase").select(F.regexp_extract("file_path", NODE_OF_PATH, 1).alias("node_id"), "block")


@source_query("read_sockets", _SOCKETS.replace("FROM lineitem WHERE l_linestatus = 'O')", "FROM lineitem WHERE l_suppkey % 4 > 0)"))
def socket_files(spark, t, root):
    """Four tables a node, of which one has a row that does not parse."""
    ln, hexed = F.col("l_linenumber"), lambda c: F.lpad(F.hex(c.cast("long")), 4, "0")
    local, remote = F.when(ln == 1, 4001).when(ln == 2, 4002).otherwise(7), F.when(ln == 3, 4002).when(ln == 1, 4002).otherwise(8)
    code = F.when(F.col("l_returnflag") == "N", "0A").otherwise("01")
    row = F.concat(F.lit("   "), F.col("l_orderkey"), F.lit(": 0100007F:"), hexed(local), F.lit(" 00000000:"), hexed(remote), F.lit(" "), code, F.lit(" 0"))
    part = F.col("l_suppkey") % 4
    rows = t("lineitem").select(F.concat_ws("/", node("l_orderkey"), part.cast("string")).alias("path"), F.when((part == 0) & (ln == 1), "broken").otherwise(row).alias("line"), F.lit(1).alias("n"))
    header = rows.select("path", F.lit("  sl  local_address rem_address   st").alias("line"), F.lit(0).alias("n")).distinct()
    sinks.write_named_files(rows.unionByName(header), root, order=["n", "line"])
    return telemetry_jobs.tcp_sockets(readers.read_socket_table(spark, root), [4001, 4002])


@source_query("stream_tails", "SELECT user_id, user_id % 3 = 2 AS valid FROM events GROUP BY 1")
def tails(spark, t, root):
    """A third of the files ends without a newline, a third with a line that is no JSON."""
    last = F.max("event_id").over(Window.partitionBy("user_id")) == F.col("event_id")
    e = t("events").select(F.concat(F.lit("f/"), F.col("user_id").cast("string")).alias("path"), "event_id", F.when(last & (F.col("user_id") % 3 == 1), '{"a":').otherwise(F.coalesce("props", F.lit("{}"))).alias("line"), F.when(last & (F.col("user_id") % 3 == 0), "").otherwise("\n").alias("end"))
    sinks.write_named_files(e, root, order=["event_id"], end="end")
    return readers.stream_tail_status(spark, f"{root}/f").select(F.element_at(F.split("file_path", "/"), -1).cast("long").alias("user_id"), "valid")


# --- growing files ---------------------------------------------------------------------------

_CAP = 24


@source_query("growing_lines", f"SELECT node_id, file_date, file_hour, CASE WHEN event_id % 40 <> 7 THEN line END AS line, CASE WHEN event_id % 40 = 7 THEN 'record_too_long' END AS reason FROM ({_LINES}) UNION ALL SELECT node_id, '20231231', 5, NULL, 'torn_tail' FROM ({_LINES}) GROUP BY 1")
def growing_files(spark, t, root):
    """The stream replays a node's hours; some lines are over the cap, and an hour of each node ends without a newline."""
    e = _event_lines(t)
    long = F.when(F.col("event_id") % 40 == 7, F.rpad("line", _CAP + 40, "x")).otherwise(F.col("line"))
    rows = e.select("node_id", "date", "hour", "event_id", long.alias("line"), F.lit("\n").alias("end"))
    torn = e.select("node_id", F.lit("20231231").alias("date"), F.lit(5).alias("hour"), F.lit(0).cast("long").alias("event_id"), F.lit("half a line").alias("line"), F.lit("").alias("end")).distinct()
    path = F.concat_ws("/", "node_id", F.lit("status/hourly"), "date", F.col("hour").cast("string"))
    sinks.write_named_files(rows.unionByName(torn).withColumn("path", path), f"{root}/logs", order=["event_id"], end="end")
    growing.read_growing(spark, f"{root}/logs", "status", "replay")  # registers the source
    stream = spark.readStream.format("growing_lines").options(root=f"{root}/logs", stream="status", history="replay", record_cap=_CAP, task_bytes=1 << 16).load()
    stream.writeStream.format("parquet").option("path", f"{root}/rows").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(growing.SCHEMA).parquet(f"{root}/rows").select("node_id", "file_date", "file_hour", "line", "reason")


# --- sinks -----------------------------------------------------------------------------------


@source_query("sink_metrics", "SELECT 'value' AS metric, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, sum(value) AS total, count(DISTINCT user_id) AS labels FROM events WHERE value IS NOT NULL GROUP BY 2")
def metrics_sink(spark, t, root):
    e = t("events").filter("value is not null").withColumns({"ts": F.col("ts").cast("timestamp"), "node_id": F.lit("n")})
    rows = sinks.metric(e, "value", "gauge", ["user_id"], F.col("value"))
    sinks.write_metrics(rows.withColumn("value", F.lit(-1.0)), root)  # the generation before, which is replaced
    sinks.write_metrics(rows, root)
    back = spark.read.parquet(root)
    return back.groupBy("metric", F.col("date").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.count_distinct(F.col("labels")["user_id"]).alias("labels"))


@source_query("sink_jsonl", "SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS count, bool_or(o_orderstatus = 'P') AS legacy FROM orders GROUP BY 1")
def jsonl_sink(spark, t, root):
    days = t("orders").groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("count"), F.bool_or(F.col("o_orderstatus") == "P").alias("legacy"))
    sinks.write_jsonl(days, root)
    return spark.read.schema("day string, count long, legacy boolean").json(root)


@source_query("sink_csv", "SELECT '10.0.0.' || s_suppkey AS ip, s_name AS moniker, '0x' || s_suppkey AS address, '' AS vp FROM supplier")
def csv_sink(spark, t, root):
    key = F.col("s_suppkey").cast("string")
    sinks.write_validator_csv(t("supplier").select(F.concat(F.lit("10.0.0."), key).alias("ip"), F.col("s_name").alias("moniker"), F.concat(F.lit("0x"), key).alias("address")), root)
    return spark.read.option("header", True).option("emptyValue", "").csv(root).na.fill("", ["vp"])


@source_query("sink_lines", "SELECT p_brand || '/' || p_partkey AS value FROM part WHERE p_partkey % 7 > 0")
def lines_sink(spark, t, root):
    k = F.col("p_partkey")
    ip = F.when(k % 14 == 0, "").when(k % 7 > 0, F.concat_ws("/", "p_brand", k.cast("string")))
    sinks.write_lines(t("part").select(ip.alias("ip")), "ip", root)
    return spark.read.text(root)


@source_query("current_generation", "SELECT event_type, count(*) AS n FROM events WHERE user_id % 2 = 1 GROUP BY 1")
def generation(spark, t, root):
    """Two generations are committed; a reader sees the second alone."""
    for number in (0, 1):
        generations.write_generation(A.counter(t("events").filter(F.col("user_id") % 2 == number), ["event_type"]), root, number)
    return generations.read_generation(spark, root)
