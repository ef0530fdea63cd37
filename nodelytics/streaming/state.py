"""Structured Streaming: bounded dedupe, interval joins, keyed state with time to live, atomic snapshots.

Stateful processors need the RocksDB state store.  Each has a batch twin in ``operators`` with equal results.
A key's rows of a batch are put in order by runs in the task's own temp folder, so they may be more than fit into memory.
"""

from __future__ import annotations

import heapq
import os
import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from itertools import batched

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from ..operators.folds import TtlMembers
from ..operators.joins import sent

OUT = "key string, us long, added boolean, expired long, dropped long, size long"
#: Rows of a key that are sorted in memory, rows of one frame, and runs that are merged at once.
RUN_ROWS, PART_ROWS, FAN = 100_000, 5_000, 16


def _place(row: tuple, at: Sequence[int]) -> tuple:
    """Where a row stands by the columns at ``at``, missing values last."""
    return tuple((True, 0) if (v := row[i]) is None or v != v else (False, v) for i in at)


def in_order(rows: Iterator[pd.DataFrame], order: Sequence[str]) -> Iterator[pd.DataFrame]:
    """The rows of a key by ``order``, missing values last, in frames of bounded size; more than ``RUN_ROWS`` go through sorted runs on disk."""
    held, many = _first_run(rows)
    if many:
        names, parts = _by_runs(held, rows, order)
        yield from (pd.DataFrame(part, columns=names) for part in parts)
    elif held:
        yield _sorted_run(held, order)


def tuples_in_order(rows: Iterator[pd.DataFrame], columns: Sequence[str], order: Sequence[str]) -> Iterator[Sequence[tuple]]:
    """``columns`` of the rows that ``in_order`` gives, as lists of tuples: a key of few rows costs no sorting of frames."""
    held, many = _first_run(rows)
    if many:
        names, parts = _by_runs(held, rows, order)
        at = [names.index(c) for c in columns]
        yield from ([tuple(row[i] for i in at) for row in part] for part in parts)
    elif held:
        at = [list(columns).index(c) for c in order]
        found = [row for pdf in held for row in zip(*[pdf[c].tolist() for c in columns], strict=True)]
        yield sorted(found, key=lambda row: _place(row, at))


def _first_run(rows: Iterator[pd.DataFrame]) -> tuple[list[pd.DataFrame], bool]:
    """The frames up to a full run, and whether they filled it."""
    held, n = [], 0
    for pdf in rows:
        held.append(pdf)
        n += len(pdf)
        if n >= RUN_ROWS:
            return held, True
    return held, False


def _sorted_run(held: list[pd.DataFrame], order: Sequence[str]) -> pd.DataFrame:
    return pd.concat(held, ignore_index=True).sort_values(list(order))


def _by_runs(full: list[pd.DataFrame], rest: Iterator[pd.DataFrame], order: Sequence[str]) -> tuple[list[str], Iterator[tuple]]:
    """The names of the columns, and parts of at most ``PART_ROWS`` rows: of a first run and of what comes after it."""
    names = list(full[0].columns)
    return names, _merged_parts(full, rest, order, [names.index(c) for c in order])


def _merged_parts(held: list[pd.DataFrame], rest: Iterator[pd.DataFrame], order: Sequence[str], at: list[int]) -> Iterator[tuple]:
    levels: list[list[str]] = []
    with tempfile.TemporaryDirectory(prefix="runs-") as home:

        def merged(paths: list[str]) -> Iterator[tuple]:
            return heapq.merge(*map(read, paths), key=lambda row: _place(row, at))

        def read(path: str) -> Iterator[tuple]:
            with open(path, "rb") as f:
                while f.peek(1):
                    yield from pickle.load(f)

        def write(found: Iterator[tuple]) -> str:
            path = f"{home}/{uuid.uuid4().hex}"
            with open(path, "wb") as f:
                for part in batched(found, PART_ROWS):
                    pickle.dump(part, f)
            return path

        def add(path: str, level: int = 0) -> None:
            levels.extend([] for _ in range(level + 1 - len(levels)))
            levels[level].append(path)
            if len(levels[level]) == FAN:
                full, levels[level] = levels[level], []
                made = write(merged(full))
                for p in full:
                    os.unlink(p)
                add(made, level + 1)

        while held:
            add(write(_sorted_run(held, order).itertuples(index=False, name=None)))
            held, _ = _first_run(rest)
        yield from batched(merged([p for level in levels for p in level]), PART_ROWS)


def dedupe(stream: DataFrame, key: Sequence[str], ts: str, within: str) -> DataFrame:
    """The first row of each key; a key is remembered for the time given."""
    return stream.withWatermark(ts, within).dropDuplicatesWithinWatermark(list(key))


def correlate(requests: DataFrame, replies: DataFrame, keys: Sequence[str], request_ts: str, reply_ts: str, within: str, how: str = "inner") -> DataFrame:
    """Interval join of two streams; with ``left_outer`` unanswered requests come out once the time is over."""
    a = requests.withWatermark(request_ts, within)
    b = replies.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in replies.columns if c not in keys]).withWatermark(reply_ts, within)
    match = (F.col(reply_ts) >= F.col(request_ts)) & (F.col(reply_ts) <= F.col(request_ts) + F.expr(f"INTERVAL {within}"))
    for k in keys:
        match = match & (F.col(k) == F.col(f"_r_{k}"))
    return a.join(b, match, how).drop(*[f"_r_{k}" for k in keys])


class TtlSet(StatefulProcessor):
    """Keys with their last sight: expire, touch or add, then drop the least recently seen over capacity."""

    def __init__(self, ttl_s: int, capacity: int):
        self.ttl, self.capacity = ttl_s * 1_000_000, capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "member string", "us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        before = {k[0]: v[0] for k, v in self.seen.iterator()}  # at most ``capacity``
        members = TtlMembers(self.ttl, self.capacity, before)
        for pdf in in_order(rows, ["us", "seq"]):
            out = [(str(key[0]), row.us, *members.touch(row.member, row.us)) for row in pdf.itertuples(index=False)]
            yield pd.DataFrame(out, columns=["key", "us", "added", "expired", "dropped", "size"])
        for member in before.keys() - members.seen.keys():
            self.seen.removeKey((member,))
        for member, us in members.seen.items():
            if before.get(member) != us:  # only what changed is written
                self.seen.updateValue((member,), (us,))

    def close(self) -> None:
        pass


def ttl_set(stream: DataFrame, key: str, member: str, us: str, seq: str, ttl_s: int, capacity: int) -> DataFrame:
    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(member).cast("string").alias("member"), F.col(us).alias("us"), F.col(seq).alias("seq"))
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=TtlSet(ttl_s, capacity), outputStructType=OUT, outputMode="Append", timeMode="None")


def ttl_batches(key: str, member: str, us: str, seq: str, ttl_s: int, capacity: int, home: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink with the results of ``ttl_set``, in ``home/made/*/state=false``.

    Spark sorts a batch, and a fold over Arrow batches keeps the set of one key.  The sets after a batch go to
    ``state=true`` beside its rows and come before the rows of the next batch: a repeated batch gives the same.
    """

    def run(batches):
        current, held, started = None, {}, False
        members = None
        for batch in batches:
            made = []
            for k, m, t, seed in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                if not started or k != current:
                    made += [(current, x, u, None, None, None, None, True) for x, u in (members.seen if members else held).items()]
                    current, held, members, started = k, {}, None, True
                if seed:
                    held[m] = t
                else:
                    members = members or TtlMembers(ttl_s * 1_000_000, capacity, held)
                    made.append((k, m, t, *members.touch(m, t), False))
            if made:
                yield _ttl_rows(made)
        if left := members.seen if members else held:
            yield _ttl_rows([(current, x, u, None, None, None, None, True) for x, u in left.items()])

    def sink(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(F.col(key).cast("string").alias("key"), F.col(member).cast("string").alias("member"), F.col(us).cast("long").alias("us"), F.lit(False).alias("seed"), F.col(seq).alias("seq"))
        if batch_id:
            held = batch.sparkSession.read.schema("key string, member string, us long").parquet(f"{home}/made/{batch_id - 1}/state=true")
            rows = rows.unionByName(held.withColumns({"seed": F.lit(True), "seq": F.lit(None).cast(rows.schema["seq"].dataType)}))
        dealt = rows.repartition("key").sortWithinPartitions("key", F.desc("seed"), "us", "seq")
        dealt.mapInArrow(run, _TTL).write.mode("overwrite").partitionBy("state").parquet(f"{home}/made/{batch_id}")

    return sink


_TTL = "key string, member string, us long, added boolean, expired long, dropped long, size long, state boolean"


def _ttl_rows(made: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    fields = [c.split() for c in _TTL.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(zip(*made, strict=True), fields, strict=True)], names=[n for n, _ in fields])


class StickyNames(StatefulProcessor):
    """The first ``n`` distinct members of a key keep their name, later ones are ``other``."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.names = handle.getMapState("names", "member string", "us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        known = {k[0] for k, _ in self.names.iterator()}
        for pdf in in_order(rows, ["us", "seq"]):
            labels = []
            for row in pdf.itertuples(index=False):
                if row.member not in known and len(known) < self.n:
                    known.add(row.member)
                    self.names.updateValue((row.member,), (row.us,))
                labels.append(row.member if row.member in known else "other")
            yield pd.DataFrame({"key": [str(key[0])] * len(pdf), "seq": pdf["seq"].to_numpy(), "label": labels})

    def close(self) -> None:
        pass


def sticky_names(stream: DataFrame, key: str, member: str, us: str, seq: str, n: int) -> DataFrame:
    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(member).cast("string").alias("member"), F.col(us).alias("us"), F.col(seq).alias("seq"))
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=StickyNames(n), outputStructType="key string, seq long, label string", outputMode="Append", timeMode="None")


def sticky_batches(key: str, member: str, us: str, seq: str, n: int, home: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink with the results of ``sticky_names`` for members that are not null, in ``home/rows/*``.

    A batch is reduced to the first sight of each (key, member) before a shuffle, so no key's rows meet in one task.  The at
    most ``n`` names of each key are written to ``home/names`` by batch, from those of the batch before: a repeated batch gives the same.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(F.col(key).cast("string").alias("key"), F.col(member).cast("string").alias("member"), F.col(us).alias("us"), F.col(seq).alias("seq"))
        found = rows.filter("member is not null").groupBy("key", "member").agg(F.min(F.struct(F.lit(True).alias("late"), "us", "seq")).alias("first"))
        if batch_id:
            before = spark.read.schema(found.schema).parquet(f"{home}/names/{batch_id - 1}")
            early = F.struct(F.lit(False).alias("late"), F.col("first.us").alias("us"), F.col("first.seq").alias("seq"))
            found = found.unionByName(before.withColumn("first", early)).groupBy("key", "member").agg(F.min("first").alias("first"))
        ranked = found.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("first", "member")))
        ranked.filter(F.col("r") <= n).drop("r").write.mode("overwrite").parquet(f"{home}/names/{batch_id}")
        names = spark.read.schema(found.schema).parquet(f"{home}/names/{batch_id}").select(F.col("key").alias("_key"), F.col("member").alias("_member"))
        labelled = rows.join(sent(names), F.col("key").eqNullSafe(F.col("_key")) & (F.col("member") == F.col("_member")), "left")
        labelled.select("key", "seq", F.coalesce("_member", F.lit("other")).alias("label")).write.mode("overwrite").parquet(f"{home}/rows/{batch_id}")

    return sink


class Monotone(StatefulProcessor):
    """Rows that exceed the last accepted row in every column; others come out as late, none is lost."""

    def __init__(self, columns: Sequence[str]):
        self.columns = list(columns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.base = handle.getValueState("base", T.StructType([T.StructField(f"v{i}", T.DoubleType()) for i in range(len(self.columns))]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        base = self.base.get() if self.base.exists() else None
        for pdf in in_order(rows, ["seq"]):
            verdict = []
            for values in pdf[self.columns].itertuples(index=False, name=None):
                good = base is None or all(v > b for v, b in zip(values, base, strict=True))
                base = tuple(map(float, values)) if good else base
                verdict.append("accepted" if good else "late")
            yield pd.DataFrame({"key": [str(key[0])] * len(pdf), "seq": pdf["seq"].to_numpy(), "verdict": verdict})
        self.base.update(base)

    def close(self) -> None:
        pass


def monotone(stream: DataFrame, key: str, seq: str, columns: Sequence[str]) -> DataFrame:
    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(seq).alias("seq"), *[F.col(c).cast("double").alias(c) for c in columns])
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=Monotone(columns), outputStructType="key string, seq long, verdict string", outputMode="Append", timeMode="None")


class RetireIdle(StatefulProcessor):
    """The last sight of a key; once event time has passed it by ``idle_s`` seconds, the key comes out and its state goes."""

    def __init__(self, idle_s: int):
        self.idle_ms = idle_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        before = self.last.get()[0] if self.last.exists() else None
        newest = max((int(pdf["us"].max()) for pdf in rows), default=before)
        if before is None or newest > before:
            if before is not None:
                self.handle.deleteTimer(before // 1000 + self.idle_ms)
            self.last.update((newest,))
            self.handle.registerTimer(newest // 1000 + self.idle_ms)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0]
        self.last.clear()
        yield pd.DataFrame({"key": [str(key[0])], "last_us": [last]})

    def close(self) -> None:
        pass


def retire_idle(stream: DataFrame, key: str, ts: str, idle_s: int, delay: str) -> DataFrame:
    """``(key, last_us)`` of each key at the end of its idle time; nothing is kept of a retired key."""
    rows = stream.withWatermark(ts, delay).select(F.col(key).cast("string").alias("key"), F.unix_micros(ts).alias("us"), F.col(ts).alias("ts"))
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=RetireIdle(idle_s), outputStructType="key string, last_us long", outputMode="Append", timeMode="EventTime")


def run_available(df: DataFrame, name: str, checkpoint: str, mode: str = "append", sink: Callable | None = None):
    """Run a stream over what is there and end; into a memory table, or through ``sink(batch, id)``."""
    writer = df.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(sink) if sink else writer.format("memory").queryName(name).outputMode(mode)
    query = writer.start()
    query.awaitTermination()
    return query
