"""Keyed state with event-time timers: chains of stages, the last different keys, requests with replies.

The state classes are those of ``operators.chains``, whose batch forms give the same rows.  The state of a key is
bounded by its capacity or horizon; a key has one timer, at its next end.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.chains import CHAIN_ROWS, Chains, Recent, Replies
from .state import in_order, tuples_in_order


class _Timed(StatefulProcessor):
    """A processor whose key has one timer, at the next time that ``_next`` tells."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.timer = handle.getValueState("timer", "ms long")

    def _schedule(self, us: int | None) -> None:
        ms = None if us is None else us // 1000 + 1
        before = self.timer.get()[0] if self.timer.exists() else None
        if ms == before:
            return
        if before is not None:
            self.handle.deleteTimer(before)
            self.timer.clear()
        if ms is not None:
            self.handle.registerTimer(ms)
            self.timer.update((ms,))

    def close(self) -> None:
        pass


def _write_changes(state, before: dict, now: dict, key=lambda k: k, value=lambda v: v) -> None:
    for k in before.keys() - now.keys():
        state.removeKey(key(k))
    for k, v in now.items():
        if before.get(k) != v:
            state.updateValue(key(k), value(v))


class ChainsOfKey(_Timed):
    def __init__(self, stages: Sequence[str], ttl_s: int, capacity: int):
        self.stages, self.ttl, self.capacity = list(stages), ttl_s * 1_000_000, capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = handle.getMapState("open", "chain string", "stage int, began long, touched long, alias string, token string")
        self.done = handle.getMapState("done", "chain string, token string", "us long")

    def _held(self) -> tuple[Chains, dict, dict]:
        held = Chains(self.stages, self.ttl, self.capacity)
        before = {k[0]: tuple(v) for k, v in self.open.iterator()}, {tuple(k): v[0] for k, v in self.done.iterator()}
        held.restore(*before)
        return held, *before

    def _keep(self, held: Chains, opened: dict, done: dict) -> None:
        _write_changes(self.open, opened, held.open, lambda k: (k,))
        _write_changes(self.done, done, held.done, tuple, lambda v: (v,))
        ends = [t for t in (held.oldest(), min(held.done.values(), default=None)) if t is not None]
        self._schedule(min(ends) + self.ttl if ends else None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        held, *before = self._held()
        for pdf in in_order(rows, ["us", "seq"]):
            made = []
            for row in pdf[["us", "seq", "stage", "chain", "alias", "token"]].astype(object).itertuples(index=False):
                made += [(str(key[0]), c, t, None, "expired", None) for c, t in held.expire(row.us)]
                found, verdict, took = held.accept(row.us, row.stage, row.chain, row.alias, row.token)
                made.append((str(key[0]), found, row.us, row.seq, verdict, took))
            yield _chain_rows(made)
        self._keep(held, *before)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, *before = self._held()
        self.timer.clear()
        gone = list(held.expire(timerValues.getCurrentWatermarkInMs() * 1000))
        self._keep(held, *before)
        if gone:
            yield _chain_rows([(str(key[0]), c, t, None, "expired", None) for c, t in gone])


def _chain_rows(made: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(made, columns=["key", "chain", "us", "seq", "verdict", "duration_s"]).astype({"us": "Int64", "seq": "Int64", "duration_s": "float64"})


def chains(stream: DataFrame, key: str, stage: str, chain: str, alias: str, token: str, ts: str, seq: str, stages: Sequence[str], ttl_s: int, delay: str, capacity: int = 4096) -> DataFrame:
    """``(key, chain, us, seq, verdict, duration_s)``: a row for each row of the stream, and one for each chain that expires."""
    named = {"key": key, "stage": stage, "chain": chain, "alias": alias, "token": token}
    rows = stream.withWatermark(ts, delay).select(*[F.col(c).cast("string").alias(n) for n, c in named.items()], F.unix_micros(ts).alias("us"), F.col(seq).cast("long").alias("seq"), F.col(ts))
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=ChainsOfKey(stages, ttl_s, capacity), outputStructType=f"key string, {CHAIN_ROWS}", outputMode="Append", timeMode="EventTime")


class RecentOfKey(StatefulProcessor):
    def __init__(self, capacity: int):
        self.capacity = capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.members = handle.getMapState("members", "member string", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        before = {k[0]: v[0] for k, v in self.members.iterator()}  # at most ``capacity``
        held = Recent(self.capacity, before)
        for pdf in in_order(rows, ["us", "seq"]):
            members = pdf["member"].astype(object).where(pdf["member"].notna(), None)
            yield pd.DataFrame({"key": [str(key[0])] * len(pdf), "seq": pdf["seq"].to_numpy(), "member": members.to_numpy(), "fresh": [held.fresh(m) for m in members.tolist()]})
        _write_changes(self.members, before, held.held, lambda k: (k,), lambda v: (v,))

    def close(self) -> None:
        pass


def recent(stream: DataFrame, key: str, member: str, us: str, seq: str, capacity: int = 4096) -> DataFrame:
    """``(key, seq, member, fresh)`` of every row: whether its member is not among the last ``capacity`` different ones of its key."""
    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(member).cast("string").alias("member"), F.col(us).cast("long").alias("us"), F.col(seq).cast("long").alias("seq"))
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=RecentOfKey(capacity), outputStructType="key string, seq long, member string, fresh boolean", outputMode="Append", timeMode="None")


class RepliesOfKey(StatefulProcessor):
    """All that is held of a key is one value, its timer's time too: a call of the key reads it once and writes it once, if it changed."""

    def __init__(self, horizon_s: int):
        self.horizon = horizon_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("replies", "sent array<struct<key string, us long, answered boolean, told boolean>>, acks array<struct<key string, source string>>, timer long")

    def _held(self) -> tuple[Replies, tuple | None]:
        held, before = Replies(self.horizon), self.state.get()
        if before:
            held.sent = {key: [us, answered, told] for key, us, answered, told in before[0]}
            held.acks = {tuple(k): True for k in before[1]}
        return held, before and ([tuple(x) for x in before[0]], [tuple(x) for x in before[1]], before[2])

    def _keep(self, held: Replies, before: tuple | None, fired: bool = False) -> None:
        end = held.next_end()
        ms = None if end is None else end // 1000 + 1
        timer = before[2] if before and not fired else None
        if ms != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if ms is not None:
                self.handle.registerTimer(ms)
        now = ([(k, *v) for k, v in held.sent.items()], list(held.acks), ms)
        if ms is None:  # nothing is held without a request
            if before:
                self.state.clear()
        elif now != before:
            self.state.update(now)

    @staticmethod
    def _rows(key, made: list[tuple]) -> pd.DataFrame:
        exact, us, seq, outcome = zip(*made, strict=True)
        return pd.DataFrame({"loose": [str(key[0])] * len(made), "exact": exact, "us": us, "seq": pd.Series(seq, dtype=object), "outcome": outcome})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        held, before = self._held()
        for part in tuples_in_order(rows, ["us", "reply", "seq", "exact", "source"], ["us", "reply", "seq"]):
            made = []
            for us, reply, seq, exact, source in part:
                made += [(k, t, None, "expired") for k, t in held.expire(us)]
                if reply:
                    made.append((exact, us, seq, held.reply(exact, source, us)))
                else:
                    held.request(exact, us)
            if made:
                yield self._rows(key, made)
        self._keep(held, before)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, before = self._held()
        gone = [(k, t, None, "expired") for k, t in held.expire(timerValues.getCurrentWatermarkInMs() * 1000)]
        self._keep(held, before, fired=True)
        if gone:
            yield self._rows(key, gone)

    def close(self) -> None:
        pass


def outcomes(rows: DataFrame, loose: Sequence[str], exact: Sequence[str], source: str, reply: str, ts: str, seq: str, horizon_s: int, delay: str) -> DataFrame:
    """``(loose, exact, us, seq, outcome)``: the outcome of each reply, and ``expired`` (no seq, the request's time) of each request without one.

    ``rows`` holds requests and replies; ``reply`` tells them apart.  Keys come out as their values joined by a bar.
    """
    joined = lambda names: F.concat_ws("|", *[F.col(n).cast("string") for n in names])
    made = rows.withWatermark(ts, delay).select(joined(loose).alias("loose"), joined(exact).alias("exact"), F.col(source).cast("string").alias("source"), F.col(reply).alias("reply"), F.unix_micros(ts).alias("us"), F.col(seq).cast("long").alias("seq"), F.col(ts))
    return made.groupBy("loose").transformWithStateInPandas(statefulProcessor=RepliesOfKey(horizon_s), outputStructType="loose string, exact string, us long, seq long, outcome string", outputMode="Append", timeMode="EventTime")
