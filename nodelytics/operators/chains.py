"""Small ordered states that batch folds and stream processors share: chains of stages, recent keys, requests with replies.

Each takes the rows of one key in order.  Sizes are bounded by a capacity or a time to live, never by the rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHAIN_ROWS = "chain string, us long, seq long, verdict string, duration_s double"


class Chains:
    """Open chains of ordered stages, and completed ones that must not complete again.

    A first stage opens a chain unless it is open or ``capacity`` chains are.  A row that names a chain and an
    alias binds the alias to it, a row with an alias alone finds its chain by it, and each stage follows the one
    before.  The token of the last but one stage must come again with the last.  Whatever does not fit is
    ``unjoinable`` and changes nothing.  A chain that no row has moved for the time to live is gone; a completed
    pair of chain and token is remembered as long, the oldest going first beyond the capacity.
    """

    def __init__(self, stages: Sequence[str], ttl_us: int, capacity: int):
        self.place = {s: i for i, s in enumerate(stages)}
        self.last = len(stages) - 1
        self.ttl, self.capacity = ttl_us, capacity
        self.open: dict[str, tuple] = {}  # chain: stage, began, touched, alias, token
        self.alias: dict[str, str] = {}
        self.done: dict[tuple, int] = {}
        self._sights: list[tuple[int, str]] = []
        self._ends: list[tuple[int, tuple]] = []

    def restore(self, open_: dict[str, tuple], done: dict[tuple, int]) -> None:
        self.open, self.done = dict(open_), dict(done)
        self.alias = {v[3]: k for k, v in open_.items() if v[3] is not None}
        self._sights = [(v[2], k) for k, v in open_.items()]
        self._ends = [(t, k) for k, t in done.items()]
        heapq.heapify(self._sights)
        heapq.heapify(self._ends)

    def _set(self, chain: str, value: tuple) -> None:
        self.open[chain] = value
        heapq.heappush(self._sights, (value[2], chain))

    def _close(self, chain: str) -> tuple:
        value = self.open.pop(chain)
        if value[3] is not None:
            self.alias.pop(value[3], None)
        return value

    def oldest(self) -> int | None:
        """The time of the row that moved the stalest chain."""
        while self._sights and (self._sights[0][1] not in self.open or self.open[self._sights[0][1]][2] != self._sights[0][0]):
            heapq.heappop(self._sights)
        return self._sights[0][0] if self._sights else None

    def _oldest_done(self) -> int | None:
        while self._ends and self.done.get(self._ends[0][1]) != self._ends[0][0]:
            heapq.heappop(self._ends)
        return self._ends[0][0] if self._ends else None

    def expire(self, now: int) -> Iterator[tuple[str, int]]:
        """``(chain, time of its last row)`` of the chains that end before ``now``."""
        while (t := self.oldest()) is not None and now - t > self.ttl:
            chain = heapq.heappop(self._sights)[1]
            self._close(chain)
            yield chain, t
        while (t := self._oldest_done()) is not None and now - t > self.ttl:
            del self.done[heapq.heappop(self._ends)[1]]

    def accept(self, us: int, stage: str, chain: str | None, alias: str | None, token: str | None) -> tuple[str | None, str, float | None]:
        """``(chain, verdict, duration in seconds)`` of one row."""
        i = self.place.get(stage)
        if i is None:
            return chain, "unknown", None
        if i == 0:
            if chain is None or chain in self.open or len(self.open) >= self.capacity:
                return chain, "unjoinable", None
            self._set(chain, (0, us, us, None, None))
            return chain, "opened", None
        if chain is None:
            chain = self.alias.get(alias)
        held = self.open.get(chain)
        if held is None or held[0] != i - 1 or (alias is not None and held[3] not in (None, alias)) or (held[3] is None and self.alias.get(alias, chain) != chain):
            return chain, "unjoinable", None
        _, began, _, bound, kept = held
        if i < self.last:
            if i == self.last - 1 and token is None:
                return chain, "unjoinable", None
            if bound is None and alias is not None:
                bound = alias
                self.alias[alias] = chain
            self._set(chain, (i, began, us, bound, token if i == self.last - 1 else kept))
            return chain, "moved", None
        if token != kept or (chain, token) in self.done:
            return chain, "unjoinable", None
        while len(self.done) >= self.capacity and self._oldest_done() is not None:
            del self.done[heapq.heappop(self._ends)[1]]
        self.done[chain, token] = us
        heapq.heappush(self._ends, (us, (chain, token)))
        self._close(chain)
        return chain, "completed", (us - began) / 1e6


class Recent:
    """The last ``capacity`` different keys by arrival, with the number of each; a key that is held does not move up."""

    def __init__(self, capacity: int, held: Mapping[str, int] | None = None):
        self.capacity = capacity
        self.held = dict(sorted((held or {}).items(), key=lambda x: x[1]))
        self.n = max(self.held.values(), default=0)

    def fresh(self, key: str | None) -> bool:
        """Whether the key is not held; a missing or empty key never is."""
        if key is None or key == "" or key != key:
            return True
        if key in self.held:
            return False
        self.n += 1
        self.held[key] = self.n
        if len(self.held) > self.capacity:
            del self.held[next(iter(self.held))]
        return True


class Replies:
    """Requests of one loose key with their replies: each reply is ``matched``, ``mismatch`` or ``orphan``, each request without one ``expired``.

    The latest request of a key counts.  A reply matches once a source, not before the request and not after the
    horizon; otherwise it is a mismatch if any request of the loose key is known.  A request without a match is reported at the
    end of its horizon and known for as long again.
    """

    def __init__(self, horizon_us: int):
        self.horizon = horizon_us
        self.sent: dict[str, list] = {}  # key: time, whether a reply came, whether it was reported
        self.acks: dict[tuple[str, str], bool] = {}
        self._due: int | None = None  # no request ends before

    def request(self, key: str, us: int) -> None:
        if key not in self.sent or us >= self.sent[key][0]:
            self.sent[key] = [us, False, False]
            self._due = min(us + self.horizon, self._due) if self._due is not None else us + self.horizon

    def reply(self, key: str, source: str, us: int) -> str:
        held = self.sent.get(key)
        if held and 0 <= us - held[0] <= self.horizon:
            held[1] = True
            if (key, source) in self.acks:
                return "mismatch"
            self.acks[key, source] = True
            return "matched"
        return "mismatch" if self.sent else "orphan"

    def expire(self, now: int) -> Iterator[tuple[str, int]]:
        """``(key, time)`` of the requests whose horizon has passed without a reply; those of two horizons are forgotten."""
        if self._due is not None and now <= self._due:
            return
        for key, (us, answered, told) in list(self.sent.items()):
            if now - us > self.horizon and not told:
                self.sent[key][2] = True
                if not answered:
                    yield key, us
            if now - us > 2 * self.horizon:
                del self.sent[key]
                for ack in [a for a in self.acks if a[0] == key]:
                    del self.acks[ack]
        self._due = self.next_end()

    def next_end(self) -> int | None:
        return min((us + self.horizon * (2 if told else 1) for us, _, told in self.sent.values()), default=None)


def _folded(df: DataFrame, by: Sequence[str], order: Sequence[str], run, schema: T.StructType) -> DataFrame:
    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInPandas(run, schema)


def chains(df: DataFrame, by: Sequence[str], stage: str, chain: str, alias: str, token: str, us: str, seq: str, stages: Sequence[str], ttl_s: int, capacity: int = 4096, as_of_us: int | None = None) -> DataFrame:
    """The batch form of ``streaming.keyed.chains``: ``by`` and ``CHAIN_ROWS``; expired chains are rows with the time of their last row.

    ``as_of_us``: the time at which the chains that are still open at the end may have expired.
    """
    keys = list(by)
    schema = T.StructType([*df.select(*keys).schema.fields, *df.sparkSession.createDataFrame([], CHAIN_ROWS).schema.fields])

    def run(parts):
        current, held = None, None

        def gone(now) -> list[tuple]:
            return [(*current, c, t, None, "expired", None) for c, t in held.expire(now)]

        for pdf in parts:
            made = []
            for row in pdf[[*keys, us, seq, stage, chain, alias, token]].astype(object).itertuples(index=False, name=None):
                mark, (t, n, s, c, a, k) = row[: len(keys)], row[len(keys) :]
                if mark != current:
                    if held and as_of_us is not None:
                        made += gone(as_of_us)
                    current, held = mark, Chains(stages, ttl_s * 1_000_000, capacity)
                made += gone(t)
                found, verdict, took = held.accept(t, s, c, a, k)
                made.append((*mark, found, t, n, verdict, took))
            yield pd.DataFrame(made, columns=schema.names)
        if held and as_of_us is not None:
            yield pd.DataFrame(gone(as_of_us), columns=schema.names)

    return _folded(df, keys, [us, seq], run, schema)


def recent(df: DataFrame, by: Sequence[str], order: Sequence[str], member: str, capacity: int = 4096) -> DataFrame:
    """``df`` and ``fresh``: whether a row's member is not among the last ``capacity`` different ones of its key."""
    keys = list(by)
    schema = T.StructType([*df.schema.fields, T.StructField("fresh", T.BooleanType())])

    def run(parts):
        current, held = None, None
        for pdf in parts:
            fresh = []
            for mark, m in zip(pdf[keys].astype(object).itertuples(index=False, name=None), pdf[member].tolist(), strict=True):
                if mark != current:
                    current, held = mark, Recent(capacity)
                fresh.append(held.fresh(m))
            yield pdf.assign(fresh=fresh)

    return _folded(df, keys, order, run, schema)


def first_sights(df: DataFrame, by: Sequence[str], order: Sequence[str], member: str, capacity: int = 4096) -> DataFrame:
    """The rows of ``recent`` that are fresh."""
    return recent(df, by, order, member, capacity).filter(F.col("fresh")).drop("fresh")
