"""Order-dependent folds.

Rows of a key meet in one partition in order and pass through a small state: the fold reads Arrow
batches as they come and never holds a key's rows together, so a key may be of any size.
``ewma_dominant`` holds one mean a key, of a group of keys of bounded size.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .joins import sent


def ordered_fold(df: DataFrame, by: Sequence[str], order: Sequence[str], start: Callable[[], object], step: Callable[[object, object], object], out: Sequence[T.StructField]) -> DataFrame:
    """``df`` and the columns ``out``: ``step(state, row)`` returns their values for a row and changes the state in place.

    Rows come as named tuples, so the columns that ``step`` reads must not begin with an underscore.
    """
    schema = T.StructType([*df.schema.fields, *out])
    names = [f.name for f in out]
    keys = list(by)

    def run(parts):
        current, state = object(), None
        for pdf in parts:
            made = []
            marks = list(zip(*[pdf[k] for k in keys], strict=True)) if keys else [()] * len(pdf)
            for mark, row in zip(marks, pdf.itertuples(index=False), strict=True):
                if mark != current:
                    current, state = mark, start()
                made.append(step(state, row))
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(made, columns=names)], axis=1)

    dealt = (df.repartition(*keys) if keys else df.coalesce(1)).sortWithinPartitions(*keys, *order)
    return dealt.mapInPandas(run, schema)


def monotone_filter(df: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows in which every column exceeds that of the last accepted row; rejected rows do not move the baseline."""
    from pyspark.sql import functions as F

    def step(state: list, row):
        values = [getattr(row, c) for c in columns]
        good = not state or all(v > b for v, b in zip(values, state, strict=True))
        if good:
            state[:] = values
        return (good,)

    made = ordered_fold(df, by, order, list, step, [T.StructField("_accepted", T.BooleanType())])
    return made.filter(F.col("_accepted")).drop("_accepted")


#: Keys of a scope that a task of ``ewma_dominant`` holds at once, about.
GROUP_KEYS = 50_000


def _decayed(marked: DataFrame, n_scope: int, alpha: float, ratio: float, prune: float) -> DataFrame:
    """Of each snapshot and group of keys: the two greatest means, and the keys whose observation the choice of the dominant key may need.

    Input columns: the scope, snapshot, group, last (the mark at a snapshot's end), key, value and
    reset, in order.  The first row of a snapshot and group carries its ties and total.
    """
    keep = n_scope + 1
    schema = T.StructType([*marked.schema.fields[:keep], *[T.StructField(n, t) for n, t in (("k", T.StringType()), ("mean", T.DoubleType()), ("ties", T.LongType()), ("total", T.DoubleType()), ("reset", T.BooleanType()))]])

    def top(names: list[str], means: np.ndarray) -> int:
        same = np.flatnonzero(means == means.max())
        return int(min(same, key=names.__getitem__))

    def run(batches):
        current, slot, names, means, live, seen = object(), {}, [], np.zeros(0), np.zeros(0, bool), []
        for batch in batches:
            made = []
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                scope, (group, last, key, value, reset) = row[:keep], row[keep:]
                if (scope[:-1], group) != current:
                    current, slot, names, means, live = (scope[:-1], group), {}, [], np.zeros(0), np.zeros(0, bool)
                if not last:
                    if key is None or value is None:
                        raise ValueError("a key or value of ewma_dominant is null")
                    seen.append((key, value))
                    continue
                if reset:
                    live[:] = False
                    means[:] = 0
                    made.append((*scope, None, None, 0, 0.0, True))
                    seen = []
                    continue
                fresh = [k for k, _ in seen if k not in slot]
                slot.update(zip(fresh, range(len(names), len(names) + len(fresh))))
                names += fresh
                means = np.concatenate((means * (1 - alpha), np.zeros(len(fresh))))
                live = np.concatenate((live, np.zeros(len(fresh), bool)))
                at = np.array([slot[k] for k, _ in seen], np.int64)
                means[at] += alpha * np.array([v for _, v in seen], np.float64)
                live[at] = True
                small = means < prune
                small[at] = means[at] < 0  # a key that is seen stays, however small its mean
                live &= ~small
                means[~live] = 0
                ranked = np.where(live, means, -np.inf)
                best, second = None, None
                if live.any():
                    best = top(names, ranked)
                    greatest = ranked[best]
                    made.append((*scope, names[best], float(greatest), int((ranked == greatest).sum()), math.fsum(means), False))
                    ranked[best] = -np.inf
                    if live.sum() > 1:
                        second = top(names, ranked)
                        made.append((*scope, names[second], float(ranked[second]), 0, 0.0, False))
                else:
                    greatest = -math.inf
                    made.append((*scope, None, None, 0, 0.0, False))
                for i, (k, v) in zip(at.tolist(), seen, strict=True):
                    # an observation that leaves a key out of reach changes nothing, unless it lowers its mean
                    if i not in (best, second) and (not v >= 0 or live[i] and not greatest > ratio * means[i]):
                        made.append((*scope, k, float(means[i]) if live[i] else None, 0, 0.0, False))
                seen = []
                if len(made) > 10_000:
                    yield _rows(made, arrow)
                    made = []
            if made:
                yield _rows(made, arrow)

    arrow = to_arrow_schema(schema)
    return marked.mapInArrow(run, schema)


def _rows(made: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), schema, strict=True)], schema=schema)


def ewma_dominant(df: DataFrame, scope: Sequence[str], snapshot: str, key: str, value: str, alpha: float = 0.3, ratio: float = 1.2, prune: float = 1e-9) -> DataFrame:
    """Per snapshot the dominant key by decayed means: it is left only for a key of more than ``ratio`` times its mean.

    Input has one row per (scope, snapshot, key).  Output, one row per snapshot: dominant, share,
    challenger ratio, ties for the best, tenure in snapshots, switches so far.  A snapshot of zeros clears all.

    The keys of a scope are dealt to groups of about ``GROUP_KEYS``, each folded by a task of its own; per
    snapshot these give their two greatest means and the observed keys within ``ratio``, and one fold chooses among them.
    """
    from pyspark.sql import functions as F

    n = len(scope)
    rows = df.select(*[F.col(c).alias(f"s{i}") for i, c in enumerate(scope)], F.col(snapshot).alias("snap"), F.col(key).cast("string").alias("k"), F.col(value).cast("double").alias("v"))
    by = [f"s{i}" for i in range(n)]
    groups = F.ceil(F.approx_count_distinct("k") / GROUP_KEYS).cast("int")
    sizes = sent(rows.groupBy(*by).agg(F.greatest(F.lit(1), groups).alias("groups")).select(*[F.col(c).alias(f"_{c}") for c in by], "groups"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    ends = rows.groupBy(*by, "snap").agg(F.max((F.col("v") > 0) & ~F.isnan("v")).alias("some")).join(sizes, same)
    ends = ends.select(*by, "snap", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("g"), F.lit(True).alias("last"), F.lit(None).cast("string").alias("k"), F.lit(None).cast("double").alias("v"), (~F.coalesce("some", F.lit(False))).alias("reset"))
    dealt = rows.join(sizes, same).select(*by, "snap", F.pmod(F.xxhash64("k"), F.col("groups")).cast("int").alias("g"), F.lit(False).alias("last"), "k", "v", F.lit(False).alias("reset"))
    marked = dealt.unionByName(ends).repartition(*by, "g").sortWithinPartitions(*by, "g", "snap", "last")
    parts = _decayed(marked, n, alpha, ratio, prune)
    out = [("dominant", T.StringType()), ("share", T.DoubleType()), ("challenger", T.DoubleType()), ("ties", T.LongType()), ("tenure", T.LongType()), ("switches", T.LongType())]
    schema = T.StructType([*df.select(*scope, snapshot).schema.fields, *[T.StructField(c, t) for c, t in out]])
    arrow = to_arrow_schema(schema)

    def choose(state: dict, top: list, ties: list, total: list, own: tuple | None, reset: bool) -> tuple:
        if reset or not top:
            state.update(now=None, tenure=0)
            return (None, None, None, 0, 0, state["switches"])
        now, mean = state["now"], state["mean"]
        if now is not None:
            mean = own[0] if own else mean * (1 - alpha)
            mean = None if mean is None or own is None and mean < prune else mean
        best, greatest = top[0]
        if now is None or mean is None or greatest > ratio * mean:
            state["switches"] += now is not None and now != best
            state["tenure"] = state["tenure"] if now == best else 0
            now, mean = best, greatest
        state.update(now=now, mean=mean, tenure=state["tenure"] + 1)
        challenger = next((m for k, m in top if k != now), 0.0)
        return (now, mean / math.fsum(total), max(challenger, 0.0) / mean, sum(t for m, t in ties if m == greatest), state["tenure"], state["switches"])

    def run(batches):
        mark, state = None, {}
        top, ties, total, own, cleared = [], [], [], None, False
        for batch in batches:
            made = []
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                at, (k, mean, tied, sum_, reset) = row[: n + 1], row[n + 1 :]
                if at != mark:
                    if mark is not None:
                        made.append((*mark, *choose(state, top, ties, total, own, cleared)))
                    if mark is None or at[:-1] != mark[:-1]:
                        state = {"now": None, "mean": None, "tenure": 0, "switches": 0}
                    mark, top, ties, total, own, cleared = at, [], [], [], None, reset
                if k is None:
                    continue
                if k == state["now"]:
                    own = (mean,)
                if mean is not None:
                    top = sorted([*top, (k, mean)], key=lambda x: (-x[1], x[0]))[:2]
                if tied:
                    ties.append((mean, tied))
                    total.append(sum_)
            if made:
                yield _rows(made, arrow)
        if mark is not None:
            yield _rows([(*mark, *choose(state, top, ties, total, own, cleared))], arrow)

    return (parts.repartition(*by) if by else parts.coalesce(1)).sortWithinPartitions(*by, "snap").mapInArrow(run, schema)


def lifecycle(df: DataFrame, by: Sequence[str], order: Sequence[str], stage: str, ts_us: str, stages: Sequence[str], ttl_s: int, max_open: int = 4096) -> DataFrame:
    """Stages in order within a time to live; the last stage of a whole chain gets ``completed`` true and its duration.

    A first stage opens a chain (or opens it anew); the next expected stage moves every open chain
    of the key on; a chain older than the time to live is gone.
    """
    follow = {s: i for i, s in enumerate(stages)}

    def step(open_: dict, row):
        now, i = getattr(row, ts_us), follow.get(getattr(row, stage))
        for k in [k for k, v in open_.items() if now - v[1] > ttl_s * 1_000_000]:
            del open_[k]
        if i is None:
            return (False, None)
        if i == 0:
            open_["chain"] = (0, now)
            while len(open_) > max_open:
                open_.pop(next(iter(open_)))
            return (False, None)
        at, began = open_.get("chain", (None, None))
        if at != i - 1:
            return (False, None)
        if i == len(stages) - 1:
            del open_["chain"]
            return (True, (now - began) / 1e6)
        open_["chain"] = (i, began)
        return (False, None)

    return ordered_fold(df, by, order, dict, step, [T.StructField("completed", T.BooleanType()), T.StructField("duration_s", T.DoubleType())])


class TtlMembers:
    """Members with their last sight, and a heap of sights by time and member, in which older sights of a member are stale."""

    def __init__(self, ttl_us: int, capacity: int, seen: dict | None = None):
        self.ttl, self.capacity = ttl_us, capacity
        self.seen = dict(seen or {})
        self._heap = [self._sight(t, k) for k, t in self.seen.items()]
        heapq.heapify(self._heap)

    @staticmethod
    def _sight(time: int, member) -> tuple:
        return time, member is None, "" if member is None else member, member

    def _oldest(self) -> tuple | None:
        while self._heap and self.seen.get(self._heap[0][-1]) != self._heap[0][0]:
            heapq.heappop(self._heap)
        return self._heap[0] if self._heap else None

    def touch(self, member, now: int) -> tuple[bool, int, int, int]:
        """Whether the member was added, how many were expired and how many dropped, and the size after it."""
        expired = dropped = 0
        while (old := self._oldest()) and now - old[0] > self.ttl:
            del self.seen[old[-1]]
            expired += 1
        added = member not in self.seen
        self.seen[member] = now
        heapq.heappush(self._heap, self._sight(now, member))
        while len(self.seen) > self.capacity:
            del self.seen[self._oldest()[-1]]
            dropped += 1
        return added, expired, dropped, len(self.seen)


def ttl_set(df: DataFrame, by: Sequence[str], order: Sequence[str], key: str, ts_us: str, ttl_s: int, capacity: int) -> DataFrame:
    """A bounded set of keys: expire first, then touch or add, then drop the least recently seen while over capacity.

    Per row: whether the key was added, how many were expired and how many dropped, and the size after it.
    """

    def step(seen: TtlMembers, row):
        return seen.touch(getattr(row, key), getattr(row, ts_us))

    out = [("added", T.BooleanType()), ("expired", T.LongType()), ("dropped", T.LongType()), ("size", T.LongType())]
    return ordered_fold(df, by, order, lambda: TtlMembers(ttl_s * 1_000_000, capacity), step, [T.StructField(n, t) for n, t in out])
