"""Suffix order and common prefixes of a shard by external induced sorting.

The shard is a file of chunks, each closed by a separator that sorts before every byte.  Suffixes
are S or L type as usual.  The leftmost S suffixes (LMS) are ordered first: their substrings are
sorted by an induction and named, and the string of names is ordered by recursion; in their order
they then induce all others.  A string of names of at most ``BASE`` symbols is ordered in memory.

Queues carry suffix tuples: the position, and the common prefix with the suffix put out before it
in the same queue.  There is a queue for each first symbol; what it holds arrives in order, so symbol
and arrival together are the priority, and pieces of bounded size move at once.  A tuple's common
prefix is one more than the least of those put out since the last tuple of its symbol.  The
recursion's common prefixes count names; they become symbols by the first name that differs.

Queues beyond ``QUEUE_MEMORY``, the text, types, order and prefixes lie in files, so a shard may be
far larger than memory.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: Bytes that pending tuples of a set of queues may take in memory before they go to disk.
QUEUE_MEMORY = 4 << 20
#: Tuples that move at once, and symbols of a string that is ordered in memory.
PIECE, BASE = 1 << 17, 1 << 20


def disk_array(n: int, kind) -> np.ndarray:
    """An array in a file without a name; it goes with its last reference."""
    file = tempfile.TemporaryFile()
    return np.memmap(file, kind, "w+", shape=(max(n, 1),))[:n].view(np.ndarray)


def _pieces(n: int) -> Iterator[slice]:
    return (slice(lo, min(lo + PIECE, n)) for lo in range(0, n, PIECE))


class DiskQueues:
    """First-in first-out tuples (position, common prefix) by symbol; beyond the memory allowed, runs of them go to one file."""

    def __init__(self, memory: int | None = None):
        self._runs: dict[int, list] = {}
        self._memory, self._held = QUEUE_MEMORY if memory is None else memory, 0
        self._file = tempfile.TemporaryFile()
        self._end = 0

    def push(self, symbol: int, run: np.ndarray) -> None:
        if self._held + run.nbytes > self._memory:
            self._file.seek(self._end)
            self._file.write(run.tobytes())
            self._runs.setdefault(symbol, []).append((self._end, len(run)))
            self._end += run.nbytes
        else:
            self._held += run.nbytes
            self._runs.setdefault(symbol, []).append(run.copy())

    def deal(self, symbols: np.ndarray, runs: np.ndarray) -> None:
        """Append tuples, ordered by symbol, to their queues."""
        if not len(runs):
            return
        cuts = np.flatnonzero(np.diff(symbols)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(runs)], strict=True):
            self.push(int(symbols[a]), runs[a:b])

    def take(self, symbol: int) -> Iterator[np.ndarray]:
        """The queue's tuples in pieces; those that are pushed to it meanwhile come after them."""
        while waiting := self._runs.pop(symbol, None):
            some, size = [], 0
            for run in waiting:
                if isinstance(run, tuple):
                    self._file.seek(run[0])
                    run = np.frombuffer(self._file.read(8 * run[1]), np.int32).reshape(-1, 2)
                else:
                    self._held -= run.nbytes
                some.append(run)
                size += len(run)
                if size >= PIECE:
                    yield np.concatenate(some)
                    some, size = [], 0
            if some:
                yield np.concatenate(some)


def _range_min(v: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least of ``v[lo]`` to ``v[hi]``, both in."""
    level = np.frexp(hi - lo + 1)[1] - 1  # the greatest power of two within the range
    out = np.empty(len(lo), v.dtype)
    for k in range(int(level.max()) + 1):
        mine = level == k
        out[mine] = np.minimum(v[lo[mine]], v[hi[mine] - (1 << k) + 1])
        v = np.minimum(v[: -(1 << k)], v[1 << k :]) if len(v) > 1 << k else v
    return out


class Carried:
    """Common prefixes of the tuples to push, from those of the suffixes put out, up to ``cap``."""

    def __init__(self, symbols: int, cap: int):
        self._cap, self._now = cap, 0
        #: Per symbol: the batch of its last tuple (-1: none), and the least prefix put out after it in that batch.
        self._batch, self._tail = disk_array(symbols, np.int32), disk_array(symbols, np.int32)
        self._batch[:] = -1
        #: Batches since which no smaller prefix was put out, and their least prefix: both ascend.
        self._index: list[int] = []
        self._value: list[int] = []

    def put(self, prefixes: np.ndarray, at: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The batch ``prefixes`` is put out, and at its places ``at`` tuples of ``symbols`` are pushed, ordered by symbol and place."""
        out = np.empty(len(at), np.int32)
        if len(at):
            first = np.append(True, symbols[1:] != symbols[:-1])
            last = np.append(first[1:], True)
            own = symbols[first]
            before = self._batch[own]
            between = np.append(np.array(self._value, np.int32), self._cap)[np.searchsorted(self._index, before, "right")] if self._index else self._cap
            least = np.minimum(np.minimum(self._tail[own], np.minimum.accumulate(prefixes)[at[first]]), between)
            out[first] = np.where(before < 0, -1, least)
            rest = np.flatnonzero(~first)
            if len(rest):
                out[rest] = _range_min(prefixes, at[rest - 1] + 1, at[rest])
            after = np.append(np.minimum.accumulate(prefixes[::-1])[::-1], self._cap)
            self._tail[symbols[last]] = after[at[last] + 1]
            self._batch[symbols[last]] = self._now
        least = int(prefixes.min())
        while self._value and self._value[-1] >= least:
            self._value.pop()
            self._index.pop()
        self._index.append(self._now)
        self._value.append(least)
        self._now += 1
        out = np.minimum(out + 1, self._cap)
        out[symbols == 0] = 0  # a separator is no common symbol
        return out


def _push(t: np.ndarray, run: np.ndarray, keep, queues: DiskQueues, carried: Carried | None) -> None:
    """From suffixes put out: tuples of those before them whose symbol ``keep`` wants."""
    at = np.flatnonzero(run[:, 0] > 0)
    symbols = np.asarray(t[run[at, 0] - 1])
    wanted = keep(symbols)
    at, symbols = at[wanted], symbols[wanted]
    order = np.argsort(symbols, kind="stable")
    at, symbols = at[order], symbols[order]
    prefixes = carried.put(run[:, 1], at, symbols) if carried else np.zeros(len(at), np.int32)
    queues.deal(symbols, np.column_stack((run[at, 0] - 1, prefixes)).astype(np.int32))


def _alike(t: np.ndarray, a: int, b: int, cap: int) -> int:
    """Common run of the first symbol of an L and an S suffix, which part where the shorter run ends."""
    c, j = t[a], 0
    while j < cap and c and t[a + j] == c == t[b + j]:
        j += 1
    return j


def _counts(t: np.ndarray, s: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of each first symbol, and the L suffixes among them."""
    every, l_type = np.zeros(top, np.int64), np.zeros(top, np.int64)
    for p in _pieces(len(t)):
        every += np.bincount(t[p], minlength=top)
        l_type += np.bincount(t[p][~s[p]], minlength=top)
    return every, l_type


def _induce(t: np.ndarray, s: np.ndarray, top: int, lms: np.ndarray, prefixes: np.ndarray | None, cap: int) -> tuple[np.ndarray, np.ndarray | None]:
    """The order of all suffixes that the given order of the LMS suffixes induces, and the common prefix of each with the one before it.

    ``prefixes``: those of the LMS suffixes; None where only the order is wanted.
    """
    n = len(t)
    out, pre = disk_array(n, np.int32), disk_array(n + 1, np.int32)
    every, l_type = _counts(t, s, top)
    heads = np.cumsum(every) - every
    present = np.flatnonzero(every).tolist()
    tails = DiskQueues()
    for p in _pieces(len(lms)):
        symbols = np.asarray(t[lms[p]])
        order = np.argsort(symbols, kind="stable")
        tails.deal(symbols[order], np.column_stack((lms[p], prefixes[p] if prefixes is not None else np.zeros(len(symbols), np.int32)))[order].astype(np.int32))

    carry = prefixes is not None
    queues, carried = DiskQueues(), Carried(top, cap) if carry else None
    for c in present:  # L suffixes, ascending
        end = int(heads[c])
        for run in queues.take(c):
            out[end : end + len(run)], pre[end : end + len(run)] = run[:, 0], run[:, 1]
            end += len(run)
            _push(t, run, lambda b, c=c: b >= c, queues, carried)
        met = False
        for run in tails.take(c):
            if not met and carry:
                run[0, 1] = _alike(t, int(out[end - 1]), int(run[0, 0]), cap) if end > heads[c] else 0
            met = True
            _push(t, run, lambda b, c=c: b > c, queues, carried)
    queues, carried = DiskQueues(), Carried(top, cap) if carry else None
    for c in reversed(present):  # S suffixes, descending: a prefix is that with the next larger suffix
        end = int(heads[c] + every[c])
        for run in queues.take(c):
            out[end - len(run) : end] = run[::-1, 0]
            pre[end - len(run) + 1 : end + 1] = run[::-1, 1]
            end -= len(run)
            _push(t, run, lambda b, c=c: b <= c, queues, carried)
        first, last = int(heads[c]), int(heads[c] + l_type[c])
        if first == last:
            continue
        if carry:
            pre[last] = _alike(t, int(out[last - 1]), int(out[last]), cap) if l_type[c] < every[c] else 0
        for hi in range(last, first, -PIECE):
            lo = max(first, hi - PIECE)
            run = np.column_stack((out[lo:hi][::-1], pre[lo + 1 : hi + 1][::-1]))
            _push(t, run, lambda b, c=c: b < c, queues, carried)
    out[0], pre[0] = n - 1, 0  # the end of the text, which nothing induces
    if n > 1:
        pre[1] = 0
    return out, pre[:n] if carry else None


def _types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is S type: its first differing neighbour to the right is larger."""
    n = len(t)
    s = disk_array(n, bool)
    s[n - 1] = True  # the end is S type
    for p in reversed(list(_pieces(n - 1))):
        step = np.sign(t[p.start + 1 : p.stop + 1].astype(np.int64) - t[p])
        at = np.where(step != 0, np.arange(len(step)), len(step))
        following = np.minimum.accumulate(at[::-1])[::-1]
        s[p] = np.where(following < len(step), step[np.minimum(following, len(step) - 1)] > 0, s[p.stop])
    return s


def _lms(s: np.ndarray) -> np.ndarray:
    found = [np.flatnonzero(s[p.start + 1 : p.stop + 1] & ~s[p]) + p.start + 1 for p in _pieces(len(s) - 1)]
    made = disk_array(sum(map(len, found)), np.int32)
    made[:] = np.concatenate(found) if found else 0
    return made


def _named(t: np.ndarray, s: np.ndarray, lms: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the LMS-substrings in text order, and their number: equal substrings share a name, names follow their order."""
    m = len(lms)
    index = disk_array(len(t), np.int32)
    index[lms] = np.arange(m, dtype=np.int32)
    names, name, before = disk_array(m, np.int32), -1, None
    end = lambda i: np.where(i + 1 < m, lms[np.minimum(i + 1, m - 1)], lms[i])
    for p in _pieces(len(order)):
        b = order[p]
        b = b[b >= 0]
        if not len(b):
            continue
        a = np.append(b[0] if before is None else before, b[:-1])
        length = end(index[b]) - b
        same = length == end(index[a]) - a
        live, j = np.flatnonzero(same), 0
        while len(live):
            live = live[length[live] >= j]
            equal = (t[a[live] + j] == t[b[live] + j]) & (s[a[live] + j] == s[b[live] + j])
            same[live[~equal]] = False
            live = live[equal]
            j += 1
        if before is None:
            same[0] = False
        made = name + np.cumsum(~same)
        names[index[b]] = made
        name, before = int(made[-1]), b[-1]
    return names, name + 1


def _in_memory(t: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Order and prefixes of a string that fits the memory allowed: ranks are doubled in depth until all differ.

    A rank is the first place of its group in the order; only groups of several suffixes are sorted again.
    """
    n = len(t)
    order = np.argsort(t, kind="stable")
    rank = np.empty(n, np.int64)
    live, step, key = np.arange(n), 0, t[order].astype(np.int64)
    while len(live):
        at = order[live]
        if step:
            behind = np.zeros(len(at), np.int64)
            inside = at + step < n
            behind[inside] = rank[at[inside] + step] + 1
            key = rank[at] * (n + 1) + behind
            o = np.argsort(key)
            at, key = at[o], key[o]
            order[live] = at
        new = np.append(True, key[1:] != key[:-1])
        rank[at] = live[np.maximum.accumulate(np.where(new, np.arange(len(live)), 0))]
        live = live[~(new & np.append(new[1:], True))]
        step = max(1, 2 * step)
    # prefixes: where the suffix before in the order moves along, a prefix is one less than its left neighbour's
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    fresh = np.append(True, (before[1:] <= 0) | (before[:-1] + 1 != before[1:]) | (t[:-1] != t[np.maximum(before[1:], 1) - 1]))
    value = np.zeros(n, np.int64)
    at = np.flatnonzero(fresh & (before >= 0))
    other, j = before[at], 0
    while len(at):
        inside = np.maximum(at, other) + j < n
        same = np.zeros(len(at), bool)
        same[inside] = t[at[inside] + j] == t[other[inside] + j]
        value[at[~same]] = j
        at, other, j = at[same], other[same], j + 1
    start = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    value = np.maximum(0, value[start] - (np.arange(n) - start))
    return order.astype(np.int32), np.minimum(value[order], cap).astype(np.int32)


def _in_symbols(t: np.ndarray, lms: np.ndarray, order: np.ndarray, names: np.ndarray, cap: int, ends: np.ndarray | None) -> np.ndarray:
    """The common prefixes of LMS suffixes in order, from those of their names: the first name that differs is compared."""
    out = disk_array(len(order), np.int32)
    for p in _pieces(len(order)):
        j = order[p]
        i = np.append(order[p.start - 1] if p.start else j[0], j[:-1])
        k = names[p]
        x, y = lms[i].astype(np.int64), lms[j].astype(np.int64)
        room = np.full(len(j), cap, np.int64)
        if ends is not None:
            for z in (x, y):
                room = np.minimum(room, ends[np.searchsorted(ends, z)] - z)
        value = np.minimum(lms[np.minimum(j + k, len(lms) - 1)] - y, room)
        live = np.flatnonzero(value < room)
        while len(live):
            a, b = x[live] + value[live], y[live] + value[live]
            inside = np.maximum(a, b) < len(t)
            live, a, b = live[inside], a[inside], b[inside]
            live = live[t[a] == t[b]]
            value[live] += 1
            live = live[value[live] < room[live]]
        out[p] = value
    if len(out):
        out[0] = 0
    return out


def suffix_order(t: np.ndarray, cap: int = 1 << 30, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``t`` in order, and the common prefix of each with the one before it, up to ``cap``.

    ``ends``: places of the separators (symbol 0), beyond which no prefix goes.  The last symbol is the
    least of all; without ``ends`` it occurs once.
    """
    n = len(t)
    if ends is None and n <= BASE:
        return _in_memory(t, cap)
    top = max(int(t[p].max()) for p in _pieces(n)) + 1
    s = _types(t)
    lms = _lms(s)
    order, _ = _induce(t, s, top, lms, None, cap)
    for p in _pieces(n):  # of all suffixes, the LMS ones stay
        x = order[p]
        order[p] = np.where((x > 0) & s[x] & ~s[np.maximum(x - 1, 0)], x, -1)
    names, different = _named(t, s, lms, order)
    del order
    if different == len(lms):
        by_name = disk_array(len(lms), np.int32)
        by_name[names] = np.arange(len(lms), dtype=np.int32)
        common = np.zeros(len(lms), np.int32)
    else:
        by_name, common = suffix_order(names, cap)
    prefixes = _in_symbols(t, lms, by_name, common, cap, ends)
    sorted_lms = disk_array(len(lms), np.int32)
    for p in _pieces(len(lms)):
        sorted_lms[p] = lms[by_name[p]]
    return _induce(t, s, top, sorted_lms, prefixes, cap)
