"""Removal of long repeated byte strings across documents, by suffix order of distributed shards.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere else.  Steps:

1. Every window of ``LENGTH`` bytes has an anchor, the least-hashed ``GRAM`` bytes inside it, so
   equal windows have equal anchors.  Runs of windows with one anchor are the units of work.
2. Anchors that occur once are dropped by a join on narrow rows.  Texts with equal bytes are one.
3. The other runs become chunks (a run's windows overlap, so a chunk is a run and one window
   more), are collapsed where equal, and go to shards by anchor: equal windows share a shard.
4. Each shard orders its suffixes by induced sorting with disk-backed queues and marks windows
   that share ``LENGTH`` bytes with a neighbour.  The chunks of an anchor that has very many (a
   common line in different surroundings) are first cut again, by anchors that avoid what is common
   to them, and collapsed where equal, so that they too spread over shards.  Shards are about ``SHARD_BYTES``, but
   may be of any size: what they hold lies in files.
5. Marked windows return to their texts and are joined into spans.

Null texts are empty; texts shorter than ``LENGTH`` lose nothing.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, apart, release, scratch, slices, small, stash, table, utf8
from .induced import disk_array, suffix_order

LENGTH, GRAM = 400, 100
#: Passages of the pipeline: at least so many words; 50 words hold 200 bytes or more but for very short words.
PASSAGE_WORDS, PASSAGE_BYTES, PASSAGE_GRAM = 50, 200, 50
#: Chunk bytes of a shard, about, and different chunks of an anchor beyond which it is parted by a second one.
#: A shard of twice the size has about ``induced.BASE`` names; with more it is ordered by a second recursion, for five times as long.
SHARD_BYTES, HOT_CHUNKS = 3 << 19, 3000
#: So often at most a crowded anchor's chunks are parted again; of about so many of them grams are counted, and so many make one common.
ROUNDS, LOOKED_AT, LEAST_COMMON = 4, 200, 6
_SLAB = 1 << 18
_ODD = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def _powers() -> tuple[np.ndarray, np.ndarray]:
    n = _SLAB + 1
    up, down = np.full(n, _ODD, np.uint64), np.full(n, pow(_ODD, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


_UP, _DOWN = _powers()
_BYTES = np.random.default_rng(7).integers(0, _MASK, 256, np.uint64, endpoint=True)


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all ``k``-byte strings of at most a slab of bytes."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[data] * _UP[:n], out=sums[1:])
    h = (sums[k:] - sums[:-k]) * _DOWN[: n - k + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def runs(text: bytes, length: int = LENGTH, gram: int = GRAM, choice: int = 0, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """First window of each run, and its anchor.  A run ends where the next begins, or with the text's last window.

    Anchors depend on the window's bytes alone: the leftmost of the least hashes (their upper 44 bits).
    ``choice``: 0, or another number for another hash, whose anchors lie elsewhere.  ``common``: sorted hashes
    of strings that are anchors only where a window holds no other.
    """
    data = np.frombuffer(text, np.uint8)
    n_windows, w = len(data) - length + 1, length - gram + 1
    firsts, anchors = [], []
    step = _SLAB - length + 1
    last = -1
    for lo in range(0, max(n_windows, 0), step):
        hi = min(lo + step, n_windows)
        h = gram_hashes(data[lo : hi + length - 1], gram)
        if choice:
            last_of = np.zeros(len(h), bool)
            if common is not None and len(common):
                last_of = common[np.minimum(np.searchsorted(common, h), len(common) - 1)] == h
            h = (h + np.uint64(choice - 1)) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
            h = h >> np.uint64(1) | last_of.astype(np.uint64) << np.uint64(63)
        m = (h >> np.uint64(20) << np.uint64(20)) | np.arange(len(h), dtype=np.uint64)
        span = 1
        while span * 2 <= w:
            m = np.minimum(m[:-span], m[span:])
            span *= 2
        if w > span:
            m = np.minimum(m[: len(m) - (w - span)], m[w - span :])
        at = (m & np.uint64((1 << 20) - 1)).astype(np.int64)
        new = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        if len(new) and lo + at[0] == last:
            new = new[1:]
        firsts.append(lo + new)
        anchors.append(h[at[new]].view(np.int64))
        last = lo + int(at[-1])
    if not firsts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(firsts), np.concatenate(anchors)


def _text_id(text) -> F.Column:
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32))


def _anchors(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """``(tid, first, last, anchor)`` runs per row of ``texts (tid, text)``, as arrays."""
    lists = T.StructType([T.StructField("tid", T.BinaryType()), T.StructField("first", T.ArrayType(T.IntegerType())), T.StructField("last", T.ArrayType(T.IntegerType())), T.StructField("anchor", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in batches:
            for part in slices([batch], "text", 4 << 20):
                found = []
                for t in utf8(part.column(1)):
                    first, anchor = runs(t, length, gram)
                    last = np.append(first[1:], len(t) - length + 1) - 1
                    found.append((first, last, anchor))
                columns = [pa.array([f[i] for f in found], pa.list_(kind)) for i, kind in enumerate((pa.int32(), pa.int32(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["tid", "first", "last", "anchor"])

    return texts.mapInArrow(run, lists)


def _chunks(texts: DataFrame, length: int) -> DataFrame:
    """``(tid, first, anchor, chunk)`` from ``(tid, text, runs)``; the same text in a row counts once."""

    def run(batches):
        before = None
        for batch in batches:
            for part in slices([batch], "text", 2 << 20):
                out = ([], [], [], [])
                for tid, text, rs in zip(part.column(0).to_pylist(), utf8(part.column(1)), part.column(2).to_pylist(), strict=True):
                    if tid == before:
                        continue
                    before = tid
                    for r in rs:
                        for column, value in zip(out, (tid, r["first"], r["anchor"], text[r["first"] : r["last"] + length]), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.binary(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["tid", "first", "anchor", "chunk"])

    return texts.mapInArrow(run, "tid binary, first int, anchor long, chunk binary")


_RANGES = "cid binary, a int, b int"


def _ranges(cids: list[bytes], starts: np.ndarray, marked: np.ndarray) -> pa.RecordBatch:
    """Runs of marked windows within each chunk."""
    at = np.flatnonzero(marked)
    chunk = np.searchsorted(starts, at, "right") - 1
    cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(chunk) != 0)) + 1
    head, tail = np.concatenate(([0], cut)).astype(np.int64), np.concatenate((cut - 1, [len(at) - 1])).astype(np.int64)
    if not len(at):
        head = tail = np.zeros(0, np.int64)
    of = chunk[head]
    return pa.RecordBatch.from_arrays([pa.array([cids[i] for i in of.tolist()], pa.binary()), pa.array(at[head] - starts[of], pa.int32()), pa.array(at[tail] - starts[of], pa.int32())], names=["cid", "a", "b"])


def marked_windows(chunks: list[bytes] | np.ndarray, lengths: np.ndarray, many: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Chunk starts in the shard's text, and which positions begin a window that also begins elsewhere.

    ``many``: the chunk occurs more than once, so each of its windows does.
    """
    text = chunks if isinstance(chunks, np.ndarray) else np.frombuffer(b"".join(chunks), np.uint8)
    n = len(text) + len(lengths)
    if n >= 1 << 31:
        raise ValueError(f"a shard of {n} symbols is beyond the 32-bit positions of the suffix order; use more shards (SHARD_BYTES)")
    t = disk_array(n, np.uint16)  # zero where nothing is written: the separators
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    for lo in range(0, len(text), _SLAB):
        part = text[lo : lo + _SLAB]
        at = np.arange(lo, lo + len(part))
        t[at + np.searchsorted(starts - np.arange(len(starts)), at, "right") - 1] = part.astype(np.uint16) + 1
    order, prefix = suffix_order(t, length, ends)
    marked = disk_array(n, bool)
    for lo in range(0, n, _SLAB):
        k = np.flatnonzero(prefix[lo : lo + _SLAB] >= length) + lo
        marked[order[k]] = True
        marked[order[k - 1]] = True
    del order, prefix
    for i in np.flatnonzero(many).tolist():
        marked[starts[i] : ends[i] - length + 1] = True
    return starts, marked


def _solve(batches, length: int):
    """Shards one after the other; the chunks of one are gathered in a file."""
    import tempfile

    shard, file, cids, lengths, many = None, None, [], [], []

    def out():
        file.flush()
        text = np.memmap(file, np.uint8, "r") if sum(lengths) else np.zeros(0, np.uint8)
        starts, marked = marked_windows(text, np.array(lengths, np.int64), np.array(many, bool), length)
        return _ranges(cids, starts, marked)

    for batch in batches:
        for s, cid, chunk, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if s != shard:
                if cids:
                    yield out()
                shard, file, cids, lengths, many = s, tempfile.TemporaryFile(), [], [], []
            file.write(chunk)
            cids.append(cid)
            lengths.append(len(chunk))
            many.append(m > 1)
    if cids:
        yield out()


def _grams(batches, gram: int):
    """``(anchor, gram)``: the hashes of the different strings of ``gram`` bytes of each chunk."""
    for batch in batches:
        for one in slices([batch], "chunk", 1 << 18):
            found = [np.unique(gram_hashes(np.frombuffer(chunk, np.uint8), gram)) for chunk in one.column(1).to_pylist()]
            anchors = np.repeat(one.column(0).to_numpy(zero_copy_only=False), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([pa.array(anchors, pa.int64()), pa.array(np.concatenate(found).view(np.int64))], names=["anchor", "gram"])


def _split(chunks: pa.Table, common: pa.Table, length: int, gram: int, choice: int) -> pa.Table:
    """``(of, gram, cid, first, part, m)``: the runs of some chunks of a crowded anchor by another choice of anchors."""
    avoided = np.sort(common.column("grams").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
    out = ([], [], [], [], [], [])
    for of, cid, chunk, m in zip(*(chunks.column(c).to_pylist() for c in ("anchor", "cid", "chunk", "m")), strict=True):
        first, anchor = runs(chunk, length, gram, choice, avoided)
        last = np.append(first[1:], len(chunk) - length + 1) - 1
        for f, l, a in zip(first.tolist(), last.tolist(), anchor.tolist(), strict=True):
            for column, value in zip(out, (of, a, cid, f, chunk[f : l + length], m), strict=True):
                column.append(value)
    return pa.table([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.int64()), strict=True)], names=["of", "gram", "cid", "first", "part", "m"])


def _parted(chunks: DataFrame, crowded: DataFrame, length: int, gram: int, choice: int = 1) -> DataFrame:
    """``(cid, a, b)``: runs of windows that repeat, of the ``chunks (anchor, cid, chunk, m)`` of ``crowded (anchor, k)``.

    The chunks are cut at other anchors, which avoid the strings that many chunks of the crowded one hold:
    what surrounds a common passage is dealt by itself, and what lies inside is equal and collapses.
    Equal windows have equal anchors whatever is avoided, since that hangs on the crowded anchor alone.
    """
    mine = chunks.join(small(crowded, 100_000), "anchor")
    looked = mine.filter(F.pmod(F.xxhash64("cid"), F.floor(F.col("k") / LOOKED_AT) + 1) == 0).select("anchor", "chunk")
    counts = looked.mapInArrow(functools.partial(_grams, gram=gram), "anchor long, gram long").groupBy("anchor", "gram").agg(F.count(F.lit(1)).alias("n"))
    common = counts.filter(F.col("n") >= LEAST_COMMON).groupBy("anchor").agg(F.collect_list("gram").alias("grams"))
    # about a thousand chunks a group, each with the anchor's list
    groups = F.floor(F.col("k") / 1000) + 1
    lists = crowded.join(common, "anchor", "left").select("anchor", F.coalesce("grams", F.array().cast("array<long>")).alias("grams"), F.explode(F.sequence(F.lit(0).cast("long"), groups - 1)).alias("group"))
    dealt = mine.select("anchor", F.pmod(F.xxhash64("cid"), groups).alias("group"), "cid", "chunk", "m")
    split = lambda left, right: _split(left, right, length, gram, choice)
    cut = dealt.groupBy("anchor", "group").cogroup(lists.groupBy("anchor", "group")).applyInArrow(split, "of long, gram long, cid binary, first int, part binary, m long")
    parted = stash(cut.select(F.xxhash64("of", "gram").alias("anchor"), "cid", "first", "part", "m", F.unhex(F.substring(F.sha2("part", 256), 1, 32)).alias("pid")), "parts")
    parts = stash(parted.groupBy("anchor", F.col("pid").alias("cid"), F.col("part").alias("chunk")).agg(F.sum("m").alias("m")), "parts-to-order")
    sizes = parts.groupBy("anchor").agg(F.count(F.lit(1)).alias("k"), F.max("m").alias("m"), F.max("cid").alias("cid"), F.max(F.octet_length("chunk")).alias("n"))
    alone = _alone(sizes, length)
    several = stash(sizes.filter("k > 1").select("anchor", "k"), "anchors-to-order")
    found = stash(_repeats(parts, several, length, gram, choice + 1).unionByName(alone), "ranges-of-parts")
    return parted.select("cid", "first", "pid").join(found.withColumnRenamed("cid", "pid"), "pid").select("cid", (F.col("first") + F.col("a")).alias("a"), (F.col("first") + F.col("b")).alias("b"))


def _alone(sizes: DataFrame, length: int) -> DataFrame:
    """``(cid, a, b)``: a chunk without another of its anchor has nothing to be compared with, and repeats if it occurs more than once."""
    return sizes.filter("k = 1 and m > 1").select("cid", F.lit(0).alias("a"), (F.col("n") - length).alias("b"))


def _repeats(chunks: DataFrame, several: DataFrame, length: int, gram: int, choice: int = 1) -> DataFrame:
    """``(cid, a, b)``: runs of windows that repeat, of the ``chunks (anchor, cid, chunk, m)`` of the anchors ``several (anchor, k)``."""
    crowded = several.filter(F.col("k") > HOT_CHUNKS)
    if choice > ROUNDS or crowded.isEmpty():
        return _ordered(chunks.join(several.select("anchor"), "anchor", "left_semi").select("anchor", "cid", "chunk", "m"), length)
    usual = chunks.join(several.filter(F.col("k") <= HOT_CHUNKS).select("anchor"), "anchor", "left_semi").select("anchor", "cid", "chunk", "m")
    return _ordered(usual, length).unionByName(_parted(chunks, crowded, length, gram, choice))


def _dealt(chunks: DataFrame) -> DataFrame:
    """``(shard, cid, chunk, m)`` of ``chunks (anchor, cid, chunk, m)``, one shard a task."""
    total = chunks.agg(F.coalesce(F.sum(F.octet_length("chunk")), F.lit(0))).first()[0]
    n = total // SHARD_BYTES + 1
    sharded = chunks.select(F.pmod(F.xxhash64("anchor"), F.lit(n)).cast("int").alias("shard"), "cid", "chunk", "m")
    # by the number itself: hashed numbers collide, and a task orders several shards while others have none
    return sharded.repartitionById(n, "shard").sortWithinPartitions("shard")


def _ordered(chunks: DataFrame, length: int) -> DataFrame:
    """``(cid, a, b)``: runs of windows of ``chunks (anchor, cid, chunk, m)`` that repeat, from the suffix orders of shards dealt by anchor."""
    return _dealt(chunks).mapInArrow(functools.partial(_solve, length=length), _RANGES)


def repeated_spans(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``(tid, spans)``: per distinct text with something to remove, the maximal byte runs ``[a, b)``, in order."""
    texts = docs.select(F.col(text).alias("text")).filter(F.octet_length("text") >= length).select(_text_id(F.col("text")).alias("tid"), "text")
    rows = stash(_anchors(texts, length, gram), "anchors")
    copies = rows.groupBy("tid").agg(F.count(F.lit(1)).alias("n"), F.max(F.element_at("last", -1)).alias("last")).filter("n > 1").select("tid", F.array(F.struct(F.lit(0).alias("a"), (F.col("last") + length).alias("b"))).alias("spans"))
    copies = stash(copies, "copies")
    once = rows.dropDuplicates(["tid"]).select("tid", F.inline(F.arrays_zip("first", "last", "anchor")))
    once = stash(once, "runs")
    # written first, so that the join below has two plain exchanges, of which a hot anchor's can be split
    release(rows)
    again = stash(once.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor"), "anchors-again")
    single = once.join(again, "anchor", "left_semi")
    asked = single.groupBy("tid").agg(F.collect_list(F.struct("first", "last", "anchor")).alias("runs"))
    made = texts.join(asked, "tid").select("tid", "text", "runs")
    chunks = stash(_chunks(made, length).withColumn("cid", F.unhex(F.substring(F.sha2("chunk", 256), 1, 32))), "chunks")
    release(once, again)
    # per different chunk: how often it occurs (in a text that has copies, twice at least); per anchor: its different chunks
    narrow = chunks.select("tid", "first", "anchor", "cid", F.octet_length("chunk").alias("n"))
    mine = narrow.join(copies.select("tid", F.lit(1).alias("copied")), "tid", "left")
    cids = mine.groupBy("anchor", "cid").agg((F.count(F.lit(1)) + F.coalesce(F.max("copied"), F.lit(0))).alias("m"), F.max("n").alias("n"), F.min(F.struct("tid", "first")).alias("at"))
    cids = stash(cids, "distinct-chunks")
    sizes = cids.groupBy("anchor").agg(F.count(F.lit(1)).alias("k"), F.max("m").alias("m"), F.max("cid").alias("cid"), F.max("n").alias("n"))
    alone = _alone(sizes, length)
    several = stash(sizes.filter("k > 1").select("anchor", "k"), "anchors-to-order")
    # the bytes come from one place of each chunk, so that no anchor's rows meet
    places = cids.join(several.select("anchor"), "anchor", "left_semi").select("at.tid", "at.first", "m")
    counted = stash(chunks.join(places, ["tid", "first"]).select("cid", "anchor", "chunk", "m"), "chunks-to-order")
    with scratch():
        ranges = stash(_repeats(counted, several, length, gram).unionByName(alone), "ranges", keep=True)
    release(counted, several, cids)

    back = chunks.select("tid", "first", "cid").join(ranges, "cid").select("tid", (F.col("first") + F.col("a")).alias("a"), (F.col("first") + F.col("b") + length).alias("b"))
    spans = _joined(back).join(copies.select("tid"), "tid", "left_anti")
    found = stash(spans.unionByName(copies), "spans")
    release(chunks, ranges, copies)
    return found


def _joined(ranges: DataFrame) -> DataFrame:
    """``(tid, spans)``: overlapping and touching ranges ``[a, b)`` of a text made one."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("tid").orderBy("a", "b")
    before = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = ranges.distinct().withColumn("new", (F.coalesce(before, F.lit(-1)) < F.col("a")).cast("int"))
    numbered = new.withColumn("span", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = numbered.groupBy("tid", "span").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return whole.groupBy("tid").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("spans"))


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM, made: str = "") -> DataFrame:
    """``docs`` and two columns, their names led by ``made`` (and by underscores where ``docs`` has them): ``spans`` (removed byte runs) and ``kept`` (remaining bytes)."""
    removed, kept = apart(docs, f"{made}spans", f"{made}kept")
    new = fresh("_span_", docs)
    found = repeated_spans(docs, text, length, gram).select(F.col("tid").alias(f"{new}tid"), F.col("spans").alias(f"{new}found"))
    joined = docs.join(found, _text_id(F.col(text)) == F.col(f"{new}tid"), "left")
    spans = F.coalesce(f"{new}found", F.array().cast("array<struct<a:int,b:int>>"))
    whole = joined.withColumn(removed, spans).drop(f"{new}tid", f"{new}found")
    return whole.withColumn(kept, without(F.encode(F.coalesce(F.col(text), F.lit("")), "utf-8"), F.col(removed)))


def without(data: Column, spans: Column) -> Column:
    """``data`` (binary) without the byte runs ``spans``: the gaps from the end of one to the start of the next."""
    gaps = F.zip_with(
        F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["b"])),
        F.concat(F.transform(spans, lambda s: s["a"]), F.array(F.octet_length(data))),
        lambda a, b: F.struct(a.alias("a"), b.alias("b")),
    )
    kept = F.aggregate(gaps, F.lit(b""), lambda acc, g: F.concat(acc, F.substring(data, g["a"] + 1, g["b"] - g["a"])))
    return F.when(F.size(spans) == 0, data).otherwise(kept)


_BLANK = b" \t\n\r\x0b\x0c"


def whole_words(text: bytes, a: int, b: int) -> tuple[int, int]:
    """The part of ``[a, b)`` without the words of which it holds only an end or a beginning."""
    blank = lambda i: text[i] in _BLANK
    if 0 < a < b and not blank(a - 1):
        while a < b and not blank(a):
            a += 1
    if a < b < len(text) and not blank(b):
        while b > a and not blank(b - 1):
            b -= 1
    return a, b


def cut_passages(text: bytes, spans: list[tuple[int, int]], least_words: int) -> tuple[str, bool]:
    """``text`` without the spans of at least ``least_words`` whole words, and whether there were any.

    Only whole words go, and what is left on both sides of a passage stays two words.
    """
    spans = [(a, b) for a, b in (whole_words(text, a, b) for a, b in spans) if len(text[a:b].split()) >= least_words]
    if not spans:
        return text.decode("utf-8", "ignore"), False
    edges = [0, *(x for s in spans for x in s), len(text)]
    kept = b""
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        part = text[a:b]
        glued = kept and part and kept[-1] not in _BLANK and part[0] not in _BLANK
        kept += b" " + part if glued else part
    return kept.decode("utf-8", "ignore"), True


def drop_passages(docs: DataFrame, length: int = PASSAGE_BYTES, gram: int = PASSAGE_GRAM, least_words: int = PASSAGE_WORDS) -> DataFrame:
    """``docs`` without the passages of ``least_words`` words that also stand elsewhere; ``n_chars`` is counted anew where a text changed.

    A passage is a run of bytes each of which lies in a string of ``length`` bytes that also starts
    anywhere else.  Every copy goes, the first too: which bytes of overlapping passages are copies of which
    is not told, so what only stands in repeated passages is lost to the corpus.  Rows stay, with what is
    left; null texts stay null; further columns stay as they are.
    """
    new = fresh("_cut_", docs)
    found = repeated_spans(docs, "text", length, gram).select(F.col("tid").alias(f"{new}tid"), F.col("spans").alias(f"{new}spans"))
    joined = docs.join(found, _text_id(F.col("text")) == F.col(f"{new}tid"), "left").drop(f"{new}tid")
    place, at = docs.columns.index("text"), len(docs.columns)

    def run(batches):
        for batch in batches:
            for part in slices([batch], batch.schema.names[place]):
                made = []
                for t, spans in zip(utf8(part.column(place)), part.column(at).to_pylist(), strict=True):
                    made.append((None, False) if not spans else cut_passages(t, [(s["a"], s["b"]) for s in spans], least_words))
                columns = [pa.array([m[0] if m[1] else None for m in made], pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns[:at], *columns], names=[*part.schema.names[:at], f"{new}text"])

    cut = joined.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(f"{new}text", T.StringType())]))
    left = F.col(f"{new}text")
    columns = {"text": F.coalesce(left, F.col("text")), "n_chars": F.coalesce(F.length(left).cast("long"), F.col("n_chars")) if "n_chars" in docs.columns else None}
    return cut.select(*[columns[c].alias(c) if c in columns else F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["b"] - s["a"])
    return cut.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
