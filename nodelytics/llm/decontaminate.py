"""Benchmark decontamination over a distributed positional inverted index.

The index is a table of segments, each of which holds the documents of about ``SEGMENT_BYTES`` of
text: their words in order as dictionary of terms, and per term the list of its positions.  It is
made by one pass over the corpus, knows nothing of a benchmark and serves any number of them.

A window (10 words of an item, or all words of a shorter one) is looked up from its rarest term, by
counts over the whole corpus: the term's positions, less its offset, are the candidates, and the
list of each further term in the order of rarity, less its own offset, must hold them (exact
phrase), or have a position within a distance in any order (proximity).  Lists are intersected for
all windows of a slice at once.

The benchmark is taken in slices of bounded size, one after the other, so what the driver reads and
sends at once is bounded; the index is read once a slice, the texts never again.

Null texts and texts without words have no words and no hits; items without words have no window.
An item without an id marks the words of its windows but is not listed.  Repeated rows are rows of
their own.  Extra columns of documents and items are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from .common import fresh, slices, small, stash, stash_all, table, utf8

WINDOW = 10
#: Text bytes of a segment; a longer document has one of its own.  Its row stays below half a megabyte, which the
#: JVM's collector still takes as a usual object; rows of megabytes filled an executor's heap.
SEGMENT_BYTES = 3 << 17
#: Rows of a row group, which a reader takes at once.
_GROUP = {"parquet.block.row.count.limit": "8"}
#: Bytes of benchmark text that are looked up at once.
SLICE_BYTES = 4 << 20
#: Candidates that are compared at once.
_CANDIDATES = 1 << 18
#: Keys of contaminated texts (32 bytes each) that are sent to every worker at most.
SENT_KEYS = 200_000
#: A-Z become a-z; these bytes and those of non-ASCII characters make words, all others part them.
_LOWER = bytes((b + 32 if 65 <= b <= 90 else b) if (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128) else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_LOWER).split() if text else []


# --- the index -------------------------------------------------------------------------------


def index(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """One row a segment.

    ``docs``: the columns ``keep`` and ``n_words`` of each document; ``starts``: its first position,
    and the end; ``terms``: the different words in order, parted by blanks; ``ends``: where each
    term's list ends in ``positions``.  Numbers are little-endian 32-bit.
    """
    fields = [*docs.select(*keep).schema.fields, T.StructField("n_words", T.LongType())]
    schema = T.StructType([T.StructField("segment", T.LongType()), T.StructField("docs", T.ArrayType(T.StructType(fields))), *[T.StructField(c, T.BinaryType()) for c in ("starts", "terms", "ends", "positions")]])
    kind = pa.struct([pa.field(f.name, to_arrow_type(f.dataType)) for f in fields])

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices([batch], batch.schema.names[-1], SEGMENT_BYTES):
                lists = [words(t) for t in utf8(part.column(len(keep)))]
                sizes = np.fromiter(map(len, lists), np.int64, len(lists))
                flat = [w for ws in lists for w in ws]
                terms = sorted(set(flat))
                place = dict(zip(terms, range(len(terms)), strict=True))
                ids = np.fromiter(map(place.__getitem__, flat), np.int32, len(flat))
                rows = pa.StructArray.from_arrays([*(c.cast(f.type) for c, f in zip(part.columns[: len(keep)], kind, strict=False)), pa.array(sizes, pa.int64())], fields=list(kind))
                columns = [
                    pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(lists)], pa.int32()), rows),
                    *(pa.array([x], pa.binary()) for x in (np.append(0, np.cumsum(sizes)).astype("<i4").tobytes(), b" ".join(terms), np.cumsum(np.bincount(ids, minlength=len(terms))).astype("<i4").tobytes(), np.argsort(ids, kind="stable").astype("<i4").tobytes())),
                ]
                number += 1
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return stash(docs.select(*keep, F.col(text).alias(fresh("text", docs.select(*keep)))).mapInArrow(run, schema), "segments", **_GROUP)


@dataclass
class Segment:
    """One row of the index, in a worker, with the numbers that a slice's words have in it (-1: none)."""

    starts: np.ndarray
    ends: np.ndarray
    positions: np.ndarray
    local: np.ndarray

    @classmethod
    def read(cls, starts: bytes, terms: bytes, ends: bytes, positions: bytes, asked: list[bytes]) -> Segment:
        names = terms.split(b" ") if terms else []
        place = dict(zip(names, range(len(names)), strict=True))
        return cls(np.frombuffer(starts, "<i4"), np.append(0, np.frombuffer(ends, "<i4")), np.frombuffer(positions, "<i4"), np.fromiter((place.get(w, -1) for w in asked), np.int64, len(asked)))

    def counts(self) -> np.ndarray:
        """Postings of each asked word."""
        return np.where(self.local >= 0, self.ends[self.local + 1] - self.ends[self.local], 0)

    def keys(self) -> np.ndarray:
        """``term * words + position`` of all postings, ascending."""
        return np.repeat(np.arange(len(self.ends) - 1), np.diff(self.ends)) * (int(self.starts[-1]) + 1) + self.positions

    def key(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        return term * (int(self.starts[-1]) + 1) + position

    def document(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, position, "right") - 1


def _first(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The least key that is not below each wanted one (beyond all: the greatest number)."""
    at = np.searchsorted(keys, wanted)
    found = np.append(keys, np.iinfo(np.int64).max)
    return found[at]


# --- what is looked up -----------------------------------------------------------------------


@dataclass
class Slice:
    """Bounded benchmark text: its different words, and per length of window the words of each window and its item."""

    asked: list[bytes]
    items: list[str | None]
    windows: dict[int, tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, rows: list, width: int | None) -> Slice:
        """``width`` None: one window an item, of all its different words."""
        number: dict[bytes, int] = {}
        made: dict[int, list] = {}
        for i, row in enumerate(rows):
            ids = np.array([number.setdefault(w, len(number)) for w in words(row["text"].encode())], np.int32)
            if width is None:
                ids = np.unique(ids)
            if len(ids):
                n = min(width or len(ids), len(ids))
                spans = np.lib.stride_tricks.sliding_window_view(ids, n)
                made.setdefault(n, []).append(np.column_stack((spans, np.full(len(spans), i, np.int32))))
        windows = {}
        for n, parts in made.items():
            each = np.unique(np.concatenate(parts), axis=0)
            windows[n] = (each[:, :n].astype(np.int64), each[:, n])
        return cls(list(number), [None if r["item_id"] is None else str(r["item_id"]) for r in rows], windows)


def _slices(items: DataFrame) -> Iterator[list]:
    """The items in slices of bounded bytes, each collected when it is asked for."""
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = total // SLICE_BYTES + 1
    for i in range(n):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) if n > 1 else items
        yield part.select("item_id", "text").filter("text is not null").collect()


def frequencies(segments: DataFrame, asked: list[bytes]) -> np.ndarray:
    """Postings of each asked word over the whole index."""
    sent = segments.sparkSession.sparkContext.broadcast(asked)

    def run(batches):
        total = np.zeros(len(sent.value), np.int64)
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total += Segment.read(row[0], row[1], row[2], b"", sent.value).counts()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["term", "n"])

    found = segments.select("starts", "terms", "ends").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    out = np.zeros(len(asked), np.int64)
    for r in found.collect():  # bounded by the slice's words
        out[r["term"]] = r["n"]
    return out


def _candidates(segment: Segment, terms: np.ndarray, offset: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(window, position - offset)`` over the lists of one term a window, in parts of bounded size."""
    lo, hi = segment.ends[terms], segment.ends[terms + 1]
    upto = np.cumsum(hi - lo)
    total = int(upto[-1]) if len(upto) else 0
    for a in range(0, total, _CANDIDATES):
        at = np.arange(a, min(a + _CANDIDATES, total))
        window = np.searchsorted(upto, at, "right")
        place = lo[window] + at - (upto[window] - (hi - lo)[window])
        yield window, segment.positions[place] - offset[window]


def _phrases(segment: Segment, spans: np.ndarray, rarity: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(window, first position)`` of exact occurrences.  ``rarity``: the places of each window's words, the rarest first."""
    local = segment.local[spans]
    live = np.flatnonzero((local >= 0).all(axis=1))
    if not len(live):
        return
    local, rarity, n = local[live], rarity[live], spans.shape[1]
    keys = segment.keys()
    every = np.arange(len(live))
    for window, start in _candidates(segment, local[every, rarity[:, 0]], rarity[:, 0]):
        for r in range(1, n):
            place = rarity[window, r]
            wanted = segment.key(local[window, place], start + place)
            held = (start >= 0) & (_first(keys, wanted) == wanted)
            window, start = window[held], start[held]
        inside = (start >= 0) & (segment.document(start) == segment.document(start + n - 1))
        yield live[window[inside]], start[inside]


def _near(segment: Segment, spans: np.ndarray, rarity: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(window, position of its rarest word)`` where all its other words stand within the distance, in one document."""
    local = segment.local[spans]
    live = np.flatnonzero((local >= 0).all(axis=1))
    if not len(live):
        return
    local, rarity = local[live], rarity[live]
    keys = segment.keys()
    every = np.arange(len(live))
    for window, at in _candidates(segment, local[every, rarity[:, 0]], np.zeros(len(live), np.int64)):
        for r in range(1, spans.shape[1]):
            term, doc = local[window, rarity[window, r]], segment.document(at)
            first = segment.key(term, np.maximum(at - distance, segment.starts[doc]))
            last = segment.key(term, np.minimum(at + distance, segment.starts[doc + 1] - 1))
            held = _first(keys, first) <= last
            window, at = window[held], at[held]
        yield live[window], at


HITS = "segment long, doc int, start int, len int, item string"


def _of_slice(segments: DataFrame, rows: list, width: int | None, distance: int | None) -> DataFrame:
    part = Slice.of(rows, width)
    count = frequencies(segments, part.asked)
    # windows with a word that the corpus lacks cannot occur
    part.windows = {n: (s[k], i[k]) for n, (s, i) in part.windows.items() if (k := (count[s] > 0).all(axis=1)).any()}
    rarity = {n: np.argsort(count[s], axis=1, kind="stable") for n, (s, _) in part.windows.items()}
    sent = segments.sparkSession.sparkContext.broadcast((part, rarity))

    def run(batches):
        part, rarity = sent.value
        for batch in batches:
            for number, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                segment = Segment.read(*row, part.asked)
                for n, (spans, of) in part.windows.items():
                    for window, at in _phrases(segment, spans, rarity[n]) if distance is None else _near(segment, spans, rarity[n], distance):
                        doc = segment.document(at)
                        columns = [pa.array(np.full(len(at), number), pa.int64()), pa.array(doc, pa.int32()), pa.array(at - segment.starts[doc], pa.int32()), pa.array(np.full(len(at), n), pa.int32()), pa.array([part.items[i] for i in of[window].tolist()], pa.string())]
                        yield pa.RecordBatch.from_arrays(columns, names=["segment", "doc", "start", "len", "item"])

    return segments.select("segment", "starts", "terms", "ends", "positions").mapInArrow(run, HITS)


def _matches(segments: DataFrame, items: DataFrame, width: int | None, distance: int | None) -> DataFrame:
    return stash_all((_of_slice(segments, rows, width, distance) for rows in _slices(items)), "hits")


def phrase_hits(segments: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """``(segment, doc, start, len, item)`` of every exact occurrence of a window of ``items (item_id, text)``; ``start`` counts words of the document."""
    return _matches(segments, items, width, None)


def proximity_hits(segments: DataFrame, items: DataFrame, distance: int) -> DataFrame:
    """The same columns where the rarest word of an item stands at ``start`` and all its others within ``distance`` words of it."""
    return _matches(segments, items, None, distance)


# --- documents -------------------------------------------------------------------------------


def _per_row(hits: DataFrame) -> DataFrame:
    """``(segment, doc, n_hit, items)``: words inside hits, overlaps once, and the set of items."""
    row = ["segment", "doc"]
    spans = hits.groupBy(*row, "start").agg(F.max(F.col("start") + F.col("len")).alias("end"))
    before = F.max("end").over(Window.partitionBy(*row).orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    cover = spans.withColumn("before", F.coalesce(before, F.lit(0))).groupBy(*row).agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "before"))).cast("long").alias("n_hit"))
    named = hits.filter("item is not null").select(*row, "item").distinct().groupBy(*row).agg(F.sort_array(F.collect_list("item")).alias("items"))
    return cover.join(named, row, "left")


def contamination(docs: DataFrame, items: DataFrame, keep: list[str], width: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: ``keep``, ``n_words``, ``n_hit`` and ``items`` (ids as strings, sorted)."""
    segments = index(docs, keep)
    rows = segments.select("segment", F.posexplode("docs").alias("doc", "_d")).select("segment", "doc", "_d.*")
    found = rows.join(_per_row(phrase_hits(segments, items, width)), ["segment", "doc"], "left")
    return found.select(*keep, "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold any window of the benchmark."""
    key = fresh("_text_", docs)
    keyed = docs.filter("text is not null").select("text", F.unhex(F.sha2("text", 256)).alias(key))
    found = stash(contamination(keyed, items, [key]).filter("n_hit > 0").select(key).distinct(), "contaminated")
    return docs.join(small(found, SENT_KEYS), F.unhex(F.sha2(docs["text"], 256)) == F.col(key), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    made = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return made.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
