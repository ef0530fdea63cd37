"""Ranked lexical search over an index whose terms are dealt to successive owners.

Documents are cut into slices of bounded text.  An index row is a slice: its documents, and for each
query term that occurs in it the documents and how often.  Terms are dealt to ``OWNERS`` stages, the
rarest to the first, so that each stage holds about the same number of postings.

A bundle is a group of items over one slice.  It starts empty and passes the owners one after the
other: each stage co-groups the bundles with the postings its terms have in the slice, adds the whole
numbers ``weight * saturation`` to the bundle's sparse accumulators, and passes it on.  A document goes
from an accumulator only where it cannot be among the best: where its sum and all that later owners
could still add stay below the sum that the k-th best of the same slice already has.  The last owner's
bundles give their best k, and the best k of all slices are the result; nothing is approximate.

No group is larger than a group of items times a slice, however frequent a term is.  Items are taken
in blocks of bounded text, one after the other, so what the driver reads and sends is bounded; each
block reads the texts once.

Null texts have no terms; documents without a term are never found.  An item without a text or without a
term that occurs has no rows.  Repeated documents and items are rows of their own; ids that are null
stand last among ties.  Extra columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from .common import LARGE_ROWS, slices, stash, stash_all, table, utf8

TOP = 10
#: Share of the length in the saturation, in hundredths.
LENGTH_SHARE = 90
#: Text bytes and documents of a slice at most (a longer text has one of its own).
SLICE_BYTES, SLICE_DOCS = 4 << 20, 4096
#: Bytes of item text that are looked up at once, and items of one bundle.
BLOCK_BYTES, BUNDLE_ITEMS = 4 << 20, 256
#: Stages of term owners.
OWNERS = 4
_SCALE = 1_000_000_000
_TABLE = bytes((b + 32 if 65 <= b <= 90 else b) if (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128) else 32 for b in range(256))
BUNDLE = "bundle int, slice long, ends binary, docs binary, sums binary"


def terms(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


def weight(n_docs: int, n_with: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n_with + 1)))


def saturation(n_times: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """``(10^9 * tf) div (1000 * tf + 8 * m)``, m being ``100 - share + (share * n * N) div L``."""
    m = 100 - LENGTH_SHARE + LENGTH_SHARE * length * n_docs // n_terms
    return _SCALE * n_times // (1000 * n_times + 8 * m)


# --- the index -------------------------------------------------------------------------------


def index(docs: DataFrame, vocabulary: list[bytes], doc_id: str = "doc_id", text: str = "text", slice_docs: int = SLICE_DOCS) -> DataFrame:
    """One row a slice: ``docs`` (ids), ``lengths`` (terms of each), and the postings of the vocabulary: ``terms``, where each one's postings end, the documents, and ``times``."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)  # of one block of items
    id_type = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField("slice", T.LongType()), T.StructField("ids", T.ArrayType(id_type)), *[T.StructField(c, T.BinaryType()) for c in ("lengths", "terms", "ends", "docs", "times")]])
    id_arrow = to_arrow_type(id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        place = {w: i for i, w in enumerate(sent.value)}
        for batch in batches:
            for long in slices([batch], batch.schema.names[1], SLICE_BYTES):
                for at in range(0, long.num_rows, slice_docs):
                    part = long.slice(at, slice_docs)
                    lengths, found, owners = np.zeros(part.num_rows, np.int64), [], []
                    for i, t in enumerate(utf8(part.column(1))):
                        words = terms(t)
                        lengths[i] = len(words)
                        held = [x for x in map(place.get, words) if x is not None]
                        found += held
                        owners.append(len(held))
                    key = np.array(found, np.int64) * part.num_rows + np.repeat(np.arange(part.num_rows), owners)
                    key, times = np.unique(key, return_counts=True)
                    term, first = np.unique(key // part.num_rows, return_index=True)
                    ends = np.append(first[1:], len(key))[: len(term)]
                    ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0).cast(id_arrow))
                    binary = [lengths.astype("<i8"), term.astype("<i4"), ends.astype("<i4"), (key % part.num_rows).astype("<i4"), times.astype("<i4")]
                    yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), ids, *(pa.array([x.tobytes()], pa.binary()) for x in binary)], names=schema.names)
                    number += 1

    return stash(docs.select(doc_id, text).mapInArrow(run, schema), "postings", **LARGE_ROWS)


def statistics(slices_: DataFrame, n_vocabulary: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and per vocabulary term the documents that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_docs = n_terms = 0
        held = np.zeros(n_vocabulary, np.int64)
        for batch in batches:
            for lengths, term, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lengths, ends = np.frombuffer(lengths, "<i8"), np.frombuffer(ends, "<i4").astype(np.int64)
                n_docs, n_terms = n_docs + int((lengths > 0).sum()), n_terms + int(lengths.sum())
                held[np.frombuffer(term, "<i4")] += np.diff(ends, prepend=0)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *at.tolist()], pa.int32()), pa.array([n_docs, n_terms, *held[at].tolist()], pa.int64())], names=["term", "n"])

    found = slices_.select("lengths", "terms", "ends").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # bounded by the vocabulary
    n = {r["term"]: r["n"] for r in found}
    return n.get(-2, 0), n.get(-1, 0), np.array([n.get(i, 0) for i in range(n_vocabulary)], np.int64)


def owner_of(held: np.ndarray, owners: int = OWNERS) -> np.ndarray:
    """The stage of each term: rarest first, about equally many postings a stage."""
    order = np.argsort(held, kind="stable")
    upto = np.cumsum(held[order])
    out = np.zeros(len(held), np.int64)
    total = int(upto[-1]) if len(upto) else 0
    out[order] = np.minimum((upto - held[order]) * owners // max(total, 1), owners - 1)
    return out


# --- the pipeline of owners ------------------------------------------------------------------


@dataclass
class Plan:
    """What every worker gets for a block of items: the terms of each item, weights, owners, and the two totals."""

    items: list[np.ndarray]
    weights: np.ndarray
    owners: np.ndarray
    n_docs: int
    n_terms: int
    per_bundle: int

    def bundle(self, number: int) -> list[np.ndarray]:
        return self.items[number * self.per_bundle : (number + 1) * self.per_bundle]

    def remaining(self, item: np.ndarray, stage: int) -> int:
        """More than the owners after ``stage`` can add to any document."""
        return int(self.weights[item[self.owners[item] > stage]].sum()) * (_SCALE // 1000)


def _postings(slices_: DataFrame, sent, bundles: int, stage: int) -> DataFrame:
    """``(bundle, slice, terms, ends, docs, gains)``: what the stage's owner holds of each slice for each bundle, weighed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = sent.value
        wanted = []
        for b in range(bundles):
            mine = np.zeros(len(plan.weights), bool)
            for item in plan.bundle(b):
                mine[item] = True
            wanted.append(mine & (plan.owners == stage))
        for batch in batches:
            for number, lengths, term, ends, docs, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lengths, term, ends, docs, times = (np.frombuffer(x, k).astype(np.int64) for x, k in zip((lengths, term, ends, docs, times), ("<i8", "<i4", "<i4", "<i4", "<i4"), strict=True))
                sizes = np.diff(ends, prepend=0)
                for b, mine in enumerate(wanted):
                    use = mine[term]
                    if not use.any():
                        continue
                    rows = np.repeat(use, sizes)
                    d = docs[rows]
                    gain = saturation(times[rows], lengths[d], plan.n_docs, plan.n_terms)
                    columns = [term[use].astype("<i4"), np.cumsum(sizes[use]).astype("<i4"), d.astype("<i4"), gain.astype("<i4")]
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([number], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in columns)], names=["bundle", "slice", "terms", "ends", "docs", "gains"])

    return slices_.select("slice", "lengths", "terms", "ends", "docs", "times").mapInArrow(run, "bundle int, slice long, terms binary, ends binary, docs binary, gains binary")


def _passed(bundles: DataFrame, postings: DataFrame, sent, stage: int, k: int) -> DataFrame:
    """The bundles after the owner of ``stage`` has added its contributions."""
    names = ["bundle", "slice", "ends", "docs", "sums"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row, plan = left.to_pylist()[0], sent.value
        items = plan.bundle(row["bundle"])
        before = np.append(0, np.frombuffer(row["ends"], "<i4"))
        old_docs, old_sums = np.frombuffer(row["docs"], "<i4"), np.frombuffer(row["sums"], "<i8")
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        top = int(old_docs.max()) + 1 if len(old_docs) else 0
        if right.num_rows:
            post = right.to_pylist()[0]
            term, ends, docs, gains = np.frombuffer(post["terms"], "<i4"), np.append(0, np.frombuffer(post["ends"], "<i4")), np.frombuffer(post["docs"], "<i4"), np.frombuffer(post["gains"], "<i4").astype(np.int64)
            held = {t: (docs[a:z], gains[a:z] * int(plan.weights[t])) for t, a, z in zip(term.tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True)}
            top = max(top, int(docs.max()) + 1)
        sums = np.zeros(top, np.int64)
        new_ends, new_docs, new_sums, total = [], [], [], 0
        for i, item in enumerate(items):
            sums[:] = 0
            sums[old_docs[before[i] : before[i + 1]]] = old_sums[before[i] : before[i + 1]]
            for t in item[plan.owners[item] == stage].tolist():
                if t in held:
                    d, add = held[t]
                    sums[d] += add
            live = np.flatnonzero(sums)
            got = sums[live]
            if len(live) > k:
                kth = np.partition(got, len(got) - k)[len(got) - k]
                stays = got + plan.remaining(item, stage) >= kth
                live, got = live[stays], got[stays]
            total += len(live)
            new_ends.append(total)
            new_docs.append(live)
            new_sums.append(got)
        made = [np.array(new_ends).astype("<i4"), np.concatenate(new_docs).astype("<i4"), np.concatenate(new_sums).astype("<i8")]
        return pa.table([pa.array([row["bundle"]], pa.int32()), pa.array([row["slice"]], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in made)], names=names)

    return bundles.groupBy("bundle", "slice").cogroup(postings.groupBy("bundle", "slice")).applyInArrow(run, BUNDLE)


def _best(bundles: DataFrame, slices_: DataFrame, items: list, per_bundle: int, item_type: T.DataType, k: int) -> DataFrame:
    """``(item, item_id, doc_id, score)``: the best k of each item within each slice."""
    sent = bundles.sparkSession.sparkContext.broadcast(items)  # ids of one block of items
    id_type = slices_.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", item_type), T.StructField("doc_id", id_type), T.StructField("score", T.LongType())])
    kinds = [to_arrow_type(f.dataType) for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ends, docs, sums = np.append(0, np.frombuffer(row["ends"], "<i4")), np.frombuffer(row["docs"], "<i4").tolist(), np.frombuffer(row["sums"], "<i8").tolist()
                ids, out = row["ids"], []
                for i in range(len(ends) - 1):
                    found = [(-s, ids[d] is None, ids[d] if ids[d] is not None else 0) for d, s in zip(docs[ends[i] : ends[i + 1]], sums[ends[i] : ends[i + 1]], strict=True)]
                    item = row["bundle"] * per_bundle + i
                    out += [(item, sent.value[item], None if none else d, -s) for s, none, d in sorted(found)[:k]]
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], kinds[c]) for c in range(4)], names=schema.names)

    met = bundles.join(slices_.select("slice", "ids"), "slice").select("bundle", "ends", "docs", "sums", "ids")
    return met.mapInArrow(run, schema)


def _blocks(items: DataFrame) -> Iterator[list]:
    """The items with a text in blocks of bounded bytes, each collected when it is asked for."""
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = total // BLOCK_BYTES + 1
    for i in range(n):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) if n > 1 else items
        if rows := part.select("item_id", "text").filter("text is not null").collect():
            yield rows


def _of_block(docs: DataFrame, rows: list, item_type: T.DataType, k: int, owners: int, slice_docs: int, bundle_items: int) -> DataFrame:
    place: dict[bytes, int] = {}
    items = [np.unique(np.array([place.setdefault(w, len(place)) for w in terms(r["text"].encode())], np.int64)) for r in rows]
    spark = docs.sparkSession
    slices_ = index(docs, list(place), slice_docs=slice_docs)
    n_docs, n_terms, held = statistics(slices_, len(place))
    plan = Plan(items, np.array([weight(n_docs, h) for h in held.tolist()], np.int64), owner_of(held, owners), n_docs, n_terms, bundle_items)
    sent = spark.sparkContext.broadcast(plan)
    n_bundles = -(-len(items) // bundle_items)
    nothing = F.unhex(F.lit(""))
    sizes = F.array(*[F.lit(len(plan.bundle(b))) for b in range(n_bundles)])
    bundles = slices_.select(F.posexplode(sizes).alias("bundle", "n"), "slice").select("bundle", "slice", F.unhex(F.repeat(F.lit("00000000"), F.col("n"))).alias("ends"), nothing.alias("docs"), nothing.alias("sums"))
    for stage in range(owners):
        bundles = _passed(bundles, _postings(slices_, sent, n_bundles, stage), sent, stage, k)
    best = _best(bundles, slices_, [r["item_id"] for r in rows], bundle_items, item_type, k)
    # the best of each item: Spark keeps k rows a task before the shuffle
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, owners: int = OWNERS, doc_id: str = "doc_id", text: str = "text", slice_docs: int = SLICE_DOCS, bundle_items: int = BUNDLE_ITEMS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the k best documents with a score above 0 of each row of ``items (item_id, text)``."""
    item_type = items.schema["item_id"].dataType
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = (_of_block(docs, rows, item_type, k, owners, slice_docs, bundle_items) for rows in _blocks(items))
    schema = T.StructType([T.StructField("item_id", item_type), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("score", T.LongType())])
    none = docs.sparkSession.createDataFrame([], schema)
    return stash_all((f for part in ([none], found) for f in part), "ranked")


def query(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
