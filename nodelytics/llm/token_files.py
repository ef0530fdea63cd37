"""Token ids in files with directly addressable codes.

A file of ids is a Parquet folder whose rows are blocks of whole documents in ascending id order.
A block holds the ids of its documents in levels of 8-bit chunks: level 0 has the low chunk of
every id; a bit in the level's continuation bitmap says that the id goes on in the next level, and
a rank directory (set bits before each 512) says where.  Any id is read by at most four chunk
reads and rank lookups, without decoding its block.  Spark's writer commits the files, so tasks
may be lost and run again.

Columns: ``bucket``, ``block`` (order within the bucket), ``doc_ids``, ``starts`` (first id of each
document in the block, and the end), ``n_ids``, and per level ``chunks``, ``more`` and ``ranks``.

Null texts are empty; a null doc_id sorts first.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import shared_dir, slices, small, table, utf8

END = 2
#: Fixed value: letters in a run and marks in a run are pieces of their own, as the pattern of the vocabulary's splitter says.
_PIECES = r"[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Ids in a block; a longer document has a block of its own.
BLOCK_IDS = 1 << 18
RANK_BITS = 512
#: Words whose ids a worker keeps, in each of two rounds.
CACHED_WORDS = 300_000
#: Documents in a range, about; a range (``bucket``) is written by one task.
RANGE_DOCS = 8_000
BLOCK_SCHEMA = "bucket int, block int, doc_ids array<long>, starts array<int>, n_ids int, chunks array<binary>, more array<binary>, ranks array<binary>"


# --- the codes -------------------------------------------------------------------------------


def pack(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Chunks, continuation bitmaps and rank directories of each level."""
    chunks, more, ranks = [], [], []
    rest = ids.astype(np.uint32)
    while True:
        chunks.append((rest & 255).astype(np.uint8).tobytes())
        on = rest > 255
        bits = np.packbits(on, bitorder="little")
        more.append(bits.tobytes())
        steps = np.add.reduceat(on, np.arange(0, len(on), RANK_BITS)) if len(on) else np.zeros(0, np.int64)
        ranks.append((np.cumsum(steps) - steps).astype("<u4").tobytes())
        if not on.any():
            return chunks, more, ranks
        rest = rest[on] >> 8


def unpack(chunks: list[bytes], more: list[bytes]) -> np.ndarray:
    """All ids of a block."""
    value = None
    for c, m in zip(reversed(chunks), reversed(more), strict=True):
        low = np.frombuffer(c, np.uint8).astype(np.uint32)
        if value is not None:
            on = np.unpackbits(np.frombuffer(m, np.uint8), count=len(low), bitorder="little").astype(bool)
            low[on] |= value << np.uint32(8)
        value = low
    return value


def at(i: int, chunks: list[bytes], more: list[bytes], ranks: list[bytes]) -> int:
    """The id at position ``i`` of a block, by rank lookups alone."""
    value = shift = 0
    for c, m, r in zip(chunks, more, ranks, strict=True):
        value |= c[i] << shift
        if not m[i >> 3] >> (i & 7) & 1:
            break
        word = i // RANK_BITS
        before = int.from_bytes(m[word * RANK_BITS // 8 : i // 8 + 1], "little") & ((1 << (i - word * RANK_BITS)) - 1)
        i = int.from_bytes(r[4 * word : 4 * word + 4], "little") + before.bit_count()
        shift += 8
    return value


# --- encoding --------------------------------------------------------------------------------


#: Letters that no step before the merges changes (lower case; composed; ASCII or Latin-1), and marks that follow them to the word's end.
_PLAIN = re.compile(rb"((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+)([!-/:-@\[-`{-~]*)").fullmatch


class _Words:
    """Ids of words between ASCII white space, which the library splits at in any case.

    A word of plain letters is one piece for the library's merges, and so is a run of marks after
    it.  Such words are encoded by the same model behind a split at blanks alone; all others go
    through the whole library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        top = max(vocabulary.values(), default=0) + 1
        self.kind = "<u2" if top <= 1 << 16 else "<u4"
        self.ids: dict[bytes, bytes] = {}
        self._old: dict[bytes, bytes] = {}
        settings = json.loads(self.library.to_str())
        ending = settings["model"].get("end_of_word_suffix")
        self.merges = None
        lower = "Lowercase" in json.dumps(settings["normalizer"])
        if ending and lower and _PIECES in json.dumps(settings["pre_tokenizer"]):
            self.closes = np.zeros(top, bool)
            self.closes[[i for t, i in vocabulary.items() if t.endswith(ending)]] = True
            self.merges = Tokenizer.from_str(json.dumps({**settings, "added_tokens": [], "normalizer": None, "pre_tokenizer": None}))
            self.merges.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def learn(self, words: Iterable[bytes]) -> None:
        """Have the ids of all ``words`` in ``ids``."""
        if len(self.ids) > CACHED_WORDS:  # words of the last round come back when they are met again
            self.ids, self._old = {}, self.ids
        new, ended, odd = set(), [], []
        for w in words:
            if w in self._old:
                self.ids[w] = self._old[w]
            elif self.merges is None:
                odd.append(w)
            elif w.isalpha() and w.islower():
                new.add(w)
            elif (m := _PLAIN(w)) is None:
                odd.append(w)
            elif m[2]:
                letters, marks = m.groups()
                ended.append((w, letters, marks))
                if letters not in self.ids:
                    new.add(letters)
                if marks not in self.ids:
                    new.add(marks)
            else:
                new.add(w)
        self._learn_plain(list(new))
        self._learn_odd(odd)
        for w, letters, marks in ended:
            self.ids[w] = self.ids[letters] + self.ids[marks]

    def _learn_plain(self, words: list[bytes]) -> None:
        """Words that are one piece each: the ids of one end where a token closes a word."""
        lists = [words[lo : lo + 1000] for lo in range(0, len(words), 1000)]
        for some, made in zip(lists, self.merges.encode_batch_fast([b" ".join(x).decode() for x in lists], add_special_tokens=False) if lists else [], strict=True):
            codes = np.array(made.ids, self.kind)
            ends = (codes.itemsize * (np.flatnonzero(self.closes[codes]) + 1)).tolist()
            raw = codes.tobytes()
            self.ids.update(zip(some, [raw[i:j] for i, j in zip([0, *ends], ends, strict=False)], strict=True))

    def _learn_odd(self, words: list[bytes]) -> None:
        """Encode words in one text each thousand, and deal the ids out by where their characters stand."""
        for lo in range(0, len(words), 1000):
            some = words[lo : lo + 1000]
            texts = [w.decode("utf-8", "replace") for w in some]
            made = self.library.encode(" ".join(texts), add_special_tokens=False)
            lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
            starts = np.cumsum(lengths) - lengths
            of = np.searchsorted(starts, np.fromiter((o[0] for o in made.offsets), np.int64, len(made.ids)), "right") - 1
            codes = np.array(made.ids, self.kind)
            ends = (codes.itemsize * np.cumsum(np.bincount(of, minlength=len(some)))).tolist()
            raw = codes.tobytes()
            self.ids.update(zip(some, [raw[i:j] for i, j in zip([0, *ends], ends, strict=False)], strict=True))


def _split(text: bytes) -> list[bytes]:
    """Words between ASCII white space, lower-cased (the library does so too) unless special strings may be inside."""
    return (text if b"<|" in text else text.lower()).split()


@functools.lru_cache(maxsize=2)
def _words(path: str) -> _Words:
    return _Words(path)


def encode_narrow(texts: list[bytes | None], path: str, end: int | None = END) -> tuple[list[bytes], str]:
    """Ids of whole texts with the end id, in the least width that holds every id of the vocabulary, and that kind."""
    library = _words(path)
    tail = b"" if end is None else np.array([end], library.kind).tobytes()
    words = [_split(t) if t else [] for t in texts]
    new = set().union(*words).difference(library.ids)
    if new:
        if len(library.ids) > CACHED_WORDS:  # the cache starts anew, so the batch's known words are asked for too
            new = set().union(*words)
        library.learn(new)
    return [b"".join(map(library.ids.__getitem__, w)) + tail for w in words], library.kind


def encode(texts: list[bytes | None], path: str, end: int | None = END) -> list[bytes]:
    """Ids of whole texts, little-endian unsigned 32-bit, with the end id."""
    codes, kind = encode_narrow(texts, path, end)
    return codes if kind == "<u4" else [np.frombuffer(c, kind).astype("<u4").tobytes() for c in codes]


# --- writing and reading ---------------------------------------------------------------------


def _blocks(batches, kind: str):
    """Blocks of rows that come sorted by range and id; ``kind``: the width of their ids."""
    bucket, number, ids, parts, held = None, 0, [], [], 0

    def out():
        data = np.concatenate(parts)
        starts = np.cumsum([0, *map(len, parts)])
        chunks, more, ranks = pack(data)
        values = [[bucket], [number], [ids], [starts.tolist()], [len(data)], [chunks], [more], [ranks]]
        types = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32(), *[pa.list_(pa.binary())] * 3]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names=[c.split()[0] for c in BLOCK_SCHEMA.split(", ")])

    for batch in batches:
        for part in slices([batch], "packed", 1 << 20):
            for b, doc, packed in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                code = np.frombuffer(packed, kind)
                if parts and (b != bucket or held + len(code) > BLOCK_IDS):
                    yield out()
                    number, ids, parts, held = number + 1, [], [], 0
                if b != bucket:
                    bucket, number = b, 0
                ids.append(doc)
                parts.append(code)
                held += len(code)
    if parts:
        yield out()


def _firsts(docs: DataFrame, ranges: int) -> np.ndarray:
    """The first id of each of about ``ranges`` equal ranges, from the ids alone: one line a range comes to the driver."""
    ids = docs.select("doc_id").filter("doc_id is not null").repartitionByRange(ranges, "doc_id")
    firsts = ids.groupBy(F.spark_partition_id().alias("p")).agg(F.min("doc_id").alias("first")).toPandas()["first"]
    return np.sort(firsts.to_numpy(np.int64))[1:]


def write(docs: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", range_docs: int = RANGE_DOCS) -> None:
    """Write the ids of ``docs`` as a folder of files; the order is that of ``doc_id``."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ranges = docs.count() // range_docs + 1
    sent = docs.sparkSession.sparkContext.broadcast(_firsts(docs, ranges))  # eight bytes a range
    schema = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("packed", T.BinaryType())])

    def run(batches):
        for batch in batches:
            for part in slices([batch], "text"):
                ids = part.column(0)
                place = np.searchsorted(sent.value, ids.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), "right")
                packed = encode_narrow(utf8(part.column(1)), tokenizer)[0]
                yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), ids, pa.array(packed, pa.binary())], names=["bucket", "doc_id", "packed"])

    # a range is a partition of its own: its number, not a hash of it, says where it goes
    dealt = docs.mapInArrow(run, schema).repartitionById(ranges, "bucket").sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), "packed")
    dealt.mapInArrow(functools.partial(_blocks, kind=_words(tokenizer).kind), BLOCK_SCHEMA).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids`` (binary)."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    sizes = blocks.groupBy("bucket").agg(F.sum("n_ids").alias("n"))  # one line a bucket
    offsets = sizes.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("offset"))
    within = blocks.select("bucket", "block", "n_ids").withColumn("inner", F.sum("n_ids").over(Window.partitionBy("bucket").orderBy("block")) - F.col("n_ids"))
    places = within.join(offsets, "bucket").select("bucket", "block", (F.col("offset") + F.col("inner")).alias("first"))
    schema = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("inner", T.IntegerType()), T.StructField("ids", T.BinaryType())])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["chunks"], row["more"]).astype("<u4")
                s, n = row["starts"], len(row["doc_ids"])
                columns = [pa.array([row["bucket"]] * n, pa.int32()), pa.array([row["block"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(s[:-1], pa.int32()), pa.array([ids[a:b].tobytes() for a, b in zip(s[:-1], s[1:], strict=True)], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "block", "doc_id", "inner", "ids"])

    # blocks are few beside ids: their places are sent if a count allows it
    rows = blocks.select("bucket", "block", "doc_ids", "starts", "chunks", "more").mapInArrow(run, schema)
    return rows.join(small(places, 100_000), ["bucket", "block"]).select("doc_id", (F.col("first") + F.col("inner")).alias("start"), F.expr("octet_length(ids) div 4").alias("n_tokens"), "ids")


def lookup(spark: SparkSession, path: str, positions: DataFrame) -> DataFrame:
    """``(doc_id, pos, id)`` for asked ``(doc_id, pos)``, read by rank lookups; positions outside give no row."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    member = blocks.select("bucket", "block", F.posexplode("doc_ids").alias("n", "doc_id"))
    asked = positions.join(member, "doc_id").groupBy("bucket", "block").agg(F.collect_list(F.struct("doc_id", "n", "pos")).alias("asked"))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                found = [(a["doc_id"], a["pos"], at(row["starts"][a["n"]] + a["pos"], row["chunks"], row["more"], row["ranks"])) for a in row["asked"] if 0 <= a["pos"] < row["starts"][a["n"] + 1] - row["starts"][a["n"]]]
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], names=["doc_id", "pos", "id"])

    return blocks.join(asked, ["bucket", "block"]).select("starts", "chunks", "more", "ranks", "asked").mapInArrow(run, "doc_id long, pos long, id long")


def query(spark, sf_dir: str) -> DataFrame:
    import uuid

    import public_tokenizers

    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
