"""Importance resampling towards the distribution of a target table.

A text is its words (bytes through a 256-entry table that lower-cases A-Z and blanks separators, then
``bytes.split``) and the runs of up to ``ngrams`` of them.  A run's hash is the CRC-32 of its words
joined by blanks, made by chaining: the CRC of the shorter run is the seed for a blank and the next
word.  Hashes fall into buckets; per task a ``Counter`` reduces them, Spark adds the counters up.

A bucket's gain is the floored thousandfold logarithm of its smoothed share in the target over that
in the documents; a document's weight is the floored mean of gains over its features.  Adding a
Gumbel number made of a hash of the id and taking the highest sums draws without replacement in
proportion to ``exp(weight / 1000)``.

The draw needs no global sort: sums are whole numbers, so a histogram of them (its length is bounded
by the range of gains and Gumbel numbers, not by the rows) tells how many documents stand before each
sum, and documents are numbered inside one sum only.

Null texts and texts without words have no features, weight 0, and are not drawn when
``least_words`` is over 0.  Rows without an id are scored as if the id were empty and stand last among
ties.  Repeated rows are rows of their own and get ranks of their own.  With no documents nothing is
drawn; with an empty target all gains come from the smoothing.  Extra columns are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import slices, small, stash, table, utf8

NGRAMS, BUCKETS = 2, 10_000
#: Of the documents with at least so many words, so many in a hundred are drawn.
LEAST_WORDS, PERCENT = 20, 25
SEED = 7
#: Lengths of the histogram of sums up to which it is sent to every worker.
SENT_SUMS = 200_000
_TABLE = bytes((b + 32 if 65 <= b <= 90 else b) if (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128) else 32 for b in range(256))


def features(text: bytes | None, ngrams: int = NGRAMS) -> tuple[int, list[int]]:
    """The number of words, and the CRC-32 of every run of up to ``ngrams`` words."""
    words = text.translate(_TABLE).split() if text else []
    run = list(map(crc32, words))
    found = list(run)
    for n in range(1, ngrams):
        run = list(map(crc32, words[n:], map(crc32, repeat(b" "), run)))
        found += run
    return len(words), found


def bucket_counts(df: DataFrame, text: str = "text", ngrams: int = NGRAMS, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts of ``df`` by bucket; at most ``buckets`` rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[int] = Counter()
        for batch in batches:
            for part in slices([batch], batch.schema.names[0]):
                for t in utf8(part.column(0)):
                    found = features(t, ngrams)[1]
                    total.update((np.array(found, np.int64) % buckets).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(list(total.keys()), pa.int32()), pa.array(list(total.values()), pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in df.select(text).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket ``floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets))))``, in doubles."""
    size = len(corpus)
    upper, lower = float(corpus.sum() + size), float(target.sum() + size)
    return np.array([math.floor(1000 * math.log((float(t) + 1) * upper / ((float(s) + 1) * lower))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, doc_id: str = "doc_id", text: str = "text", ngrams: int = NGRAMS) -> DataFrame:
    """``(doc_id, n_words, n_features, weight)`` of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)  # one number a bucket
    id_type = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = sent.value
        for batch in batches:
            for part in slices([batch], batch.schema.names[1]):
                made = []
                for t in utf8(part.column(1)):
                    n, found = features(t, ngrams)
                    made.append((n, len(found), int(gain[np.array(found, np.int64) % len(gain)].sum()) // len(found) if found else 0))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in zip(*made, strict=True))], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {id_type}, n_words long, n_features long, weight long")


def with_score(df: DataFrame, seed: int = SEED) -> DataFrame:
    """Adds ``score``: weight plus ``floor(-1000 * ln(-ln((h + 0.5) / 2^32)))``, h the first 32 bits of sha256(``seed:id``)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return df.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long"))


def ranked(scored: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """``scored`` and ``rank``: 1, 2, ... of the drawn rows by falling score, then ascending id; null for the others.

    ``scored`` is read twice, so it should be a stored table.
    """
    able = F.col("n_words") >= least_words
    sums = scored.filter(able).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    falling = Window.orderBy(F.col("score").desc())  # over the histogram only
    before = sums.select(F.col("score").alias("_score"), (F.sum("n").over(falling) - F.col("n")).alias("_before"), F.sum("n").over(Window.partitionBy()).alias("_able"))
    before = before.select("_score", "_before", F.expr(f"_able * {percent} div 100").alias("_drawn"))
    before = small(stash(before.filter("_before < _drawn"), "sums"), SENT_SUMS)
    met = scored.join(before, able & (F.col("score") == F.col("_score")), "left")
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_score").orderBy(F.col("doc_id").asc_nulls_last()))
    inside = met.filter("_score is not null").withColumn("rank", place.cast("long"))
    inside = inside.withColumn("rank", F.when(F.col("rank") <= F.col("_drawn"), F.col("rank")))
    return inside.select(*scored.columns, "rank").unionByName(met.filter("_score is null").select(*scored.columns, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", ngrams: int = NGRAMS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """``(doc_id, n_words, n_features, weight, score, rank)`` of every row of ``docs``; rank is null where it is not drawn."""
    gain = gains(bucket_counts(docs, text, ngrams, buckets), bucket_counts(target, text, ngrams, buckets))
    return ranked(stash(with_score(weighed(docs, gain, doc_id, text, ngrams), seed), "scored"), least_words, percent)


def drawn(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that are drawn, with all their columns; of rows with one id all or none stay, by their best rank."""
    ids = resample(docs, target, doc_id, **options).filter("rank is not null and doc_id is not null").select(F.col("doc_id").alias("_drawn_id")).distinct()
    return docs.join(ids, docs[doc_id] == ids["_drawn_id"], "left_semi")


def query(spark, sf_dir: str) -> DataFrame:
    made = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return made.select("doc_id", "n_features", "weight", "score", "rank")
