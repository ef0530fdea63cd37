"""Language identification by prediction by partial matching.

Each language has a byte context tree of variable order (0 to 3).  At a context the next byte has
its count over (total + distinct), and the escape, distinct over (total + distinct), leads to the
next shorter context; below order 0 all 256 bytes are equal.  Statistics are frozen after the fit,
so the code length of a text under a language is exact and does not depend on other texts; the
shortest code wins.  For speed the frequent contexts of all languages are one table of code lengths,
a row for each context and a column for each byte; at the few places where a text stands in one of
the other, rare contexts, their counts are looked up in sorted lists and the same formula is applied.
No context is dropped.

The trees are fitted on a sample of bounded size (``FIT_DOCS`` documents a language, by a hash of
the id).  A null text, or one without a letter, is ``und`` with score 0; the score of others is the
share of the winner among the languages at their code lengths per 64 bytes at most (0 to 1).
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, table, utf8, with_columns, worker_cache

ORDER = 3
#: Documents a language that the fit reads, about (whole texts).
FIT_DOCS = 1500
#: Contexts of two and three bytes that have rows in the code table (the most frequent ones), and bytes of it; the others are looked up.
CONTEXTS = 12_000
TABLE_BYTES = 40 << 20
UND = "und"
_LETTER = regex.compile(r"\p{L}")
_SLAB = 1 << 18


def held_out(doc_id: str = "doc_id"):
    """Documents that the fit never sees."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "utf-8")) % 3 == 1, F.lit(False))


def counts(docs: DataFrame) -> DataFrame:
    """``(lang, gram, n)``: grams are a byte and the three before it (0 at the start), as a 32-bit number."""

    def run(batches):
        for batch in batches:
            for part in slices([batch], "text", 4 << 20):
                by: dict[str, list[bytes]] = {}
                for lang, text in zip(part.column(0).to_pylist(), utf8(part.column(1)), strict=True):
                    if text:
                        by.setdefault(lang, []).append(b"\0\0\0" + text)
                for lang, texts in by.items():
                    grams = np.concatenate([_grams(np.frombuffer(t, np.uint8)) for t in texts])
                    g, n = np.unique(grams, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g, pa.int64()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _grams(data: np.ndarray) -> np.ndarray:
    """Of a text led by three zeros."""
    d = data.astype(np.uint32)
    return d[:-3] << 24 | d[1:-2] << 16 | d[2:-1] << 8 | d[3:]


class Model:
    """The code table: ``cost[row, language, byte column]`` in bits, and the row of each history of three bytes."""

    def __init__(self, langs: list[str], grams: dict[str, tuple[np.ndarray, np.ndarray]], contexts: int = CONTEXTS):
        self.langs = langs
        every = np.concatenate([g for g, _ in grams.values()]) if langs else np.zeros(0, np.int64)
        weights = np.concatenate([n for _, n in grams.values()]) if langs else np.zeros(0, np.int64)
        seen = np.unique(np.concatenate([every >> s & 255 for s in (24, 16, 8, 0)])) if len(every) else np.zeros(0, np.int64)
        #: bytes get columns; the last column is for all bytes that the fit has not seen
        self.column = np.full(256, len(seen), np.int64)
        self.column[seen] = np.arange(len(seen))
        width = self.width = len(seen) + 1
        contexts = min(contexts, max(256, TABLE_BYTES // max(1, 4 * len(langs) * width)))
        two, three = (_frequent(every >> 8 & m, weights) for m in (0xFFFF, 0xFFFFFF))
        # a context is kept with its own suffixes, so that every escape has somewhere to go
        three = three[: contexts * 2 // 3]
        two = np.unique(np.concatenate((two[: contexts // 3], three & 0xFFFF)))
        three, one = np.sort(three), seen
        self.rows = 1 + len(one) + len(two) + len(three)
        first = {1: 1, 2: 1 + len(one), 3: 1 + len(one) + len(two)}
        kept = {1: one, 2: two, 3: three}
        cost = np.zeros((self.rows, len(langs), width))
        for k, lang in enumerate(langs):
            g, n = grams[lang]
            p = np.full(width, 1 / 256)  # below order 0
            last = None
            for order in range(ORDER + 1):
                known = np.array([0]) if not order else kept[order]
                table = np.zeros((len(known), width))
                where = (g >> 8) & ((1 << 8 * order) - 1)
                place = np.searchsorted(known, where)
                good = (place < len(known)) & (known[np.minimum(place, len(known) - 1)] == where) if len(known) else np.zeros(len(g), bool)
                np.add.at(table, (place[good], self.column[g[good] & 255]), n[good])
                total, distinct = table.sum(1, keepdims=True), (table > 0).sum(1, keepdims=True)
                if not order:
                    parent = np.broadcast_to(p, table.shape)
                else:
                    short = known & ((1 << 8 * (order - 1)) - 1)
                    parent = last[np.searchsorted(kept[order - 1], short)] if order > 1 else np.broadcast_to(last[0], table.shape)
                whole = np.maximum(total + distinct, 1)
                found = np.where(table > 0, table / whole, np.where(total > 0, distinct / whole * parent, parent))
                start = first.get(order, 0)
                cost[start : start + len(known), k] = -np.log2(found)
                last = found
        self.cost = np.ascontiguousarray(cost.transpose(0, 2, 1).reshape(self.rows * width, len(langs)), np.float32)
        self._first, self._kept = first, kept
        #: Rare contexts by order, and per order and language their counts: contexts, totals, distinct bytes; and (context, byte), count.
        self._rare = {2: np.setdiff1d(np.unique(every >> 8 & 0xFFFF), two), 3: np.setdiff1d(np.unique(every >> 8), three)}
        self._lists = {order: [self._counts(*grams[lang], order) for lang in langs] for order in (2, 3)}

    def _counts(self, g: np.ndarray, n: np.ndarray, order: int) -> tuple[np.ndarray, ...]:
        """Sorted lists of a language's counts at the rare contexts of an order."""
        part = g & ((1 << 8 * (order + 1)) - 1)
        mine = np.isin(part >> 8, self._rare[order])
        keys, at = np.unique(part[mine], return_inverse=True)
        count = np.bincount(at, n[mine], len(keys)) if len(keys) else np.zeros(0)
        contexts, first, distinct = np.unique(keys >> 8, return_index=True, return_counts=True)
        total = np.add.reduceat(count, first) if len(keys) else np.zeros(0)
        return contexts, total, distinct, keys, count

    def rare_bits(self, row: np.ndarray, history: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Bits of bytes in rare contexts, summed per language, from the rows of their longest frequent contexts."""
        p = np.exp2(-self.cost[row * self.width + self.column[byte]].astype(np.float64))
        for order in (2, 3):
            context = history & ((1 << 8 * order) - 1)
            rare = np.isin(context, self._rare[order])
            for k, (contexts, total, distinct, keys, count) in enumerate(self._lists[order]):
                at = np.searchsorted(contexts, context)
                live = np.flatnonzero(rare & (at < len(contexts)))
                live = live[contexts[at[live]] == context[live]]
                t, d = total[at[live]], distinct[at[live]]
                key = context[live] << 8 | byte[live]
                place = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
                found = keys[place] == key if len(keys) else np.zeros(len(key), bool)
                p[live, k] = np.where(found, count[place] / (t + d), d / (t + d) * p[live, k]) if len(live) else p[live, k]
        return -np.log2(p).sum(0)

    def lookup(self) -> np.ndarray:
        """The row of each history of three byte columns: its longest suffix in the table; less than 0, by one, where a rare context is longer."""
        w = self.width
        c = self.column
        out = np.zeros((w, w, w), np.int32)  # histories oldest first
        for x in self._kept[1]:
            out[:, :, c[x]] = self._first[1] + np.searchsorted(self._kept[1], x)
        for i, x in enumerate(self._kept[2].tolist()):
            out[:, c[x >> 8], c[x & 255]] = self._first[2] + i
        for x in self._rare[2].tolist():
            out[:, c[x >> 8], c[x & 255]] = -1 - out[:, c[x >> 8], c[x & 255]]
        three, rare = self._kept[3], self._rare[3]
        at = c[rare >> 16], c[rare >> 8 & 255], c[rare & 255]
        out[at] = np.minimum(out[at], -1 - out[at])
        out[c[three >> 16], c[three >> 8 & 255], c[three & 255]] = self._first[3] + np.arange(len(three))
        return out.reshape(-1)


def _frequent(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    v, at = np.unique(values, return_inverse=True)
    n = np.bincount(at, weights, len(v)) if len(v) else np.zeros(0)
    return v[np.lexsort((v, -n))]


def code_lengths(model: Model, rows: np.ndarray, text: bytes) -> np.ndarray:
    """Bits of the whole text under each language."""
    total = np.zeros(len(model.langs))
    data = np.frombuffer(b"\0\0\0" + text, np.uint8)
    c = model.column[data]
    w = model.width
    for lo in range(0, len(c) - 3, _SLAB):
        x = c[lo : lo + _SLAB + 3]
        row = rows[(x[:-3] * w + x[1:-2]) * w + x[2:-1]].astype(np.int64)
        rare = np.flatnonzero(row < 0)
        if len(rare):
            d = data[lo : lo + _SLAB + 3].astype(np.int64)
            total += model.rare_bits(-1 - row[rare], d[rare] << 16 | d[rare + 1] << 8 | d[rare + 2], d[rare + 3])
            keep = row >= 0
            row, x = row[keep], np.concatenate((x[:3], x[3:][keep]))
        total += model.cost[row * w + x[3:]].sum(0, dtype=np.float64)
    return total


def fit(docs: DataFrame, contexts: int = CONTEXTS) -> Model:
    """Context trees from the bounded sample of the documents that are not held out and have a language and a text."""
    usable = docs.select("doc_id", "lang", "text").filter("lang is not null and text is not null").filter(~held_out())
    per = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = None
    for lang, n in per.items():
        c = F.lit(min(1.0, FIT_DOCS / n))
        share = F.when(F.col("lang") == lang, c) if share is None else share.when(F.col("lang") == lang, c)
    if share is None:
        return Model([], {})
    draw = F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1_000_000)) / 1_000_000
    made = counts(usable.filter(draw < share)).toPandas()  # bounded by the sample
    langs = sorted(per)
    return Model(langs, {lang: (x["gram"].to_numpy(np.int64), x["n"].to_numpy(np.int64)) for lang in langs for x in [made[made["lang"] == lang]]}, contexts)


_WORKER = worker_cache("language")


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` and the columns ``lang_pred`` and ``score``, from the text alone."""
    sent = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, model))

    def run(texts):
        key, m = sent.value
        if _WORKER.get("key") != key:
            _WORKER.clear()
            _WORKER.update(key=key, rows=m.lookup())
        pred, score = [], []
        for t in texts:
            if not t or not m.langs or not _LETTER.search(t.decode("utf-8", "replace")):
                pred.append(UND)
                score.append(0.0)
                continue
            bits = code_lengths(m, _WORKER["rows"], t)
            best = int(bits.argmin())
            share = 2.0 ** (-(bits - bits[best]) * min(1.0, 64 / len(t)))
            pred.append(m.langs[best])
            score.append(float(1 / share.sum()))
        return [pred, score]

    return with_columns(docs, text, "lang_pred string, score double", run, "language")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    made = predict(docs.select("doc_id", "text"), fit(docs))
    return made.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
