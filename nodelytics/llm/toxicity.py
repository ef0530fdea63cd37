"""Toxicity severity by cumulative-link ordinal regression on sparse text features: words and word beginnings.

P(grade >= k) = sigmoid(w.x - t_k) with one weight vector for all grades and ordered thresholds
t_1 < t_2 < t_3; the output is the expected grade, the sum of these probabilities.

Labels say only toxic or not, so the grades of the fit are: 0 for rows that are not toxic; toxic
rows get 1, 2 or 3 by how many different features of strong toxic evidence they hold, cut at the
thirds of that number over the toxic rows of the fit.  Evidence is the log-odds of a feature's document frequency between the two classes,
counted by Spark.  Features are the ``FEATURES`` ones whose
log-odds are surest (absolute value less two standard errors); values are log(1 + count).  The
regression has an absolute-value penalty that leaves most weights zero.  All of the fit uses about
``FIT_ROWS`` labelled rows at most, picked by a hash of the id: of toxic ones up to a half, so that rare
ones stay, and the rest of the others.  Probabilities are corrected for the shares picked.

Null, empty and wordless texts have no features; they get the severity of an empty text but are
never flagged.  Without toxic labels nothing is flagged.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small, stash, table, utf8, with_columns

GRADES = 3
FEATURES, FIT_ROWS = 600, 12_000
#: Strong evidence: log-odds, and z-score.
STRONG_ODDS, STRONG_Z = 2.0, 3.0
#: Least share of labelled documents with a word, for it to be a feature, and least number.
LEAST_SHARE, LEAST_DOCS = 0.0005, 3
LASSO, STEPS = 1e-4, 250
_WORDS = bytes((b + 32 if 65 <= b <= 90 else b) if (65 <= b <= 90 or 97 <= b <= 122 or b >= 128) else 32 for b in range(256))
_COUNTED, CACHED_WORDS = 300_000, 300_000
#: Lengths of word beginnings that are features.
PREFIXES = (3, 4, 5, 6, 7)


def words(text: bytes | None) -> list[str]:
    """Words of ASCII letters (lower-cased) and non-ASCII characters."""
    return text.translate(_WORDS).decode("utf-8", "replace").split() if text else []


def features(word: str) -> list[str]:
    """The word, and its first letters as far as it is longer."""
    return [word, *("^" + word[:k] for k in PREFIXES if len(word) > k)]


class _Known(dict):
    """The model's features of each word met."""

    def __init__(self, names):
        self.names = names

    def __missing__(self, word: str) -> tuple[str, ...]:
        if len(self) > CACHED_WORDS:
            self.clear()
        found = self[word] = tuple(f for f in features(word) if f in self.names)
        return found


@dataclass
class Model:
    weights: dict[str, float]
    thresholds: list[float]
    #: Share of the toxic rows that the fit picked over that of the others.
    ratio: float = 1.0

    def __post_init__(self):
        self.known = _Known(self.weights)

    def probabilities(self, text: bytes | None) -> list[float]:
        """P(grade >= k) for each k."""
        found = Counter(chain.from_iterable(map(self.known.__getitem__, words(text))))
        x = sum(self.weights[w] * math.log1p(n) for w, n in found.items())
        found = [1 / (1 + math.exp(min(700.0, t - x))) for t in self.thresholds]
        return found if self.ratio == 1 else [p / (found[0] + self.ratio * (1 - found[0])) for p in found]


def labelled(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """``(doc_id, text, toxic)`` of about ``FIT_ROWS`` labelled documents at most, by a hash of the id and by class; texts are not null.

    Also the share of toxic rows picked over that of the others.  The hash picks ids on both sides,
    and the labels picked are few enough to be sent, so no text is shuffled.
    """
    marks = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total, toxic = marks.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("toxic") > 0).cast("long")), F.lit(0))).first()
    most = max(FIT_ROWS // 2, FIT_ROWS - (total - toxic))
    bad = min(1.0, most / max(1, toxic))
    good = min(1.0, (FIT_ROWS - min(toxic, most)) / max(1, total - toxic))
    draw = F.pmod(F.xxhash64(F.lit("fit"), F.col("doc_id").cast("long")), F.lit(1_000_000))
    picked = marks.filter(draw < F.when(F.col("toxic") > 0, int(bad * 1_000_000)).otherwise(int(good * 1_000_000)))
    texts = docs.select("doc_id", "text").filter("text is not null").filter(draw < int(max(bad, good) * 1_000_000))
    return texts.join(small(stash(picked, "labels"), 2 * FIT_ROWS), "doc_id"), bad / (good or 1.0)


def document_frequencies(rows: DataFrame) -> DataFrame:
    """``(word, toxic, n)`` over the rows of the fit; tasks sum their own words first."""

    def run(batches):
        held: Counter = Counter()

        def out():
            keys = list(held)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([held[k] for k in keys], pa.int64())], names=["word", "toxic", "n"])
            held.clear()

        for batch in batches:
            for part in slices([batch], "text"):
                for text, toxic in zip(utf8(part.column(0)), part.column(1).to_pylist(), strict=True):
                    held.update((f, toxic) for f in {f for w in {*words(text)} for f in features(w)})
                    held["", toxic] += 1  # the class's number of documents
                if len(held) > _COUNTED:
                    yield from out()
        if held:
            yield from out()

    return rows.select("text", F.col("toxic").cast("int")).mapInArrow(run, "word string, toxic int, n long").groupBy("word", "toxic").agg(F.sum("n").alias("n"))


def _loss(x, y, w, gaps):
    """Mean cumulative-link loss and its gradient; ``gaps`` are the first threshold and the logs of the steps to the next."""
    n = len(y)
    t = gaps[0] + np.concatenate(([0.0], np.cumsum(np.exp(gaps[1:]))))
    edges = np.concatenate((np.ones((n, 1)), 1 / (1 + np.exp(np.clip(t - (x @ w)[:, None], -500, 500))), np.zeros((n, 1))), axis=1)
    rows = np.arange(n)
    p = np.maximum(edges[rows, y] - edges[rows, y + 1], 1e-12)
    slope = edges * (1 - edges)
    up, down = slope[rows, y] / p, slope[rows, y + 1] / p
    g_t = np.zeros(GRADES)
    np.add.at(g_t, (y - 1)[y > 0], up[y > 0])
    np.add.at(g_t, y[y < GRADES], -down[y < GRADES])
    g_gap = np.concatenate(([g_t.sum()], [g_t[k:].sum() * np.exp(gaps[k]) for k in range(1, GRADES)])) / n
    return -np.log(p).mean(), x.T @ (down - up) / n, g_gap


def _descend(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sparse weights and ordered thresholds: proximal gradient steps with momentum and a step that halves where the loss would rise."""
    n, d = x.shape
    above = np.array([((y >= k).sum() + 0.5) / (n + 1) for k in range(1, GRADES + 1)])
    t = np.log((1 - above) / above)
    at = np.concatenate((np.zeros(d), t[:1], np.log(np.maximum(np.diff(t), 1e-2))))
    ahead, k, step = at, 1.0, 8.0
    for _ in range(STEPS):
        loss, g_w, g_gap = _loss(x, y, ahead[:d], ahead[d:])
        g = np.concatenate((g_w, g_gap))
        while True:
            new = ahead - step * g
            new[:d] = np.sign(new[:d]) * np.maximum(np.abs(new[:d]) - step * LASSO, 0)
            move = new - ahead
            if step < 1e-4 or _loss(x, y, new[:d], new[d:])[0] <= loss + g @ move + move @ move / (2 * step) + 1e-12:
                break
            step /= 2
        following = (1 + math.sqrt(1 + 4 * k * k)) / 2
        ahead, at, k = new + (k - 1) / following * (new - at), new, following
    return at[:d], at[d] + np.concatenate(([0.0], np.cumsum(np.exp(at[d + 1 :]))))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    rows, ratio = labelled(docs, labels)
    by_word = document_frequencies(rows).groupBy("word").agg(F.sum(F.when(F.col("toxic") > 0, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") > 0, 0).otherwise(F.col("n"))).alias("b"))
    by_word = stash(by_word, "toxic-words")
    totals = by_word.filter(F.octet_length("word") == 0).first()
    if totals is None or not totals["a"] or not totals["b"]:
        return Model({}, [50.0] * GRADES)
    a, b = totals["a"], totals["b"]
    odds = F.log((F.col("a") + 0.5) / (a - F.col("a") + 0.5)) - F.log((F.col("b") + 0.5) / (b - F.col("b") + 0.5))
    error = F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    scored = by_word.filter((F.octet_length("word") > 0) & (F.col("a") + F.col("b") >= max(LEAST_DOCS, LEAST_SHARE * (a + b)))).select("word", odds.alias("odds"), (odds / error).alias("z"), (F.abs(odds) - 2 * error).alias("sure"))
    top = scored.orderBy(F.desc("sure"), "word").limit(FEATURES).collect()
    number = {r["word"]: i for i, r in enumerate(top)}
    strong = {r["word"] for r in top if r["odds"] >= STRONG_ODDS and r["z"] >= STRONG_Z}
    def values(texts):
        known = _Known(number)
        out = [Counter(chain.from_iterable(map(known.__getitem__, words(t)))) for t in texts]
        return [[[number[w] for w in c] for c in out], [[float(math.log1p(n)) for n in c.values()] for c in out], [len(strong.intersection(c)) for c in out]]

    found = with_columns(rows, "text", "at array<int>, value array<double>, evidence int", values).select("toxic", "at", "value", "evidence").collect()
    if not found:
        return Model({}, [50.0] * GRADES)
    x = np.zeros((len(found), len(number)), np.float32)
    y = np.zeros(len(found), np.int64)
    thirds = np.quantile([r["evidence"] for r in found if r["toxic"] > 0] or [0], [k / GRADES for k in range(1, GRADES)])
    for i, r in enumerate(found):
        x[i, r["at"]] = r["value"]
        y[i] = 0 if r["toxic"] <= 0 else 1 + int((r["evidence"] > thirds).sum())
    w, t = _descend(x, y)
    return Model({k: float(w[i]) for k, i in number.items()}, [float(v) for v in t], ratio)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` and the columns ``severity`` (0 to 3), ``grade`` (the likeliest) and ``toxic`` (P(grade >= 1) over a half)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts):
        severity, grade, toxic = [], [], []
        for t in texts:
            p = sent.value.probabilities(t)
            cells = np.diff([-1.0, *(-v for v in p), 0.0])
            severity.append(sum(p))
            grade.append(int(cells.argmax()))
            toxic.append(p[0] > 0.5 and bool(words(t)))
        return [severity, grade, toxic]

    return with_columns(docs, text, "severity double, grade int, toxic boolean", run)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return predict(docs, fit(docs, table(spark, sf_dir, "labels"))).drop("text")
