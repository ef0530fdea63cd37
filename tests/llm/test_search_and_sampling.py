import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from nodelytics.llm import lexical, neighbours, resample


def split(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


# --- importance resampling -------------------------------------------------------------------


def brute_resample(rows, target, ngrams=2, buckets=10_000, least=20, percent=25, seed=7):
    def grams(t):
        w = split(t)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, ngrams + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(b for _, x in rows for b in grams(x)), Counter(b for x in target for b in grams(x))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in s}
    out = []
    for i, x in rows:
        g = grams(x)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in g) // len(g) if g else 0
        out.append([i, len(split(x)), len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for rank, r in enumerate(able[: len(able) * percent // 100], 1):
        r[5] = rank
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("ngrams,buckets,percent", [(2, 10_000, 25), (3, 7, 60), (1, 100, 100)])
def test_resample(spark, docs, empty, ngrams, buckets, percent):
    target = spark.createDataFrame([(1, "Abc dé; abc漢 word"), (2, None), (3, ""), (4, "one two")], "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    made = resample.resample(docs, target, ngrams=ngrams, buckets=buckets, percent=percent)
    assert sorted(map(tuple, made.collect()), key=repr) == brute_resample(rows, [r.text for r in target.collect()], ngrams, buckets, 20, percent)
    assert resample.resample(empty, target).count() == 0
    none = [tuple(r) for r in resample.resample(docs, empty, ngrams=ngrams, buckets=buckets, percent=percent).collect()]
    assert sorted(none, key=repr) == brute_resample(rows, [], ngrams, buckets, 20, percent)


def test_drawn_rows_keep_their_columns(docs):
    kept = resample.drawn(docs, docs.filter("doc_id < 3"))
    ids = {r.doc_id for r in resample.resample(docs, docs.filter("doc_id < 3")).filter("rank is not null and doc_id is not null").collect()}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == ids and ids


def test_equal_scores_go_by_id(spark):
    """Ranks are gapless and cross the histogram of sums without a fault."""
    rows = [(i, " ".join(["word"] * (20 + i % 3))) for i in range(2000)]
    made = resample.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("word",)], "text string")).collect()
    drawn = sorted((r for r in made if r.rank), key=lambda r: r.rank)
    assert [r.rank for r in drawn] == list(range(1, 501))
    assert all((-a.score, a.doc_id) < (-b.score, b.doc_id) for a, b in zip(drawn, drawn[1:], strict=False))
    assert len({r.score for r in drawn}) < 500  # there were ties


# --- lexical search --------------------------------------------------------------------------


def brute_search(docs, items, k=10):
    words = [(i, split(t)) for i, t in docs]
    n, total = sum(1 for _, w in words if w), sum(len(w) for _, w in words)
    held = Counter(t for _, w in words for t in set(w))
    out = []
    for item, text in items:
        found = []
        for i, w in words:
            tf, score = Counter(w), 0
            for t in set(split(text)) & set(tf):
                m = 100 - 90 + (90 * len(w) * n) // total
                score += math.floor(1000 * math.log((2 * n + 2) / (2 * held[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m))
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("owners,per_slice,per_bundle,block", [(4, 4096, 256, 4 << 20), (3, 7, 5, 300), (1, 1, 1, 4 << 20), (9, 20, 3, 4 << 20)])
def test_lexical_search(spark, docs, empty, monkeypatch, owners, per_slice, per_bundle, block):
    monkeypatch.setattr(lexical, "BLOCK_BYTES", block)
    pairs = [(r.doc_id, r.text) for r in docs.collect()]
    words = [" ".join(split(t)[:9]) for _, t in pairs[:9]]
    rows = [(i, t) for i, t in enumerate([*words, "one TWO one", "", None, "absent", "a b c e", words[0]])] + [(None, "two words"), (3, words[3])]
    items = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "item_id long, text string, doc_id string, score int")
    want = brute_search(pairs, rows)
    made = lexical.search(docs, items, owners=owners, slice_docs=per_slice, bundle_items=per_bundle)
    assert sorted(map(tuple, made.collect()), key=repr) == want
    assert lexical.search(empty, items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0


def test_pruning_loses_nothing(spark):
    """Many documents, some of whose terms come late and often; the best ten stay right."""
    rng = np.random.default_rng(3)
    share = 1 / np.arange(1, 61)
    pairs = [(i, " ".join(f"w{x}" for x in rng.choice(60, rng.integers(1, 60), p=share / share.sum()))) for i in range(400)]
    rows = [(i, " ".join(f"w{x}" for x in rng.choice(60, 8))) for i in range(20)]
    made = lexical.search(spark.createDataFrame(pairs, "doc_id long, text string"), spark.createDataFrame(rows, "item_id long, text string"), k=3)
    assert sorted(map(tuple, made.collect()), key=repr) == brute_search(pairs, rows, 3)


def test_owners_hold_alike():
    held = np.array([0, 1, 1, 2, 50, 50, 3, 1])
    owner = lexical.owner_of(held, 2)
    assert owner[4] != owner[5] and (owner[[0, 1, 2, 3, 6, 7]] == 0).all()


# --- nearest neighbours ----------------------------------------------------------------------


def brute_nearest(rows, asked, k=5):
    rows = [(i, np.array(v)) for i, v in rows]
    out = {}
    for q, v in asked:
        v = np.array(v)
        found = sorted((-float((v * x).sum() / (np.sqrt((v * v).sum()) * np.sqrt((x * x).sum()))), i) for i, x in rows if i != q)
        out[q] = [(i, -s) for s, i in found[:k]]
    return out


def test_chi_square():
    assert abs(neighbours.chi_square(3.0, 2) - (1 - math.exp(-1.5))) < 1e-12
    draws = (np.random.default_rng(1).standard_normal((200_000, 8)) ** 2).sum(axis=1)
    assert abs((draws <= neighbours.stop_factor(0.9, 8)).mean() - 0.9) < 0.01


def test_recall_over_many_cells(spark, monkeypatch):
    """Several cells, cells of several blocks, visits dealt to several tasks."""
    for name, value in (("BLOCK", 300), ("VISITS", 7), ("SAMPLE", 64)):
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((30, 24))
    rows = [(i, (centres[rng.integers(30)] + 0.5 * rng.standard_normal(24)).tolist()) for i in range(4000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = rows[::50]
    want, got = brute_nearest(rows, asked), {}
    for r in neighbours.nearest(df, df.filter("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, []).append(r)
    assert got.keys() == want.keys()
    hits = 0
    for q, found in got.items():
        found.sort(key=lambda r: r.rank)
        assert [r.rank for r in found] == [1, 2, 3, 4, 5]
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        exact = dict(brute_nearest([rows[r.vec_id] for r in found], [rows[q]])[q])
        assert all(abs(exact[r.vec_id] - r.score) < 1e-12 for r in found)
        hits += len({r.vec_id for r in found} & {i for i, _ in want[q]})
    assert hits >= 0.95 * 5 * len(want)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(4)
    same = rng.standard_normal(6).tolist()
    good = [(i, rng.standard_normal(6).tolist()) for i in range(40)] + [(100 + i, same) for i in range(30)] + [(7, same), (8, same), (8, same)]
    bad = [(200, None), (201, []), (202, [0.0] * 6), (203, [nan, *same[1:]]), (204, [inf, *same[1:]]), (205, [None, *same[1:]]), (206, [1.0, 2.0]), (None, same)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in good + bad], "vec_id long, embedding array<double>, query_id string, rank int")
    got = {}
    for r in neighbours.nearest(df, df.filter("vec_id >= 100 or vec_id in (1, 2)"), confidence=1 - 1e-12).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    unique = list({(i, tuple(v)) for i, v in good})
    want = brute_nearest(unique, [x for x in unique if x[0] >= 100 or x[0] in (1, 2)])
    assert got.keys() == want.keys()
    for q, found in got.items():
        assert [i for _, i, _ in sorted(found)] == [i for i, _ in want[q]]
    assert [i for _, i, _ in sorted(got[100])] == [7, 8, 101, 102, 103]
    assert neighbours.nearest(df.limit(0), df.limit(0)).count() == 0
    few = df.filter("vec_id in (1, 2, 3)")
    assert neighbours.nearest(few, few).count() == 6
    one = df.filter("vec_id = 1")
    assert neighbours.nearest(one, one).count() == 0
