import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from nodelytics.llm import decontaminate, lexicon, quality, shards, simhash, token_counts

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def rows(df):
    return [tuple(r) for r in df.collect()]


def brute_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    ws = [w for w in re.split("[\x20\x09-\x0d]+", low) if w]
    shingles = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] if len(ws) >= 3 else [" ".join(ws)] if ws else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    """Id -> least id of its component."""
    ids = list(fps)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            if (fps[ids[a]] ^ fps[ids[b]]).bit_count() <= 3:
                x, y = root(ids[a]), root(ids[b])
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_simhash(docs, empty):
    made = simhash.near_duplicate_groups(docs)
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    want = {i: brute_fingerprint(t) for i, t in texts.items()}
    groups = brute_components(want)
    got = made.collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is not None:
            assert r.fp & (1 << 64) - 1 == want[r.doc_id]
            assert r.component_id == groups[r.doc_id]
    assert simhash.near_duplicate_groups(empty).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(groups.values()))
    assert simhash.keep_one(empty).count() == 0


def test_simhash_hot_key(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 4)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = np.random.default_rng(1)
    base = int(rng.integers(1 << 60))
    values = {base ^ int(sum(1 << int(b) for b in rng.choice(40, rng.integers(0, 4), replace=False))) for _ in range(150)}
    values |= {int(x) for x in rng.integers(-(1 << 62), 1 << 62, 100)} | {0, 1, 3, 7, 15, 31, 63, 127, 255, 511}
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    stars = simhash.components(simhash.links(fps)).collect()
    got = defaultdict(set)
    for r in stars:
        got[r.root].add(r.node)
    want = defaultdict(set)
    for i, g in brute_components({v: v & (1 << 64) - 1 for v in values}).items():
        want[g].add(i)
    assert sorted(map(sorted, got.values())) == sorted(sorted(x) for x in want.values() if len(x) > 1)


def brute_base(text):
    ws = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    windows = Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
    hit = {j for i in range(len(ws) - 7) if windows[tuple(ws[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit), len(lines)


def test_quality_base(docs, empty):
    made = quality.with_base(docs.select("doc_id", "text"))
    for r in made.collect():
        assert tuple(r)[2:] == brute_base(r.text), r.text
    assert quality.with_base(empty.select("text")).count() == 0


def test_quality_keeps_clashing_columns(docs, spark):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    odd = docs.withColumns({"_q_n_words": F.lit(1), "_cut_stratum": F.lit("a"), "_stratum": F.lit("b"), "_label_id": F.lit(3)})
    made = quality.filter_documents(odd, labels)
    want = sorted(str(r.n_words) for r in docs.collect() if r.text and brute_base(r.text)[0] >= 20 and brute_base(r.text)[4] * 100 <= 30 * brute_base(r.text)[0])
    assert made.columns == odd.columns and sorted(str(r.n_words) for r in made.collect()) == want
    with pytest.raises(ValueError, match="n_words"):
        quality.with_base(docs)


def test_exact_bound():
    for k, n, level in ((0, 50, 0.05), (3, 100, 0.01), (10, 4000, 0.001)):
        p = quality.upper_bound(k, n, level)
        x = np.arange(k + 1)
        logs = np.array([np.sum(np.log(np.arange(n - i + 1, n + 1))) - np.sum(np.log(np.arange(1, i + 1))) for i in x])
        assert abs(np.exp(logs + x * np.log(p) + (n - x) * np.log1p(-p)).sum() - level) < 1e-6
    assert quality.upper_bound(5, 5, 0.1) == 1.0
    assert quality.choose([0, 0, 0], [1.0, 2.0], 0.1, 0.05) is None


def test_quality_cutoffs(spark):
    good, bad = [(i, "en", "plain words here " * 20 + f"{i} " + " ".join(f"w{i}x{j}" for j in range(60))) for i in range(3000)], [(5000 + i, "en", " ".join(f"a{i}b{j}###|||" for j in range(60))) for i in range(100)]
    good = [(i, "en", " ".join(f"word{i}x{j}" for j in range(30))) for i, _, _ in good]
    docs = spark.createDataFrame(good + bad + [(9000, None, " ".join(f"a{j}b###" for j in range(60))), (9001, "en", None)], "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i, _, _ in good] + [(5000, 0, 0), (None, 1, None)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality.filter_documents(docs, labels).collect()}
    assert {i for i, _, _ in good} <= kept and 9001 not in kept
    assert not kept & {i for i, _, _ in bad} and 9000 in kept  # no label of its stratum: no cutoff
    made = quality.verdicts(quality.with_base(docs), labels)
    assert {r.doc_id for r in made.collect() if r.kept} == kept
    assert quality.filter_documents(docs.limit(0), labels.limit(0)).count() == 0


def test_token_counts_and_lexicon(docs, empty):
    library = tokenizers.Tokenizer.from_file(BYTE_BPE)
    counted = token_counts.with_token_count(docs.select("doc_id", "text"), BYTE_BPE).collect()
    image = lexicon.fit_lexicon(docs, BYTE_BPE, size=200)
    coded = lexicon.encode_decode(docs.select("doc_id", "text"), BYTE_BPE, image).collect()
    for a, b in zip(counted, coded, strict=True):
        ids = library.encode(a.text or "", add_special_tokens=False).ids
        assert a.n_tokens == len(ids) and np.frombuffer(b.ids, "<u4").tolist() == ids
        assert b.decoded == library.decode(ids, skip_special_tokens=False)
    assert lexicon.digests(empty, BYTE_BPE).count() == 0
    digest = {r.doc_id: r for r in lexicon.digests(docs, BYTE_BPE).collect()}
    assert digest[66].n_tokens == 0 and digest[66].ids_sha256 == hashlib.sha256(b"").hexdigest()


def test_lexicon_automaton():
    words = {w.encode(): [i, i + 1] for i, w in enumerate(["a", "ab", "abc", "tops", "taps", "tap", "top", "é"])}
    lex = lexicon.Lexicon(lexicon.compile_lexicon(words))
    asked = [*words, b"", b"t", b"topsy", b"zz", b"abcd"]
    for w, n in zip(asked, lex.find(asked).tolist(), strict=True):
        assert (lex.get(n).tolist() if n >= 0 else None) == words.get(w)
    assert lexicon.Lexicon(lexicon.compile_lexicon({})).find([b"a"]).tolist() == [-1]


def brute_contamination(texts, items):
    def ws(t):
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    out = []
    for t in texts:
        words, hit, named = ws(t), set(), set()
        for item, text in items:
            its = ws(text)
            for k in range(max(1, len(its) - 9) if its else 0):
                w = its[k : k + 10]
                for i in range(len(words) - len(w) + 1):
                    if words[i : i + len(w)] == w:
                        hit.update(range(i, i + len(w)))
                        named |= set() if item is None else {str(item)}
        out.append((len(words), len(hit), sorted(named)))
    return out


def test_decontamination(spark, docs, empty, monkeypatch):
    few = docs.filter("doc_id is null or doc_id < 82")
    texts = {r.doc_id: r.text for r in few.collect() if r.doc_id is not None}
    items = [(1, texts[7][:200]), (2, "Two Words"), (3, ""), (4, None), (5, "12"), (6, texts[3].upper()), (7, "never seen here"), (8, texts[7][:200]), (None, texts[9][:300])]
    bench = spark.createDataFrame([(*i, 7) for i in items], "item_id long, text string, doc_id int")
    want = dict(zip(texts, brute_contamination(texts.values(), items), strict=True))
    for size in (1 << 24, 300):  # one slice, many slices
        monkeypatch.setattr(decontaminate, "SLICE_BYTES", size)
        got = decontaminate.contamination(few.select("doc_id", "text"), bench, ["doc_id"]).collect()
        assert len(got) == few.count()
        for r in got:
            if r.doc_id is not None:
                assert (r.n_words, r.n_hit, r["items"]) == want[r.doc_id], r.doc_id
    clean = decontaminate.drop_contaminated(few, bench)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} - {None} == {i for i, w in want.items() if not w[1]}
    assert decontaminate.contamination(empty, bench, ["doc_id"]).count() == 0
    assert decontaminate.drop_contaminated(few, bench.limit(0)).count() == few.count()


def test_proximity(spark, monkeypatch):
    """Against every word of every document; words of other documents do not count."""
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(0, 60), p=np.arange(1, 31) / 465)) for _ in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "doc_id long, text string")
    items = [(1, "w3 w9"), (2, "w1 W2 w1 w4"), (3, "w29"), (4, "none w3"), (5, None)]
    monkeypatch.setattr(decontaminate, "_CANDIDATES", 7)
    segments = decontaminate.index(docs.repartition(3), ["doc_id"])
    hits = decontaminate.proximity_hits(segments, spark.createDataFrame(items, "item_id long, text string"), 4)
    rows = segments.select("segment", F.posexplode("docs").alias("doc", "d")).select("segment", "doc", "d.doc_id")
    got = sorted((r.doc_id, r.start, r.item) for r in hits.join(rows, ["segment", "doc"]).collect())
    count = Counter(w for t in texts for w in t.split())
    want = []
    for item, text in items:
        asked = sorted(set((text or "").lower().split()))
        if not asked or not all(count[w] for w in asked):
            continue
        least = {w for w in asked if count[w] == min(count[x] for x in asked)}
        assert len(least) == 1
        for i, t in enumerate(texts):
            ws = t.split()
            want += [(i, p, str(item)) for p, w in enumerate(ws) if w in least and set(asked) <= set(ws[max(0, p - 4) : p + 5])]
    assert got == sorted(want) and got
    # the stored index serves a second benchmark
    again = decontaminate.phrase_hits(segments, spark.createDataFrame([(7, "w3 w9")], "item_id long, text string"))
    assert again.count() == sum(a == "w3" and b == "w9" for t in texts for a, b in zip(t.split(), t.split()[1:]))


def test_shards(docs, empty):
    made = shards.shards(docs)
    got = made.collect()
    assert len(got) == docs.count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    size, slots = Counter(), defaultdict(list)
    for r in got:
        if r.doc_id is not None:
            raw = (texts[r.doc_id] or "").encode()
            assert r["size"] == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw)
        size[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(size) <= set(range(16))
    assert shards.shards(empty).count() == 0


def test_shards_are_even_under_one_value(spark):
    def table(other):
        text = F.when(F.col("id") % 3 == 0, F.lit("same text")).otherwise(F.concat(other, F.repeat(F.lit("x"), (F.col("id") % 97).cast("int"))))
        return spark.range(20_000).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"))

    sums = [r[1] for r in shards.shards(table(F.concat(F.lit("t"), "id"))).groupBy("shard").agg(F.sum("size")).collect()]
    assert len(sums) == 16 and max(sums) < 1.02 * min(sums)
    # 97 texts of up to a third of a shard: none is parted but the one that outweighs a shard, so sizes are as even as whole texts allow
    few = shards.shards(table(F.lit("t"))).cache()
    sums = [r[1] for r in few.groupBy("shard").agg(F.sum("size")).collect()]
    assert len(sums) == 16 and max(sums) < 1.15 * min(sums)
    assert few.groupBy("text_crc32", "size").agg(F.countDistinct("shard").alias("n")).filter("n > 1").count() == 1


def test_equal_texts_share_a_shard(spark):
    rng = np.random.default_rng(8)
    texts = [f"text {i} " + "w " * int(rng.integers(1, 400)) for i in range(900)]
    rows = [(i, texts[int(rng.integers(900))] if i % 2 else f"own {i} " + "v " * int(rng.integers(1, 300)), str(rng.choice(["en", "de", "fr"])), str(rng.choice(["a", "b"]))) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: (r.shard, r["size"]) for r in shards.shards(docs).collect()}
    of = defaultdict(set)
    sums = Counter()
    for i, t, _, _ in rows:
        of[t].add(got[i][0])
        sums[got[i][0]] += got[i][1]
    assert all(len(x) == 1 for x in of.values()) and len(sums) == 16 and max(sums.values()) < 1.03 * min(sums.values())
    by_target = {r.shard for r in shards.shards(docs, target_bytes=sum(sums.values()) // 7).collect()}
    assert by_target == set(range(8))


def test_cuts_are_weighted_medians(spark):
    """Each cut against all places of its node, ordered and summed."""
    rng = np.random.default_rng(9)
    places, weights, node = rng.integers(0, 1 << 60, (3000, 3)), rng.integers(1, 90, 3000), rng.integers(4, 8, 3000)
    light = spark.createDataFrame([(int(n), int(w), *map(int, p)) for n, w, p in zip(node, weights, places, strict=True)], "node long, bytes long, d0 long, d1 long, d2 long")
    stats = {k: {"bytes": int(weights[node == k].sum()), "lo": places[node == k].min(0).tolist(), "hi": places[node == k].max(0).tolist()} for k in range(4, 8)}
    heavies = [{"unit": 1, "bytes": 9000, "d": [5, 5, 5], "node": 4}, {"unit": 2, "bytes": 4000, "d": [9, 9, 9], "node": 9}]
    nodes, side = shards.plan_splits(stats, heavies, [1 << 60] * 3)
    cuts = shards.weighted_cuts(light, {k: v for k, v in nodes.items() if k in stats})
    for k, s in stats.items():
        width = [h - lo if k != 4 else h - 5 for lo, h in zip(s["lo"], s["hi"], strict=True)]
        assert nodes[k]["dim"] == int(np.argmax(width))
        mine = node == k
        left = int(weights[mine & (places[:, nodes[k]["dim"]] < cuts[k])].sum())
        heavy = 9000 * (side[1] == 0) if k == 4 else 0
        assert abs(left + heavy - nodes[k]["bytes"] / 2) <= 0.002 * nodes[k]["bytes"] + 90
    assert nodes[9]["target"] == 0 and side[2] in (0, 1)
