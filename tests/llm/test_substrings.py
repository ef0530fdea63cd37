import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from nodelytics.llm import induced, substrings


def brute(texts, length=400):
    """Kept bytes, removed count and spans of each text."""
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        out.append((int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("base", "piece", "memory"), [(1 << 20, 1 << 17, 4 << 20), (4, 1 << 17, 4 << 20), (4, 3, 64), (8, 7, 0)])
def test_order_and_prefixes(monkeypatch, base, piece, memory):
    """Against a plain sort of the suffixes: by recursion to strings of a few names, and with queues that go to disk."""
    monkeypatch.setattr(induced, "BASE", base)
    monkeypatch.setattr(induced, "PIECE", piece)
    monkeypatch.setattr(induced, "QUEUE_MEMORY", memory)
    for seed in range(20):
        rng = random.Random(seed)
        chunks = [bytes(rng.choice(b"abc" if seed % 2 else b"a") for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 9))] + [b"ab" * 20] * (seed % 3)
        t = np.concatenate([x for c in chunks + chunks[:2] for x in (np.frombuffer(c, np.uint8).astype(np.uint16) + 1, np.zeros(1, np.uint16))])
        text, cap = t.tolist(), rng.choice([7, 1000])
        order, prefix = induced.suffix_order(t, cap, np.flatnonzero(t == 0))
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        for n, (a, b) in enumerate(zip(order.tolist(), order[1:].tolist(), strict=False)):
            k = 0
            while k < cap and max(a, b) + k < len(text) and text[a + k] == text[b + k] != 0:
                k += 1
            assert prefix[n + 1] == k


def test_a_shard_a_task(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SHARD_BYTES", 1000)
    chunks = spark.range(400).select("id", F.xxhash64("id").alias("anchor"), F.col("id").cast("string").cast("binary").alias("cid"), F.lit(b"x" * 100).alias("chunk"), F.lit(1).cast("long").alias("m"))
    dealt = substrings._dealt(chunks.drop("id"))
    tasks = dealt.select("shard", "cid", F.spark_partition_id().alias("task")).collect()
    shards = {r.shard for r in tasks}
    assert len(tasks) == 400 and len(shards) == 41 == dealt.rdd.getNumPartitions()
    assert len({r.task for r in tasks}) == len({(r.task, r.shard) for r in tasks}) == len(shards)


def test_a_shard_of_twice_the_size_needs_no_second_recursion(monkeypatch):
    deeper, order = [], induced.suffix_order
    monkeypatch.setattr(induced, "suffix_order", lambda t, *rest: (deeper.append(len(t)), order(t, *rest))[1])
    rng = np.random.default_rng(6)
    words = ["".join(w) for w in rng.choice(list("aaabcdeeefghiiijklmnooopqrstuuuvw"), (5000, 7))]
    prose = " ".join(words[i][: 2 + i % 6] for i in rng.integers(0, 5000, substrings.SHARD_BYTES // 2)).encode()[: 2 * substrings.SHARD_BYTES]
    lengths = np.full(len(prose) // 600, 600)
    substrings.marked_windows(np.frombuffer(prose, np.uint8)[: lengths.sum()], lengths, np.zeros(len(lengths), bool))
    assert deeper and max(deeper) <= induced.BASE


def test_queues_spill():
    q = induced.DiskQueues(memory=64)
    pairs = lambda i: np.column_stack((np.arange(i, i + 10), np.full(10, i))).astype(np.int32)
    for i in range(20):
        q.push(i % 3, pairs(i))
    assert np.concatenate(list(q.take(1))).tolist() == [x for i in range(1, 20, 3) for x in pairs(i).tolist()]
    assert list(q.take(1)) == []


def test_runs_depend_on_windows_alone():
    rng = np.random.default_rng(3)
    text = rng.integers(97, 101, 5000).astype(np.uint8).tobytes()
    first, anchor = substrings.runs(text)
    whole = dict(zip(first.tolist(), anchor.tolist(), strict=True))
    of = [anchor[np.searchsorted(first, i, "right") - 1] for i in range(len(text) - 399)]
    assert len(whole) > 5
    for i in (0, 17, 900, 4600):
        assert substrings.runs(text[i : i + 400])[1].tolist() == [of[i]]


@pytest.mark.parametrize("hot", [3000, 1])
def test_removal(spark, docs, monkeypatch, hot):
    monkeypatch.setattr(induced, "BASE", 1000)
    monkeypatch.setattr(substrings, "HOT_CHUNKS", hot)
    monkeypatch.setattr(substrings, "SHARD_BYTES", 20_000)
    rng = random.Random(2)
    extra = ["x" * 900, "y" * 399, "y" * 399, "z" * 400, "z" * 401]
    shared = "".join(rng.choice("abcdé ") for _ in range(700))
    extra += ["".join(rng.choice("abc ") for _ in range(300)) + shared[rng.randint(0, 200) :][: rng.randint(380, 500)] + "".join(rng.choice("abc ") for _ in range(90)) for _ in range(25)]
    rows = docs.select("doc_id", "text", "n_chars").filter("doc_id is null or doc_id < 82").unionByName(spark.createDataFrame([(1000 + i, t, len(t)) for i, t in enumerate(extra)], "doc_id long, text string, n_chars long"))
    rows = rows.withColumn("n", F.monotonically_increasing_id())
    kept = {r.n: r for r in rows.collect()}
    want = dict(zip(kept, brute([(r.text or "").encode() for r in kept.values()]), strict=True))
    got = substrings.remove_repeats(rows).select("n", "spans", F.sha2("kept", 256).alias("sha")).collect()
    assert len(got) == len(want)
    for r in got:
        assert (sum(s.b - s.a for s in r.spans), len(r.spans), r.sha) == want[r.n], kept[r.n]
    made = substrings.drop_passages(rows.drop("n"))
    assert made.columns == ["doc_id", "text", "n_chars"] and made.count() == len(want)
    for r in made.collect():
        assert r.text is None or r.n_chars == len(r.text)


def test_a_crowded_anchor_is_parted(spark, monkeypatch):
    """A passage in many surroundings: no anchor keeps over 5 % of the chunks, and results are those of a plain count."""
    monkeypatch.setattr(substrings, "HOT_CHUNKS", 40)
    rng = random.Random(12)
    letters = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passages = [letters(150), letters(390), letters(700)]
    texts = [letters(rng.randint(300, 600)) + passages[i % 3] + letters(rng.randint(300, 600)) for i in range(900)]
    texts += [t[:-200] for t in texts[:60]] + texts[60:70] + [letters(500) + passages[1] + passages[0] + letters(300)]
    most, dealt = [], substrings._dealt

    def watched(chunks):
        most.append(chunks.groupBy("anchor").count().agg(F.max("count")).first()[0] or 0)
        return dealt(chunks)

    monkeypatch.setattr(substrings, "_dealt", watched)
    want = brute([t.encode() for t in texts])
    got = substrings.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "n long, text string")).select("n", "spans", F.sha2("kept", 256).alias("sha")).collect()
    assert len(got) == len(texts) and sum(bool(r.spans) for r in got) > 400
    for r in got:
        assert (sum(s.b - s.a for s in r.spans), len(r.spans), r.sha) == want[r.n]
    assert len(most) > 1 and max(most) <= 45


def test_passages_of_fifty_words(spark):
    """Passages of 50 words leave every text they stand in, shorter repeats stay, and further columns do not clash."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(4000)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages, short = [prose(n) for n in (51, 60, 120)], prose(40)
    texts = {i: prose(150) for i in range(20)}
    for i, p in enumerate(passages * 2):
        texts[i] = f"{prose(70)} {p} {prose(30)}" if i % 2 else f"{p} {prose(30)}"
    for i in (10, 11):
        texts[i] = f"{prose(60)} {short} {prose(60)}"
    docs = spark.createDataFrame([(i, t, len(t), "a", "b", "c") for i, t in texts.items()], "doc_id long, text string, n_chars long, spans string, kept string, _cut_text string")
    made = substrings.drop_passages(docs)
    assert made.columns == docs.columns
    got = {r.doc_id: r for r in made.collect()}
    for i, t in texts.items():
        if i < 6:
            inside = " ".join(passages[i % 3].split()[1:-1])
            assert inside in t and inside not in got[i].text and len(got[i].text) > 150 and got[i].n_chars == len(got[i].text)
        else:
            assert got[i].text == t
    assert "kept" in docs.columns and substrings.remove_repeats(docs).columns[-1] == "_kept"


def test_empty(empty):
    assert substrings.remove_repeats(empty.drop("kept")).count() == 0
    assert substrings.drop_passages(empty).columns == empty.columns and substrings.drop_passages(empty).count() == 0


def test_only_whole_words_go():
    words = [f"word{i}" for i in range(60)]
    text = " ".join(words).encode()
    at = [text.index(w.encode()) for w in words]
    # both ends in the middle of a word: 48 whole words do not count as 50
    assert substrings.cut_passages(text, [(at[4] + 3, at[53] + 3)], 50) == (text.decode(), False)
    kept, cut = substrings.cut_passages(text, [(at[4] + 3, at[53] + 3)], 48)
    assert cut and kept == " ".join(words[:5] + words[53:])
    # a span of whole words leaves the words on both sides apart
    kept, cut = substrings.cut_passages(text, [(at[4], at[54] - 1)], 50)
    assert cut and kept.split() == words[:4] + words[54:]
    kept, cut = substrings.cut_passages(text, [(at[4] - 1, at[54])], 50)
    assert cut and kept.split() == words[:4] + words[54:]
    assert substrings.cut_passages(text, [(0, len(text))], 50) == ("", True)
    assert substrings.whole_words(b"abc", 1, 2) == (2, 2)
    wide = ("漢" * 30 + " " + "字 " * 60).encode()
    kept, cut = substrings.cut_passages(wide, [(10, len(wide))], 50)
    assert cut and kept == "漢" * 30


def test_too_large_a_shard_is_refused():
    endless = np.lib.stride_tricks.as_strided(np.zeros(1, np.uint8), shape=((1 << 31) - 1,), strides=(0,))
    with pytest.raises(ValueError, match="more shards"):
        substrings.marked_windows(endless, np.array([1]), np.array([False]), 4)
