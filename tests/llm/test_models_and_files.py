import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from nodelytics.llm import language, token_files, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def test_directly_addressable_codes():
    rng = np.random.default_rng(1)
    for ids in (rng.integers(0, 49_408, 5000), rng.integers(0, 1 << 32, 700), np.arange(10), np.array([1 << 24, 0, 255, 256])):
        chunks, more, ranks = token_files.pack(ids)
        assert token_files.unpack(chunks, more).tolist() == ids.tolist()
        for i in [0, len(ids) - 1, *rng.integers(0, len(ids), 40).tolist()]:
            assert token_files.at(i, chunks, more, ranks) == ids[i]


def test_encoding_equals_the_library():
    library = tokenizers.Tokenizer.from_file(WORD_BPE)
    rng = np.random.default_rng(3)
    letters = list("aÉé.,|!? \n'sß×÷漢😀<>É́A1…\u0085 ") + ["<|endoftext|>"]
    odd = ["".join(rng.choice(letters, rng.integers(0, 50))) for _ in range(400)] + ["a.. b", "x.,| y", "ΑΣ. x", ""]
    for t in odd:
        assert np.frombuffer(token_files.encode([t.encode()], WORD_BPE, None)[0], "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_files(spark, docs, empty, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 400)
    library = tokenizers.Tokenizer.from_file(WORD_BPE)
    unique = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    token_files.write(unique, str(tmp_path / "f"), WORD_BPE, range_docs=30)
    got = token_files.read(spark, str(tmp_path / "f")).withColumn("crc", F.crc32("ids")).orderBy("doc_id").collect()
    start, flat = 0, {}
    for r, d in zip(got, unique.orderBy("doc_id").collect(), strict=True):
        ids = library.encode(d.text or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.crc) == (d.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
        flat[r.doc_id] = ids
    asked = spark.createDataFrame([(0, 0), (5, len(flat[5]) - 1), (5, len(flat[5])), (78, 1), (78, 20_000)], "doc_id long, pos long")
    found = {(r.doc_id, r.pos): r.id for r in token_files.lookup(spark, str(tmp_path / "f"), asked).collect()}
    assert found == {k: flat[k[0]][k[1]] for k in [(0, 0), (5, len(flat[5]) - 1), (78, 1), (78, 20_000)]}
    for name, rows in (("all", docs), ("none", empty)):  # null ids and repeated rows; no rows
        token_files.write(rows, str(tmp_path / name), WORD_BPE)
        assert token_files.read(spark, str(tmp_path / name)).count() == rows.count()


def brute_bits(grams, text, order=3):
    """Code length of a text by the trees' definition."""
    total = 0.0
    data = b"\0\0\0" + text
    for i in range(3, len(data)):
        hist, byte = data[i - 3 : i], data[i]
        p, chain = 1 / 256, []
        for k in range(order + 1):
            chain.append(grams[k].get(hist[3 - k :], {}))
        for node in chain:
            n, d = sum(node.values()), len(node)
            if n:
                p = node[byte] / (n + d) if byte in node else d / (n + d) * p
        total -= np.log2(p)
    return total


@pytest.mark.parametrize("rows_for", [0, 12, 10_000])
def test_code_lengths_are_exact(rows_for):
    """However few contexts have rows in the table."""
    texts = {"x": b"abracadabra abacus", "y": b"zebra zoo zebra"}
    grams, counted = {}, {}
    for lang, t in texts.items():
        g = language._grams(np.frombuffer(b"\0\0\0" + t, np.uint8))
        v, n = np.unique(g, return_counts=True)
        grams[lang] = (v.astype(np.int64), n)
        counted[lang] = [{} for _ in range(4)]
        for code, m in zip(v.tolist(), n.tolist(), strict=True):
            h, b = code.to_bytes(4, "big")[:3], code & 255
            for k in range(4):
                node = counted[lang][k].setdefault(h[3 - k :], {})
                node[b] = node.get(b, 0) + m
    model = language.Model(["x", "y"], grams, contexts=rows_for)
    assert len(model._rare[3]) > 0 or rows_for > 12
    rows = model.lookup()
    for text in (b"abra zoo", b"qq!a", b"abacus\xff", b"", texts["x"] + texts["y"], b"cadabra zebra\xfe zoo abr"):
        got = language.code_lengths(model, rows, text)
        for k, lang in enumerate(model.langs):
            assert abs(got[k] - brute_bits(counted[lang], text)) < 1e-3


def test_language(spark, empty):
    rng = np.random.default_rng(4)
    words = {"aa": ["und", "der", "schön", "nicht", "haus"], "bb": ["the", "of", "house", "nice", "and"]}
    rows = [(i, " ".join(rng.choice(words[lang], rng.integers(3, 40))), lang) for i in range(300) for lang in [("aa", "bb")[i % 2]]]
    rows += [(1000, None, "aa"), (1001, "12 34 !", "bb"), (1002, "", None), (None, "the house", None), (1003, "der und " * 60_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert model.langs == ["aa", "bb"]
    got = {r.doc_id: r for r in language.predict(docs.select("doc_id", "text"), model).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows[:300]) and all(0 <= r.score <= 1 for r in got.values())
    assert [got[i].lang_pred for i in (1000, 1001, 1002, None, 1003)] == ["und", "und", "und", "bb", "aa"]
    assert language.predict(docs.select("doc_id", "text"), language.fit(empty)).filter("lang_pred <> 'und'").count() == 0
    assert language.predict(empty.select("doc_id", "text"), model).count() == 0


def test_toxicity(spark, empty):
    rng = np.random.default_rng(5)
    clean, vile = [f"w{i}q" for i in range(200)], ["vileword", "badword", "nastyword"]
    rows, labels = [], []
    for i in range(600):
        words = rng.choice(clean, 40).tolist()
        bad = i % 6 == 0
        if bad:
            words[3:3] = rng.choice(vile, 1 + i % 18 // 6 * 4).tolist()
        rows.append((i, " ".join(words)))
        if i < 450:
            labels.append((i, 1, int(bad)))
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (902, "123 !"), (None, "vileword badword nastyword")], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int"))
    assert model.thresholds == sorted(model.thresholds)
    got = {r.doc_id: r for r in toxicity.predict(docs, model).collect()}
    held = range(450, 600)
    assert all(got[i].toxic == (i % 6 == 0) for i in held)
    assert np.mean([got[i].severity for i in held if i % 18 == 12]) > np.mean([got[i].severity for i in held if i % 18 == 0])
    assert not any(got[i].toxic for i in (900, 901, 902)) and got[None].toxic
    assert toxicity.predict(empty.select("doc_id", "text"), toxicity.fit(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int"))).count() == 0


def test_loss_and_gradient_by_brute_force():
    """The loss from its definition, and the gradient against differences of it."""
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(40, 5)), rng.integers(0, toxicity.GRADES + 1, 40)
    w, gaps = rng.normal(size=5), np.array([-0.4, 0.2, -0.7])

    def plain(w, gaps):
        edges = [gaps[0], gaps[0] + np.exp(gaps[1]), gaps[0] + np.exp(gaps[1]) + np.exp(gaps[2])]
        total = 0.0
        for row, grade in zip(x, y, strict=True):
            at_least = [1.0, *(1 / (1 + np.exp(t - sum(a * b for a, b in zip(row, w, strict=True)))) for t in edges), 0.0]
            total -= np.log(at_least[grade] - at_least[grade + 1])
        return total / len(y)

    loss, g_w, g_gap = toxicity._loss(x, y, w, gaps)
    assert loss == pytest.approx(plain(w, gaps))
    step = 1e-6
    for i in range(5):
        e = np.eye(5)[i] * step
        assert g_w[i] == pytest.approx((plain(w + e, gaps) - plain(w - e, gaps)) / (2 * step), abs=1e-6)
    for i in range(3):
        e = np.eye(3)[i] * step
        assert g_gap[i] == pytest.approx((plain(w, gaps + e) - plain(w, gaps - e)) / (2 * step), abs=1e-6)
    found, thresholds = toxicity._descend(x, y)
    assert np.all(np.diff(thresholds) > 0)
    gaps = np.concatenate((thresholds[:1], np.log(np.diff(thresholds))))
    least = plain(found, gaps) + toxicity.LASSO * np.abs(found).sum()
    for _ in range(30):  # no point near it is better
        assert least <= plain(found + rng.normal(size=5) * 0.02, gaps + rng.normal(size=3) * 0.02) + 1e-3


def test_names_that_clash(spark):
    docs = spark.createDataFrame([(1, "a", 0.5, 1)], "doc_id long, text string, score double, grade int")
    made = language.predict(docs, language.Model([], {}))
    assert made.columns == [*docs.columns, "lang_pred", "_score"] and (made.first().score, made.first()["_score"]) == (0.5, 0.0)
    made = toxicity.predict(docs, toxicity.Model({}, [1.0] * 3))
    assert made.columns == [*docs.columns, "severity", "_grade", "toxic"] and made.first().grade == 1


def test_pipeline(spark, tmp_path):
    import hashlib

    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "simhash near-dedup", "suffix-array dedup", "benchmark decontamination", "bpe encoding"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    given, counts = docs, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, given, sf).write.parquet(str(tmp_path / str(i)))
        given = spark.read.parquet(str(tmp_path / str(i)))
        counts.append(given.count())
        if i < 4:
            assert given.columns == docs.columns
    assert counts == sorted(counts, reverse=True) and counts[1] < counts[0] and counts[-1] == counts[-2]
    last = {r.doc_id: r for r in given.collect()}
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in spark.read.parquet(str(tmp_path / "3")).collect():
        assert last[r.doc_id].n_tokens == len(library.encode(r.text, add_special_tokens=False).ids)
        assert last[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
