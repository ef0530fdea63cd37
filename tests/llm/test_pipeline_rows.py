"""The pipeline over odd rows, stage by stage against brute force, and over no rows."""

import hashlib

import numpy as np
import pytest
from test_small_operators import brute_base, brute_components, brute_contamination, brute_fingerprint

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

SF = "/root/testdata/sf0.001"


def stages(spark, docs, home):
    """The output of each stage, written and read again."""
    import corpus_pipeline

    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{home}/{i}")
        docs = spark.read.parquet(f"{home}/{i}")
        yield docs


def test_odd_rows(spark, docs, tmp_path):
    given = docs.withColumnRenamed("fp", "_near_id").withColumnRenamed("kept", "_cut_spans")  # names that stages use themselves
    rules, near, cut, clean, coded = stages(spark, given, tmp_path)
    for made in (rules, near, cut, clean):
        assert made.columns == given.columns
    rows = given.collect()
    passed = [r for r in rows if brute_base(r.text)[0] >= 20 and 100 * brute_base(r.text)[4] <= 30 * brute_base(r.text)[0]]
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "")
    assert sorted(map(key, rules.collect())) == sorted(map(key, passed))
    named = [r for r in passed if r.doc_id is not None]
    groups = brute_components({r.doc_id: brute_fingerprint(r.text) for r in named})
    kept = {r.doc_id for r in near.collect()} - {None}
    assert kept == set(groups.values())
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert len(texts) == near.count() and all(t is None or len(t) <= len(next(r.text for r in passed if r.doc_id == i)) for i, t in texts.items())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = dict(zip(texts, brute_contamination(texts.values(), items), strict=True))
    assert {r.doc_id for r in clean.collect()} == {i for i, w in hit.items() if not w[1]}
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in coded.collect():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())


def test_no_rows(spark, empty, tmp_path):
    counts = [made.count() for made in stages(spark, empty, tmp_path)]
    assert counts == [0] * 5
