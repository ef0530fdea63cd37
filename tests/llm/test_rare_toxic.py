from nodelytics.llm import toxicity


def test_rare_toxic_rows_stay_in_the_fit(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "FIT_ROWS", 200)
    rows = [(i, " ".join(f"w{(i * 7 + j * j) % 60}q" for j in range(30)) + (" vileword badword" if i % 400 == 0 else "")) for i in range(12_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "1 AS quality", "cast(doc_id % 400 = 0 AS int) AS toxic").filter("doc_id < 11000")
    got = toxicity.predict(docs, toxicity.fit(docs, labels)).filter("toxic").collect()
    assert {r.doc_id for r in got} == {i for i in range(12_000) if i % 400 == 0}
