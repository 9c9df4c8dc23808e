import collections

import corpus_pipeline


def test_stages_and_end(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    numbers = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, d), "t")
        assert docs.columns == spark.read.parquet(f"{d}/documents.parquet").columns
        numbers.append(docs.count())
    assert numbers == sorted(numbers, reverse=True) and numbers[-1] > 0.5 * numbers[0]
    got = corpus_pipeline.packed(spark, docs, d).collect()
    assert {r["doc_id"] for r in got} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    per = collections.Counter()
    for r in got:
        per[r["sequence_id"]] += r["length"]
    assert max(per.values()) <= 4096


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty and very long texts, ties, repeated rows, an empty table and columns with clashing names through every stage."""
    base = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{base}/documents.parquet")
    rows = [r.asDict() for r in docs.limit(40).collect()]
    item = spark.read.parquet(f"{base}/benchmark.parquet").first()["text"]
    long = " ".join(r["text"] for r in rows[:10]) * 20
    odd = [(None, rows[0]["text"], None), (None, None, "en"), (7, "", "en"), (7, " \n\t ", "xx"), (10**9, long, "en"), (10**9, long, "en"), (10**9 + 1, "w" * 200_000, "en"), (10**9 + 2, item, "en"), (None, item, "en")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, kept int, __0 int, __text int, h int, predicted int"
    made = [(i, t, x, "s", len(t or ""), "a", 1, 2, 3, 4, 5) for i, t, x in odd] + [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], "a", 1, 2, 3, 4, 5) for r in rows]
    table = spark.createDataFrame(made, schema)
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{base}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.materialise(stage(spark, table, str(tmp_path)), "odd")
        assert kept.columns == table.columns and kept.count() <= table.count()
        assert stage(spark, table.filter("doc_id < 0"), str(tmp_path)).count() == 0
    clean = {r["doc_id"] for r in corpus_pipeline.distinct(spark, table, str(tmp_path)).select("doc_id").collect()}
    assert {7, 10**9} <= clean
    left = corpus_pipeline.decontaminated(spark, table, str(tmp_path)).collect()
    assert item not in {r["text"] for r in left} and any(r["doc_id"] == 10**9 + 1 for r in left)
    packed = corpus_pipeline.packed(spark, table, str(tmp_path))
    assert packed.select("doc_id", "piece", "ids_crc32").distinct().count() > table.count() // 2 and corpus_pipeline.packed(spark, table.filter("doc_id < 0"), str(tmp_path)).count() == 0


def test_texts_go_to_python_in_bounded_batches(spark, monkeypatch):
    """10,000 texts of 4 KB in a partition were one batch of 40 MB; run() leaves the session as it was."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    from spanforge.llm.batches import BATCH, BATCH_BYTES

    texts = spark.range(0, 10_000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 800).alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.nbytes]})

    spark.conf.unset(BATCH)
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[-1:])
    corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert BATCH not in spark.conf.getAll
    try:
        for stage in (corpus_pipeline.classified, corpus_pipeline.ruled, corpus_pipeline.packed):
            spark.conf.unset(BATCH)
            stage(spark, spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "/root/testdata/sf0.001")
            assert max(r["n"] for r in texts.mapInArrow(sizes, "n long").collect()) < BATCH_BYTES + 10_000
    finally:
        spark.conf.unset(BATCH)


def test_encoders_go_before_other_work():
    """A worker that has packed and then scores texts held the tokenizer as long as it lived."""
    import weakref

    from spanforge.llm.batches import lean
    from spanforge.llm.encode import tokenizer_path, word_encoder

    path = tokenizer_path("word_bpe_49k.json")
    found = weakref.ref(word_encoder(path))
    lean()
    assert found() is None
    found = weakref.ref(word_encoder(path))
    lean(word_encoder)
    assert found() is word_encoder(path)
