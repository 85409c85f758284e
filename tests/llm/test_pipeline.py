from __future__ import annotations

import corpus_pipeline


def test_stages_keep_the_columns_and_take_effect(spark, prose, tmp_path):
    rows = [(i, prose(120, i), "en", f"s{i % 3}") for i in range(60)]
    rows += [(100, rows[0][1], "en", "s0"), (101, f"{prose(60, 900)} {prose(40, 901)}", "en", "s1"), (102, f"{prose(100, 902)} 97.51.17.173", "en", "s2"), (103, "", "en", None), (104, None, None, "s0")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, prose(40, 901))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    ids = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(str(tmp_path / f"out{i}"))
        docs = spark.read.parquet(str(tmp_path / f"out{i}"))
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert ids[0] == {*range(60), 100, 101, 102} and ids[1] == ids[0] - {100} and ids[2] == ids[1] - {101} and ids[3] == ids[2]
    text = spark.read.parquet(str(tmp_path / "out3")).filter("doc_id = 102").first()
    assert "97.51.17.173" not in text.text and text.n_chars == len(text.text)
    assert ids[4] <= ids[3] and docs.filter("copies < 1").count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(ids[4])


def test_mixing_of_null_and_repeated_ids(spark, prose):
    rows = [(i, prose(50, n), "en", "s0", 9) for n, i in enumerate([None, None, None, 7, 7, 8])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    texts = [r.text for r in corpus_pipeline._mixing(spark, docs, "").collect()]
    assert len(texts) == len(set(texts)) > 0


def test_empty_corpus(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_mixing_keeps_columns_of_any_type(spark, documents, tmp_path):
    from pyspark.sql import functions as F

    docs = documents([(i, f"some words of text {i}") for i in range(30)]).withColumn("tags", F.create_map(F.lit("a"), F.col("doc_id"))).withColumn("deep", F.array(F.struct(F.create_map(F.lit(1), F.lit("x")).alias("m"))))
    got = corpus_pipeline._mixing(spark, docs, str(tmp_path)).collect()
    assert got and all(r.tags == {"a": r.doc_id} and r.deep[0].m == {1: "x"} for r in got)
