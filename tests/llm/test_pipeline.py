from __future__ import annotations

import corpus_pipeline
from perindex.llm import quality_rules
from perindex.session import materialize

FOLDER = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_narrow_down(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before = {r["doc_id"]: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = materialize(stage(spark, docs, FOLDER), name)
        assert after.dtypes == docs.dtypes
        ids = [r["doc_id"] for r in after.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= set(before)
        docs = after
    packed = corpus_pipeline.pack(spark, docs, FOLDER).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in docs.collect()}


def test_an_unlabelled_corpus_stays(spark):
    texts = {1: "clean words", 2: "12 !", 3: None, 4: "日本", 5: ""}
    docs = spark.createDataFrame(
        [(i, t, None, "s", 0) for i, t in texts.items()],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    kept = corpus_pipeline.language(spark, docs, FOLDER)
    assert kept.dtypes == docs.dtypes and sorted(r["doc_id"] for r in kept.collect()) == [1, 4]


def test_odd_rows_pass_through(spark):
    docs = spark.createDataFrame(
        [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "word " * 3, "en", "s", 15)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).collect()
        assert stage(spark, docs.limit(0), FOLDER).count() == 0
    kept = corpus_pipeline.near_duplicates(spark, docs, FOLDER).collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 2]
    assert quality_rules.kept_documents(docs, docs.selectExpr("doc_id", "1 as quality").limit(0)).count() == 0
