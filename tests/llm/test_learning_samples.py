"""What comes to the driver to learn from, where ids repeat."""

from __future__ import annotations

from perindex.llm import language_id, quality_rules

FOLDER = "/root/testdata/sf0.001"


def test_repeated_documents_give_the_same_rules(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    stats = quality_rules.statistics(docs)
    rules = quality_rules.learn_from(stats, labels)
    many = stats
    for _ in range(3):
        many = many.unionByName(stats)
    assert quality_rules.learn_from(many.repartition(7), labels) == rules
    # A sample far smaller than the repeated rows is still the sample of the documents.
    few = quality_rules.learn_from(stats, labels, sample=20)
    assert quality_rules.learn_from(many.repartition(5), labels, sample=20) == few


def test_languages_are_learned_without_ids_and_from_copies(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang")
    copies = docs.limit(1).crossJoin(spark.range(500)).select("doc_id", "text", "lang")
    for table in (docs.selectExpr("cast(null as long) as doc_id", "text", "lang"), docs.unionByName(copies)):
        model = language_id.fit(table)
        found = language_id.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter("lang_pred <> 'und'").collect()
        assert sum(r["lang_pred"] == r["lang"] for r in found) >= 0.95 * len(found)
