"""The pipeline on the smallest tables, held against what its stages must keep."""

import corpus_pipeline
from panelwright.llm import decontaminate, jaccard_join

SF = "/root/testdata/sf0.001"


def test_stages_chain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, SF).persist()
        seen.append(docs.count())
        if name != "mix":
            assert docs.columns == columns
        if name == "jaccard_join":
            kept = jaccard_join.jaccard_components(docs)
            assert kept.filter("component_id <> doc_id").count() == 0
            groups = jaccard_join.jaccard_components(before).select("component_id").distinct().count()
            assert docs.count() == groups
        if name == "decontaminate":
            assert decontaminate.contaminated(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    assert seen == sorted(seen, reverse=True) and seen[0] >= 0.98 * 200
    assert corpus_pipeline.run(spark, SF).count() == seen[-1]
