from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from veritally.llm import decontam, simhash


def test_stages_keep_columns_and_clean_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    extra = docs.unionByName(spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "1234 5678", "en", "s", 9), (None, "a text without an id stays", "en", "s", 9)], docs.schema))
    kept = extra
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept
        kept = stage(spark, before, small).cache()
        assert kept.columns == docs.columns, name
        assert kept.exceptAll(before).count() == 0, name
        if name == "language":
            assert before.count() - kept.count() == 2
    assert kept.where("doc_id is null").count() == 1
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and 0.5 * docs.count() < len(ids) < docs.count()
    found = simhash.near_duplicates(kept)
    assert found.where(F.col("doc_id") != F.col("component_id")).count() == 0
    assert decontam.contamination(kept, spark.read.parquet(f"{small}/benchmark.parquet")).where("size(spans) > 0").count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, kept, small)
    assert last.count() == len(ids)


def test_run_gives_a_row_for_each_kept_document(spark, small):
    assert corpus_pipeline.run(spark, small).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
