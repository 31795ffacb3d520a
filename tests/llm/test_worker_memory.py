"""A worker outlives an operator, but keeps nothing of it once it works for another."""

from __future__ import annotations

import gc
import time

import pyarrow as pa
from pyspark.sql import functions as F
from veritally.llm import bpe, decontam, toxicity
from veritally.llm.common import map_arrow
from veritally.llm.queries import tokenizer_path


def test_workers_drop_what_other_operators_kept(spark, small):
    def held(batches):
        for _ in batches:
            pass
        time.sleep(0.5)  # so that every idle worker gets a task
        encoders = sum(type(x).__name__ == "ChunkEncoder" for x in gc.get_objects())
        yield pa.RecordBatch.from_pydict({"n": pa.array([encoders + len(decontam._powers)], pa.int64())})

    docs = spark.read.parquet(f"{small}/documents.parquet").repartition(4)
    assert bpe.encode_digests(docs, tokenizer_path()).count() == docs.count()
    decontam.clean(docs, spark.read.parquet(f"{small}/benchmark.parquet")).write.format("noop").mode("overwrite").save()
    bpe.encode_digests(docs, tokenizer_path()).write.format("noop").mode("overwrite").save()
    probe = map_arrow(spark.range(4).repartition(4), held, "n long")
    probe.collect()
    assert probe.agg(F.sum("n")).first()[0] == 0


def test_hits_come_from_lists_as_they_are():
    rows = pa.table({"at": pa.array([[1, 3], [], [0]], pa.list_(pa.int32())), "hits": pa.array([[5, 2], [], [7]], pa.list_(pa.int32()))})
    assert toxicity.hits_of(rows, 4).tolist() == [[0, 5, 0, 2], [0, 0, 0, 0], [7, 0, 0, 0]]
    assert toxicity.hits_of(rows.slice(1), 4).tolist() == [[0, 0, 0, 0], [7, 0, 0, 0]]
