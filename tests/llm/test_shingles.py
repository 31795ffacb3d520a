from __future__ import annotations

import corpus_pipeline
import pytest

from veritally.llm import shingles, simhash


def alike(a, b) -> float:
    x, y = set(shingles.shingles(a).tolist()), set(shingles.shingles(b).tolist())
    return len(x & y) / len(x | y) if x | y else 1.0


def test_the_stage_removes_copies_beyond_four_bits(spark, small):
    words = [f"word{i * i % 997}x{i}" for i in range(120)]
    text = " ".join(words)
    near = " ".join([*words[:30], "other", *words[31:90], "another", *words[91:]])
    far = " ".join(words[:60])
    assert alike(text, near) >= 0.8 > alike(text, far)
    assert (simhash.fingerprint(text) ^ simhash.fingerprint(near)).bit_count() > 4
    docs = spark.createDataFrame([(1, text), (2, near), (3, far), (4, text.upper()), (None, text)], "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, small).collect()} == {1, 3, None}
    assert shingles.near_copies(docs.where("doc_id > 99")).count() == 0


@pytest.mark.parametrize("block", [3, 256])
def test_components_are_those_of_all_pairs(spark, small, block):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    extra = [(10**6 + i, " ".join(f"w{k if k != 7 * i else -i}" for k in range(150))) for i in range(12)] + [(10**6 + 50, None), (10**6 + 51, " "), (10**6 + 52, "One two"), (10**6 + 53, "one  two")]
    both = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    sets = {r.doc_id: set(shingles.shingles(r.text).tolist()) for r in both.collect()}
    root = {i: i for i in sets}
    for i in sorted(sets):
        for j in sets:
            a, b = sets[i], sets[j]
            if i < j and len(a & b) >= 0.8 * len(a | b) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = {k: low if v == high else v for k, v in root.items()}
    got = {r.doc_id: r.component_id for r in shingles.near_copies(both, block=block).collect()}
    assert got == root and len(set(root.values())) < len(root)
