"""Near copies by the similarity of shingle sets: candidates by MinHash bands, each pair verified on its whole sets.

Equal texts collapse to one node. Nodes with an equal band are candidates; stars to the least node of each band give
clusters, and no pair is listed. Each text of a cluster goes once, or once for each pair of blocks of a large cluster,
to a task that computes exact Jaccard similarities and returns only links that connect. Bands miss a pair at the
threshold itself with a chance of ``(1 - 0.8 ** ROWS) ** BANDS``, 7 in 100,000, and more similar ones less often.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blank_words, cut_lineage, join_values, map_arrow, map_texts
from .simhash import SEED, components

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
#: Members of a cluster that one task compares with as many others.
BLOCK = 256
#: Shingles that are permuted at once.
PERMUTED = 1 << 12

_RANDOM = np.random.default_rng(SEED)
_FACTORS = _RANDOM.integers(0, 1 << 31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1)
_TERMS = _RANDOM.integers(0, 1 << 32, BANDS * ROWS, np.uint32)


def shingles(text: str | None, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """XXH64 of the text's distinct word shingles, sorted; of all words where they are fewer; none without words."""
    words = blank_words(text)
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    n = len(words) - shingle_words + 1
    digest = xxhash.xxh64_intdigest
    if n <= 1:
        return np.array([digest(joined, SEED)], np.uint64)
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=starts[1:])
    a, b = starts[:n].tolist(), (starts[shingle_words:] - 1).tolist()
    return np.unique(np.array([digest(joined[i:j], SEED) for i, j in zip(a, b, strict=True)], np.uint64))


def bands(own: np.ndarray) -> list[int]:
    """A signed hash for each band: of its number and the least values of the shingles under its permutations."""
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    low = ((own ^ (own >> np.uint64(32))) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    for i in range(0, len(low), PERMUTED):
        for k in range(BANDS * ROWS):
            least[k] = min(least[k], (low[i : i + PERMUTED] * _FACTORS[k] + _TERMS[k]).min())
    raw = least.tobytes()
    step = 4 * ROWS
    found = np.array([xxhash.xxh64_intdigest(raw[i * step : (i + 1) * step], i) for i in range(BANDS)], np.uint64)
    return found.view(np.int64).tolist()


def similar_links(sets: list[np.ndarray], similarity: float, split: int | None = None) -> list[tuple[int, int]]:
    """Places of pairs at least so similar that connect all that such pairs connect; ``split``: only pairs across it."""
    sizes = np.array(list(map(len, sets)), np.int64)
    names, numbers = np.unique(np.concatenate([*sets, np.empty(0, np.uint64)]), return_inverse=True)
    ends = np.cumsum(sizes)
    parts = [numbers[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
    marked = np.zeros(len(names), np.int64)
    side = np.zeros(len(sets), bool) if split is None else np.arange(len(sets)) >= split
    rest = np.arange(len(sets))
    found: list[tuple[int, int]] = []
    while len(rest) > 1:
        frontier, rest = [int(rest[0])], rest[1:]
        while frontier and len(rest):
            x = frontier.pop(0)
            others = rest
            if split is not None:
                others = rest[side[rest] != side[x]]
            least, most = np.minimum(sizes[others], sizes[x]), np.maximum(sizes[others], sizes[x])
            others = others[least >= similarity * most]
            if not len(others):
                continue
            marked[parts[x]] = 1
            shared = np.array([int(marked[parts[y]].sum()) for y in others.tolist()], np.int64)
            marked[parts[x]] = 0
            new = others[shared >= similarity * (sizes[others] + sizes[x] - shared)]
            found += [(x, y) for y in new.tolist()]
            frontier += new.tolist()
            rest = np.setdiff1d(rest, new, assume_unique=True)
    return found


def _verified(similarity: float, shingle_words: int):
    """Over rows (root, lower, upper, block, node, text) sorted by all but the last two: links inside a block or across two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, nodes, blocks, sets = None, [], [], []

        def close() -> Iterator[pa.RecordBatch]:
            if len(nodes) > 1:
                split = None if unit[1] == unit[2] else blocks.count(unit[1])
                found = similar_links(sets, similarity, split)
                yield pa.RecordBatch.from_arrays([pa.array([nodes[p[i]] for p in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            heads = zip(*(c.to_pylist() for c in batch.columns[:5]), strict=True)
            for (root, lower, upper, block, node), text in zip(heads, batch.column(5), strict=True):
                if unit != (root, lower, upper):
                    yield from close()
                    unit, nodes, blocks, sets = (root, lower, upper), [], [], []
                nodes.append(node)
                blocks.append(block)
                sets.append(shingles(text.as_py(), shingle_words))
        yield from close()

    return run


def near_copies(df: DataFrame, similarity: float = SIMILARITY, shingle_words: int = SHINGLE_WORDS, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(key, component_id): component_id is the smallest key that links of at least that Jaccard similarity reach.

    Texts without words are copies of each other. Ties and repeated rows keep a row each; a null key is kept and counts
    as no smallest key. An empty table gives an empty result.
    """
    nodes = cut_lineage(df.select(F.col(key), F.xxhash64(text).alias("node")))
    texts = df.select(F.xxhash64(text).alias("node"), F.col(text).alias("text"))

    def work(names: list, values: list[str | None]) -> dict[str, list]:
        return {"node": names, "bands": [bands(shingles(t, shingle_words)) for t in values]}

    signed = map_texts(texts, work, "node long, bands array<long>", "node")
    keyed = cut_lineage(signed.dropDuplicates(["node"])).select("node", F.explode("bands").alias("band"))
    least = keyed.groupBy("band").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").select("band", "hub")
    stars = keyed.join(least, "band").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    clusters = components(stars)
    sizes = clusters.groupBy("root").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    placed = clusters.join(sizes, "root").select("node", "root", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    members = texts.dropDuplicates(["node"]).join(placed, "node")
    units = members.select("root", "block", "node", "text", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    units = units.select("root", F.least("block", "other").alias("lower"), F.greatest("block", "other").alias("upper"), "block", "node", "text")
    dealt = units.repartition("root", "lower", "upper").sortWithinPartitions("root", "lower", "upper", "block")
    roots = components(map_arrow(dealt, _verified(similarity, shingle_words), "a long, b long"))
    first = nodes.groupBy("node").agg(F.min(key).alias("least"), F.count("*").alias("n"))
    linked = roots.join(first, "node").select("node", "root", "least")
    by_root = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    by_node = linked.join(by_root, "root").select("node", "component_id")
    both = first.join(by_node, "node", "left").select("node", "n", F.coalesce("component_id", "least").alias("component_id"))
    return join_values(nodes, cut_lineage(both), "node").select(key, "component_id")
