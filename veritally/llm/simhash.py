"""Near duplicates by SimHash, found through deletion-variant signatures.

Fingerprints that differ in at most four bits, cut into three segments, have a segment in which they differ in at
most one bit. Each distinct fingerprint is indexed under one key for every bit of every segment: the segment with
that bit deleted. Fingerprints with a common key are candidates and are verified on all 64 bits. A pair that is
equal in the segment shares all its keys and is verified under the first only.

Copies collapse to one fingerprint before anything is joined. Inside a key's bucket a breadth-first search over the
verified links returns only links that connect, at most one for each member, never all pairs; links between
different texts are lost to no cap. A bucket over ``BUCKET`` members is dealt out as pairs of blocks of bounded
size, which separate tasks compare.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blank_words, cut_lineage, join_values, map_arrow, map_texts

SEED = 42
BITS = 64
#: Members of a bucket that one task compares.
BUCKET = 16_384
#: Shingles whose bits are counted at once.
COUNTED = 1 << 15


def fingerprint(text: str | None, shingle_words: int = 4) -> int:
    """Bit k is 1 if set in over half the XXH64 of the text's word shingles, repeats included; 0 without words."""
    words = blank_words(text)
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words) - shingle_words + 1
    if n <= 1:
        return xxhash.xxh64_intdigest(joined, SEED)
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=starts[1:])
    a, b = starts[:n].tolist(), (starts[shingle_words:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[i:j], SEED) for i, j in zip(a, b, strict=True)], "<u8")
    ones = np.zeros(BITS, np.int64)
    for i in range(0, n, COUNTED):
        part = hashes[i : i + COUNTED]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, shingle_words: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): the fingerprint of every whole text as a signed long."""

    def work(keys: list, texts: list[str | None]) -> dict[str, list]:
        values = np.array([fingerprint(t, shingle_words) for t in texts], np.uint64)
        return {key: keys, "fp": values.view(np.int64)}

    return map_texts(df, work, f"`{key}` {df.schema[key].dataType.simpleString()}, fp long", key, text)


def segments(max_bits: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each segment: so few that one of them has at most one of the differing bits."""
    n = max_bits // 2 + 1
    edges = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _masks(max_bits: int) -> tuple[list[int], list[int]]:
    """By bit: the bits of its segment, and the segment's first bit."""
    masks, firsts = [], []
    for first, bits in segments(max_bits):
        masks += [((1 << bits) - 1) << first] * bits
        firsts += [first] * bits
    return masks, firsts


def connecting_links(values: np.ndarray, max_bits: int, bit: int, first: bool, mask: int, split: int | None = None) -> list[tuple[int, int]]:
    """Links that connect what the links of one bucket connect: a spanning forest found breadth first.

    In the bucket of a segment's first bit every pair counts. In another, only pairs that differ in the deleted bit:
    the others are equal in the segment and meet under the first. ``split``: only pairs across this position.
    """
    n = len(values)
    side = np.zeros(n, bool) if split is None else np.arange(n) >= split
    deleted = (values >> np.uint64(bit)) & np.uint64(1)
    rest = np.arange(n)
    found: list[tuple[int, int]] = []
    while len(rest) > 1:
        frontier, rest = rest[:1], rest[1:]
        while len(frontier) and len(rest):
            now, frontier = frontier[:256], frontier[256:]
            near = np.bitwise_count(values[now][:, None] ^ values[rest][None, :]) <= max_bits
            if not first:
                near &= deleted[now][:, None] != deleted[rest][None, :]
            if split is not None:
                near &= side[now][:, None] != side[rest][None, :]
            met = near.any(axis=0)
            if met.any():
                by = now[near[:, met].argmax(axis=0)]
                new = rest[met]
                found += zip(values[by].tolist(), values[new].tolist(), strict=True)
                frontier = np.concatenate([frontier, new])
                rest = rest[~met]
    return found


def _bucket_links(max_bits: int, bucket: int):
    """Over rows (bit, part, fp) sorted by bucket: links, or for a large bucket its members with block numbers."""
    masks, firsts = _masks(max_bits)
    mask_of, first_of = np.array(masks, np.uint64), np.array(firsts, np.int64)

    def small(bits: np.ndarray, starts: np.ndarray, sizes: np.ndarray, values: np.ndarray) -> tuple[list, list]:
        """All pairs of buckets of up to 8 members, by their distance in the order."""
        left, right = [], []
        group = np.repeat(np.arange(len(sizes)), sizes)
        offset = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        size = sizes[group]
        for d in range(1, int(sizes.max(initial=0))):
            i = np.flatnonzero(offset + d < size)
            x, y, bit = values[i], values[i + d], bits[group[i]]
            apart = ((x ^ y) & mask_of[bit]) != 0
            ok = (np.bitwise_count(x ^ y) <= max_bits) & (apart | (first_of[bit] == bit))
            left.append(x[ok])
            right.append(y[ok])
        return left, right

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(a: np.ndarray, b: np.ndarray, bit: int | None = None, part: int | None = None, block: np.ndarray | None = None) -> pa.RecordBatch:
            n = len(a)
            return pa.RecordBatch.from_arrays(
                [pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array([bit] * n, pa.int32()), pa.array([part] * n, pa.int64()), pa.array([None] * n if block is None else block, pa.int32())],
                names=["a", "b", "bit", "part", "block"],
            )

        held_bit, held_part, held = None, None, np.empty(0, np.uint64)
        streamed = 0  # members of the open bucket that were given out as a large one's

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal held, streamed
            if len(held) and (streamed or len(held) > bucket):
                yield out(held, held, held_bit, held_part, (streamed + np.arange(len(held))) // bucket)
            elif len(held) > 1:
                links = connecting_links(held, max_bits, held_bit, firsts[held_bit] == held_bit, masks[held_bit])
                if links:
                    pairs = np.array(links, np.uint64)
                    yield out(pairs[:, 0], pairs[:, 1])
            held, streamed = np.empty(0, np.uint64), 0

        for batch in batches:
            bits, parts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            values = batch.column(2).to_numpy().view(np.uint64)
            if not len(values):
                continue
            starts = np.concatenate([[0], np.flatnonzero((bits[1:] != bits[:-1]) | (parts[1:] != parts[:-1])) + 1])
            sizes = np.diff(np.concatenate([starts, [len(values)]]))
            if held_bit is not None and (bits[0], parts[0]) == (held_bit, held_part):
                held = np.concatenate([held, values[: sizes[0]]])
                if len(held) > bucket:
                    yield out(held, held, held_bit, held_part, (streamed + np.arange(len(held))) // bucket)
                    streamed += len(held)
                    held = np.empty(0, np.uint64)
                if len(sizes) == 1:
                    continue
                starts, sizes = starts[1:], sizes[1:]
            yield from close()
            few = sizes[:-1] <= 8
            keep = np.concatenate([few, [False]])
            rows = np.repeat(keep, sizes)
            left, right = small(bits[starts[keep]], starts[keep], sizes[keep], values[starts[0] :][rows])
            if left:
                yield out(np.concatenate(left), np.concatenate(right))
            for i in np.flatnonzero(~few):
                held_bit, held_part, held = int(bits[starts[i]]), int(parts[starts[i]]), values[starts[i] : starts[i] + sizes[i]]
                yield from close()
            held_bit, held_part, held = int(bits[starts[-1]]), int(parts[starts[-1]]), values[starts[-1] :].copy()
        if held_bit is not None:
            yield from close()

    return run


def _block_links(max_bits: int):
    """Over rows (bit, part, lower, upper, block, fp) sorted by all but fp: links inside a block or across two."""
    masks, firsts = _masks(max_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, members = None, []

        def close() -> Iterator[pa.RecordBatch]:
            if unit is None:
                return
            bit, _, lower, upper = unit
            values = np.array([fp for _, fp in members], np.int64).view(np.uint64)
            split = None if lower == upper else sum(block == lower for block, _ in members)
            links = np.array(connecting_links(values, max_bits, bit, firsts[bit] == bit, masks[bit], split), np.uint64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(links[:, i].copy().view(np.int64)) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            for bit, part, lower, upper, block, fp in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if unit != (bit, part, lower, upper):
                    yield from close()
                    unit, members = (bit, part, lower, upper), []
                members.append((block, fp))
        yield from close()

    return run


def links(distinct: DataFrame, max_bits: int = 4, bucket: int = BUCKET) -> DataFrame:
    """(a, b) over distinct fingerprints ``fp``: links of at most ``max_bits`` bits that connect all that such links connect."""
    masks, _ = _masks(max_bits)
    deleted = F.array(*[F.lit(_signed(m & ~(1 << bit))) for bit, m in enumerate(masks)])
    spread = distinct.repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # few bytes here, many rows next
    variants = spread.select("fp", F.explode(F.sequence(F.lit(0), F.lit(BITS - 1))).alias("bit")).select("bit", F.col("fp").bitwiseAND(F.get(deleted, F.col("bit"))).alias("part"), "fp")
    found = cut_lineage(map_arrow(variants.repartition("bit", "part").sortWithinPartitions("bit", "part"), _bucket_links(max_bits, bucket), "a long, b long, bit int, part long, block int"))
    plain = found.where("block is null").select("a", "b")
    large = found.where("block is not null").select("bit", "part", "block", F.col("a").alias("fp"))
    last = large.groupBy("bit", "part").agg(F.max("block").alias("last"))
    units = large.join(last, ["bit", "part"]).select("bit", "part", "block", "fp", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("other"))
    units = units.select("bit", "part", F.least("block", "other").alias("lower"), F.greatest("block", "other").alias("upper"), "block", "fp")
    sorted_units = units.repartition("bit", "part", "lower", "upper").sortWithinPartitions("bit", "part", "lower", "upper", "block")
    across = map_arrow(sorted_units, _block_links(max_bits), "a long, b long")
    return plain.unionByName(across).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the edges (a, b) reaches.

    Alternating large-star and small-star steps, each written to the checkpoint folder; rounds grow as the logarithm
    of the longest path. A step deals rows by node and gathers no component.
    """
    both = edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).where("u <> v").distinct()
    current, before = cut_lineage(both), None
    while True:
        doubled = current.select("u", "v").unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = doubled.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = doubled.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # each node's smaller neighbours and itself point to the smallest of them
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u")
        current = cut_lineage(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(smallest.select("u", F.col("m").alias("v"))).distinct())
        state = current.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.hash("v").cast("long"))).first()
        if state == before:
            break
        before = state
    roots = current.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def near_duplicates(df: DataFrame, max_bits: int = 4, shingle_words: int = 4, similarity: float | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, component_id): component_id is the smallest key that links of at most ``max_bits`` bits reach.

    With a ``similarity`` links are instead those of shingle sets at least so alike, exactly (``shingles``), and the result is
    (key, component_id). A bit bound that holds such pairs would leave keys so short that buckets grow with the input.

    Null, empty and blank texts have fingerprint 0 and are linked like any other; ties and repeated rows keep a row
    each; a null key is kept and counts as no smallest key. An empty table gives an empty result.
    """
    if similarity is not None:
        from .shingles import near_copies

        return near_copies(df, similarity, shingle_words, key, text)
    own = cut_lineage(fingerprints(df, shingle_words, key, text))
    distinct = cut_lineage(own.groupBy("fp").agg(F.min(key).alias("least"), F.count("*").alias("n")))
    roots = components(links(distinct.select("fp"), max_bits))
    linked = distinct.join(roots, distinct.fp == roots.node).select("fp", "root", "least")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = distinct.join(linked.select("fp", "root"), "fp", "left").join(least, "root", "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id"))
    return join_values(own, cut_lineage(by_fp), "fp").select(key, "fp", "component_id")
