"""Language-model scores by online logistic context mixing, beside an add-one unigram score.

*Base.* The tokens of all training texts are counted once. The most frequent words, a bounded number of them, are
broadcast; all other words of a text meet their counts in a join on the word, where no key is frequent.

*Model.* A token is coded in binary choices of a Huffman code of the frequent words, with an escape for all others.
Predictors give each choice a probability from counts over all training texts: those of the choices alone, which follow
from the words' counts, and two tables that are indexed by a hash of the choices before and a context, the word before or
the two words before. The tables grow with the training bytes up to ``MOST_BITS``; beyond that contexts share slots. The predictors' logits and a bias are mixed by weights, one set for
each gate, how often the two longer contexts were seen, and place in the code. A text begins with weights that are fitted
on every choice of all training texts, counted by gate, place and bins of the predictors' logits. They are improved after each
``BLOCK`` of its tokens by the gradient of their cost, from its first to its last, whatever its length.
Texts are scored in lockstep, a block of each at a time; a text's score doesn't depend on the others.

*Rare words.* What follows an escape is the word's spelling, mixed with its share of all rare training tokens, ``UNIGRAM``
of it. A spelling is coded and mixed alike, byte by byte, from the two bytes before, the four before and the word so far;
its tables are counted over the distinct rare training words, and a word is spelled once for the whole corpus. The shares
come, in the join, from the complete counts. Both grow with the input without a bound.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, cut_lineage, held_out, map_arrow

#: Words that are broadcast with their counts, at most.
FREQUENT = 100_000
#: Slots of the larger tables, as a power of two: about one for each SLOT_BYTES bytes counted, within these bounds.
LEAST_BITS, MOST_BITS, SLOT_BYTES = 14, 22, 8
#: Predictors; and of those with a table, bits fewer than the larger ones have, for words and for spelling.
K = 3
WORD_TABLES, SPELLING_TABLES = (0, 0), (2, 0, 0)
#: Levels of how often the two longer contexts were seen, from which on each set of weights is used; places in a code.
MIDDLE_LEVELS, LONG_LEVELS = (0, 2, 6), (0, 1, 4)
GATES = len(MIDDLE_LEVELS) * len(LONG_LEVELS)
PLACES = 12
#: Logits are kept in steps of 1/STEP.
STEP = 16.0
#: Bins of logits, in steps: what all training choices are counted in before the first weights are fitted, and where each bin lies.
BIN_EDGES = (-88, -62, -44, -30, -20, -12, -6, 0, 6, 12, 20, 30, 44, 62, 88)
BIN_AT = np.array((-104, -75, -53, -37, -25, -16, -9, -3, 3, 9, 16, 25, 37, 53, 75, 104))
CELLS = GATES * PLACES << 13
#: Tokens after which weights are improved, and the rates.
BLOCK = 64
RATE, BIAS_RATE = 0.015, 0.015
#: Texts in lockstep, so that what they learn stays in a core's cache.
LANES = 64
#: Share of a rare word's unigram probability in the mix.
UNIGRAM = 0.3
#: Bounds of a worker: bytes of text read at once; tokens counted and words spelled at once; distinct words counted before they
#: are given out; slots of a segment.
SCORED_CHARS, COUNTED_TOKENS, SPELLED = 3 << 20, 1 << 16, 2_000
#: Tokens whose choices are looked up at once, so that all that is computed of them stays in a core's cache.
CACHED_TOKENS = 1 << 12
#: Places that are added to at once.
ADDED = 1 << 16
#: Bytes of a word up to which its hash is computed together with others'.
CRC_BYTES = 32
COUNTED_WORDS = 300_000
SEGMENT = 1 << 12

#: [logit in steps, as a byte]: its bin.
BINS = np.searchsorted(BIN_EDGES, np.arange(256, dtype=np.uint8).view(np.int8), side="right").astype(np.int32)
_P = np.uint64(0x9E3779B97F4A7C15)
_SALTS = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
#: [16 * level of the middle context + level of the longest]: the gate.
GATE = ((np.searchsorted(MIDDLE_LEVELS, np.arange(16), side="right") - 1)[:, None] * len(LONG_LEVELS) + np.searchsorted(LONG_LEVELS, np.arange(16), side="right") - 1).ravel()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & np.uint32(1), (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


_CRC = _crc_table()


def crc32s(words: pa.Array) -> np.ndarray:
    """``zlib.crc32`` of each word, byte by byte over all words that still have one; of words over ``CRC_BYTES`` singly."""
    out = np.full(len(words), 0xFFFFFFFF, np.uint32)
    if not len(words):
        return out
    _, offsets, data = words.cast(pa.binary()).buffers()
    edges = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    letters = np.frombuffer(data or b"", np.uint8)
    sizes = np.diff(edges)
    clipped = np.minimum(sizes, CRC_BYTES + 1).astype(np.uint8)
    order = np.argsort(clipped, kind="stable")
    begins = np.searchsorted(clipped[order], np.arange(CRC_BYTES + 2), side="right").tolist()
    at, own = edges[:-1][order], out.copy()
    for i in range(CRC_BYTES):
        part = own[begins[i] : begins[CRC_BYTES]]
        if not len(part):
            break
        part[:] = _CRC.take((part ^ letters.take(at[begins[i] : begins[CRC_BYTES]] + i)) & np.uint32(0xFF)) ^ (part >> np.uint32(8))
    out[order] = ~own
    for i in order[begins[CRC_BYTES] :].tolist():
        out[i] = zlib.crc32(letters[edges[i] : edges[i + 1]])
    return out


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of texts after lower-casing A-Z, and how many each has; none of a null.

    Arrow's ASCII functions know these very classes, and a cut at them leaves UTF-8 whole.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, offsets = lists.flatten(), lists.offsets.to_numpy()
    filled = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    ends = np.concatenate([[0], np.cumsum(filled)])
    return words.filter(pa.array(filled)), ends[offsets[1:]] - ends[offsets[:-1]]


def pieces(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches cut into pieces of about so many bytes in their last column; a text is never cut."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): tokens of all texts; the end token is the empty word. Words are summed in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        texts = 0

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])

        for piece in pieces(batches, SCORED_CHARS):
            found = pc.value_counts(words_of(piece.column(0))[0])
            held.append(pa.table({"word": found.field(0), "n": found.field(1)}))
            texts += piece.num_rows
            if sum(t.num_rows for t in held) > 2 * COUNTED_WORDS:
                held = [summed()]
                if held[0].num_rows > COUNTED_WORDS:
                    yield from held[0].combine_chunks().to_batches()
                    held = []
        if held:
            yield from summed().combine_chunks().to_batches()
        if texts:
            yield pa.RecordBatch.from_pydict({"word": pa.array([""], pa.string()), "n": pa.array([texts], pa.int64())})

    return map_arrow(df.select(text), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def code_lengths(weights: list[int]) -> np.ndarray:
    """Lengths of a Huffman code's words; one of a single symbol has length 1."""
    heap = [(w, i, (i,)) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    parents, n = {}, len(heap)
    heap = [(w, i) for w, i, _ in heap]
    nodes = n
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        parents[a[1]] = parents[b[1]] = nodes
        heapq.heappush(heap, (a[0] + b[0], nodes))
        nodes += 1
    depths = np.zeros(nodes, np.int64)
    for i in range(nodes - 2, -1, -1):
        depths[i] = depths[parents[i]] + 1
    return np.maximum(depths[:n], 1)


class Code:
    """The choices of each symbol of a canonical Huffman code, and how often each choice was a one, as logits."""

    def __init__(self, lengths: np.ndarray, counts: np.ndarray):
        self.lengths = lengths
        self.first = np.cumsum(lengths) - lengths
        order = np.lexsort((np.arange(len(lengths)), lengths))
        sizes = lengths[order].tolist()
        codes, code, before = np.zeros(len(lengths), np.uint64), 0, sizes[0]
        for i, size in zip(order.tolist(), sizes, strict=True):
            code <<= size - before
            codes[i], before = code, size
            code += 1
        depth = np.arange(lengths.sum()) - np.repeat(self.first, lengths)
        left = (np.repeat(lengths, lengths) - depth).astype(np.uint64)
        value = np.repeat(codes, lengths)
        names = (np.uint64(1) << depth.astype(np.uint64)) | (value >> left)
        self.nodes = (_mix(names * _P) >> np.uint64(32)).astype(np.uint32)
        self.bits = ((value >> (left - np.uint64(1))) & np.uint64(1)).astype(np.uint8)
        self.places = np.minimum(depth, PLACES - 1).astype(np.uint8)
        _, node = np.unique(names, return_inverse=True)
        times = np.repeat(np.asarray(counts, float), lengths)
        ones = np.bincount(node, times * self.bits)
        self.plain = logits(np.bincount(node, times) - ones, ones).take(node)

    @cached_property
    def packed(self) -> np.ndarray:
        """Node, logit, bit and place of each choice side by side, from the lowest bits on: all are found at one place in memory."""
        both = self.nodes | (self.plain.view(np.uint8).astype(np.uint64) << np.uint64(32))
        return both | (self.bits.astype(np.uint64) << np.uint64(40)) | (self.places.astype(np.uint64) << np.uint64(48))

    def of(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of the symbols each choice belongs to, where each one's choices begin, and where each choice is in this code."""
        lengths = self.lengths.take(symbols)
        begins = np.cumsum(lengths)
        begins -= lengths
        owners = np.repeat(np.arange(len(lengths)), lengths)
        at = (self.first.take(symbols) - begins).take(owners)
        at += np.arange(len(at))
        return owners, begins, at


class Vocabulary:
    """Frequent words with their counts, the end token among them, and their code with the escape; the code of bytes."""

    def __init__(self, frequent: dict[bytes, int], ends: int, tokens: int, types: int):
        self.frequent, self.tokens, self.types, self.ends = frequent, tokens, types, ends
        self.rare = tokens - ends - sum(frequent.values())
        names = [*sorted(frequent), b""]
        self.names = pa.array([w.decode() for w in names[:-1]], pa.string())
        self.counts = np.array([*(frequent[w] for w in names[:-1]), ends], np.int64)
        self.escape = len(names)
        weights = [*(self.counts + 1).tolist(), self.rare + 1]
        letters = (np.bincount(np.frombuffer(b" ".join(names), np.uint8), minlength=256) + 1).tolist()
        self.code, self.letters = Code(code_lengths(weights), weights), Code(code_lengths(letters), letters)


def _bases(contexts: list[np.ndarray]) -> list[np.ndarray]:
    return [(_mix((c + np.uint64(1)) * salt) >> np.uint64(32)).astype(np.uint32) for c, salt in zip(contexts, _SALTS, strict=False)]


class Stream:
    """The tokens of several texts as symbols, and the hash of each table's context at each of them.

    ``rare`` are the places of words without a symbol of their own, ``rare_words`` these words; ``bytes`` the size of each text's
    words with one more for each and for the end.
    """

    narrower, plain = WORD_TABLES, True

    def __init__(self, texts: pa.Array, own: Vocabulary):
        words, counts = words_of(texts)
        self.code, self.sizes = own.code, counts + 1
        self.starts = np.cumsum(self.sizes) - self.sizes
        tokens, text = int(self.sizes.sum()), np.repeat(np.arange(len(counts)), counts)
        found = pc.index_in(words, value_set=own.names)
        unknown = found.is_null()
        at = np.arange(len(words)) + text
        self.symbols = np.full(tokens, own.escape - 1, np.int64)
        self.symbols[at] = pc.fill_null(found, own.escape).to_numpy(zero_copy_only=False)
        self.rare, self.rare_words = at[unknown.to_numpy(zero_copy_only=False)], words.filter(unknown)
        self.bytes = self.sizes + np.bincount(text, pc.binary_length(words).to_numpy(zero_copy_only=False), len(counts)).astype(np.int64)
        hashes = self.symbols.astype(np.uint64)
        hashes[self.rare] = crc32s(self.rare_words).astype(np.uint64) + np.uint64(1 << 32)
        hashes = _mix(hashes * _P + np.uint64(1))
        place = np.arange(tokens) - np.repeat(self.starts, self.sizes)
        one, two = np.zeros(tokens, np.uint64), np.zeros(tokens, np.uint64)
        one[1:], two[2:] = hashes[:-1], hashes[:-2]
        one[place < 1], two[place < 2] = 0, 0
        self.bases = _bases([one, _mix(one * _P + two + np.uint64(3))])


class Spelled:
    """The bytes of several words, each with a blank behind it, as symbols; and the hash of each table's context."""

    narrower, plain = SPELLING_TABLES, False

    def __init__(self, words: list[bytes] | pa.Array, own: Vocabulary):
        self.code = own.letters
        words = words.cast(pa.binary()) if isinstance(words, pa.Array) else pa.array(words, pa.binary())
        ended = pc.binary_join_element_wise(words, pa.scalar(b""), pa.scalar(b" "))
        _, offsets, data = ended.buffers()
        edges = np.frombuffer(offsets, np.int32)[ended.offset : ended.offset + len(ended) + 1].astype(np.int64) if len(ended) else np.zeros(1, np.int64)
        self.symbols = np.frombuffer(data or b"", np.uint8)[edges[0] : edges[-1]]
        self.sizes = sizes = np.diff(edges)
        self.starts = edges[:-1] - edges[0]
        inside = np.arange(len(self.symbols)) - np.repeat(self.starts, sizes)
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(sizes.max(initial=1)), _P)]), dtype=np.uint64)
        wide = self.symbols.astype(np.uint64)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(wide * powers[inside], dtype=np.uint64)])
        back = np.zeros(len(wide), np.uint64)
        shorter = back
        for i in range(1, 5):
            back[i:] |= np.where(inside[i:] >= i, wide[:-i], np.uint64(0)) << np.uint64(8 * (i - 1))
            if i == 2:
                shorter = back.copy()
        self.bases = _bases([shorter, back, sums[:-1] - np.repeat(sums[self.starts], sizes)])


class Tables:
    """Where each table's slots are."""

    def __init__(self, bits: int, narrower: tuple[int, ...]):
        self.bits = [bits - b for b in narrower]
        edges = np.cumsum([0, *(1 << b for b in self.bits)])
        self.firsts, self.slots = [np.uint32(x) for x in edges[:-1]], int(edges[-1])
        self.shifts = [np.uint32(32 - b) for b in self.bits]

    def of(self, k: int, bases: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Slots of table k for contexts and nodes, in place of the contexts."""
        bases += nodes
        bases >>= self.shifts[k]
        bases += self.firsts[k]
        return bases


def table_bits(size: int) -> int:
    """Bits of the larger tables for so many training bytes."""
    return min(MOST_BITS, max(LEAST_BITS, (max(size, 1) // SLOT_BYTES).bit_length()))


def logits(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logits of a one, in steps."""
    return np.clip(np.round(np.log((ones + 0.4) / (zeros + 0.4)) * STEP), -127, 127).astype(np.int8)


def levels_of(seen: np.ndarray) -> np.ndarray:
    """0 to 15: counts below 8 as they are, then powers of two."""
    return np.minimum(15, np.where(seen < 8, seen, 5 + np.floor(np.log2(np.maximum(seen, 1))))).astype(np.uint8)


def seen_of(levels: np.ndarray) -> np.ndarray:
    """The least count of a level."""
    return np.where(levels < 8, levels, 2.0 ** (levels.astype(float) - 5))


def gates_of(middle: np.ndarray, long: np.ndarray) -> np.ndarray:
    return GATE.take(middle * np.uint8(16) + long)


def count_into(counts: np.ndarray, where: Tables, stream: Stream | Spelled) -> None:
    """Add the choices of a stream to [2 * slot + choice], those of many tokens sorted, so that they meet the counts in memory's order."""
    one = np.uint32(1)
    found: list[np.ndarray] = []
    for i in range(0, len(stream.symbols), CACHED_TOKENS):
        owners, _, at = stream.code.of(stream.symbols[i : i + CACHED_TOKENS])
        nodes, told = stream.code.nodes.take(at), stream.code.bits.take(at)
        for k in range(len(stream.bases)):
            slots = where.of(k, stream.bases[k][i : i + CACHED_TOKENS].take(owners), nodes)
            slots <<= one
            slots |= told
            found.append(slots)
        if len(found) * CACHED_TOKENS >= 4 * COUNTED_TOKENS:
            add_sorted(counts, found)
            found = []
    if found:
        add_sorted(counts, found)


def add_sorted(counts: np.ndarray, found: list[np.ndarray]) -> None:
    """Add one at each place found."""
    places = np.concatenate(found)
    places.sort()
    for i in range(0, len(places), ADDED):
        np.add.at(counts, places[i : i + ADDED].astype(np.intp), np.uint32(1))


def packed_counts(counts: np.ndarray) -> bytes:
    """A byte of each count, then places and values of those that need more, deflated: most are small, and a quarter is deflated in less time."""
    over = np.flatnonzero(counts >= 255).astype(np.uint32)
    return zlib.compress(np.minimum(counts, 255).astype(np.uint8).tobytes() + over.tobytes() + counts[over].tobytes(), 1)


def unpacked_counts(packed: bytes) -> np.ndarray:
    data = zlib.decompress(packed)
    counts = np.frombuffer(data, np.uint8, 2 * SEGMENT).astype(np.int64)
    over, values = np.frombuffer(data, np.uint32, offset=2 * SEGMENT).reshape(2, -1)
    counts[over] = values
    return counts


def count_segments(df: DataFrame, vocabulary, bits: int, text: str, spelling: bool) -> DataFrame:
    """(segment, counts): zeros and ones of each slot over a task's texts or words, as ``packed_counts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, where = vocabulary.value, Tables(bits, SPELLING_TABLES if spelling else WORD_TABLES)
        counts = np.zeros(2 * where.slots, np.uint32)
        for piece in pieces(batches, SCORED_CHARS // 8 if spelling else SCORED_CHARS):
            texts = piece.column(0)
            count_into(counts, where, Spelled(texts, own) if spelling else Stream(texts, own))
        width = 2 * SEGMENT
        for i in range(0, len(counts), 64 * width):
            parts = [(j // width, counts[j : j + width]) for j in range(i, min(i + 64 * width, len(counts)), width)]
            used = [(s, packed_counts(p)) for s, p in parts if p.any()]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in used], pa.int32()), pa.array([c for _, c in used], pa.binary())], names=["segment", "counts"])

    return map_arrow(df.select(text), run, "segment int, counts binary")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over segments in order: each one's logits and levels, from the sums of its counts."""
    current, total = None, None

    def close() -> pa.RecordBatch:
        pairs = total.reshape(-1, 2)
        return pa.RecordBatch.from_arrays(
            [pa.array([current], pa.int32()), pa.array([logits(pairs[:, 0], pairs[:, 1]).tobytes()], pa.binary()), pa.array([levels_of(pairs.sum(axis=1)).tobytes()], pa.binary())], names=["segment", "logits", "levels"]
        )

    for batch in batches:
        for segment, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = unpacked_counts(counts.as_py())
            if segment != current:
                if current is not None:
                    yield close()
                current, total = segment, own
            else:
                total += own
    if current is not None:
        yield close()


def tables(df: DataFrame, vocabulary, size: int, text: str = "text", spelling: bool = False) -> tuple[np.ndarray, np.ndarray, int]:
    """Logits and levels of all slots, and the bits, of texts or of spelled words with so many bytes. Counts are summed by segment; the driver gets a byte of each a slot.

    A task counts several partitions where its tables would else outweigh its texts.
    """
    bits = table_bits(size)
    slots = Tables(bits, SPELLING_TABLES if spelling else WORD_TABLES).slots
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, size // (4 * slots))
    found = count_segments(df.coalesce(tasks), vocabulary, bits, text, spelling).repartition("segment").sortWithinPartitions("segment")
    rows = map_arrow(found, _summed, "segment int, logits binary, levels binary").toArrow()
    held, levels = np.zeros(-(-slots // SEGMENT) * SEGMENT, np.int8), np.zeros(-(-slots // SEGMENT) * SEGMENT, np.uint8)
    for batch in rows.to_batches():
        for segment, a, b in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            at = segment * SEGMENT
            own = np.frombuffer(a.as_py(), np.int8)
            held[at : at + len(own)] = own
            levels[at : at + len(own)] = np.frombuffer(b.as_py(), np.uint8)
    return held, levels, bits


def _less_one() -> tuple[np.ndarray, np.ndarray]:
    """[level, choice, logit in steps] and [level]: logits and levels once one count of a choice is taken out."""
    n = seen_of(np.arange(16))
    zeros = (n[:, None, None] + 0.8) / (1 + np.exp(np.arange(256, dtype=np.uint8).view(np.int8) / STEP)) - 0.4
    told = np.arange(2)[None, :, None]
    return logits(np.maximum(zeros - (1 - told), 0), np.maximum(n[:, None, None] - zeros - told, 0)).ravel(), levels_of(np.maximum(n - 1, 0))


LOGITS_LESS, LEVELS_LESS = _less_one()
#: [choice, or 2 where it wasn't counted][level, logit in steps]: the logit once that choice's count is taken out.
LOGITS_TOLD = np.concatenate([LOGITS_LESS.reshape(16, 2, 256).swapaxes(0, 1).ravel(), np.tile(np.arange(256, dtype=np.uint8).view(np.int8), 16)])
#: [level, logit in steps]: the bins of the logit once a zero and once a one is taken out, and the level then, in 4 bits each.
LESS = np.bitwise_or.reduce([*(BINS.take(LOGITS_LESS.view(np.uint8)).reshape(16, 2, 256) << np.array([0, 4])[:, None]).swapaxes(0, 1), np.repeat(LEVELS_LESS.astype(int) << 8, 256).reshape(16, 256)]).astype(np.uint16).ravel()


def without_own(held: np.ndarray, levels: np.ndarray, told: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logits in steps and levels of slots, once the counts of the choices made in them are taken out."""
    at = levels.astype(np.int64)
    at <<= 1
    at += told
    at <<= 8
    at += held.view(np.uint8)
    return LOGITS_LESS.take(at), LEVELS_LESS.take(levels)


def one_table(held: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """What ``LESS`` says of each slot, so that a choice finds all it needs at one place in memory."""
    both = np.empty(len(held), np.uint16)
    for i in range(0, len(both), ADDED):
        at = levels[i : i + ADDED].astype(np.intp)
        at <<= 8
        at += held[i : i + ADDED].view(np.uint8)
        LESS.take(at, out=both[i : i + ADDED], mode="clip")
    return both


def fit_into(cells: np.ndarray, static: np.ndarray, held: np.ndarray, levels: np.ndarray, bits: int, stream: Stream | Spelled, both: np.ndarray | None = None) -> None:
    """Count the choices of a stream by gate, place, choice and the bins of the predictors' logits.

    Each choice's own count is taken out of what the tables tell of it. ``both``: their ``one_table``, if it is there already.
    """
    where, last = Tables(bits, stream.narrower), len(stream.bases) - 1
    both = one_table(held, levels) if both is None else both
    found: list[np.ndarray] = []
    for i in range(0, len(stream.symbols), CACHED_TOKENS):
        owners, begins, at = stream.code.of(stream.symbols[i : i + CACHED_TOKENS])
        own = static.take(at)
        nodes, cell = own.astype(np.uint32), (own >> 32).astype(np.int32)
        told, bins, seen = ((cell >> 10) & 4).astype(np.uint16), np.zeros(len(at), np.uint16), []
        for k in range(last + 1):
            slot = both.take(where.of(k, stream.bases[k][i : i + CACHED_TOKENS].take(owners), nodes))
            seen.append(slot.take(begins) >> 8)
            slot >>= told
            slot &= 15
            bins <<= 4
            bins |= slot
        cell += bins
        cell += (gates_of(*seen[-2:]).astype(np.int32) * (PLACES << 13)).take(owners)
        found.append(cell)
        if len(found) * CACHED_TOKENS >= 4 * COUNTED_TOKENS:
            cells += np.bincount(np.concatenate(found), minlength=CELLS)
            found = []
    if found:
        cells += np.bincount(np.concatenate(found), minlength=CELLS)


def static_cells(code: Code, plain: bool) -> np.ndarray:
    """What place, choice and the logits of choices alone add to a cell, in the upper 32 bits; the choice's node below."""
    cell = (code.places.astype(np.int64) << 13) | (code.bits.astype(np.int64) << 12)
    if plain:
        cell |= BINS.take(code.plain.view(np.uint8)) << 8
    return (cell << 32) | code.nodes


def first_weights(cell: np.ndarray, n: np.ndarray) -> np.ndarray:
    """[gates, places, K + 1] weights and bias by logistic regression over counted choices, for each gate and place by itself."""
    even = np.array([1.0 / K] * K + [0.0])
    weights = np.tile(even, (GATES * PLACES, 1))
    x, y, own = np.ones((len(cell), K + 1)), (cell >> 12 & 1).astype(float), cell >> 13
    for k in range(K):
        x[:, k] = BIN_AT.take(cell >> 4 * (K - 1 - k) & 15) / STEP
    for row in np.unique(own):
        chosen = own == row
        w, xj, yj, nj = weights[row].copy(), x[chosen], y[chosen], n[chosen].astype(float)
        for _ in range(20):
            p = 1 / (1 + np.exp(-np.clip(xj @ w, -20, 20)))
            curve = (xj * (nj * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ xj + 20 * np.eye(K + 1)
            w += np.clip(np.linalg.solve(curve, xj.T @ (nj * (yj - p)) - 20 * (w - even)), -0.2, 0.2)
        weights[row] = np.clip(w, -0.5, 2.0)
    return weights.reshape(GATES, PLACES, K + 1)


def fitted(df: DataFrame, vocabulary, held: np.ndarray, levels: np.ndarray, bits: int, text: str = "text", spelling: bool = False) -> np.ndarray:
    """First weights from every choice of all texts, or of all spelled words. The driver gets one count a cell, of ``CELLS`` at most."""
    shared = df.sparkSession.sparkContext.broadcast((held, levels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, (held, levels), cells = vocabulary.value, shared.value, np.zeros(CELLS, np.int64)
        static = static_cells(own.letters, False) if spelling else static_cells(own.code, True)
        both = one_table(held, levels)
        for piece in pieces(batches, SCORED_CHARS // 8 if spelling else SCORED_CHARS):
            texts = piece.column(0)
            fit_into(cells, static, held, levels, bits, Spelled(texts, own) if spelling else Stream(texts, own), both)
        used = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(cells[used])], names=["cell", "n"])

    counted = map_arrow(df.select(text), run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    shared.destroy()
    return first_weights(counted["cell"].to_numpy(), counted["n"].to_numpy())


def _in_steps(weights: np.ndarray) -> np.ndarray:
    """[gate and place, predictor], for logits in steps."""
    return (weights * np.array([1 / STEP] * K + [1.0])).reshape(-1, K + 1).astype(np.float32)


class Spelling:
    """How rare words are spelled."""

    def __init__(self, vocabulary: Vocabulary, held: np.ndarray, levels: np.ndarray, bits: int, weights: np.ndarray):
        self.own, self.bits, self.weights = vocabulary, bits, _in_steps(weights)
        self.both = levels.astype(np.uint16)
        self.both <<= 8
        self.both |= held.view(np.uint8)

    @property
    def held(self) -> np.ndarray:
        return self.both.astype(np.uint8).view(np.int8)

    @property
    def levels(self) -> np.ndarray:
        return (self.both >> 8).astype(np.uint8)

    def scores(self, words: list[bytes] | pa.Array, counted: np.ndarray) -> np.ndarray:
        """log10 of each word's probability among all strings; where it was counted, as if it had not been."""
        out = [self._scores(words[i : i + SPELLED], counted[i : i + SPELLED]) for i in range(0, len(words), SPELLED)]
        return np.concatenate([np.empty(0), *out])

    def _scores(self, words: list[bytes] | pa.Array, counted: np.ndarray) -> np.ndarray:
        stream, where = Spelled(words, self.own), Tables(self.bits, SPELLING_TABLES)
        code = stream.code
        owners, begins, choices = code.of(stream.symbols)
        nodes, told = code.nodes.take(choices), code.bits.take(choices)
        known = np.repeat(counted, stream.sizes)
        plane = told.astype(np.uint16)
        plane[~known.take(owners)] = 2
        plane <<= 12
        x, seen = [], []
        for k in range(K):
            found = self.both.take(where.of(k, stream.bases[k].take(owners), nodes))
            levels = (found.take(begins) >> 8).astype(np.uint8)
            seen.append(np.where(known, LEVELS_LESS.take(levels), levels))
            found |= plane
            x.append(LOGITS_TOLD.take(found).astype(np.float32))
        rows = (gates_of(*seen[1:]).astype(np.int64) * PLACES).take(owners)
        rows += code.places.take(choices)
        logit = self.weights[:, K].take(rows)
        for k in range(K):
            logit += self.weights[:, k].take(rows) * x[k]
        np.clip(logit, -12, 12, out=logit)
        cost = np.log1p(np.exp(np.where(told > 0, -logit, logit)))
        return -np.add.reduceat(cost, begins[stream.starts]).astype(float) / np.log(10)


class Model:
    def __init__(self, vocabulary: Vocabulary, spelling: Spelling, held: np.ndarray, levels: np.ndarray, bits: int, weights: np.ndarray):
        self.own, self.spelling, self.bits, self.held = vocabulary, spelling, bits, held
        self.levels = levels
        self.weights = _in_steps(weights)

    def coded(self, stream: Stream) -> np.ndarray:
        """log10 of the probability of each symbol, each text by its own weights."""
        out = np.empty(len(stream.symbols))
        order = np.argsort(-stream.sizes, kind="stable")
        for i in range(0, len(order), LANES):
            self._lockstep(stream, order[i : i + LANES], out)
        out /= np.log(10)
        return out

    def _lockstep(self, stream: Stream, texts: np.ndarray, out: np.ndarray) -> None:
        """Natural logarithms into ``out`` for these texts, which come in falling order of size."""
        where, code = Tables(self.bits, WORD_TABLES), self.own.code
        starts, sizes = stream.starts[texts], stream.sizes[texts]
        ends, blocks = starts + sizes, -(-sizes // BLOCK)
        sets = GATES * PLACES
        weights = [np.tile(self.weights[:, k], len(starts)) for k in range(K + 1)]
        active = np.searchsorted(-blocks, -np.arange(1, int(blocks[0]) + 1), side="right")
        for step, m in enumerate(active.tolist()):
            at = (starts[:m] + step * BLOCK)[:, None] + np.arange(BLOCK)
            valid = (at < ends[:m, None]).ravel()
            text = np.repeat(np.arange(m), BLOCK)
            at = at.ravel()
            if not valid.all():
                at, text = at[valid], text[valid]
            owners, begins, choices = code.of(stream.symbols[at])
            own = code.packed.take(choices)
            nodes, told, places = own.astype(np.uint32), own.view(np.uint8)[5::8], own.view(np.uint8)[6::8]
            x, seen = [own.view(np.int8)[4::8].astype(np.float32)], []
            for k in range(len(stream.bases)):
                slots = where.of(k, stream.bases[k][at].take(owners), nodes)
                x.append(self.held.take(slots).astype(np.float32))
                seen.append(self.levels.take(slots.take(begins)))
            rows = ((text * GATES + gates_of(*seen)) * PLACES).take(owners)
            rows += places
            logit = weights[K].take(rows)
            for k in range(K):
                logit += weights[k].take(rows) * x[k]
            np.clip(logit, -12, 12, out=logit)
            np.negative(logit, out=logit)
            np.exp(logit, out=logit)
            logit += 1
            np.reciprocal(logit, out=logit)
            error = told - logit
            out[at] = np.add.reduceat(np.log(1 - np.abs(error)), begins)
            size = m * sets
            for k in range(K):
                x[k] *= error
                weights[k][:size] += RATE / STEP**2 * np.bincount(rows, x[k], size)
            weights[K][:size] += BIAS_RATE * np.bincount(rows, error, size)


def frequent_bound(counts: DataFrame, most: int = FREQUENT) -> int | None:
    """The least count, in steps of a histogram, of words that are at most so many in all; None where no step is."""
    histogram = counts.where("word <> ''").groupBy(_step().alias("step")).agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect()
    held, least = 0, None
    for r in histogram:
        held += r.words
        if held > most:
            break
        least = r.step
    return least


def _step() -> Column:
    return F.floor(F.log2("n") * 8).cast("int")


def is_frequent(bound: int | None) -> Column:
    return (F.col("word") != "") & (F.lit(False) if bound is None else _step() >= bound)


def spelled(words: DataFrame, spelling) -> DataFrame:
    """(word, n, spelled) of counted words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = spelling.value
        for batch in batches:
            scores = own.scores(batch.column(0), np.ones(batch.num_rows, bool))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores)], names=["word", "n", "spelled"])

    return map_arrow(words.select("word", "n"), run, "word string, n long, spelled double")


def train(df: DataFrame, key: str = "doc_id", text: str = "text", modulus: int = 7, remainder: int = 2) -> tuple[Model, DataFrame]:
    """The model, and the rare words (word, n, spelled), of the texts whose crc32 doesn't leave the remainder."""
    context = df.sparkSession.sparkContext
    own = df.where(~held_out(F.col(key), modulus, remainder)).select(F.col(key), F.col(text).alias("text"))
    counts = cut_lineage(word_counts(own))
    frequent = is_frequent(frequent_bound(counts, FREQUENT))
    rare = counts.where((F.col("word") != "") & ~frequent)
    size = F.octet_length("word") + 1
    sizes = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("types"), F.coalesce(F.max(F.when(F.col("word") == "", F.col("n"))), F.lit(0)).alias("ends"),
        F.coalesce(F.sum(F.col("n") * size), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.when(~frequent, size)), F.lit(0)).alias("spelled"),
    ).first()
    top = counts.where(frequent).toArrow()
    listed = {w.encode(): n for w, n in zip(top["word"].to_pylist(), top["n"].to_pylist(), strict=True)}
    vocabulary = Vocabulary(listed, sizes["ends"], sizes["tokens"], sizes["types"])
    shared = context.broadcast(vocabulary)

    held, levels, bits = tables(rare, shared, sizes["spelled"], "word", True)
    spelling = Spelling(vocabulary, held, levels, bits, fitted(rare, shared, held, levels, bits, "word", True))
    table = spelled(rare, context.broadcast(spelling))

    held, levels, bits = tables(own, shared, sizes["bytes"])
    weights = fitted(own, shared, held, levels, bits)
    return Model(vocabulary, spelling, held, levels, bits, weights), table


def score(df: DataFrame, model: Model, rare: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every whole text.

    Null and empty texts are the end token alone. Repeated rows are scored each. Without training rows the counts are
    zero and every choice is even. bits_per_byte is over the bytes of the words, with one more for each and for the end.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[key].dataType.simpleString()
    ddl = f"row long, `{key}` {kind}, n_tokens long, known long, base double, score double, bytes long, rare array<struct<word:string,times:int>>"
    arrow = arrow_schema(df.sparkSession, ddl)
    size = float(model.own.tokens + model.own.types + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for piece in pieces(batches, SCORED_CHARS):
            stream, rows = Stream(piece.column(2), own.own), piece.num_rows
            text = np.repeat(np.arange(rows), stream.sizes)
            scores = np.bincount(text, own.coded(stream), rows)
            here = stream.symbols < own.own.escape
            found = own.own.counts[stream.symbols[here]]
            base = np.bincount(text[here], np.log10((found + 1) / size), rows)
            known = np.bincount(text[here], found > 0, rows).astype(np.int64)
            coded = stream.rare_words.dictionary_encode()
            names = max(len(coded.dictionary), 1)
            pairs, times = np.unique(text[stream.rare] * names + coded.indices.to_numpy(), return_counts=True)
            words = coded.dictionary.take(pa.array(pairs % names))
            edges = np.searchsorted(pairs, np.arange(rows + 1) * names)
            lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.StructArray.from_arrays([words, pa.array(times, pa.int32())], ["word", "times"]))
            columns = [stream.sizes, known, base, scores, stream.bytes]
            told = [pa.array(c, f.type) for c, f in zip(columns, list(arrow)[2:], strict=False)]
            yield pa.RecordBatch.from_arrays([piece.column(0).cast(arrow.field(0).type), piece.column(1).cast(arrow.field(1).type), *told, lists.cast(arrow.field("rare").type)], schema=arrow)

    scored = cut_lineage(map_arrow(df.select(F.monotonically_increasing_id().alias("row"), key, text), run, ddl))
    # A rare word has one row, so that parts of the smaller side are even and need no sort; the hash deals them out, the word decides.
    each = scored.select("row", F.inline("rare")).withColumn("hash", F.xxhash64("word"))
    met = each.join(rare.withColumn("hash", F.xxhash64("word")).hint("shuffle_hash"), ["hash", "word"], "left")
    alone = F.col("spelled") + F.lit(float(np.log10(1 - UNIGRAM)))
    by_count = F.log10(F.col("n") * F.lit(UNIGRAM / max(model.own.rare, 1)))
    mixed = F.greatest(alone, by_count) + F.log10(1 + F.pow(F.lit(10.0), F.least(alone, by_count) - F.greatest(alone, by_count)))
    sums = met.groupBy("row").agg(
        F.sum(F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(size))).alias("base_more"), F.sum(F.col("times") * mixed).alias("score_more"),
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("met"), F.collect_list(F.when(F.col("n").isNull(), F.struct("word", "times"))).alias("unknown"),
    )
    joined = scored.drop("rare").join(sums, "row", "left")
    nothing = F.lit(0.0)
    full = joined.select(
        key, "n_tokens", (F.col("known") + F.coalesce("met", F.lit(0))).alias("n_known"), F.lit(model.own.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base_more", nothing)).alias("base_score"), (F.col("score") + F.coalesce("score_more", nothing)).alias("score"), "bytes", F.col("unknown.word").alias("words"), F.col("unknown.times").alias("times"),
    )
    told = f"`{key}` {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    out = arrow_schema(df.sparkSession, told)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Add the words that no training text has."""
        own = shared.value
        for batch in batches:
            scores = batch.column(5).to_numpy().copy()
            lists, times = batch.column(7).to_pylist(), batch.column(8).to_pylist()
            words = [w.encode() for x in lists for w in x or ()]
            if words:
                places = np.repeat(np.arange(len(lists)), [len(x or ()) for x in lists])
                spelled = own.spelling.scores(words, np.zeros(len(words), bool)) + (np.log10(1 - UNIGRAM) if own.own.rare else 0)
                scores += np.bincount(places, spelled * np.array([n for x in times for n in x or ()]), len(lists))
            per_byte = -scores / np.log10(2) / batch.column(6).to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(scores), pa.array(per_byte)], schema=out)

    return map_arrow(full, finish, told)
