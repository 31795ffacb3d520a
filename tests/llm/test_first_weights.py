"""The first weights of context mixing come from every training choice, whatever the texts' number and length."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from veritally.llm import lm
from veritally.llm.common import is_held_out


def some_texts(number: int, words: int) -> list[tuple[int, str]]:
    rng = np.random.default_rng(3)
    ids = [i for i in range(1, 10 * number) if not is_held_out(i, 7, 2)][:number]
    return [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.4, words) % 300)) for i in ids]


def test_long_texts_are_learned_from(spark):
    """All texts have over 8,192 characters, so that a sample of shorter ones would be empty and the weights even."""
    rows = some_texts(4, 4_000)
    assert min(len(t) for _, t in rows) > 8_192
    model, _ = lm.train(spark.createDataFrame(rows, "doc_id long, text string"))
    even = lm._in_steps(np.tile([1 / lm.K] * lm.K + [0.0], (lm.GATES, lm.PLACES, 1)))
    assert not np.allclose(model.weights, even)


def test_every_choice_counts_once_wherever_it_is_read(spark, monkeypatch):
    rows = some_texts(60, 50)
    seen = []
    real = lm.first_weights
    monkeypatch.setattr(lm, "first_weights", lambda cell, n: seen.append((np.asarray(cell), np.asarray(n))) or real(cell, n))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model, _ = lm.train(df.repartition(1))
    other, _ = lm.train(df.repartition(5))
    assert np.allclose(model.weights, other.weights) and np.allclose(model.spelling.weights, other.spelling.weights)
    stream = lm.Stream(pa.array([t for _, t in rows], pa.string()), model.own)
    assert int(seen[1][1].sum()) == int(seen[3][1].sum()) == int(model.own.code.lengths.take(stream.symbols).sum())


def test_cells_are_those_of_each_choice():
    own = lm.Vocabulary({b"a": 5, b"b": 3, b"c": 1}, 4, 20, 9)
    rng = np.random.default_rng(1)
    stream, where = lm.Stream(pa.array(["a b c a", "zz b b", ""], pa.string()), own), lm.Tables(14, lm.WORD_TABLES)
    held, levels = rng.integers(-127, 128, where.slots).astype(np.int8), rng.integers(0, 16, where.slots).astype(np.uint8)
    cells, want = np.zeros(lm.CELLS, np.int64), np.zeros(lm.CELLS, np.int64)
    lm.fit_into(cells, lm.static_cells(own.code, True), held, levels, 14, stream)
    for i, symbol in enumerate(stream.symbols):
        gate = None
        for c in range(int(own.code.first[symbol]), int(own.code.first[symbol] + own.code.lengths[symbol])):
            told, found, bins = int(own.code.bits[c]), [], [np.searchsorted(lm.BIN_EDGES, own.code.plain[c], side="right")]
            for k in range(2):
                slot = where.of(k, stream.bases[k][i : i + 1].copy(), own.code.nodes[c : c + 1])
                logit, level = lm.without_own(held[slot], levels[slot], np.array([told]))
                bins.append(np.searchsorted(lm.BIN_EDGES, logit[0], side="right"))
                found.append(level)
            gate = int(lm.gates_of(*found)[0]) if gate is None else gate
            want[(((gate * lm.PLACES + int(own.code.places[c])) * 2 + told) << 12) + (bins[0] << 8) + (bins[1] << 4) + bins[2]] += 1
    assert (cells == want).all() and cells.sum() > 8


def test_counted_choices_give_the_weights_of_the_choices_themselves():
    """Of two predictors that say 53 steps or nothing, the one that is right takes the weight."""
    right, wrong = (14 << 8) + (7 << 4) + 7, (1 << 8) + (7 << 4) + 7
    weights = lm.first_weights(np.array([(1 << 12) + right, right, (1 << 12) + wrong, wrong]), np.array([970, 30, 30, 970]))
    assert abs(weights[0, 0, 0] - np.log(97 / 3) / (lm.BIN_AT[14] / lm.STEP)) < 0.1 and np.allclose(weights[1:], [[1 / 3, 1 / 3, 1 / 3, 0]])


def test_hashes_of_words_are_their_crc32():
    words = ["a", "\u65e5\u672c", "x" * (lm.CRC_BYTES - 1), "y" * lm.CRC_BYTES, "z" * (lm.CRC_BYTES + 1), "\u00e9" * 900, "hello"] * 3
    for some in (pa.array(words), pa.array(words).slice(3, 9), pa.array([], pa.string())):
        assert lm.crc32s(some).tolist() == [zlib.crc32(w.encode()) for w in some.to_pylist()]


def test_cells_do_not_depend_on_how_many_tokens_are_looked_up_at_once(monkeypatch):
    own = lm.Vocabulary({b"a": 5, b"b": 3, b"c": 1}, 4, 20, 9)
    rng = np.random.default_rng(1)
    stream, where = lm.Stream(pa.array(["a b c a zz b b"] * 9 + [""], pa.string()), own), lm.Tables(14, lm.WORD_TABLES)
    held, levels = rng.integers(-127, 128, where.slots).astype(np.int8), rng.integers(0, 16, where.slots).astype(np.uint8)
    found = []
    for size in (1, 7, 1 << 12):
        monkeypatch.setattr(lm, "CACHED_TOKENS", size)
        monkeypatch.setattr(lm, "COUNTED_TOKENS", 2 * size)
        cells, counts = np.zeros(lm.CELLS, np.int64), np.zeros(2 * where.slots, np.uint32)
        lm.fit_into(cells, lm.static_cells(own.code, True), held, levels, 14, stream)
        lm.count_into(counts, where, stream)
        found.append((cells, counts))
    assert all((a == found[0][0]).all() and (b == found[0][1]).all() for a, b in found) and found[0][0].sum() > 100


def test_choices_meet_their_counts_in_order_of_memory(monkeypatch):
    """Counts as those of each choice by itself, in few passes whose places rise, whatever order the texts have."""
    own = lm.Vocabulary({b"a": 5, b"b": 3, b"c": 1}, 4, 20, 9)
    stream, where = lm.Stream(pa.array(["a b c a zz b b"] * 9 + [""], pa.string()), own), lm.Tables(14, lm.WORD_TABLES)
    counts, want, order = np.zeros(2 * where.slots, np.uint32), np.zeros(2 * where.slots, np.uint32), []
    real = lm.add_sorted
    monkeypatch.setattr(lm, "add_sorted", lambda c, found: order.append(sum(map(len, found))) or real(c, found))
    lm.count_into(counts, where, stream)
    for i, symbol in enumerate(stream.symbols):
        for c in range(int(own.code.first[symbol]), int(own.code.first[symbol] + own.code.lengths[symbol])):
            for k in range(2):
                want[2 * int(where.of(k, stream.bases[k][i : i + 1].copy(), own.code.nodes[c : c + 1])[0]) + int(own.code.bits[c])] += 1
    assert (counts == want).all() and order == [int(want.sum())]


def test_counts_are_packed_in_a_byte_each_where_they_are_small():
    counts = np.random.default_rng(2).geometric(0.5, 2 * lm.SEGMENT).astype(np.uint32)
    counts[[0, 7, 9, 4_000]] = 254, 255, 256, 4_000_000_000
    assert (lm.unpacked_counts(lm.packed_counts(counts)) == counts).all()
    assert not lm.unpacked_counts(lm.packed_counts(np.zeros(2 * lm.SEGMENT, np.uint32))).any()
    assert len(zlib.compress(counts.tobytes(), 1)) > 1.3 * len(lm.packed_counts(counts))


def test_spelled_words_are_the_same_as_a_list_and_as_an_array(monkeypatch):
    own = lm.Vocabulary({b"a": 5, b"b": 3, b"c": 1}, 4, 20, 9)
    words, where, rng = ["a", "séldom", "x" * 300, "rare"] * 5, lm.Tables(14, lm.SPELLING_TABLES), np.random.default_rng(1)
    held, levels = rng.integers(-127, 128, where.slots).astype(np.int8), rng.integers(0, 16, where.slots).astype(np.uint8)
    spelling = lm.Spelling(own, held, levels, 14, rng.uniform(-1, 1, (lm.GATES, lm.PLACES, lm.K + 1)))
    assert (spelling.held == held).all() and (spelling.levels == levels).all()
    counted = np.arange(20) % 3 > 0
    whole = spelling.scores([w.encode() for w in words], counted)
    assert (spelling.scores(pa.array(["before", *words]).slice(1), counted) == whole).all()
    monkeypatch.setattr(lm, "SPELLED", 3)
    assert np.allclose(spelling.scores(pa.array(words), counted), whole, rtol=1e-6)
    assert len(spelling.scores(pa.array([], pa.string()), np.zeros(0, bool))) == 0 and not len(lm.Spelled([], own).symbols)
