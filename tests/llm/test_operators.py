"""Each operator against brute force or its own round trip, and on awkward rows."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veritally.llm import bpe, chat, common, decontam, langid, license, lm, rules, simhash, tokencount, toxicity
from veritally.llm.common import alnum_words, blank_words, is_held_out
from veritally.llm.queries import tokenizer_path

ODD = [
    (1, "The quick brown fox\njumps over the lazy dog. Don't we'll they're 's"), (2, None), (3, ""), (4, " \n\t "), (5, "a" * 30_000), (6, "word " * 4_000), (7, "Ünïcödé ½ ٣ 漢字 — <|endoftext|> x"),
    (8, "same text twice here now"), (9, "same text twice here now"), (9, "same text twice here now"), (None, "no id at all but some words in here"),
]
CLASHING = ["row", "fp", "score", "words", "label", "rows", "n", "h", "kind", "lang", "bit", "least", "root", "key"]


@pytest.fixture(scope="module")
def odd(spark):
    """Awkward rows, with columns whose names the operators use inside."""
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    for name in CLASHING:
        df = df.withColumn(name, F.lit("x") if name == "lang" else F.lit(7))
    return df


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


MIXED = st.text(alphabet=st.sampled_from("aabesttrvlldm''' \n\t\r 12½é漢,.!<|>\x1c\x85　ß😀"), max_size=80)


@settings(max_examples=150, deadline=None)
@given(st.lists(MIXED, min_size=1, max_size=5))
def test_tokens_are_the_librarys(library, texts_):
    own = [len(library.encode(t, add_special_tokens=False).ids) for t in texts_]
    assert tokencount.counter(tokenizer_path()).count(texts_) == own
    assert [tokencount.split_short(t) for t in texts_] == [[t[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(t)] for t in texts_]


@settings(max_examples=60, deadline=None)
@given(st.lists(MIXED, min_size=2, max_size=12))
def test_chunk_joints_agree_with_the_library(library, parts):
    own = bpe.encoder(tokenizer_path())
    whole = "".join(parts)
    parts = [p for p in parts if p]
    got = np.frombuffer(own._join(parts, own._encode_chunks(parts)), own.kind).tolist() if parts else []
    assert "<|endoftext|>" in whole or got == library.encode(whole, add_special_tokens=False).ids


def test_token_counts(odd, none, library):
    got = tokencount.over_limit(tokencount.count_tokens(odd, tokenizer_path())).collect()
    want = Counter((i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in ODD)
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    assert tokencount.count_tokens(none, tokenizer_path()).count() == 0


def test_other_kinds_of_tokenizer_files_are_refused(tmp_path):
    import json

    with open(tokenizer_path(), encoding="utf-8") as f:
        spec = json.load(f)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": spec["model"] | {"ignore_merges": True}}):
        path = tmp_path / "other.json"
        path.write_text(json.dumps(spec | change))
        with pytest.raises(ValueError, match=next(iter(change))):
            tokencount.BpeCounter(str(path))


def test_hot_keys_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    rows = spark.createDataFrame([(k, i) for i, k in enumerate([1, 1, 1, 1, 2, 2, 3])], "k long, i int")
    values = spark.createDataFrame([(1, 4, "a"), (2, 2, "b"), (3, 1, "c")], "k long, n long, v string")
    got = common.join_values(rows, values, "k")
    assert got.columns == ["k", "i", "v"] and sorted((r.k, r.v) for r in got.collect()) == [(1, "a")] * 4 + [(2, "b")] * 2 + [(3, "c")]
    assert common.join_values(rows.limit(0), values.limit(0), "k").count() == 0


def test_encoding_round_trip(odd, none, library, docs, texts):
    for df, rows in ((odd, ODD), (docs, list(texts.items()))):
        got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_digests(df, tokenizer_path()).collect())
        want = Counter()
        for i, t in rows:
            ids = library.encode(t or "", add_special_tokens=False).ids
            want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
        assert got == want
    back = bpe.decode(bpe.encode(odd, tokenizer_path()), tokenizer_path()).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((i, t or "") for i, t in ODD)
    assert bpe.encode_digests(none, tokenizer_path()).count() == 0
    own = bpe.encoder(tokenizer_path())
    assert own.reused > 0 and "".join(bpe.chunks("x y " * 5000)) == "x y " * 5000


def test_fingerprints_by_hand():
    import xxhash

    words = [f"w{i}" for i in range(40)] * 2
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), seed=42) for i in range(len(words) - 3)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(" \n".join(w.upper() for w in words)) == want
    assert simhash.fingerprint(None) == simhash.fingerprint(" \t") == 0
    assert simhash.fingerprint("One two") == xxhash.xxh64_intdigest("one two", seed=42)


def brute_components(values: dict, most: int) -> dict:
    ids = sorted(values)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (values[a] ^ values[b]).bit_count() <= most and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


def test_components_are_those_of_all_pairs(spark, docs, texts):
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert got == brute_components({i: simhash.fingerprint(t) for i, t in texts.items()}, 4)


@pytest.mark.parametrize("bucket", [16_384, 16])
def test_links_of_clusters_lose_nothing(spark, bucket):
    """Clusters around centres; in the second case their buckets are dealt out in blocks."""
    rng = np.random.default_rng(3)
    values = set()
    for _ in range(6):
        centre = int(rng.integers(0, 1 << 63))
        for _ in range(60):
            flipped = centre
            for b in rng.choice(64, int(rng.integers(0, 6)), replace=False):
                flipped ^= 1 << int(b)
            values.add(flipped)
    values = {i: v for i, v in enumerate(sorted(values))}
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values.values()], "fp long")
    signed = {v - (1 << 64) if v >> 63 else v: i for i, v in values.items()}
    found = simhash.components(simhash.links(df, bucket=bucket)).collect()
    groups = defaultdict(set)
    for r in found:
        groups[r.root].add(signed[r.node])
    want = defaultdict(set)
    for i, c in brute_components(values, 4).items():
        want[c].add(i)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_near_duplicates_of_odd_rows(odd, none):
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(odd).collect()}
    assert {(2, 2), (3, 2), (4, 2), (8, 8), (9, 8), (None, None)} <= got
    assert simhash.near_duplicates(odd).count() == len(ODD)
    assert simhash.near_duplicates(none).count() == 0


BENCH = [("b1", "One two three four five six seven eight nine ten eleven twelve"), ("b2", "short item"), ("b3", None), ("b4", "..."), ("b1", "One two three four five six seven eight nine ten eleven twelve"), ("b5", "x " * 30)]


def brute_hits(text: str | None, items: list) -> tuple[int, int, set]:
    words, hit, names = alnum_words(text), set(), set()
    for name, t in items:
        own = alnum_words(t)
        n = min(10, len(own))
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
        for i in range(len(words) - n + 1 if n else 0):
            if tuple(words[i : i + n]) in windows:
                hit.update(range(i, i + n))
                names.add(name)
    return len(words), len(hit), names


@pytest.mark.parametrize("limit", [decontam.BROADCAST_BYTES, 0])
def test_contamination(spark, odd, none, limit):
    planted = [
        (20, "intro one TWO three, four five six seven eight nine ten! and more"), (21, "one two three four five six seven eight nine"), (22, "a short item, short ITEM"), (23, "x " * 12 + "y " + "x " * 9), (24, "zero " + BENCH[0][1] + " " + BENCH[0][1]),
    ]
    df = odd.select("doc_id", "text", "row").unionByName(spark.createDataFrame([(*p, 1) for p in planted], "doc_id long, text string, row int"))
    bench = spark.createDataFrame(BENCH, "item_id string, text string")
    got = Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.digests(decontam.contamination(df, bench, broadcast_bytes=limit)).collect())
    want = Counter()
    for i, t in ODD + planted:
        n, hit, names = brute_hits(t, BENCH)
        want[i, n, hit, len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), hit > 0] += 1
    assert got == want
    assert decontam.contamination(none, bench, broadcast_bytes=limit).count() == 0
    assert not decontam.digests(decontam.contamination(odd, bench.limit(0))).where("contaminated").count()


def test_cleaning_is_the_same_by_broadcast_and_by_join(spark):
    bench = spark.createDataFrame([(f"i{k}", " ".join(f"w{k}x{j}" for j in range(12))) for k in range(200)] + [("one", "alone")], "item_id string, text string")
    every = " ".join(" ".join(f"w{k}x{j}" for j in range(12)) for k in range(200))
    rows = [(7, "clean text here", 1), (7, "w3x0 w3x1 w3x2 w3x3 w3x4 w3x5 w3x6 w3x7 w3x8 w3x9", 2), (None, "so ALONE it is", 3), (None, "fine", 4), (8, every, 5), (9, None, 6), (9, None, 6), (10, "", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, number int")
    want = [r for r in rows if not brute_hits(r[1], [(r.item_id, r.text) for r in bench.collect()])[1]]
    for limit in (decontam.BROADCAST_BYTES, 0):
        got = decontam.clean(docs, bench, broadcast_bytes=limit)
        assert got.columns == docs.columns and sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    both = [Counter(map(str, decontam.digests(decontam.contamination(docs, bench, broadcast_bytes=b)).collect())) for b in (decontam.BROADCAST_BYTES, 0)]
    assert both[0] == both[1] and any("n_items=200" in r for r in both[1])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=60), st.lists(st.lists(st.sampled_from("abc"), max_size=16), max_size=4))
def test_winnowing_misses_no_window(words, items):
    named = [(str(i), " ".join(w)) for i, w in enumerate(items)]
    got = decontam.Index(named).scan([" ".join(words)])
    n, hit, names = brute_hits(" ".join(words), named)
    assert (got["n_words"][0], sum(s["after"] - s["first"] for s in got["spans"][0]), set(got["items"][0])) == (n, hit, names)


def test_licenses(spark, odd, none):
    planted = [
        (30, "MIT License. mit license; Released under the MIT License"), (31, "Gnu General Public License, version 3. gnu general public"), (32, "cc by by cc by"),
        (33, "Permission is hereby granted, free of charge, to any person having obtained a copy of this software and associated documentation"), (34, "the license of mit"),
    ]
    df = odd.select("doc_id", "text", "row", "h").unionByName(spark.createDataFrame([(*p, 1, 1) for p in planted], "doc_id long, text string, row int, h int"))
    got = defaultdict(list)
    for r in license.scan(df).collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == len(ODD) + len(planted)
    for i, t in ODD + planted:
        words = [w.decode() for w in alnum_words(t)]
        places = [(k, label) for p, label in license.PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        first, last = (min(k for k, _ in places), max(k for k, _ in places)) if places else (None, None)
        for r in got[i]:
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(places), first, last, ",".join(sorted({x for _, x in places})))
            assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert got[33][0].labels == "mit" and got[33][0].base_labels == "" and got[34][0].labels == "" and got[2][0].labels == ""
    assert license.scan(none).count() == 0
    odder = spark.createDataFrame([(1, "the license " * 7), (2, "MIT LICENSE \u212ait"), (3, "licensed under the apache license, as it is, version 2 0"), (4, "license mit the under released")], "doc_id long, text string")
    rows = {r.doc_id: r for r in license.scan(odder).collect()}
    assert rows[1].labels == "" and rows[1].score == 0 and rows[2].n_words == 3 and rows[2].labels == "mit" and rows[3].labels == "apache" and rows[4].labels == ""
    own = {r.doc_id: r for r in license.scan(odder, phrases={"as it is": "as-is"}, templates=[("it's", "license mit the under")]).collect()}
    assert own[3].labels == "as-is" and own[4].labels == "it's" and own[1].base_labels == ""


def test_rules_statistics(odd, none, docs, texts):
    for df, rows in ((odd, ODD), (docs, list(texts.items()))):
        got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rules.statistics(df).collect())
        want = Counter()
        for i, t in rows:
            words = re.findall("[^\x20\x09-\x0d]+", t or "")
            lines = [x for x in (t or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
            windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
            times = Counter(windows)
            repeated = {k + j for k, w in enumerate(windows) if times[w] > 1 for j in range(5)}
            want[i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(repeated)] += 1
        assert got == want
    assert rules.statistics(none).count() == 0


def test_rules_learn_and_keep_clean_rows(spark, odd, none):
    rng = np.random.default_rng(1)
    table = {"symbol_share": rng.random(600), "mean_word": rng.random(600)}
    bad = (table["symbol_share"] > 0.8) & (table["mean_word"] < 0.9)
    found = rules.learn(table, bad, rng.random(600))
    assert found and all(c.name in rules.RATIOS for r in found for c in r.conditions)
    labels = spark.createDataFrame([(1, 1), (2, 0), (8, None), (None, 0)], "doc_id long, quality int")
    got = rules.apply(odd, labels).collect()
    assert len(got) == len(ODD) and all(r.kept for r in got if not r.base_failed) and all(r.base_failed for r in got if r.doc_id in (2, 3, 4))
    assert rules.apply(none, labels.limit(0)).count() == 0


def test_a_decision_list_rejects_what_one_statistic_tells():
    """Clean rows that a single condition takes away at once must not leave the bad ones without a rule."""
    rng = np.random.default_rng(7)
    bad = rng.random(3000) < 0.08
    table = {"symbol_share": np.where(bad, 0.1 + 0.3 * rng.random(3000), 0.0), "mean_word": 4 + 2 * rng.random(3000)}
    bad ^= rng.random(3000) < 0.005
    found = rules.learn(table, bad, rng.random(3000))
    assert found and not found[0].keep
    rejected = np.logical_or.reduce([np.logical_and.reduce([c.holds(table) for c in r.conditions]) for r in found if not r.keep])
    assert (rejected & bad).sum() > 0.85 * bad.sum() and (rejected & ~bad).sum() < 0.05 * bad.sum()


def test_decision_list_on_held_out_rows(spark, small):
    big = small.replace("0.001", "0.01")
    found = rules.statistics(spark.read.parquet(f"{big}/documents.parquet")).cache()
    labels = spark.read.parquet(f"{big}/labels.parquet")
    half = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(2))
    learned = rules.train(found, labels.where(half == 0))
    rest = found.where(~rules.base_failed()).join(labels.where(half == 1), "doc_id").select("quality", rules.expression(learned).alias("kept")).collect()
    bad = [r.kept for r in rest if r.quality == 0]
    assert bad.count(False) > 0.6 * len(bad)
    assert sum(not r.kept for r in rest if r.quality == 1) <= 0.03 * len(rest)


def test_a_decision_list_has_both_outcomes_in_order(spark):
    """Many symbols are bad but for four exceptions, which are more than a rule's conditions can tell."""
    rng = np.random.default_rng(4)
    table = {c: rng.integers(0, 100, 3000).astype(float) for c in ("n_symbols", "n_upper", "n_digits", "n_marks")} | {"n_words": np.full(3000, 100.0), "word_chars": rng.integers(100, 900, 3000).astype(float)}
    ratios = {n: table[c] / table[of] for n, c, of in (("symbol_share", "n_symbols", "word_chars"), ("upper_share", "n_upper", "word_chars"), ("digit_share", "n_digits", "word_chars"), ("mark_share", "n_marks", "n_words"), ("mean_word", "word_chars", "n_words"))}
    bad = (ratios["symbol_share"] > 0.05) & (ratios["upper_share"] < 0.2) & (ratios["digit_share"] < 0.2) & (ratios["mark_share"] < 0.7) & (ratios["mean_word"] < 7)
    bad ^= rng.random(3000) < 0.01
    found = rules.learn(ratios, bad, rng.random(3000))
    assert {r.keep for r in found} == {True, False} and not found[-1].keep
    rows = spark.createDataFrame([(i, *(int(v[i]) for v in table.values())) for i in range(3000)], "i int, " + ", ".join(f"{c} long" for c in table))
    got = {r.i: r.kept for r in rows.select("i", rules.expression(found).alias("kept")).collect()}
    for i in range(3000):
        first = next((r for r in found if all(c.holds({k: v[i] for k, v in ratios.items()}) for c in r.conditions)), None)
        assert got[i] == (True if first is None else first.keep)
    assert np.mean([got[i] != bad[i] for i in range(3000)]) > max(0.9, np.mean(~bad) + 0.05)


def test_toxicity_on_held_out_rows(spark, small, docs, odd, none):
    big = spark.read.parquet(small.replace("0.001", "0.01") + "/documents.parquet")
    labels = spark.read.parquet(small.replace("0.001", "0.01") + "/labels.parquet")
    model = toxicity.train(big, labels)
    got = toxicity.score(big, model).join(labels, "doc_id").toPandas()
    held = got[[is_held_out(i, 3, 1) for i in got.doc_id]]
    assert (held.predicted == held.toxic).mean() > 0.93 and held[held.toxic == 0].predicted.mean() < 0.03
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and not r.predicted for r in rows)
    empty = toxicity.train(none.select("doc_id", "text"), labels.limit(0))
    assert all(r.score < 1e-9 for r in toxicity.score(odd, empty).collect())
    assert toxicity.score(none, model).count() == 0


def test_label_model_finds_accuracies_and_discounts_copies():
    rng = np.random.default_rng(2)
    truth = rng.random(4000) < 0.3
    a, b = (np.where(rng.random(4000) < p, truth, rng.random(4000) < 0.05) for p in (0.9, 0.7))
    votes = np.stack([a, b, b], axis=1).astype(float)
    labels = np.where(rng.random(4000) < 0.9, truth, ~truth)
    posterior, found = toxicity.label_model(votes, labels.astype(float))
    assert ((posterior > 0.5) == truth).mean() > (labels == truth).mean() + 0.01 and found["fires1"][0] > found["fires1"][1]
    assert found["discount"][1] < found["discount"][0] and found["correlation"][1, 2] > 0.9


def test_label_model_learns_from_rows_without_labels():
    """Few labels, many rows: rates come near the truth, and a voter that repeats another adds nothing."""
    rng = np.random.default_rng(7)
    truth = rng.random(6000) < 0.3
    own = [np.where(rng.random(6000) < a, truth, rng.random(6000) < 0.1).astype(float) for a in (0.8, 0.75, 0.7, 0.65)]
    labels = np.where(np.arange(6000) < 60, truth, np.nan).astype(float)
    posterior, found = toxicity.label_model(np.stack(own, axis=1), labels)
    few, _ = toxicity.label_model(np.stack(own, axis=1)[:60], labels[:60])
    assert ((posterior > 0.5) == truth)[60:].mean() > 0.9
    assert abs(found["fires1"][0] - own[0][truth].mean()) < 0.05 and abs(found["fires0"][0] - own[0][~truth].mean()) < 0.05
    twice, copied = toxicity.label_model(np.stack([*own, own[3], own[3]], axis=1), labels)
    assert np.abs(twice - posterior).mean() < 0.03 and sorted(copied["discount"])[:2] == pytest.approx([0, 0], abs=0.02)


def test_languages(spark, small, odd, none):
    big = spark.read.parquet(small.replace("0.001", "0.01") + "/documents.parquet")
    model = langid.train(big)
    got = langid.identify(big, model).join(big.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[[is_held_out(i, 4, 2) for i in got.doc_id]]
    assert (held.lang_pred == held.lang).mean() > 0.97
    rows = {r.doc_id: r for r in langid.identify(odd, model).collect()}
    assert all(rows[i].lang_pred == langid.UNKNOWN and rows[i].score == 0 for i in (2, 3, 4)) and rows[1].lang_pred in model.languages
    assert langid.identify(none, model).count() == 0
    assert {r.lang_pred for r in langid.identify(odd, langid.train(none)).collect()} == {langid.UNKNOWN}
    two = {k: next(r.text for r in big.where(F.col("lang") == k).where("n_chars > 600").limit(1).collect()) for k in ("de", "fr")}
    mixed = spark.createDataFrame([(1, two["de"][:500] + " " + two["fr"][:500])], "doc_id long, text string")
    labels = [s.lang for s in langid.spans(mixed, model).collect()[0].spans]
    assert "de" in labels and "fr" in labels and len(labels) <= 4


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.floats(-5, 0), min_size=3, max_size=3), min_size=1, max_size=7), st.floats(0.1, 6))
def test_viterbi_is_the_best_labelling(rows, switch):
    from itertools import product

    scores = np.array(rows)

    def worth(labels):
        return scores[np.arange(len(rows)), labels].sum() - switch * np.count_nonzero(np.diff(labels))

    best = max(worth(np.array(p)) for p in product(range(3), repeat=len(rows)))
    assert math.isclose(worth(langid.viterbi(scores, switch)), best, abs_tol=1e-9)


def test_chat_round_trip_and_trees(spark, small):
    texts = ["<s>[INST] a [/INST]</s>", "\\e \\l\\b \\\\", "", None, "né 😀"]
    rows = spark.createDataFrame([(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(texts)] + [(2, 0, None, "x"), (2, 0, None, "x")], "conv_id long, turn int, role string, text string")
    found = chat.format_paths(chat.linear(rows.withColumn("tree", F.lit(1)).withColumn("id", F.lit(1))))
    got = {r.tree: r for r in found.withColumn("turns", chat.read_back(F.col("formatted"))).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("assistant" if i % 2 else "user", t or "") for i, t in enumerate(texts)]
    assert len(got[2].turns) == 2 and got[2].loss == []
    spans = [got[1].formatted[s.start : s.start + s.length] for s in got[1].loss]
    assert spans == ["\\ee \\el\\eb \\e\\e", ""]
    assert chat.format_paths(chat.linear(rows.limit(0))).count() == 0
    tree = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "bad", 0.1), ("t", 3, 1, "assistant", "good", 0.9), ("t", 4, 3, "user", "more", 0.5), ("t", 5, 4, "assistant", "end", 0.5), ("t", 8, 9, "user", "loop", 1.0), ("t", 9, 8, "user", "loop", 1.0), ("t", 10, 9, "user", "under a loop", 1.0)]
    messages = spark.createDataFrame(tree, "tree string, id int, parent int, role string, text string, score double")
    best = chat.format_paths(messages, branches=5).withColumn("turns", chat.read_back(F.col("formatted"))).orderBy("rank").collect()
    assert [[t.text for t in r.turns] for r in best] == [["q", "good", "more", "end"], ["q", "bad"]]


def test_scores_of_a_model(spark, docs, texts, odd, none):
    model, counts = lm.train(docs)
    got = {r.doc_id: r for r in lm.score(docs, model, counts).collect()}
    seen: Counter = Counter()
    for i, t in texts.items():
        if not is_held_out(i, 7, 2):
            seen.update(blank_words(t))
            seen[b""] += 1
    total, types = sum(seen.values()), len(seen)
    for i, t in texts.items():
        tokens = [*blank_words(t), b""]
        base = sum(math.log10((seen[w] + 1) / (total + types + 1)) for w in tokens)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(tokens), sum(seen[w] > 0 for w in tokens), total)
        assert math.isclose(got[i].base_score, base, rel_tol=1e-9) and got[i].score < 0
    assert np.mean([r.bits_per_byte for r in got.values()]) < 4
    rows = lm.score(odd, model, counts).collect()
    assert lm.score(odd, model, counts).columns == ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]
    assert len(rows) == len(ODD) and all(math.isfinite(r.score) for r in rows)
    blank, blank_counts = lm.train(none)
    assert all(r.train_tokens == 0 and r.base_score == 0 for r in lm.score(odd, blank, blank_counts).collect())
    assert lm.score(none, model, counts).count() == 0


def test_rare_words_meet_their_counts_in_the_join(spark, docs, texts, monkeypatch):
    model, rare = lm.train(docs)
    rows = lm.score(docs, model, rare).collect()
    whole = {r.doc_id: (r.n_known, round(r.base_score, 6)) for r in rows}
    assert len(model.own.frequent) > 1000 and not rare.count()
    monkeypatch.setattr(lm, "FREQUENT", 50)
    few, rare = lm.train(docs)
    assert 0 < len(few.own.frequent) <= 50 and max(r.n for r in rare.collect()) <= min(few.own.frequent.values())
    got = lm.score(docs, few, rare).collect()
    assert {r.doc_id: (r.n_known, round(r.base_score, 6)) for r in got} == whole
    counts = {r.word.encode(): (r.n, r.spelled) for r in rare.collect()}
    for r in got[:40]:
        stream = lm.Stream(pa.array([texts[r.doc_id]], pa.string()), few.own)
        total = float(few.coded(stream).sum())
        for word in stream.rare_words.cast(pa.binary()).to_pylist():
            n, spelled = counts.get(word, (0, None))
            spelled = few.spelling.scores([word], np.zeros(1, bool))[0] if spelled is None else spelled
            total += math.log10((1 - lm.UNIGRAM) * 10**spelled + lm.UNIGRAM * n / few.own.rare)
        assert math.isclose(r.score, total, rel_tol=1e-5)


def toy_model(rng) -> lm.Model:
    frequent = {f"w{i}".encode(): int(n) for i, n in enumerate(rng.integers(1, 500, 40))}
    own = lm.Vocabulary(frequent, 30, sum(frequent.values()) + 30 + 100, 60)
    slots = lm.Tables(14, lm.SPELLING_TABLES).slots
    held, levels = rng.integers(-90, 90, slots).astype(np.int8), rng.integers(0, 16, slots).astype(np.uint8)
    weights = rng.random((lm.GATES, lm.PLACES, lm.K + 1))
    return lm.Model(own, lm.Spelling(own, held, levels, 14, weights), held, levels, 14, weights)


def stream_of(texts: list[list[bytes]], own: lm.Vocabulary) -> lm.Stream:
    return lm.Stream(pa.array([b" ".join(t).decode() for t in texts], pa.string()), own)


def test_words_are_those_of_the_plain_reader(texts):
    some = [*texts.values(), None, "", " ", "\x0b\x0cA\x1fB\u00a0c \u2003D\n", "x" * 70_000, "\u00c9t\u00c9 AZ[`{"]
    words, counts = lm.words_of(pa.array(some, pa.string()))
    assert counts.tolist() == [len(blank_words(t)) for t in some]
    assert words.cast(pa.binary()).to_pylist() == [w for t in some for w in blank_words(t)]
    empty, none = lm.words_of(pa.array([], pa.string()))
    assert len(empty) == 0 and len(none) == 0
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(some))), pa.array(some, pa.string())], names=["i", "text"])
    for size in (1, 5_000, 1 << 30):
        cut = list(lm.pieces(iter([batch]), size))
        assert [i for p in cut for i in p.column(0).to_pylist()] == list(range(len(some)))


def test_a_distribution_adds_up():
    """The probabilities of all symbols at a place add up to one, for any weights and tables."""
    model = toy_model(np.random.default_rng(5))
    first = [[w] for w in model.own.frequent] + [[], [b"unknown"]]
    stream = stream_of(first, model.own)
    assert math.isclose(sum(10 ** model.coded(stream)[stream.starts]), 1, rel_tol=1e-4)
    letters = [bytes([b]) for b in range(256)]
    whole = model.spelling.scores(letters, np.zeros(256, bool))
    blank = [model.spelling.scores([x + b" "], np.zeros(1, bool))[0] - w for x, w in zip(letters, whole, strict=True)]
    assert all(x < 0 for x in blank) and sum(10**whole) < 1


def plain_choices(model: lm.Model | lm.Spelling, stream, i: int, weights: np.ndarray) -> tuple[float, np.ndarray]:
    """log10 of one symbol's probability, one choice at a time, and the change that it asks of the weights."""
    where, code = lm.Tables(model.bits, stream.narrower), stream.code
    symbol, total, gate, change = int(stream.symbols[i]), 0.0, None, np.zeros_like(weights)
    first = int(code.first[symbol])
    for j in range(first, first + int(code.lengths[symbol])):
        slots = [((int(stream.bases[k][i]) + int(code.nodes[j])) % (1 << 32) >> int(where.shifts[k])) + int(where.firsts[k]) for k in range(len(stream.bases))]
        x = np.array([*([float(code.plain[j])] if stream.plain else []), *(float(model.held[s]) for s in slots), 1.0])
        if gate is None:
            gate = int(lm.GATE[16 * int(model.levels[slots[-2]]) + int(model.levels[slots[-1]])])
        place, bit = int(code.places[j]), int(code.bits[j])
        p = 1 / (1 + math.exp(-min(12.0, max(-12.0, float(weights[gate, place] @ x)))))
        total += math.log10(p if bit else 1 - p)
        change[gate, place] += np.array([lm.RATE / lm.STEP**2] * lm.K + [lm.BIAS_RATE]) * (bit - p) * x
    return total, change


def test_scores_are_those_of_one_choice_at_a_time_and_of_each_text_alone():
    rng = np.random.default_rng(6)
    model = toy_model(rng)
    words = [*model.own.frequent, b"rare", "s\u00e9ldom".encode()]
    texts = [[words[i] for i in rng.integers(0, len(words), n)] for n in (0, 1, 30, 33, 200)]
    stream = stream_of(texts, model.own)
    together = model.coded(stream)
    for k, own_words in enumerate(texts):
        own = together[stream.starts[k] : stream.starts[k] + stream.sizes[k]]
        alone = stream_of([own_words], model.own)
        weights, want = model.weights.reshape(lm.GATES, lm.PLACES, lm.K + 1).astype(float), []
        for b in range(0, len(own), lm.BLOCK):
            told = [plain_choices(model, alone, i, weights) for i in range(b, min(b + lm.BLOCK, len(own)))]
            want += [t for t, _ in told]
            weights = weights + sum(c for _, c in told)
        assert np.allclose(own, want, rtol=1e-3, atol=1e-4)
        assert np.allclose(own, model.coded(alone), rtol=1e-5)
    spelling, some = model.spelling, [b"a", b"rare", "s\u00e9ldom".encode(), b"x" * 300]
    weights, spelled = spelling.weights.reshape(lm.GATES, lm.PLACES, lm.K + 1).astype(float), lm.Spelled(some, model.own)
    want = [sum(plain_choices(spelling, spelled, i, weights)[0] for i in range(a, a + n)) for a, n in zip(spelled.starts, spelled.sizes, strict=True)]
    assert np.allclose(spelling.scores(some, np.zeros(4, bool)), want, rtol=1e-3)


def tables_of(own: lm.Vocabulary, bits: int, streams: list) -> tuple[np.ndarray, np.ndarray]:
    where = lm.Tables(bits, streams[0].narrower)
    counts = np.zeros(2 * where.slots, np.uint32)
    for stream in streams:
        lm.count_into(counts, where, stream)
    pairs = counts.reshape(-1, 2)
    assert counts.sum() > 0
    return lm.logits(pairs[:, 0], pairs[:, 1]), lm.levels_of(pairs.sum(axis=1))


def test_tables_count_what_the_texts_hold(spark):
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 60, n)) for n in (0, 5, 300, 40)] + [None]
    own = toy_model(rng).own
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    shared = spark.sparkContext.broadcast(own)
    held, levels, bits = lm.tables(df, shared, 1 << 12)
    want = tables_of(own, bits, [lm.Stream(pa.array(texts, pa.string()), own)])
    slots = lm.Tables(bits, lm.WORD_TABLES).slots
    assert (held[:slots] == want[0]).all() and (levels[:slots] == want[1]).all()
    words = spark.createDataFrame([(f"word{i}",) for i in range(50)], "word string").repartition(3)
    held, levels, bits = lm.tables(words, shared, 400, "word", True)
    want = tables_of(own, bits, [lm.Spelled([f"word{i}".encode() for i in range(50)], own)])
    slots = lm.Tables(bits, lm.SPELLING_TABLES).slots
    assert (held[:slots] == want[0]).all() and (levels[:slots] == want[1]).all()
    assert lm.table_bits(1) == lm.LEAST_BITS < lm.table_bits(1 << 22) < lm.table_bits(1 << 40) == lm.MOST_BITS


def test_a_counted_word_is_spelled_as_if_it_had_not_been():
    own = toy_model(np.random.default_rng(9)).own
    words = ["alpha", "alphabet", "beta", "gamma", "omega"]
    weights = np.full((lm.GATES, lm.PLACES, lm.K + 1), 0.3)
    whole = lm.Spelling(own, *tables_of(own, 14, [lm.Spelled([w.encode() for w in words], own)]), 14, weights)
    for w in words:
        others = lm.Spelling(own, *tables_of(own, 14, [lm.Spelled([x.encode() for x in words if x != w], own)]), 14, weights)
        assert math.isclose(whole.scores([w.encode()], np.ones(1, bool))[0], others.scores([w.encode()], np.zeros(1, bool))[0], rel_tol=0.02)


@pytest.mark.parametrize("weights", [[1], [5, 1], [1, 1, 1, 1, 1], list(range(1, 40)), [10**9, 1, 1, 2]])
def test_codes_are_prefix_free_and_complete(weights):
    lengths = lm.code_lengths(weights)
    code = lm.Code(lengths, np.array(weights))
    ones = [sum(w for w, f, n in zip(weights, code.first, lengths, strict=True) if code.bits[f] == b) for b in (0, 1)]
    assert code.plain[0] == lm.logits(np.float64(ones[0]), np.float64(ones[1]))
    words = ["".join(map(str, code.bits[f : f + n])) for f, n in zip(code.first, lengths, strict=True)]
    assert len(weights) == 1 or math.isclose(sum(0.5 ** len(w) for w in words), 1)
    assert not any(a != b and b.startswith(a) for a in words for b in words) and len(set(words)) == len(words)
