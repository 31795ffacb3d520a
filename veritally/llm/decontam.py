"""Benchmark decontamination by winnowed fingerprints.

Every run of ``NGRAM + WINDOW - 1 = 10`` words keeps the hash of its least 5-word gram, on both sides, so that a
document and a benchmark item which share ten consecutive words share a kept fingerprint at the same place of that
run. Fingerprints are joined; each hit is extended over equal words along its diagonal and counts if it spans a
whole window. Items of fewer than ten words are one window of their own length and are joined by the hash of all
their words. All hits are verified on the words themselves.

The benchmark is a stated query set. Up to ``BROADCAST_BYTES`` of text, measured before each run, its index is
broadcast and joined inside the scan of the documents, without a shuffle. The index takes some 65 times the text, so
that the bound stands for 130 MB in the driver and in each worker. A larger benchmark is joined by Spark on the
fingerprints, of the sizes that its items have; documents are known by a row number of their own, and what one shares
with many items is verified in blocks of items. Both give the same rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_BYTES, arrow_schema, cut_lineage, filter_texts, keep, map_arrow, text_groups

NGRAM, WINDOW = 5, 6
#: Words of a whole window.
SPAN = NGRAM + WINDOW - 1
BROADCAST_BYTES = 2 << 20
#: Beyond that: items that a document is verified against at once, and parts that the rows of a fingerprint are dealt out to.
ITEMS, SALTS = 64, 8
#: Entries of the table that passes over most hashes before they are looked up.
SIEVE = 1 << 20

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_PLACE = [np.uint64((2 * i + 1) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF) for i in range(SPAN)]
_powers: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    keep("decontam.powers", _powers.clear)
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 21)
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, p)]), dtype=np.uint64) for p in (_P, _P_INVERSE)]
    return _powers[0], _powers[1]


class Words:
    """The words of several texts: their hashes, and where each text's words begin."""

    def __init__(self, texts: Iterable[str | None]):
        self.parts = [(t or "").encode().translate(ALNUM_BYTES) for t in texts]
        data = np.frombuffer(b" ".join(self.parts) + b" ", np.uint8)
        inside = data != 0x20
        edges = np.flatnonzero(np.diff(np.concatenate([[False], inside]).astype(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        up, down = _powers_to(len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(np.where(inside, data, 0).astype(np.uint64) * up[: len(data)], out=sums[1:])
        self.hashes = _mix((sums[ends] - sums[starts]) * down[starts])
        sizes = np.array([len(p) + 1 for p in self.parts], np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        self.begins = np.searchsorted(starts, offsets)  # word number at which each text begins; the last is their number
        self.counts = np.diff(self.begins)

    def of(self, i: int) -> list[bytes]:
        return self.parts[i].split()

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the n words from each word on, and whether they are all of one text."""
        size = len(self.hashes)
        if size < n:
            return np.empty(0, np.uint64), np.empty(0, bool)
        sums = np.zeros(size - n + 1, np.uint64)
        for i in range(n):
            sums += self.hashes[i : size - n + 1 + i] * _PLACE[i]
        ends = np.repeat(self.begins[1:], self.counts)[: size - n + 1]
        return _mix(sums), np.arange(size - n + 1) + n <= ends

    def winnowed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """5-gram hashes; the least of each window of ten words; whether those are all of one text."""
        grams, _ = self.grams(NGRAM)
        n = len(grams) - WINDOW + 1
        if n <= 0:
            return grams, np.empty(0, np.uint64), np.empty(0, bool)
        least = grams[:n].copy()
        for i in range(1, WINDOW):
            np.minimum(least, grams[i : n + i], out=least)
        ends = np.repeat(self.begins[1:], self.counts)[:n]
        return grams, least, np.arange(n) + SPAN <= ends

    def kept(self, windows: np.ndarray, grams: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Places of the least hashes of these windows, each once; the last place of equal ones."""
        at = windows.copy()
        for i in range(1, WINDOW):
            at = np.where(grams[windows + i] == least[windows], windows + i, at)
        return np.unique(at)


class Index:
    """Fingerprints of benchmark items, with where they stand."""

    def __init__(self, items: list[tuple[str, str | None]]):
        self.items = [item for item, _ in items]
        words = Words(t for _, t in items)
        self.words = [words.of(i) for i in range(len(items))]
        owner = np.repeat(np.arange(len(items)), words.counts)
        grams, least, whole = words.winnowed()
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for at in words.kept(np.flatnonzero(whole), grams, least).tolist():
            item = int(owner[at])
            self.places[int(grams[at])].append((item, at - int(words.begins[item])))
        self.short: dict[int, dict[int, list[int]]] = {}
        for n in sorted({len(w) for w in self.words if 0 < len(w) < SPAN}):
            hashes, _ = words.grams(n)
            found: dict[int, list[int]] = defaultdict(list)
            for i, w in enumerate(self.words):
                if len(w) == n:
                    found[int(hashes[words.begins[i]])].append(i)
            self.short[n] = dict(found)
        self.places = dict(self.places)
        self.sieve = self._sieve(self.places)
        self.short_sieves = {n: self._sieve(x) for n, x in self.short.items()}

    @staticmethod
    def _sieve(hashes: Iterable[int]) -> np.ndarray:
        table = np.zeros(SIEVE, bool)
        table[np.fromiter(hashes, np.uint64) & np.uint64(SIEVE - 1)] = True
        return table

    def candidates(self, words: Words) -> dict[int, list[tuple[int, int]]]:
        """By text: (place of a fingerprint, its number of words; 0 for a 5-gram) that the index has too."""
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        mask = np.uint64(SIEVE - 1)
        grams, least, whole = words.winnowed()
        windows = np.flatnonzero(whole & self.sieve[least & mask])
        hits = [(words.kept(windows, grams, least), grams, self.places, 0)]
        for n, table in self.short.items():
            hashes, whole = words.grams(n)
            hits.append((np.flatnonzero(whole & self.short_sieves[n][hashes & mask]), hashes, table, n))
        for places, hashes, table, n in hits:
            owner = np.searchsorted(words.begins, places, side="right") - 1
            for at, key, i in zip(places.tolist(), hashes[places].tolist(), owner.tolist(), strict=True):
                if key in table:
                    found[i].append((at - int(words.begins[i]), n))
        return found

    def spans(self, words: list[bytes], hashes: np.ndarray, hits: list[tuple[int, int]], short_hashes) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged spans of hit words, and the items that hit."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        done: dict[tuple[int, int], int] = {}
        for at, n in hits:
            if n:
                for item in self.short[n][short_hashes(n, at)]:
                    if words[at : at + n] == self.words[item]:
                        spans.append((at, at + n))
                        items.add(self.items[item])
                continue
            for item, place in self.places[int(hashes[at])]:
                if done.get((item, at - place), -1) > at:
                    continue
                own = self.words[item]
                a, b = at, place
                while a and b and words[a - 1] == own[b - 1]:
                    a, b = a - 1, b - 1
                c, d = at, place
                while c < len(words) and d < len(own) and words[c] == own[d]:
                    c, d = c + 1, d + 1
                done[item, at - place] = max(c, at + 1)
                if c - a >= SPAN:
                    spans.append((a, c))
                    items.add(self.items[item])
        merged: list[tuple[int, int]] = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        return merged, items

    def scan(self, texts: list[str | None]) -> dict[str, list]:
        """Columns n_words, spans and items of some texts."""
        words = Words(texts)
        out: dict[str, list] = {"n_words": words.counts.tolist(), "spans": [[]] * len(texts), "items": [[]] * len(texts)}
        found = self.candidates(words)
        if found:
            grams, _ = words.grams(NGRAM)
            tables = {n: words.grams(n)[0] for n in self.short}
            for i, hits in found.items():
                begin = int(words.begins[i])
                spans, items = self.spans(words.of(i), grams[begin:], hits, lambda n, at, b=begin: int(tables[n][b + at]))
                out["spans"][i] = [{"first": a, "after": b} for a, b in spans]
                out["items"][i] = sorted(items)
        return out


COLUMNS = "n_words long, spans array<struct<first:int,after:int>>, items array<string>"


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(key, n_words, spans, items) of every document: the word spans that lie inside an occurrence of a window of
    a benchmark item, and the sorted names of the items with occurring windows.

    Null and empty texts have no words; items without words and repeated items add nothing; an item with a null
    name is called ''. Repeated documents give a row each. Empty tables give empty results.
    """
    queries, size = _queries(benchmark, item, item_text)
    own = docs.select(F.col(key), F.col(text).alias("text"))
    if size <= broadcast_bytes:
        return _by_broadcast(own, queries, key)
    rows = _numbered(own)
    prints, hits = _by_join(rows, queries, ROW, "text")
    none = [F.expr(f"cast(array() as {t})") for t in ("array<struct<first:int,after:int>>", "array<string>")]
    full = rows.drop("text").join(prints.select(ROW, "n_words"), ROW).join(hits, ROW, "left")
    return full.select(key, "n_words", F.coalesce("spans", none[0]).alias("spans"), F.coalesce("items", none[1]).alias("items"))


def _queries(benchmark: DataFrame, item: str, item_text: str) -> tuple[DataFrame, int]:
    """(item, item_text), each once, and the bytes of all texts."""
    queries = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(item_text).alias("item_text")).where("item_text is not null").distinct()
    return queries, queries.agg(F.sum(F.octet_length("item_text"))).first()[0] or 0


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The documents without any hit, with all their columns; null and repeated keys are as good as any other."""
    queries, size = _queries(benchmark, item, item_text)
    if size > broadcast_bytes:
        rows = _numbered(docs)
        _, hits = _by_join(rows, queries, ROW, text)
        return rows.join(hits.select(ROW), ROW, "left_anti").select(*docs.columns)
    index = docs.sparkSession.sparkContext.broadcast(Index([(r.item, r.item_text) for r in queries.collect()]))
    return filter_texts(docs, lambda texts: [not spans for spans in index.value.scan(texts)["spans"]], text)


#: A column of our own.
ROW = "_decontam_row"


def _numbered(docs: DataFrame) -> DataFrame:
    """The documents with a row number, written once, so that a lost executor can't number them anew."""
    return cut_lineage(docs.withColumn(ROW, F.monotonically_increasing_id()))


def _by_broadcast(docs: DataFrame, queries: DataFrame, key: str) -> DataFrame:
    import pyarrow as pa

    index = docs.sparkSession.sparkContext.broadcast(Index([(r.item, r.item_text) for r in queries.collect()]))
    ddl = f"`{key}` {docs.schema[key].dataType.simpleString()}, {COLUMNS}"
    arrow = arrow_schema(docs.sparkSession, ddl)

    def run(batches):
        for keys, texts in text_groups(batches):
            columns = {key: keys} | index.value.scan(texts)
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in arrow], schema=arrow)

    return map_arrow(docs, run, ddl)


def _fingerprints(df: DataFrame, key: str, text: str, sizes: list[int] | None = None) -> DataFrame:
    """(key, n_words, prints) with the distinct prints (size, fp) of a text: winnowed 5-grams (size 0) and all grams of the sizes.

    Without sizes those of an item: of its own length where that is shorter than a window.
    """
    import pyarrow as pa

    ddl = f"`{key}` {df.schema[key].dataType.simpleString()}, n_words long, prints array<struct<size:int,fp:long>>"
    arrow = arrow_schema(df.sparkSession, ddl)

    def run(batches):
        for keys, texts in text_groups(batches):
            words = Words(texts)
            grams, least, whole = words.winnowed()
            sets = [(0, words.kept(np.flatnonzero(whole), grams, least), grams)]
            for n in range(1, SPAN) if sizes is None else sizes:
                hashes, whole = words.grams(n)
                places = np.flatnonzero(whole)
                if sizes is None:
                    places = places[words.counts[np.searchsorted(words.begins, places, side="right") - 1] == n]
                sets.append((n, places, hashes))
            parts = []
            for n, places, hashes in sets:
                owner = np.searchsorted(words.begins, places, side="right") - 1
                if len(places):
                    pairs = np.unique(np.stack([owner.astype(np.uint64), hashes[places]]), axis=1)
                    parts.append((pairs[0].astype(np.int64), np.full(pairs.shape[1], n, np.int32), pairs[1].view(np.int64)))
            owners, kinds, found = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64))
            order = np.argsort(owners, kind="stable")
            edges = np.searchsorted(owners[order], np.arange(len(texts) + 1))
            prints = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.StructArray.from_arrays([pa.array(kinds[order], pa.int32()), pa.array(found[order], pa.int64())], ["size", "fp"]))
            yield pa.RecordBatch.from_arrays([pa.array(keys, arrow.field(0).type), pa.array(words.counts, pa.int64()), prints.cast(arrow.field(2).type)], schema=arrow)

    return map_arrow(df.select(key, text), run, ddl)


def _by_join(rows: DataFrame, queries: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(key, n_words, prints) of all rows, and (key, spans, items) of those with a hit; for a benchmark beyond the broadcast bound."""
    import pyarrow as pa

    named = cut_lineage(queries.withColumn("number", F.monotonically_increasing_id()))
    tests = cut_lineage(_fingerprints(named, "number", "item_text").select("number", F.inline("prints")))
    sizes = sorted(r["size"] for r in tests.where("size > 0").select("size").distinct().collect())
    prints = cut_lineage(_fingerprints(rows, key, text, sizes))
    dealt = prints.select(key, F.inline("prints")).withColumn("salt", F.pmod(F.col(key), F.lit(SALTS)))
    pairs = cut_lineage(dealt.join(tests.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["size", "fp", "salt"]).select(key, "number").distinct())
    blocks = pairs.groupBy(key).agg(F.ceil(F.count("*") / ITEMS).alias("blocks"))
    placed = pairs.join(blocks, key).select(key, "number", F.pmod(F.xxhash64("number"), F.col("blocks")).alias("block"))
    units = placed.join(named, "number").groupBy(key, "block").agg(F.collect_list(F.struct("item", "item_text")).alias("tests"))
    ddl = f"`{key}` long, spans array<struct<first:int,after:int>>, items array<string>"
    arrow = arrow_schema(rows.sparkSession, ddl)

    def run(batches):
        for batch in batches:
            for name, value, tests in zip(*batch.columns, strict=True):
                found = Index([(t["item"], t["item_text"]) for t in tests.as_py()]).scan([value.as_py()])
                if found["spans"][0]:
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()], arrow.field(0).type), pa.array(found["spans"], arrow.field(1).type), pa.array(found["items"], arrow.field(2).type)], schema=arrow)

    met = cut_lineage(map_arrow(units.join(rows.select(key, F.col(text).alias("_text")), key).select(key, "_text", "tests"), run, ddl))
    spans = F.array_sort(F.flatten(F.collect_list("spans")))
    gathered = met.groupBy(key).agg(spans.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def merge(done, span):
        last = F.element_at(done, -1)
        apart = (F.size(done) == 0) | (F.get(done, F.size(done) - 1)["after"] < span["first"])
        longer = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(last["first"].alias("first"), F.greatest(last["after"], span["after"]).alias("after"))))
        return F.when(apart, F.concat(done, F.array(span))).otherwise(longer)

    none = F.expr("cast(array() as array<struct<first:int,after:int>>)")
    return prints, gathered.select(key, F.aggregate("spans", none, merge).alias("spans"), "items")


def digests(found: DataFrame) -> DataFrame:
    """n_hit, n_items, items_sha256 and contaminated from spans and items."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["after"] - s["first"]))
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


ORACLE_SQL = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), sized AS (SELECT item_id, w, least(len(w), 10) AS n FROM items WHERE len(w) > 0),
tests AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS key FROM (SELECT item_id, n, w, unnest(generate_series(1, len(w) - n + 1)) AS s FROM sized)),
sizes AS (SELECT DISTINCT n FROM sized),
grams AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS key FROM (SELECT doc_id, n, w, unnest(generate_series(1, len(w) - n + 1)) AS s FROM docs, sizes WHERE len(w) >= n)),
hits AS (SELECT DISTINCT doc_id, s, n, item_id FROM grams JOIN tests USING (n, key)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM hits) GROUP BY doc_id),
names AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS named FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(named, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN words USING (doc_id) LEFT JOIN names USING (doc_id)
"""
