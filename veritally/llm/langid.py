"""Languages of mixed texts: script ranges narrow the candidates, Viterbi over per-word scores labels spans.

Words end at blanks and marks of any script and where the script changes; runs without blanks are cut in stretches that
share their n-grams (``pieces``). A word's script, from fixed ranges of code points, leaves the languages that were seen in that script. Among these a
word scores by its character n-grams, with the log-probabilities of a naive Bayes model. The best labelling of all
words pays ``SWITCH`` for each change of language. Where no stretch of words gains more than that price by another
language, and no beginning and end together do, one label is a best labelling: an inner stretch of k runs costs k + 1
changes, one at an end k, and a labelling without that label at all one less than its runs. This is found with vector
operations alone; the other texts go through the full recursion.

*Support.* The share of a text's n-grams that any language has tells text from junk of letters. The least support of a
known text is read off the labelled sample: half of what all but one in a thousand of its texts have.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_right
from collections import Counter, defaultdict
from functools import lru_cache
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_BYTES, arrow_schema, cut_lineage, filter_texts, held_out, map_arrow, map_texts, release, text_groups

UNKNOWN = "und"
#: Price of a change of language, in nats.
SWITCH = 12.0
#: Documents of each language that the model is fitted on, about; n-grams kept of each language.
TRAINING_DOCS = 1_000
KEPT_NGRAMS = 60_000
NGRAM_SIZES = (2, 3, 4)
#: Most that one word may say for a language over another.
WORD_CAP = 8.0
#: Letters of a stretch, and up to how many letters a word stays whole; in scripts written without blanks, those of a stretch.
STRETCH, WHOLE = 16, 40
UNSPACED = {"han", "kana", "thai", "other"}
MAX_WORDS = 250_000
#: Words whose n-grams are looked up at once.
LEARNED = 4_096
#: Share of labelled texts under whose support the floor is set, and at what part of it.
OUTLIERS, FLOOR = 0.001, 0.5

#: First code points of script ranges, by Unicode blocks.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"),
    (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"),
    (0xA000, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB10, "other"),
    (0x20000, "han"), (0x30000, "other"),
]
_SCRIPT_STARTS = [a for a, _ in SCRIPTS]


def script(letters: str) -> str:
    """The script of a word's first letter outside ASCII, else of its first letter."""
    if letters.isascii():
        return "latin"
    c = next((c for c in letters if c > "\x7f"), letters[0])
    return SCRIPTS[bisect_right(_SCRIPT_STARTS, ord(c)) - 1][1]


def letters_of(word: bytes) -> str:
    text = word.decode().lower()
    return text if text.isalpha() else "".join(c for c in text if c.isalpha())


@lru_cache(maxsize=1 << 16)
def _kind(c: str) -> str:
    """Of a character: '' for a blank or mark, ' ' for what belongs to any script, else its script."""
    if c.isalpha():
        return SCRIPTS[bisect_right(_SCRIPT_STARTS, ord(c)) - 1][1]
    category = unicodedata.category(c)
    return "" if category[0] in "ZPS" or category == "Cc" else " "


def pieces(word: bytes) -> list[bytes]:
    """A word split at blanks and marks outside ASCII and at changes of script; long runs in stretches of ``STRETCH`` letters.

    A stretch is its letters, a null byte and the next letters, so that every n-gram of the run begins in one stretch.
    """
    if word.isascii() and len(word) <= WHOLE:
        return [word]
    runs: list[list[str]] = [[]]
    current = ""
    for c in word.decode():
        kind = _kind(c)
        if not kind or current and kind != " " and kind != current:
            runs.append([])
            current = ""
        if kind:
            runs[-1].append(c)
            current = kind if kind != " " else current
    out = []
    for run in filter(None, map("".join, runs)):
        letters = letters_of(run.encode())
        if len(letters) <= (STRETCH if script(letters or run) in UNSPACED else WHOLE):
            out.append(run.encode())
            continue
        padded = f" {letters} "
        edges = [0, *range(STRETCH, len(letters) - STRETCH // 2, STRETCH), len(padded)]
        out += [f"{padded[a:b]}\0{padded[b : b + max(NGRAM_SIZES) - 1]}".encode() for a, b in zip(edges, edges[1:], strict=False)]
    return out


def words_of(text: str | None) -> list[bytes]:
    """The words that are labelled: runs of ASCII letters, digits and characters outside ASCII, in their pieces."""
    return [p for w in (text or "").encode().translate(ALNUM_BYTES).split() for p in pieces(w)]


def features_of(piece: bytes) -> str:
    """What a piece is counted and scored by: its letters, or a stretch as it is, in lower case."""
    return piece.decode() if b"\0" in piece else letters_of(piece)


def weight_of(features: str) -> int:
    return len(features.partition("\0")[0].strip(" "))


def ngrams(letters: str) -> list[str]:
    core, cut, after = letters.partition("\0")
    if cut:
        padded = core + after
        return [padded[i : i + n] for n in NGRAM_SIZES for i in range(min(len(core), len(padded) - n + 1))]
    padded = f" {letters} "
    return [padded[i : i + n] for n in NGRAM_SIZES for i in range(len(padded) - n + 1)] + [f"={letters}"]


class Model:
    """Languages, their scripts, and log-probabilities of n-grams by language."""

    def __init__(self, counts: dict[str, Counter]):
        """``counts``: by language, its words with their numbers."""
        self.languages = sorted(counts)
        grams: list[Counter] = []
        self.scripts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(self.languages), bool))
        for k, language in enumerate(self.languages):
            own: Counter = Counter()
            seen: Counter = Counter()
            for letters, n in counts[language].items():
                seen[script(letters.partition("\0")[0].strip(" ") or letters)] += n
                for g in ngrams(letters):
                    own[g] += n
            for s, n in seen.items():
                if n >= 0.001 * seen.total():
                    self.scripts[s][k] = True
            grams.append(Counter(dict(own.most_common(KEPT_NGRAMS))))
        self.scripts = dict(self.scripts)
        totals = [max(1, g.total()) for g in grams]
        table = {g: i for i, g in enumerate(sorted(set().union(*grams)))}
        logs = np.log(np.array([[own[g] + 0.5 for g in table] for own in grams]).reshape(len(grams), len(table)).T / (np.array(totals) + 0.5))
        self.logs = np.zeros((len(table) + 1, len(grams)), np.float32)  # the last is that of what no language has
        self.logs[:-1] = logs - logs.max(axis=1, initial=-np.inf, keepdims=True)
        self.whole = {g[1:]: i for g, i in table.items() if g[0] == "="}
        self._index({g: i for g, i in table.items() if g[0] != "="})
        self.floor = 0.0
        self.words: dict[bytes, int] = {}  # -1: a word in pieces
        self.pieces: dict[bytes, list[bytes]] = {}
        self._clear()

    def _clear(self) -> None:
        self.words.clear()
        self.pieces.clear()
        self.scored = 0
        self.scores = np.zeros((1024, len(self.languages)), np.float32)
        self.weights = np.zeros(1024, np.float32)
        self.grams = np.zeros((1024, 2), np.float32)  # n-grams of each word, and those that any language has

    def _index(self, table: dict[str, int]) -> None:
        """Characters as numbers from 1 on; by size, n-grams and beginnings of longer ones as sorted keys, and their rows.

        A key is the place of all characters but the last among the shorter keys, and the last character's number.
        """
        letters = sorted(set().union(*table))
        self.numbers = np.zeros(ord(letters[-1]) + 2 if letters else 1, np.int64)
        self.numbers[[ord(c) for c in letters]] = range(1, len(letters) + 1)
        self.base = len(letters) + 1
        places = {c: i for i, c in enumerate(letters, 1)}
        self.keys: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in NGRAM_SIZES:
            known = {g[:n]: places[g[: n - 1]] * self.base + self.numbers[ord(g[n - 1])] for g in table if len(g) >= n}
            own = sorted(known, key=known.get)
            places = {g: i for i, g in enumerate(own)}
            self.keys[n] = np.array([known[g] for g in own], np.int64), np.array([table.get(g, len(self.logs) - 1) for g in own] + [len(self.logs) - 1], np.int64)

    def _rows(self, features: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``logs`` of all ``ngrams`` of several words, in their order, and how many each word has."""
        parts = [x.partition("\0") for x in features]
        padded = [core + after if cut else f" {core} " for core, cut, after in parts]
        sizes = np.array(list(map(len, padded)))
        starts = np.array([len(core) if cut else n for (core, cut, _), n in zip(parts, sizes.tolist(), strict=True)])
        codes = np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32)
        numbers = self.numbers.take(np.minimum(codes, len(self.numbers) - 1))
        begins = np.cumsum(sizes) - sizes
        owners = np.repeat(np.arange(len(sizes)), sizes)
        inside = np.arange(len(codes)) - begins.take(owners)
        left = np.where(inside < starts.take(owners), sizes.take(owners) - inside, 0)
        counts = [np.maximum(np.minimum(starts, sizes - n + 1), 0) for n in NGRAM_SIZES] + [np.array([not cut for _, cut, _ in parts], np.int64)]
        first = np.cumsum(sum(counts)) - sum(counts)
        rows, before = np.empty(int(sum(counts).sum()), np.int64), numbers
        for n, count in zip(NGRAM_SIZES, counts, strict=False):
            keys, own = self.keys[n]
            at = np.flatnonzero(left >= n)
            asked = before[at] * self.base + numbers[at + n - 1]
            found = np.searchsorted(keys, asked)
            if len(keys):
                found[keys.take(np.minimum(found, len(keys) - 1)) != asked] = len(keys)
            before = np.zeros(len(codes), np.int64)
            before[at] = found
            rows[(first.take(owners[at]) + inside[at])] = own.take(found)
            first = first + count
        none = len(self.logs) - 1
        rows[first[counts[-1] > 0]] = [self.whole.get(core, none) for core, cut, _ in parts if not cut]
        return rows, sum(counts)

    def _learn(self, words: list[bytes]) -> None:
        """Score new words."""
        for w in words:
            if not (w.isascii() and len(w) <= WHOLE) and b"\0" not in w and (own := pieces(w)) != [w]:
                self.words[w] = -1
                self.pieces[w] = own
        if self.pieces:
            words = [w for w in words if w not in self.pieces]
        for i in range(0, len(words), LEARNED):
            self._score(words[i : i + LEARNED])

    def _score(self, words: list[bytes]) -> None:
        first, n = self.scored, len(words)
        self.scored += n
        while first + n > len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.weights = np.concatenate([self.weights, np.zeros_like(self.weights)])
            self.grams = np.concatenate([self.grams, np.zeros_like(self.grams)])
        letters = [features_of(w) for w in words]
        self.words.update(zip(words, range(first, first + n), strict=True))
        self.weights[first : first + n] = list(map(weight_of, letters))
        some = [i for i, x in enumerate(letters) if x]
        if not self.languages or not some:
            return
        rows, sizes = self._rows([letters[i] for i in some])
        at, own = np.cumsum(sizes) - sizes, np.array(some) + first
        filled = sizes > 0
        self.grams[own, 0] = sizes
        self.grams[own[filled], 1] = np.add.reduceat((rows < len(self.logs) - 1).astype(np.int64), at[filled])
        sums = np.zeros((n, len(self.languages)), np.float64)
        sums[own[filled] - first] = np.add.reduceat(self.logs.take(rows, axis=0), at[filled], axis=0)
        sums = np.maximum(sums - sums.max(axis=1, keepdims=True), -WORD_CAP)
        scripts = {k: np.where(v, 0.0, -np.inf) for k, v in self.scripts.items()}
        latin = np.array([x.isascii() and "\0" not in x for x in letters]) & (self.weights[first : first + n] > 0)
        if "latin" in scripts:
            sums[latin] = np.maximum(sums[latin] + scripts["latin"], -WORD_CAP)
        for i in np.flatnonzero(~latin).tolist():
            x = letters[i]
            if x and (allowed := scripts.get(script(x.partition("\0")[0].strip(" ") or x))) is not None:
                sums[i] = np.maximum(sums[i] + allowed, -WORD_CAP)
        self.scores[first : first + n] = sums

    def meet(self, lists: list[list[bytes]]) -> None:
        """Score the new words of several texts together."""
        words = dict.fromkeys(chain.from_iterable(lists))
        new = [w for w in words if w not in self.words]
        if len(self.words) + len(new) > MAX_WORDS and self.words:
            self._clear()
            new = list(words)
        self._learn(new)

    def numbered(self, words: list[bytes]) -> np.ndarray:
        known = list(map(self.words.get, words))
        if None in known:
            self._learn(list(dict.fromkeys(w for w, n in zip(words, known, strict=True) if n is None)))
            known = list(map(self.words.__getitem__, words))
        numbers = np.array(known, np.int64)
        if self.pieces and (numbers < 0).any():
            return self.numbered([p for w in words for p in self.pieces.get(w, (w,))])
        return numbers

    def label(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The language number of each word in the best labelling, and the words' letters; those of ``words_of`` where a word has pieces."""
        if len(self.words) > MAX_WORDS:
            self._clear()
        numbers = self.numbered(words)
        scores, weights = self.scores[numbers], self.weights[numbers]
        if not len(numbers) or not self.languages:
            return np.zeros(len(numbers), np.int64), weights
        sums = scores.cumsum(axis=0, dtype=np.float64)
        best = int(sums[-1].argmax())
        gains = np.vstack([np.zeros(len(self.languages)), sums - sums[:, best : best + 1]])
        inner = (gains - np.minimum.accumulate(gains, axis=0)).max()
        if inner <= SWITCH and gains.max() + (gains[-1] - gains).max() <= SWITCH:
            return np.full(len(numbers), best), weights
        return viterbi(scores.astype(np.float64), SWITCH), weights

    def support(self, text: str | None) -> float:
        """The share of a text's n-grams that any language has; 0 without letters."""
        numbers = self.numbered((text or "").encode().translate(ALNUM_BYTES).split())
        every, known = self.grams[numbers].sum(axis=0, dtype=np.float64)
        return float(known / every) if every else 0.0

    def keeps(self, text: str | None) -> bool:
        """Whether a text has a language and support enough; where nothing could be learned, whether it has letters."""
        if not self.languages:
            return any(map(letters_of, words_of(text)))
        return self.predict(text)[0] != UNKNOWN and self.support(text) >= self.floor

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language with most letters in the labelled spans, and its share of all letters."""
        return self.told((text or "").encode().translate(ALNUM_BYTES).split())

    def told(self, words: list[bytes]) -> tuple[str, float]:
        """What ``predict`` says of a text with these words."""
        labels, weights = self.label(words)
        total = float(weights.sum())
        if not total or not self.languages:
            return UNKNOWN, 0.0
        shares = np.bincount(labels, weights, len(self.languages))
        return self.languages[int(shares.argmax())], min(1.0, float(shares.max()) / total)


def viterbi(scores: np.ndarray, switch: float) -> np.ndarray:
    """The labels with the greatest sum of scores less ``switch`` for each change."""
    n, k = scores.shape
    came = np.empty((n, k), np.int8)
    own = list(range(k))
    at = scores[0].tolist()
    rows = scores.tolist()
    for i in range(1, n):
        top = max(at)
        lead = at.index(top)
        floor = top - switch
        came[i] = [j if at[j] >= floor else lead for j in own]
        at = [(a if a >= floor else floor) + s for a, s in zip(at, rows[i], strict=True)]
    labels = np.empty(n, np.int64)
    labels[-1] = label = at.index(max(at))
    for i in range(n - 1, 0, -1):
        label = came[i, label]
        labels[i - 1] = label
    return labels


def train(df: DataFrame, training_docs: int = TRAINING_DOCS, key: str = "doc_id", text: str = "text", lang: str = "lang", modulus: int = 4, remainder: int = 2) -> Model:
    """Fit on whole texts of a sample, by a hash of the key, of about ``training_docs`` rows of each language.

    Rows whose crc32 leaves the remainder, and rows without language or text, are never learned from. Of rows that are
    copies of each other all are drawn or none.
    """
    own = df.select(F.col(key), F.col(text), F.col(lang))
    usable = own.where(~held_out(F.col(key), modulus, remainder) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = usable.groupBy(lang).agg(F.count("*").alias("rows"))
    drawn = F.pmod(F.xxhash64(F.col(key).cast("string"), text), F.lit(1 << 20)) / (1 << 20)
    sample = cut_lineage(usable.join(F.broadcast(sizes), lang).where(drawn < F.lit(float(training_docs)) / F.col("rows")).select(F.col(lang).alias("lang"), F.col(text).alias("text")))
    import pyarrow as pa

    def count(batches):
        found: Counter = Counter()
        for langs, texts in text_groups(batches):
            for lang, text in zip(langs, texts, strict=True):
                found.update((lang, w) for w in text.encode().translate(ALNUM_BYTES).split())
        words: Counter = Counter()
        for (lang, word), n in found.items():
            for letters in map(features_of, pieces(word)):
                if letters:
                    words[lang, letters] += n
        yield pa.RecordBatch.from_pydict({"lang": [k for k, _ in words], "word": [w for _, w in words], "n": list(words.values())})

    counts: dict[str, Counter] = defaultdict(Counter)
    summed = map_arrow(sample, count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    for batch in summed.to_batches(10_000):
        for lang, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            counts[lang][word] = n
    model = Model(dict(counts))
    del summed, counts
    release()
    shared = df.sparkSession.sparkContext.broadcast(model)
    supports = map_texts(sample, lambda langs, texts: {"lang": langs, "support": [shared.value.support(t) for t in texts]}, "lang string, support double", "lang")
    usual = supports.where("support > 0").agg(F.percentile_approx("support", OUTLIERS)).first()[0]
    model.floor = FLOOR * (usual or 0.0)
    return model


def identify(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) of every whole text: the language with most letters in the labelled spans, and its share.

    ``und`` and 0 where the text is null or has no letter, or nothing was learned. Ties go to the first language in
    the alphabet. A repeated row is a row of its own.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def work(keys: list, texts: list[str | None]) -> dict[str, list]:
        lists = [(t or "").encode().translate(ALNUM_BYTES).split() for t in texts]
        shared.value.meet(lists)
        found = list(map(shared.value.told, lists))
        return {key: keys, "lang_pred": [lang for lang, _ in found], "score": [share for _, share in found]}

    return map_texts(df, work, f"`{key}` {df.schema[key].dataType.simpleString()}, lang_pred string, score double", key, text)


def known(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows whose text has a language and support enough; all with letters if none could be learned."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    return filter_texts(df, lambda texts: [shared.value.keeps(t) for t in texts], text)


def spans(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans) with spans of (first word, word after, language) over ``words_of`` every text; none without letters."""
    import pyarrow as pa

    shared = df.sparkSession.sparkContext.broadcast(model)
    ddl = f"`{key}` {df.schema[key].dataType.simpleString()}, spans array<struct<first:int,after:int,lang:string>>"
    arrow = arrow_schema(df.sparkSession, ddl)

    def run(batches):
        own = shared.value
        for keys, texts in text_groups(batches):
            out = []
            for t in texts:
                labels, weights = own.label((t or "").encode().translate(ALNUM_BYTES).split())
                if not weights.sum() or not own.languages:
                    out.append([])
                    continue
                edges = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist(), len(labels)]
                out.append([{"first": a, "after": b, "lang": own.languages[int(labels[a])]} for a, b in zip(edges, edges[1:], strict=False)])
            yield pa.RecordBatch.from_arrays([pa.array(keys, arrow.field(0).type), pa.array(out, arrow.field(1).type)], schema=arrow)

    return map_arrow(df.select(key, text), run, ddl)
