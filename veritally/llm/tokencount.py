"""Token counts by compiled finite-state transducers.

Two deterministic machines are compiled from a byte-level BPE tokenizer file.

*Splitter.* The pre-tokenizer's pattern becomes a transducer over character classes. A transition says before
which of the last three characters a piece starts, so that the pattern's look-ahead needs no back-tracking. A
stream of texts is cut into chunks of a fixed width, wherever that falls. Each chunk's map from every entry state
to its exit state is computed for all chunks in lockstep; the maps are composed by a parallel prefix scan, which
gives each chunk its true entry state, and a second lockstep pass reads off the starts of pieces.

*Counter.* Byte-pair merging inside a piece becomes a transducer over bytes whose transitions carry the change in
the number of emitted tokens. It rests on the fact that a sequence of tokens is what merging yields if and only if
each neighbouring pair survives merging by itself: so each prefix of a piece has one last token, found from the
last tokens of shorter prefixes. A state is what can still matter of those: the suffixes that begin some longer token,
with the last token and the relative count where each starts. States are compiled when first met; a piece is
linear in its length, however long; a long one goes by chunks whose maps from entry to exit state, with the tokens
emitted, are kept and composed. A piece begins in the first state whatever came before: its map is a constant, so
that the prefix scan over the pieces of a stream is a cumulative sum. Counts of whole pieces are kept in a bounded table.

The file must be of the kind that is compiled here, or an error tells what differs.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, map_texts

#: The contractions that the pre-tokenizer's pattern splits off.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")

LETTER, NUMBER, BLANK, SPACE, OTHER, APOSTROPHE, ENDS, R, V, L, E, STOP = range(12)
N_CLASSES = 12
LETTERS = (LETTER, ENDS, R, V, L, E)
START, IN_LETTERS, IN_NUMBERS, IN_OTHER, ONE_BLANK, ONE_SPACE, RUN_BLANK, RUN_SPACE, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L, DONE = range(13)
N_STATES = 13
HERE, ONE_BACK = 1, 2

#: Ends a text in the stream; no text from Spark has a lone surrogate.
SENTINEL = "\ud800"
CHUNK = 256
#: Bounds of a worker's tables.
MAX_PIECES = 400_000
MAX_STATES = 300_000
MAX_PAIRS = 600_000
MAX_MAPS = 20_000
#: Bytes of a chunk of a long piece.
PIECE_CHUNK = 64


def _fresh(kind: int) -> int:
    """The state after the first character of a piece."""
    if kind in LETTERS:
        return IN_LETTERS
    return {NUMBER: IN_NUMBERS, BLANK: ONE_BLANK, SPACE: ONE_SPACE, OTHER: IN_OTHER, APOSTROPHE: QUOTE, STOP: START}[kind]


def _step(state: int, kind: int) -> tuple[int, int]:
    """(next state, starts): HERE for a piece that starts at this character, ONE_BACK for one at the character before."""
    white = kind in (BLANK, SPACE)
    pending = {QUOTE_R: E, QUOTE_V: E, QUOTE_L: L}
    if state in pending:
        if kind == pending[state]:
            return DONE, 0
        after, starts = _step(IN_LETTERS, kind)
        return after, starts | ONE_BACK
    if kind == STOP:
        return START, HERE
    if state == IN_LETTERS and kind in LETTERS or state == IN_NUMBERS and kind == NUMBER:
        return state, 0
    if state in (IN_OTHER, QUOTE) and kind in (OTHER, APOSTROPHE):
        return IN_OTHER, 0
    if state == QUOTE and kind in (ENDS, R, V, L):
        return {ENDS: DONE, R: QUOTE_R, V: QUOTE_V, L: QUOTE_L}[kind], 0
    if state in (ONE_BLANK, ONE_SPACE, RUN_BLANK, RUN_SPACE):
        if white:
            return (RUN_BLANK if kind == BLANK else RUN_SPACE), 0
        joined = IN_OTHER if kind == APOSTROPHE else _fresh(kind)
        if state == ONE_BLANK:
            return joined, 0
        if state == RUN_BLANK:
            return joined, ONE_BACK
        return _fresh(kind), HERE | (ONE_BACK if state == RUN_SPACE else 0)
    return _fresh(kind), HERE


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of each code point; next state and starts by class and state."""
    import regex

    kinds = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", SPACE)):
        for m in regex.finditer(pattern, every):
            a, b = ord(m[0][0]), ord(m[0][-1])
            kinds[a : b + 1] = kind
    kinds[0xD800:0xE000] = OTHER
    kinds[ord(" ")], kinds[ord("'")], kinds[ord(SENTINEL)] = BLANK, APOSTROPHE, STOP
    for c in "stmd":
        kinds[ord(c)] = ENDS
    for c, kind in (("r", R), ("v", V), ("l", L), ("e", E)):
        kinds[ord(c)] = kind
    steps = [[_step(s, k) for s in range(N_STATES)] for k in range(N_CLASSES)]
    return kinds, np.array([[a for a, _ in r] for r in steps], np.uint8), np.array([[b for _, b in r] for r in steps], np.uint8)


def piece_starts(stream: str) -> np.ndarray:
    """Positions in the stream at which pieces start; each sentinel is a piece."""
    kinds, after, starts = _tables()
    codes = np.frombuffer(stream.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(codes)
    chunks = -(-n // CHUNK)
    rows = np.full(chunks * CHUNK, STOP, np.uint8)
    rows[:n] = kinds[codes]
    columns = np.ascontiguousarray(rows.reshape(chunks, CHUNK).T.astype(np.uint16) * N_STATES)
    after, starts = after.ravel(), starts.ravel()
    maps = np.broadcast_to(np.arange(N_STATES, dtype=np.uint8), (chunks, N_STATES))
    for column in columns:
        maps = after[column[:, None] + maps]
    width = 1
    while width < chunks:  # parallel prefix scan: maps[i] becomes the map of the chunks 0..i
        maps = np.concatenate([maps[:width], np.take_along_axis(maps[width:], maps[:-width].astype(np.intp), 1)])
        width *= 2
    state = np.concatenate([np.array([START], np.uint8), maps[:-1, START]])
    told = np.empty((CHUNK, chunks), np.uint8)
    for i, column in enumerate(columns):
        at = column + state
        told[i] = starts[at]
        state = after[at]
    told = told.T.ravel()[:n]
    begins = (told & HERE) != 0
    begins[:-1] |= (told[1:] & ONE_BACK) != 0
    return np.flatnonzero(begins)


@lru_cache(maxsize=1)
def _plain_tables() -> tuple[bytes, list[list[int]], list[list[int]]]:
    kinds, after, starts = _tables()
    return kinds.tobytes(), after.tolist(), starts.tolist()


def split_short(text: str) -> list[str]:
    """The pieces of one short text, by the same transducer a character at a time."""
    kinds, after, starts = _plain_tables()
    state, edges = START, []
    for i, c in enumerate(text):
        kind = kinds[ord(c)]
        told = starts[kind][state]
        state = after[kind][state]
        if told & ONE_BACK:
            edges.append(i - 1)
        if told & HERE:
            edges.append(i)
    if starts[STOP][state] & ONE_BACK:
        edges.append(len(text) - 1)
    edges.append(len(text))
    return [text[a:b] for a, b in zip(edges, edges[1:], strict=False)]


class BpeCounter:
    """The lazily compiled counting transducer of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _check(spec)
        letters = byte_letters()
        model = spec["model"]
        plain = {t["content"] for t in spec["added_tokens"]}
        self.specials = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.ids = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if t not in plain}
        self.merges: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            a, b = model["vocab"][left], model["vocab"][right]
            self.merges[a, b] = rank
            self.parts.setdefault(model["vocab"][left + right], (a, b, rank))
        self.begins = {t[:i] for t in self.ids for i in range(len(t))}
        self.pairs: dict[int, bool] = {}
        self.spines: dict[tuple[int, int], list[tuple[int, float]]] = {}
        self.pieces: dict[str, int] = {SENTINEL: 0}
        self._reset()

    def _reset(self) -> None:
        self.maps: dict[bytes, dict[int, tuple[int, int]]] = {}
        self.states: list[tuple] = [((b"", -1, 0),)]
        self.numbers = {self.states[0]: 0}
        self.moves: list[dict[int, tuple[int, int]]] = [{}]

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens along one edge of a token's merge tree, each with the rank of the merge that consumes it."""
        if (token, side) not in self.spines:
            found, at, until = [], token, float("inf")
            while True:
                found.append((at, until))
                if at not in self.parts:
                    break
                until, at = self.parts[at][2], self.parts[at][side]
            self.spines[token, side] = found
        return self.spines[token, side]

    def _stays(self, left: int, right: int) -> bool:
        """True if merging the two tokens' bytes yields these two tokens: no merge across the joint comes in time.

        Of two equal merges the left one is done first, hence < on the left edge and <= on the right one.
        """
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            get = self.merges.get
            known = not any((rank := get((a, b))) is not None and rank < ua and rank <= ub for a, ua in self._spine(left, 1) for b, ub in self._spine(right, 0))
            if len(self.pairs) > MAX_PAIRS:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        """The transition for a byte: (next state, tokens emitted, which may be negative)."""
        letter = bytes((byte,))
        ids, begins = self.ids, self.begins
        live, emitted = [], None
        for suffix, last, count in self.states[state]:
            longer = suffix + letter
            if emitted is None:
                token = ids.get(longer)
                if token is not None and (last < 0 or self._stays(last, token)):
                    ended, emitted = token, count + 1
            if longer in begins:
                live.append((longer, last, count))
        if emitted is None:
            raise ValueError("the vocabulary lacks a byte")
        key = (*[(suffix, last, count - emitted) for suffix, last, count in live], (b"", ended, 0))
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
        move = self.moves[state][byte] = (number, emitted)
        return move

    def _walk(self, state: int, data: bytes) -> tuple[int, int]:
        """The state after these bytes, and the tokens emitted."""
        moves, total = self.moves, 0
        for byte in data:
            move = moves[state].get(byte) or self._compile(state, byte)
            state = move[0]
            total += move[1]
        return state, total

    def piece(self, text: str) -> int:
        """Tokens of one piece. A long one is cut in chunks; a chunk's map from entry state to exit state and tokens is kept
        for the states met, and the maps are composed along the piece."""
        if len(self.states) > MAX_STATES or len(self.maps) > MAX_MAPS:
            self._reset()
        data = text.encode()
        if len(data) <= 2 * PIECE_CHUNK:
            return self._walk(0, data)[1]
        state = total = 0
        for i in range(0, len(data), PIECE_CHUNK):
            chunk = data[i : i + PIECE_CHUNK]
            known = self.maps.setdefault(chunk, {})
            if state not in known:
                known[state] = self._walk(state, chunk)
            state, emitted = known[state]
            total += emitted
        return total

    def count(self, texts: list[str | None]) -> list[int]:
        """Tokens of each whole text; special strings inside a text are one token each."""
        segments: list[str] = []
        ends, extra = [], []
        size = 0
        for text in texts:
            parts = [text or ""]
            for special in self.specials:
                parts = [p for part in parts for p in part.split(special)]
            extra.append(len(parts) - 1)
            segments += parts
            size += sum(map(len, parts)) + len(parts)
            ends.append(size)
        stream = SENTINEL.join(segments) + SENTINEL
        starts = piece_starts(stream)
        edges = starts.tolist()
        edges.append(len(stream))
        pieces = [stream[a:b] for a, b in zip(edges, edges[1:], strict=False)]
        known = self.pieces
        counts = list(map(known.get, pieces))
        if None in counts:
            if len(known) > MAX_PIECES:
                known = self.pieces = {SENTINEL: 0}
            for i, c in enumerate(counts):
                if c is None:
                    piece = pieces[i]
                    c = known.get(piece)
                    if c is None:
                        c = self.piece(piece)
                        if len(piece) <= 64:
                            known[piece] = c
                    counts[i] = c
        sums = np.concatenate([[0], np.cumsum(np.array(counts, np.int64))])
        at = np.concatenate([[0], np.searchsorted(starts, ends)])
        return (np.diff(sums[at]) + np.array(extra)).tolist()


def _check(spec: dict) -> None:
    """Raise for a file whose steps are others than byte-level pre-tokenizing with the usual pattern, and plain BPE."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    wrong = {
        "model": model.get("type", "BPE") != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")),
        "normalizer": spec.get("normalizer") is not None,
        "pre_tokenizer": before.get("type") != "ByteLevel" or before.get("add_prefix_space", False) or not before.get("use_regex", True),
        "added_tokens": any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens", [])),
    }
    if any(wrong.values()):
        raise ValueError(f"not compiled here: {', '.join(k for k, v in wrong.items() if v)}")


def byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write each byte as one letter: printable Latin-1 as it is, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


@kept
def counter(path: str) -> BpeCounter:
    return BpeCounter(path)


def count_tokens(df: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens) of every row: a map over whole texts without a shuffle.

    ``tokenizer_path`` is read by each worker. Null and empty texts have 0 bytes and tokens; repeated rows are
    counted each; other columns are ignored. Equal keys stay separate rows.
    """

    def work(keys: list, texts: list[str | None]) -> dict[str, list]:
        return {key: keys, "n_bytes": [len((t or "").encode()) for t in texts], "n_tokens": counter(tokenizer_path).count(texts)}

    kind = df.schema[key].dataType.simpleString()
    return map_texts(df, work, f"`{key}` {kind}, n_bytes long, n_tokens long", key, text)


def over_limit(counts: DataFrame, limit: int = 1024) -> DataFrame:
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
