"""BPE encoding and decoding with reuse of content-defined chunks.

A text is cut where a rolling hash of its last bytes has a given form, so that passages shared by several documents
are cut alike, whatever stands before them. A chunk is encoded once and kept in a bounded table: pieces of the
pre-tokenizer with the tokens of each. The chunks' tokens are then joined. Near a joint they may differ from those
of the whole text; the joint is repaired by encoding a window around it again. The window starts a few pieces before
the joint, at a place where a piece starts for certain, and reaches over so many pieces of the next chunk until a new
piece starts where one of that chunk's own does. From an agreed start on, splitting goes on alike, so that all
further tokens of the chunk are exact.

Sharing is within a worker's table. Sharing across workers would need each chunk's text and tokens in a shuffle.
"""

from __future__ import annotations

import hashlib
import os
from array import array

import numpy as np
from pyspark.sql import DataFrame

from .common import kept, map_arrow, map_texts
from .tokencount import SENTINEL, byte_letters, piece_starts, split_short

#: Mean bytes of a chunk: a power of two. Bytes that the rolling hash covers.
CHUNK_BYTES = 1024
HASHED_BYTES = 16
#: Bounds of a worker's tables: pieces, and characters in chunks. Longer pieces are encoded each time anew.
MAX_PIECES = 400_000
MAX_CHUNK_CHARS = 16 << 20
LONG_PIECE = 64
#: Pieces at a chunk's end whose starts may depend on what follows: a contraction is at most two pieces when cut.
UNSETTLED = 3
#: Pieces kept apart at a chunk's two ends, for joints.
EDGE = 16


def _gears() -> np.ndarray:
    """256 mixed 32-bit numbers, by a multiplicative rule."""
    x = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


GEARS = _gears()


def chunks(text: str, mean: int = CHUNK_BYTES) -> list[str]:
    """Cut a text by content; the joined chunks are the text."""
    data = text.encode()
    if len(data) <= HASHED_BYTES:
        return [text] if text else []
    values = np.frombuffer(data, np.uint8)
    rolling = GEARS[values]
    width = 1
    while width < HASHED_BYTES:  # doubling: the sum over a window from the sums over its halves
        rolling[width:] += rolling[:-width] * np.uint32(31**width & 0xFFFFFFFF)
        width *= 2
    cuts = np.flatnonzero((rolling >> np.uint32(7)) & np.uint32(mean - 1) == 0) + 1
    cuts = cuts[(cuts >= HASHED_BYTES) & (cuts < len(data))]
    cuts = cuts[(values[cuts] & 0xC0) != 0x80]  # at starts of characters
    edges = [0, *cuts.tolist(), len(data)]
    return [data[a:b].decode() for a, b in zip(edges, edges[1:], strict=False)]


class Encoded:
    """A chunk's pieces and their tokens; of a long chunk those at its ends, and the tokens between."""

    __slots__ = ("head", "head_tokens", "middle", "tail", "tail_tokens")

    def __init__(self, pieces: list[str], tokens: list[bytes]):
        whole = len(pieces) <= 3 * EDGE
        self.head, self.head_tokens = (pieces, tokens) if whole else (pieces[:EDGE], tokens[:EDGE])
        self.middle = None if whole else b"".join(tokens[EDGE:-EDGE])
        self.tail, self.tail_tokens = ([], []) if whole else (pieces[-EDGE:], tokens[-EDGE:])


class ChunkEncoder:
    """Encodes and decodes as the tokenizers library does, with add_special_tokens=False and skip_special_tokens=False."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.specials = sorted((t.content for t in self.library.get_added_tokens_decoder().values()), key=len, reverse=True)
        letters = byte_letters()
        words = {i: t for t, i in self.library.get_vocab(with_added_tokens=True).items()}
        self.bytes = [b""] * (max(words) + 1)
        for i, t in words.items():
            self.bytes[i] = bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode()
        self.texts = [str(i) for i in range(len(self.bytes))]
        self.kind = np.dtype(np.uint16 if len(self.bytes) <= 1 << 16 else np.uint32)
        self.pieces: dict[str, bytes] = {}
        self.chunks: dict[str, Encoded] = {}
        self.held = 0
        self.reused = self.made = 0

    def plainly(self, texts: list[str]) -> list[bytes]:
        return [array(self.kind.char, x.ids).tobytes() for x in self.library.encode_batch(texts, add_special_tokens=False)]

    def _tokens(self, pieces: list[str]) -> list[bytes]:
        """The tokens of each piece by itself."""
        tokens = list(map(self.pieces.get, pieces))
        if None in tokens:
            missing = list({p for p, t in zip(pieces, tokens, strict=True) if t is None})
            new = dict(zip(missing, self.plainly(missing), strict=True))
            tokens = [new[p] if t is None else t for p, t in zip(pieces, tokens, strict=True)]
            if len(self.pieces) > MAX_PIECES:
                self.pieces.clear()
            self.pieces.update((p, t) for p, t in new.items() if len(p) <= LONG_PIECE)
        return tokens

    def _split(self, texts: list[str]) -> list[list[str]]:
        """The pre-tokenizer's pieces of each text."""
        stream = SENTINEL.join(texts) + SENTINEL
        edges = piece_starts(stream).tolist()
        edges.append(len(stream))
        out: list[list[str]] = []
        last = 0
        pieces = [stream[a:b] for a, b in zip(edges, edges[1:], strict=False)]
        for _ in texts:
            end = pieces.index(SENTINEL, last)
            out.append(pieces[last:end])
            last = end + 1
        return out

    def _encode_chunks(self, texts: list[str]) -> list[Encoded]:
        """Each chunk; those not in the table are encoded together, each once."""
        new = list({t for t in texts if t not in self.chunks})
        self.made += len(new)
        self.reused += len(texts) - len(new)
        made: dict[str, Encoded] = {}
        if new:
            split = self._split(new)
            tokens = self._tokens([p for pieces in split for p in pieces])
            at = 0
            for text, pieces in zip(new, split, strict=True):
                made[text] = Encoded(pieces, tokens[at : at + len(pieces)])
                at += len(pieces)
        found = [made[t] if t in made else self.chunks[t] for t in texts]
        if self.held > MAX_CHUNK_CHARS:
            self.chunks.clear()
            self.held = 0
        self.chunks.update(made)
        self.held += sum(map(len, made))
        return found

    def _join(self, texts: list[str], parts: list[Encoded]) -> bytes:
        """The tokens of the joined chunks."""
        done: list[bytes] = []  # tokens before what may still change
        pieces: list[str] = []
        tokens: list[bytes] = []
        for text, part in zip(texts, parts, strict=True):
            if not pieces:
                pieces, tokens = list(part.head), list(part.head_tokens)
                middle, tail, tail_tokens = part.middle, part.tail, part.tail_tokens
            else:
                reach = UNSETTLED + 1
                left = pieces[-UNSETTLED:]
                before = sum(map(len, left))
                head, head_tokens = part.head, part.head_tokens
                middle, tail, tail_tokens = part.middle, part.tail, part.tail_tokens
                while True:
                    if reach > len(head) and middle is not None:
                        head = self._split([text])[0]
                        head_tokens = self._tokens(head)
                        middle, tail, tail_tokens = None, [], []
                    window = split_short("".join(left) + "".join(head[:reach]))
                    if reach >= len(head) and middle is None:
                        taken, agreed = len(window), len(head)
                        break
                    starts, at = {}, before
                    for i, p in enumerate(head[: reach - UNSETTLED]):
                        starts[at] = i
                        at += len(p)
                    at, agreed = 0, None
                    for taken, p in enumerate(window):
                        if (agreed := starts.get(at)) is not None:
                            break
                        at += len(p)
                    if agreed is not None:
                        break
                    reach *= 2
                done += tokens[:-UNSETTLED]
                pieces = window[:taken] + head[agreed:]
                tokens = self._tokens(window[:taken]) + head_tokens[agreed:]
            if middle is not None:
                done += tokens
                done.append(middle)
                pieces, tokens = list(tail), list(tail_tokens)
        return b"".join(done + tokens)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Token ids of each whole text; special strings inside it are single tokens, as is the library's default."""
        cut = [self._segments(t or "") for t in texts]
        chunked = [[chunks(s) for s in segments] for segments, _ in cut]
        encoded = iter(self._encode_chunks([c for segments in chunked for s in segments for c in s]))
        out = []
        for (_, marks), segments in zip(cut, chunked, strict=True):
            found = b""
            for i, segment in enumerate(segments):
                found += self._join(segment, [next(encoded) for _ in segment])
                if i < len(marks):
                    found += self._tokens([marks[i]])[0]
            out.append(np.frombuffer(found, self.kind))
        return out

    def _segments(self, text: str) -> tuple[list[str], list[str]]:
        """What stands between special strings, and those strings."""
        segments, marks = [text], []
        for special in self.specials:
            cut, kept = [], []
            for i, segment in enumerate(segments):
                parts = segment.split(special)
                cut += parts
                kept += [special] * (len(parts) - 1) + marks[i : i + 1]
            segments, marks = cut, kept
        return segments, marks

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


@kept
def encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def encode(df: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): the token ids of every whole text; null and empty texts have none. A map without a shuffle."""

    def work(keys: list, texts: list[str | None]) -> dict[str, list]:
        return {key: keys, "ids": encoder(tokenizer_path).encode(texts)}

    return map_texts(df, work, f"`{key}` {df.schema[key].dataType.simpleString()}, ids array<int>", key, text)


def encode_digests(df: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of every row: each text is encoded and its ids are decoded again.

    Null and empty texts have no tokens and the digests of the empty string. Repeated rows give one row each.
    """

    def work(keys: list, texts: list[str | None]) -> dict[str, list]:
        own = encoder(tokenizer_path)
        out: dict[str, list] = {key: keys, "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for found in own.encode(texts):
            ids = found.tolist()
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(",".join(map(own.texts.__getitem__, ids)).encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
        return out

    return map_texts(df, work, f"`{key}` {df.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string", key, text)


def decode(df: DataFrame, tokenizer_path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) of every row of ids; null ids give an empty text."""
    import pyarrow as pa

    def run(batches):
        own = encoder(tokenizer_path)
        for batch in batches:
            texts = [own.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return map_arrow(df.select(key, ids), run, f"`{key}` {df.schema[key].dataType.simpleString()}, text string")
