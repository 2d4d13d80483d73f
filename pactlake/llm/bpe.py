"""Byte-level BPE by monoid tree reduction.

Every match of the pre-tokeniser's pattern is encoded by itself. Token
sequences of adjacent byte strings form a monoid: :meth:`Tokenizer.encode_bytes`
encodes the halves of a piece recursively, down to single bytes, and
:meth:`Tokenizer.join` combines neighbours by re-encoding a window around the
seam. The window grows, one side at a time,
until the pairs of tokens across its edges are stable, that is until encoding
the bytes of each such pair gives the pair itself.

That is enough for the whole: BPE always merges the leftmost pair of lowest
rank, so the merges inside any stretch of tokens come in the order in which
they come when the stretch is encoded alone. If no merge crosses the seam of
any adjacent pair when the pair is alone, none ever crosses it in the sequence.
Hence a sequence whose adjacent pairs are all stable is the encoding of its
bytes. (Ranks must encode each token's bytes to that token, as BPE training
yields; the tests check every token.) Windows are merged by :meth:`Tokenizer.merge`,
pair by pair; no tokenizer library takes part.

Decoding concatenates the tokens' bytes up a balanced tree.

Edge cases: a null or empty text has no tokens, and its digests are those of
the empty string; texts of any length are cut at the pattern's matches, never
truncated; bytes that the ranks do not have raise ``KeyError``; repeated rows
repeat their results; a null ``doc_id`` stays null; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

_CACHED = 1 << 18  # pieces, parts and windows of each kind remembered by a worker
_SHORT = 16  # bytes of a part or window that is remembered
_NAIVE = 48  # bytes up to which pairs are searched without a heap


class Tokenizer:
    """Ranks and pattern of a byte-level BPE vocabulary in tiktoken's text format."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self._pieces: dict[str, bytes] = {}
        self._stable: dict[tuple[int, int], bool] = {}
        self._parts: dict[bytes, list[int]] = {}
        self._recent: dict[int, list[tuple[bytes, list[int]]]] = {}
        self._windows: dict[bytes, list[int]] = {}

    def merge(self, data: bytes) -> list[int]:
        """The encoding of a byte string: of all adjacent parts the pair of lowest rank merges, the leftmost first."""
        if len(data) > _NAIVE:
            return self._merge_long(data)
        ranks = self.ranks
        whole = ranks.get(data)
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                return [ranks[part] for part in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [whole] if parts else []

    def _merge_long(self, data: bytes) -> list[int]:
        """:meth:`merge` with a heap of pairs over a linked list of parts, in ``n log n`` steps."""
        n, rank_of = len(data), self.ranks.get
        end = list(range(1, n + 1))  # of the part that begins here; 0 if none does
        before = list(range(-1, n))  # where the part before begins
        heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := rank_of(data[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, stop = heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != stop:
                continue  # one of the two parts has grown or gone
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
                if (rank := rank_of(data[i : end[stop]])) is not None:
                    heappush(heap, (rank, i, end[stop]))
            k = before[i]
            if k >= 0 and (rank := rank_of(data[k:stop])) is not None:
                heappush(heap, (rank, k, stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[data[i : end[i]]])
            i = end[i]
        return out

    def window(self, data: bytes) -> list[int]:
        """:meth:`merge`, remembered: the same few bytes meet at many seams."""
        known = self._windows.get(data)
        if known is None:
            known = self.merge(data)
            if len(data) <= _SHORT:
                if len(self._windows) >= _CACHED:
                    self._windows.clear()
                self._windows[data] = known
        return known

    def stable(self, a: int, b: int) -> bool:
        """Whether the bytes of two tokens encode to these two."""
        known = self._stable.get((a, b))
        if known is None:
            if len(self._stable) >= _CACHED:
                self._stable.clear()
            known = self._stable[a, b] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def encode_bytes(self, data: bytes, depth: int = 0) -> list[int]:
        """Halves first, then their seam; a single byte is a token.

        Short parts are remembered, and the last two longer ones of each depth: a
        rule of one character is halved into equal parts. No caller changes a result.
        """
        if len(data) < 2:
            return [self.ranks[data]] if data else []
        known = self._parts.get(data)
        if known is None:
            recent = self._recent.setdefault(depth, []) if len(data) > _SHORT else []
            known = next((ids for part, ids in recent if part == data), None)
        if known is None:
            half = len(data) // 2
            known = self.join(self.encode_bytes(data[:half], depth + 1), self.encode_bytes(data[half:], depth + 1))
            if len(data) <= _SHORT:
                if len(self._parts) >= _CACHED:
                    self._parts.clear()
                self._parts[data] = known
            else:
                recent[:] = [(data, known), *recent[:1]]
        if not depth:
            self._recent.clear()
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of two encodings, one after the other."""
        if not left or not right:
            return left or right
        if self.stable(left[-1], right[0]):
            return left + right
        i = j = 1  # the window: so many tokens on each side of the seam
        while True:
            window = self.window(self.decode(left[-i:]) + self.decode(right[:j]))
            grow_left = i < len(left) and not self.stable(left[-i - 1], window[0])
            grow_right = j < len(right) and not self.stable(window[-1], right[j])
            if not grow_left and not grow_right:
                return left[:-i] + window + right[j:]
            i = min(len(left), 4 * i) if grow_left else i
            j = min(len(right), 4 * j) if grow_right else j

    def decode(self, ids: list[int]) -> bytes:
        """Concatenation up the tree: halves first, then their bytes."""
        if len(ids) <= 4096:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])

    def _piece(self, piece: str) -> bytes:
        packed = np.array(self.encode_bytes(piece.encode()), "<u4").tobytes()
        if len(piece) <= 64:
            if len(self._pieces) >= _CACHED:
                self._pieces.clear()
            self._pieces[piece] = packed
        return packed

    def encode_packed(self, text: str) -> bytes:
        """Ids of a whole text as little-endian 32-bit integers."""
        known, piece = self._pieces.get, self._piece
        return b"".join([known(p) or piece(p) for p in self.pattern.findall(text)])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()


@lru_cache(maxsize=4)
def tokenizer(path: str, pattern: str) -> Tokenizer:
    return Tokenizer(path, pattern)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of whole texts, encoded and decoded again.

    ``path`` names the vocabulary file, which every executor must have.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                counts, ids, decoded = [], [], []
                for text in part.column(1).to_pylist():
                    packed = bpe.encode_packed(text or "")
                    counts.append(len(packed) // 4)
                    ids.append(hashlib.sha256(packed).hexdigest())
                    decoded.append(hashlib.sha256(bpe.decode(np.frombuffer(packed, "<u4").tolist())).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts, pa.int64()), pa.array(ids), pa.array(decoded)],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_column(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids`` of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [bpe.encode(text or "") for text in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode_column(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; bytes that are no UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for batch in batches:
            texts = [None if ids is None else bpe.decode(ids).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")
