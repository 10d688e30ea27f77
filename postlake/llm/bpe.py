"""Byte-level BPE: encoding by length-bucketed padded matrices, and decoding.

Texts are cut by the tokenizer's pattern.  The distinct pieces of a batch go
into numpy matrices, one per length bucket; in every round each row merges its
leftmost pair of minimum rank, pairs being looked up in an open-addressing hash
table; finished rows and unused columns are then compacted away.  Pieces longer
than the last bucket (one run of thousands of letters, say) use the same merge
rule with a heap, in O(n log n) instead of O(n^2).

Defined results: a null text counts as empty and has no ids; an empty text
likewise; bytes that are no UTF-8 are replaced by U+FFFD, as a decoder does.
Each row is encoded on its own.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.llm.common import chunks, map_arrow

NO_RANK = np.int32(2**31 - 1)
BUCKETS = (4, 8, 16, 32, 64, 128, 256)
CELLS = 1 << 20  # of one matrix
CACHED_BYTES = 24 << 20  # of pieces, with their ids, that a task remembers
OVERHEAD = 160  # bytes of a remembered piece besides its text and ids

SCHEMA = "doc_id bigint, ids array<int>, decoded binary"


class Vocabulary:
    """Ranks read from a file with a base64 token and its rank per line."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        size = max(self.ranks.values()) + 1
        parts = [b""] * size
        for token, rank in self.ranks.items():
            parts[rank] = token
        self.parts = parts
        self.lengths = np.array([len(x) for x in parts], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.data = np.frombuffer(b"".join(parts), np.uint8)
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self._pairs()

    def _pairs(self) -> None:
        """The hash table of all pairs of tokens that make a token."""
        ranks = self.ranks
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NO_RANK, np.int32)
        key, value = np.array(keys, np.int64), np.array(values, np.int32)
        slot = self._slot(key)
        while len(key):
            free = self.keys[slot] == -1
            first = np.zeros(len(key), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = free & first
            self.keys[slot[put]], self.values[slot[put]] = key[put], value[put]
            key, value, slot = key[~put], value[~put], (slot[~put] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the merged pairs; NO_RANK where there is none or a side is padding."""
        out = np.full(left.shape, NO_RANK, np.int32)
        at = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        key = left.ravel()[at].astype(np.int64) << 32 | right.ravel()[at]
        slot = self._slot(key)
        flat = out.ravel()
        while len(at):
            held = self.keys[slot]
            same = held == key
            flat[at[same]] = self.values[slot[same]]
            on = ~same & (held != -1)
            at, key, slot = at[on], key[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return flat.reshape(left.shape)

    def merge_matrix(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Ids of each piece, as the bytes of 32-bit integers."""
        n = len(pieces)
        lengths = np.array([len(x) for x in pieces])
        tokens = np.full((n, width), -1, np.int32)
        inside = np.arange(width) < lengths[:, None]
        tokens[inside] = self.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
        pairs = self.lookup(tokens[:, :-1], tokens[:, 1:])
        out: list[bytes] = [b""] * n
        row = np.arange(n)
        while len(row):
            at = pairs.argmin(axis=1)
            rank = pairs[np.arange(len(row)), at]
            done = rank == NO_RANK
            for i in np.flatnonzero(done):
                out[row[i]] = tokens[i, :lengths[i]].tobytes()
            if done.any():  # compaction of rows and columns
                keep = ~done
                row, tokens, pairs, lengths, at, rank = (x[keep] for x in (row, tokens, pairs, lengths, at, rank))
                if not len(row):
                    break
                width = int(lengths.max())
                tokens, pairs = tokens[:, :width], pairs[:, :width - 1]
            each, last = np.arange(len(row)), tokens.shape[1] - 1
            tokens[each, at] = rank
            # Every column right of the merged pair moves one to the left.
            move = np.arange(last) + (np.arange(last) > at[:, None])
            tokens = np.concatenate(
                [np.take_along_axis(tokens, move, 1), np.full((len(row), 1), -1, np.int32)], axis=1)
            move = np.minimum(np.arange(last) + (np.arange(last) > at[:, None]), last - 1)
            moved = np.take_along_axis(pairs, move, 1)
            moved[:, -1] = NO_RANK
            pairs = moved
            lengths = lengths - 1
            pairs[each, at] = self.lookup(tokens[each, at], tokens[each, np.minimum(at + 1, last)])
            before = np.flatnonzero(at > 0)
            pairs[before, at[before] - 1] = self.lookup(tokens[before, at[before] - 1], tokens[before, at[before]])
        return out

    def merge_long(self, piece: bytes) -> bytes:
        """The same merges for one long piece, with a heap of (rank, place)."""
        ids = self.bytes[np.frombuffer(piece, np.uint8)]
        n = len(ids)
        first = self.lookup(ids[:-1], ids[1:])
        heap = [(int(r), int(i)) for i, r in enumerate(first) if r != NO_RANK]
        heapq.heapify(heap)
        parts, ids = self.parts, ids.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        current = [int(r) for r in first] + [int(NO_RANK)]
        ranks = self.ranks

        def renew(i: int) -> None:
            j = after[i]
            rank = ranks.get(parts[ids[i]] + parts[ids[j]]) if j < n else None
            current[i] = int(NO_RANK) if rank is None else rank
            if rank is not None:
                heapq.heappush(heap, (rank, i))

        while heap:
            rank, i = heapq.heappop(heap)
            if ids[i] < 0 or current[i] != rank:
                continue
            j = after[i]
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            renew(i)
            if before[i] >= 0:
                renew(before[i])
        return np.array([x for x in ids if x >= 0], np.int32).tobytes()

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            rank = self.ranks.get(piece)
            if rank is not None:
                out[i] = np.int32(rank).tobytes()
            elif len(piece) > BUCKETS[-1]:
                out[i] = self.merge_long(piece)
            else:
                buckets.setdefault(next(b for b in BUCKETS if len(piece) <= b), []).append(i)
        for width, members in buckets.items():
            step = CELLS // width
            for start in range(0, len(members), step):
                part = members[start:start + step]
                for i, ids in zip(part, self.merge_matrix([pieces[i] for i in part], width)):
                    out[i] = ids
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids: one gather over the joined tokens."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        if not len(ids):
            return b""
        shift = np.repeat(self.starts[ids] - (ends - lengths), lengths)
        return self.data[np.arange(ends[-1]) + shift].tobytes()


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=4)
def splitter(pattern: str):
    return regex.compile(pattern).findall


class Pieces:
    """Ids of the pieces seen so far, forgotten beyond a number of bytes."""

    def __init__(self, vocab: Vocabulary, pattern: str, limit: int = CACHED_BYTES):
        self.vocab, self.split, self.limit = vocab, splitter(pattern), limit
        self.known: dict[str, bytes] = {}
        self.size = 0

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text, as the bytes of 32-bit integers."""
        cut = [self.split(x) for x in texts]
        new = list(set().union(*cut).difference(self.known))
        coded = self.vocab.encode_pieces([x.encode("utf-8") for x in new])
        self.known.update(zip(new, coded))
        self.size += sum(map(len, new)) + sum(map(len, coded)) + OVERHEAD * len(new)
        out = [b"".join(map(self.known.__getitem__, pieces)) for pieces in cut]
        if self.size > self.limit:
            self.known.clear()
            self.size = 0
        return out


def encode_texts(texts: list[str], path: str, pattern: str) -> list[bytes]:
    """Ids of every text, as the bytes of 32-bit integers."""
    return Pieces(vocabulary(path), pattern).encode(texts)


def encode_decode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                  with_decoded: bool = True) -> DataFrame:
    """One row per input row: the id column, ``ids`` and (``with_decoded``) the
    bytes decoded from them.  ``path`` names the rank file on every executor.
    One map-only pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        pieces = Pieces(vocab, pattern)
        for batch in chunks(batches, "text"):
            texts = [(x or b"").decode("utf-8", "replace") for x in batch.column("text").to_pylist()]
            coded = pieces.encode(texts)
            ends = np.cumsum([0, *(len(x) // 4 for x in coded)]).astype(np.int32)
            flat = np.frombuffer(b"".join(coded), np.int32)
            decoded = [vocab.decode(flat[a:b]) if with_decoded else None for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                 pa.array(decoded, pa.binary())], names=["doc_id", "ids", "decoded"])

    narrow = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return map_arrow(narrow, run, SCHEMA)
