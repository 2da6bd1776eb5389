"""Byte-level BPE over length-bucketed padded matrices.

Each distinct piece of the pre-tokenizer is a row of byte ids. Rows of similar length form a padded matrix; in every round each
row merges its leftmost pair of least rank, found by a hashed pair table, and rows without a pair leave (compaction). A merge
shortens every remaining row by exactly one, so the matrix narrows by a column a round.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.common import slices, tidy

NONE = np.int32(2**31 - 1)
LONG_PIECE = 256
CACHE_PIECES = 100_000
_MODELS: dict[int, BytePairModel] = {}


class BytePairModel:
    """Ranks of a tiktoken file, with a pair table in open addressing and encode/decode of whole arrays."""

    def __init__(self, raw: bytes, pattern: str) -> None:
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in raw.splitlines() if x)}
        self.pattern = regex.compile(pattern)
        size = max(self.ranks.values()) + 1
        if size >= 1 << 31:
            raise ValueError("ranks must fit 31 bits")
        self.bytes_of = [b""] * size
        for k, v in self.ranks.items():
            self.bytes_of[v] = k
        self.length = np.array([len(x) for x in self.bytes_of], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.byte_id = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        left, right, rank = [], [], []
        for token, r in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(r)
        self._table(np.array(left, np.uint64) << np.uint64(32) | np.array(right, np.uint64), np.array(rank, np.int32))
        self.cache: dict[str, tuple[int, ...]] = {}

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _table(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        self.bits = max(4, int(len(keys) * 4).bit_length())
        n = 1 << self.bits
        self.keys, self.vals, self.mask = np.full(n, 2**64 - 1, np.uint64), np.full(n, NONE, np.int32), n - 1
        for k, v, s in zip(keys.tolist(), ranks.tolist(), self._slot(keys).tolist(), strict=True):
            while self.keys[s] != 2**64 - 1:
                s = (s + 1) & self.mask
            self.keys[s], self.vals[s] = k, v

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each merged pair, NONE where there is none; padding (-1) never matches."""
        keys = (left.astype(np.int64).astype(np.uint64) << np.uint64(32) | (right.astype(np.int64) & 0xFFFFFFFF).astype(np.uint64)).ravel()
        out = np.full(keys.shape, NONE, np.int32)
        todo = np.flatnonzero((right.ravel() >= 0) & (left.ravel() >= 0))
        slot = self._slot(keys[todo])
        while len(todo):
            found = self.keys[slot]
            hit = found == keys[todo]
            out[todo[hit]] = self.vals[slot[hit]]
            more = ~hit & (found != 2**64 - 1)
            todo, slot = todo[more], (slot[more] + 1) & self.mask
        return out.reshape(left.shape)

    def encode_matrix(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of pieces of up to LONG_PIECE bytes, a bucket of lengths at a time."""
        out: list[tuple[int, ...]] = [()] * len(pieces)
        size = np.array([len(p) for p in pieces])
        low = 0
        for high in (4, 6, 8, 10, 12, 16, 24, 40, 80, LONG_PIECE):
            rows = np.flatnonzero((size > low) & (size <= high))
            low = high
            for rows in np.array_split(rows, len(rows) * high // 1_000_000 + 1):
                if not len(rows):
                    continue
                m = np.full((len(rows), int(size[rows].max())), -1, np.int32)
                joined = self.byte_id[np.frombuffer(b"".join([pieces[i] for i in rows]), np.uint8)]
                m[np.arange(m.shape[1]) < size[rows][:, None]] = joined
                while len(rows):
                    if m.shape[1] < 2:
                        done = np.ones(len(rows), bool)
                    else:
                        rank = self.pair_ranks(m[:, :-1], m[:, 1:])
                        at = rank.argmin(axis=1)
                        best = rank[np.arange(len(rows)), at]
                        done = best == NONE
                    for i, row in zip(rows[done].tolist(), m[done].tolist(), strict=True):
                        out[i] = tuple(x for x in row if x >= 0)
                    if done.all():
                        break
                    go = ~done
                    rows, m, at, best = rows[go], m[go], at[go], best[go]
                    r = np.arange(len(rows))
                    m[r, at] = best
                    keep = np.ones(m.shape, bool)
                    keep[r, at + 1] = False
                    m = m[keep].reshape(len(rows), m.shape[1] - 1)
        return out

    def encode_long(self, piece: bytes) -> tuple[int, ...]:
        """The same merges for one very long piece, by a heap over a linked list: O(n log n) instead of a matrix round a merge."""
        ids = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        nxt, prev, ranks, of = list(range(1, n + 1)), list(range(-1, n - 1)), self.ranks, self.bytes_of
        pair = lambda i: ranks.get(of[ids[i]] + of[ids[nxt[i]]]) if nxt[i] < n else None
        heap = [(r, i, ids[i], ids[nxt[i]]) for i in range(n) if (r := pair(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            if ids[i] != a or nxt[i] >= n or ids[nxt[i]] != b:
                continue
            j = nxt[i]
            ids[i], ids[j], nxt[i] = r, -1, nxt[j]
            if nxt[j] < n:
                prev[nxt[j]] = i
            for k in (prev[i], i):
                if k >= 0 and (x := pair(k)) is not None:
                    heapq.heappush(heap, (x, k, ids[k], ids[nxt[k]]))
        return tuple(x for x in ids if x >= 0)

    def encode_pieces(self, pieces: list[str]) -> list[tuple[int, ...]]:
        new = [p for p in pieces if p not in self.cache]
        if len(self.cache) + len(new) > CACHE_PIECES:
            self.cache = {}
            new = pieces
        raw, short = [p.encode() for p in new], []
        for p, b in zip(new, raw, strict=True):
            if (r := self.ranks.get(b)) is not None:
                self.cache[p] = (r,)
            elif len(b) > LONG_PIECE:
                self.cache[p] = self.encode_long(b)
            else:
                short.append((p, b))
        for (p, _), ids in zip(short, self.encode_matrix([b for _, b in short]), strict=True):
            self.cache[p] = ids
        return [self.cache[p] for p in pieces]

    def encode_texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and each text's offset."""
        found = [self.pattern.findall(t) if t else [] for t in texts]
        per = np.array([len(x) for x in found])
        coded = pa.array([p for x in found for p in x], pa.large_string()).dictionary_encode()
        del found
        codes = coded.indices.to_numpy(zero_copy_only=False)
        ids = self.encode_pieces(coded.dictionary.to_pylist())
        size = np.array([len(x) for x in ids], np.int64)
        flat = np.fromiter((i for x in ids for i in x), np.uint32, int(size.sum()))
        tokens, ends = gather(flat, np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else size, size, codes)
        piece_at = np.concatenate([[0], np.cumsum(per)])
        return tokens, np.concatenate([[0], ends])[piece_at]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the ids, and where each id's bytes end."""
        return gather(self.flat, self.start, self.length, ids)


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat[start[c]:start[c]+size[c]] for each code one after another, and the ends."""
    if not len(codes):
        return flat[:0], np.zeros(0, np.int64)
    n = size[codes]
    ends = np.cumsum(n)
    index = np.arange(int(ends[-1])) + np.repeat(start[codes] - (ends - n), n)
    return flat[index], ends


def model(raw: bytes, pattern: str) -> BytePairModel:
    """One model a worker process."""
    key = hash((raw, pattern))
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = BytePairModel(raw, pattern)
    return _MODELS[key]


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode whole texts and decode them again; one row per input row, no shuffle.

    ``vocabulary`` is the path of a tiktoken rank file, read on the driver and broadcast (its size is that of the file, about 1 MB).
    Returns id_col, n_tokens, ids_sha256 (ids as little-endian uint32), decoded_sha256, and ids (array<int>) if asked for.
    Null or empty texts have no ids; repeated rows give repeated results; other columns are left out; an empty table gives none.
    """
    with open(vocabulary, "rb") as f:
        raw = docs.sparkSession.sparkContext.broadcast(f.read())
    id_type = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        m = model(raw.value, pattern)
        for b in slices(batches):
            ids, at = m.encode_texts(b.column(1).to_pylist())
            plain, ends = m.decode(ids)
            ends = np.concatenate([[0], ends])[at]
            little = ids.astype("<u4")
            cols = [
                b.column(0),
                pa.array(np.diff(at), pa.int64()),
                pa.array([hashlib.sha256(little[i:j]).hexdigest() for i, j in zip(at[:-1], at[1:], strict=True)], pa.string()),
                pa.array([hashlib.sha256(plain[i:j]).hexdigest() for i, j in zip(ends[:-1], ends[1:], strict=True)], pa.string()),
            ]
            if with_ids:
                cols.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(cols, [id_col, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])

    return docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, schema)
