"""Encoding a corpus with a public byte-level BPE vocabulary.

Method: two-tier lookup.  A text is cut into pre-tokens; a minimal perfect hash
over the vocabulary resolves whole pre-tokens that are tokens; misses are merged
with a heap over linked bytes.  Pre-tokens are resolved once per Arrow batch, all
at a time: hashing and looking up are array operations over the batch's distinct
pre-tokens.

The vocabulary is a file of fixed size whose path is a parameter; each Python
worker reads it once.  Rows never leave their task: the plan is a scan and one
Arrow map, no shuffle.

Defined results: a null text and an empty text have no tokens, so their ids are
the empty list; strings of special tokens are ordinary text; a lone surrogate is
encoded as U+FFFD; repeated rows and ties give repeated rows; other columns are
ignored.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: how this vocabulary cuts a text into pre-tokens
PRE_TOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMO = 200_000  # merged pre-tokens a worker remembers; only speed depends on it
BATCH_CHARS = 4_000_000


class PerfectHash:
    """A minimal perfect hash by levels of bit arrays: a key sits at the first level where it has a slot alone."""

    GAMMA = 2.0

    def __init__(self, hashes: np.ndarray):
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        rest, base = np.unique(hashes), 0
        while len(rest):
            size = max(64, int(self.GAMMA * len(rest)))
            slot = self._slot(rest, len(self.levels), size)
            alone = np.bincount(slot, minlength=size) == 1
            rank = np.cumsum(alone) - 1 + base
            self.levels.append((size, alone, rank))
            base += int(alone.sum())
            rest = rest[~alone[slot]]
        self.size = base

    @staticmethod
    def _slot(h: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (h ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(31)
            x *= np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(29)
        return (x % np.uint64(size)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The index of each key; any index or -1 for what is no key."""
        out = np.full(len(hashes), -1, np.int64)
        open_ = np.arange(len(hashes))
        for level, (size, alone, rank) in enumerate(self.levels):
            slot = self._slot(hashes[open_], level, size)
            hit = alone[slot]
            out[open_[hit]] = rank[slot[hit]]
            open_ = open_[~hit]
            if not len(open_):
                break
        return out


class Encoder:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        keys = list(self.ranks)
        hashes = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)
        self.hash = PerfectHash(hashes)
        at = self.hash.find(hashes)
        self.keys: list[bytes] = [b""] * self.hash.size
        self.ids = np.full(self.hash.size, -1, np.int64)
        for k, i in zip(keys, at.tolist()):
            self.keys[i], self.ids[i] = k, self.ranks[k]
        self.memo: dict[str, list[int]] = {}
        self.cut = regex.compile(PRE_TOKEN).findall

    def merge(self, token: bytes) -> list[int]:
        """Byte-pair merges of one pre-token: the lowest rank first, then the leftmost."""
        n = len(token)
        parts: list[bytes | None] = [token[i : i + 1] for i in range(n)]
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        ranks = self.ranks
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(token[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            a = parts[i]
            j = after[i]
            if a is None or j >= n or len(a) + len(parts[j]) != size:
                continue  # one of the two has been merged since
            parts[i] = a = a + parts[j]
            parts[j] = None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(a + parts[k])) is not None:
                    heapq.heappush(heap, (r, i, len(a) + len(parts[k])))
            if (h := before[i]) >= 0 and (r := ranks.get(parts[h] + a)) is not None:
                heapq.heappush(heap, (r, h, len(parts[h]) + len(a)))
        return [ranks[p] for p in parts if p is not None]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of all texts."""
        number: dict[str, int] = {}
        cuts = [[number.setdefault(p, len(number)) for p in self.cut(t)] if t else [] for t in texts]
        distinct = list(number)
        raw = [p.encode("utf-8", "replace") if not p.isascii() else p.encode() for p in distinct]
        index = self.hash.find(np.array([xxhash.xxh64_intdigest(b) for b in raw], np.uint64)).tolist()
        known, memo, out = self.keys, self.memo, []
        for p, b, i in zip(distinct, raw, index):
            if i >= 0 and known[i] == b:
                out.append([int(self.ids[i])])
                continue
            got = memo.get(p)
            if got is None:
                if len(memo) >= MEMO:
                    memo.clear()
                memo[p] = got = self.merge(b)
            out.append(got)
        lengths = np.array([len(x) for x in out], np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)])
        flat = np.array([i for x in out for i in x], np.int32)
        seq = np.array([k for c in cuts for k in c], np.int64)
        per_text = np.array([len(c) for c in cuts], np.int64)
        size = lengths[seq] if len(seq) else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(size)])
        pick = np.repeat(starts[seq] - ends[:-1], size) + np.arange(ends[-1]) if len(seq) else np.zeros(0, np.int64)
        offsets = ends[np.concatenate([[0], np.cumsum(per_text)])]
        return offsets.astype(np.int32), flat[pick] if len(pick) else np.zeros(0, np.int32)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def bounded(batch: pa.RecordBatch, column: int, chars: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most so many characters of text (a longer single text is its own slice)."""
    sizes = [len(x) if x else 0 for x in batch.column(column).to_pylist()]
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > chars:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def encode_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids array<int>) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        for whole in batches:
            for b in bounded(whole, 1):
                offsets, ids = e.encode(b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))], names=["k", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", key)
