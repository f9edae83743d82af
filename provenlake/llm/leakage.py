"""Evaluation texts leaking into training text.

Method: windows of items and documents get SimHash fingerprints of their words;
multi-index blocks over the fingerprint guarantee that every pair within the Hamming
radius shares a block (radius + 1 blocks); candidates are then verified exactly.  There
are two sizes of window.

* ``near_leaks``: windows as long as the item (item lengths are cut to steps of a
  quarter, so documents are fingerprinted once per step).  A window leaks when the
  weighted share of the item window's five-word shingles that it holds, rare words
  weighing more, is at least ``NEAR``.  Pairs beyond ``NEAR_RADIUS`` are not found; the
  tests and README give the recall against brute force.
* ``find_leaks``: passages of ``PASSAGE`` words, for partial leaks.  A passage leaks
  when it has the very same words (``SIMILARITY`` 1.0), so its fingerprint is the very
  same too and the radius only matters where a caller lowers the similarity.

Documents are never shuffled: fingerprints of a document's windows are array
operations over its word signatures.  The item index is built for at most ``ITEMS``
items and ``ITEM_CHARS`` characters at once and sent to the tasks; more items are taken
in blocks of that size, each block one pass over the documents.

Defined results: words are runs of letters and digits, compared without case,
punctuation, spacing and inline markup (tags are dropped, format characters such
as zero-width spaces are dropped inside words); null, empty and short texts leak
nothing; an item id with several texts leaks where one of them does; repeated rows
give one row; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenlake.llm.tokenize import bounded

PASSAGE = 12
RADIUS = 1
SIMILARITY = 1.0
NEAR, NEAR_RADIUS, SHINGLE = 0.8, 7, 5
ITEMS, ITEM_CHARS = 20_000, 50_000_000
WORDS_AT_ONCE = 60_000

WORD = re.compile(r"[^\W_]+")
TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,200}>")
COLOUR = re.compile(r"\x1b\[[0-9;]*[A-Za-z]")
FORMAT = re.compile("[­͏؜᠎​-‏‪-‮⁠-⁤⁦-⁯﻿]")


def words_of(text: str) -> list[str]:
    if "<" in text:
        text = TAG.sub("", text)
    if "\x1b" in text:
        text = COLOUR.sub("", text)
    if text.isascii():
        return WORD.findall(text.lower())
    return WORD.findall(unicodedata.normalize("NFKC", FORMAT.sub("", text)).casefold())


def fingerprints(hashes: np.ndarray, passage: int) -> np.ndarray:
    """SimHash of every run of ``passage`` words; one fewer than words + 2 - passage."""
    n = len(hashes) - passage + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    # ones in every window, from sums of 1, 2, 4, ... words: a few byte-wise additions over the whole array
    ones, at, width, part = np.zeros((n, 64), np.uint8 if passage < 256 else np.int32), 0, 1, bits.astype(np.uint8 if passage < 256 else np.int32)
    while True:
        if passage & width:
            ones += part[at : at + n]
            at += width
        if width * 2 > passage:
            break
        part = part[:-width] + part[width:]
        width *= 2
    return np.packbits(ones > passage // 2, axis=1, bitorder="little").view("<u8").reshape(-1)


class Fingerprints:
    """Fingerprints in sorted blocks: all pairs within a radius."""

    def __init__(self, prints: list[np.ndarray], radius: int):
        self.radius = radius
        self.prints = np.concatenate(prints) if prints else np.zeros(0, np.uint64)
        edges = [round(64 * b / (radius + 1)) for b in range(radius + 2)]
        self.cuts = [(np.uint64(a), np.uint64((1 << (z - a)) - 1)) for a, z in zip(edges, edges[1:])]
        self.blocks = []
        for shift, mask in self.cuts:
            key = (self.prints >> shift) & mask
            order = np.argsort(key, kind="stable")
            self.blocks.append((key[order], order))

    def candidates(self, prints: np.ndarray) -> Iterator[tuple[int, int]]:
        """(position in prints, number of a fingerprint) of all pairs within the radius, some more than once."""
        for (shift, mask), (keys, order) in zip(self.cuts, self.blocks):
            k = (prints >> shift) & mask
            lo, hi = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
            size = hi - lo
            near = np.nonzero(size)[0]
            if not len(near):
                continue
            size, lo = size[near], lo[near]
            ends = np.cumsum(size)
            pos = np.repeat(near, size)
            item = order[np.repeat(lo - (ends - size), size) + np.arange(ends[-1])]
            ok = np.bitwise_count(prints[pos] ^ self.prints[item]) <= self.radius
            yield from zip(pos[ok].tolist(), item[ok].tolist())


def weights_of(texts: list[tuple[int, list[str]]]) -> dict[str, float]:
    """Rare words weigh more."""
    seen = Counter(w for _, ws in texts for w in set(ws))
    return {w: 1.0 + math.log((1 + len(texts)) / (1 + c)) for w, c in seen.items()}


class ItemIndex(Fingerprints):
    """Passages of one size."""

    def __init__(self, items: list[tuple[int, str | None]], passage: int = PASSAGE, radius: int = RADIUS):
        self.passage = passage
        texts = [(i, words_of(t)) for i, t in items if t]
        self.weight = weights_of(texts)
        prints, self.owner, self.words = [], [], []
        for i, ws in texts:
            p = fingerprints(word_hashes(ws, {}), passage)
            prints.append(p)
            self.owner += [i] * len(p)
            self.words += [ws[k : k + passage] for k in range(len(p))]
        super().__init__(prints, radius)

    def similar(self, a: list[str], k: int) -> float:
        b, w = self.words[k], self.weight
        total = sum(w.get(x, 1.0) for x in b)
        return sum(w.get(x, 1.0) for x, y in zip(b, a) if x == y) / total


def window_size(words: int) -> int:
    """The greatest step of a quarter that is no longer than an item."""
    size = SHINGLE
    while (up := max(size + 1, size * 5 // 4)) <= words:
        size = up
    return size


class NearIndex:
    """Windows as long as their items."""

    def __init__(self, items: list[tuple[int, str | None]], radius: int = NEAR_RADIUS):
        texts = [(i, ws) for i, t in items if t and len(ws := words_of(t)) >= SHINGLE]
        weight, memo = weights_of(texts), {}
        by_size: dict[int, list[tuple[int, list[str]]]] = {}
        for i, ws in texts:
            by_size.setdefault(window_size(len(ws)), []).append((i, ws))
        self.sizes = {}
        for size, mine in by_size.items():
            prints, owner, shingled = [], [], []
            for i, ws in mine:
                h = word_hashes(ws, memo)
                p = fingerprints(h, size)
                prints.append(p)
                owner += [i] * len(p)
                hs = shingles(h).tolist()
                ww = [sum(weight[w] for w in ws[k : k + SHINGLE]) for k in range(len(hs))]
                shingled += [dict(zip(hs[k : k + size - SHINGLE + 1], ww[k : k + size - SHINGLE + 1])) for k in range(len(p))]
            self.sizes[size] = (Fingerprints(prints, radius), owner, shingled)


def shingles(hashes: np.ndarray) -> np.ndarray:
    """A hash of every run of SHINGLE words."""
    n = len(hashes) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        out = (out + hashes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return out


def near_in(doc: int, text: str | None, index: NearIndex, memo: dict[str, int], least: float = NEAR) -> list[tuple[int, int, float]]:
    """(document, item, greatest similarity) of one text; a very long one is taken in overlapping stretches."""
    words = words_of(text) if text else []
    best: dict[int, float] = {}
    for size, (prints, owner, shingled) in index.sizes.items():
        for s in range(0, max(0, len(words) - size + 1), WORDS_AT_ONCE):
            h = word_hashes(words[s : s + WORDS_AT_ONCE + size - 1], memo)
            own = None
            for p, k in set(prints.candidates(fingerprints(h, size))):
                own = shingles(h).tolist() if own is None else own
                want, here = shingled[k], set(own[p : p + size - SHINGLE + 1])
                share = sum(w for x, w in want.items() if x in here) / sum(want.values())
                if share >= least:
                    best[owner[k]] = max(share, best.get(owner[k], 0.0))
    return [(doc, i, round(v, 6)) for i, v in best.items()]


def word_hashes(words: list[str], memo: dict[str, int]) -> np.ndarray:
    out = []
    for w in words:
        h = memo.get(w)
        if h is None:
            memo[w] = h = xxhash.xxh64_intdigest(w)
        out.append(h)
    return np.array(out, np.uint64)


def leaks_in(batch: list[tuple[int, str | None]], index: ItemIndex, similarity: float = SIMILARITY) -> Iterator[tuple[int, int, int]]:
    """(document, item, passages) of a batch of texts."""
    memo: dict[str, int] = {}
    docs = [(d, ws) for d, t in batch if t and len(ws := words_of(t)) >= index.passage]
    at = 0
    while at < len(docs):
        part, total = [], 0
        while at < len(docs) and (not part or total + len(docs[at][1]) <= WORDS_AT_ONCE):
            part.append(docs[at])
            total += len(docs[at][1])
            at += 1
        words = [w for _, ws in part for w in ws]
        lengths = np.array([len(ws) for _, ws in part])
        ends = np.cumsum(lengths)
        found: Counter = Counter()
        step = WORDS_AT_ONCE
        for s in range(0, len(words), step):  # a very long text is fingerprinted in overlapping stretches
            stretch = words[s : s + step + index.passage - 1]
            prints = fingerprints(word_hashes(stretch, memo), index.passage)
            taken = set()
            for p, k in index.candidates(prints):
                if (p, k) in taken:
                    continue
                taken.add((p, k))
                g = s + p
                d = int(np.searchsorted(ends, g, "right"))
                if g + index.passage <= ends[d] and index.similar(words[g : g + index.passage], k) >= similarity:
                    found[d, index.owner[k]] += 1
        for (d, i), n in found.items():
            yield part[d][0], i, n


def _blocks_of_items(items: DataFrame, items_at_once: int) -> Iterator[DataFrame]:
    keyed = items.where("item_id is not null and text is not null").select("item_id", "text").distinct()
    n, chars = keyed.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, math.ceil(n / items_at_once), math.ceil(chars / ITEM_CHARS))
    for b in range(blocks):
        yield keyed if blocks == 1 else keyed.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)


def find_leaks(docs: DataFrame, items: DataFrame, items_at_once: int = ITEMS) -> DataFrame:
    """(doc_id, item_id, passages): passages of the item found in the document."""
    texts, out = docs.where("doc_id is not null").select("doc_id", "text"), []
    for mine in _blocks_of_items(items, items_at_once):
        shared = docs.sparkSession.sparkContext.broadcast([(r[0], r[1]) for r in mine.collect()])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(shared.value)
            for whole in batches:
                for x in bounded(whole, 1):
                    rows = list(leaks_in(list(zip(x.column(0).to_pylist(), x.column(1).to_pylist())), index))
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["doc_id", "item_id", "passages"])

        out.append(texts.mapInArrow(run, "doc_id long, item_id long, passages long"))
    return reduce(DataFrame.unionByName, out).groupBy("doc_id", "item_id").agg(F.max("passages").alias("passages"))


def near_leaks(docs: DataFrame, items: DataFrame, items_at_once: int = ITEMS) -> DataFrame:
    """(doc_id, item_id, similarity): items of which the document holds a near copy, with the greatest similarity."""
    texts, out = docs.where("doc_id is not null").select("doc_id", "text"), []
    for mine in _blocks_of_items(items, items_at_once):
        shared = docs.sparkSession.sparkContext.broadcast([(r[0], r[1]) for r in mine.collect()])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, memo = NearIndex(shared.value), {}
            for whole in batches:
                memo.clear()
                rows = [r for d, t in zip(whole.column(0).to_pylist(), whole.column(1).to_pylist()) for r in near_in(d, t, index, memo)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.float64() if i == 2 else pa.int64()) for i in range(3)], names=["doc_id", "item_id", "similarity"])

        out.append(texts.mapInArrow(run, "doc_id long, item_id long, similarity double"))
    return reduce(DataFrame.unionByName, out).groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"))
