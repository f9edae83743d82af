"""Abusive, hateful or sexual content.

Method: class-conditional Kneser-Ney models.  Ordinary text has an interpolated
trigram model over a lowest order that all classes share; each category (abusive,
hateful, sexual) has an interpolated trigram model that backs off to the ordinary one,
so a rare expression that a category knows nothing of has the probability ordinary
text gives it, less what the category keeps for its own words: it never speaks for the
category.  A passage is judged by its length-normalised log-likelihood under a category
against that under ordinary text; the passage is the stretch of a sentence with the
greatest gain, so an abusive sentence counts however much ordinary text stands around
it.  What is left of a sentence beside its passage is judged again, and a passage that
fits a further category nearly as well is of both, so a document, and a sentence, can
have several categories.

Labels are of whole documents, so training is multi-instance: sentences of labelled
documents are cut to the stretches whose word pairs stand almost only in documents
labelled toxic, which start in the category they fit best, and are re-assigned between
the class models for ``ROUNDS``; ordinary text is that of documents labelled fine.
The models are fitted on a bounded sample of labelled documents: at most ``PER_LABEL``
of each label, in hash order (all where there are fewer), and the few ``SEEDS`` below.
Every document is scored in all categories, in whole, in one scan without a shuffle;
the models are bounded by the sample, so their broadcast is too.  Words are numbers of
31 bits (hashes) and all likelihoods of a batch are array look-ups.

Words are normalised before counting: look-alike letters, letters set apart by
blanks or zero-width characters, digits and signs used as letters, stretched letters
and masked letters.  In scripts without blanks every character is a word.

Defined results: null, empty and blank texts have scores 0 and no category; a rater
who labels a document twice counts once per label, null labels count as no vote, a
tie of votes gives no training label; repeated rows give one row; a table without
labels leaves only the seeds; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenlake.llm.tokenize import bounded

CATEGORIES = ("abusive", "hateful", "sexual")
CLASSES = ("fine", *CATEGORIES)
PER_LABEL = 5_000
ROUNDS = 3
DISCOUNT = 0.75
THRESHOLD = 1.2  # mean gain per word, in nats
TOTAL = 6.0  # gain of the whole passage, in nats, over a model of WORDS words of ordinary text; it grows with the log of its size
WORDS = 100
LISTED = 3.0  # gain of a passage from which it is listed beside the document's scores, which have no such bound
SHORTEST = 3  # words of a passage; a shorter sentence is one
ALSO = 0.5  # share of a passage's gain from which it is of a further category too; words in common alone give up to about 0.25
PRIOR = 2.0
SUSPECT = 0.55  # share of toxic documents from which a word pair speaks for a category
EVIDENCE = 1.2  # sum of the excess over a passage from which it starts in a category
MEMO = 300_000  # words whose number a worker remembers; only speed depends on it

SEEDS = {
    "abusive": [
        "you are a worthless idiot and everyone knows it", "shut up you stupid pathetic loser", "go and kill yourself", "i will find you and break your neck",
        "nobody would miss you if you were dead", "you useless pig, crawl back into your hole", "i know where you live and you will bleed", "what a moron you are",
        "halt die klappe du dummer vollidiot", "verschwinde du versager", "ferme la espèce de connard", "tu es un crétin minable", "eres un imbécil inútil", "ojalá te mueras, cerdo",
        "ты тупой идиот", "заткнись, ничтожество", "你这个白痴", "去死吧", "お前は馬鹿だ", "死ね",
    ],
    "hateful": [
        "immigrants are vermin and should be driven out", "send those foreigners back, they are not human", "people like them are born thieves and liars", "women are too stupid for this work and belong in kitchens",
        "disabled people are a burden and should not be allowed to live", "the world would be better without them, every last one", "their blood is rotten",
        "ausländer sind ungeziefer und gehören weggejagt", "los extranjeros son una plaga y hay que echarlos", "les étrangers sont de la vermine, dehors",
        "эти люди не люди, гнать их отсюда", "他们都是害虫，滚出去",
    ],
    "sexual": [
        "i want to see you naked in my bed tonight", "send me your nudes", "she moaned as he touched her naked body", "free porn videos with horny singles", "they fucked all night, sweaty and loud", "he slid his hand between her thighs",
        "ich will dich nackt auf dem tisch", "envoie moi des photos de toi nue", "quiero verte desnuda esta noche",
        "хочу увидеть тебя голой", "发裸照给我", "裸の写真を送って",
    ],
    "fine": [
        "the filter must catch words such as idiot and porn", "kill the child process and abort the orphans", "the master node executes the dummy job", "this stupid bug is hard to reproduce", "the naked eye cannot see it", "immigrants and women are mentioned in the survey",
    ],
}

# Letters of other scripts that look like Latin ones, and signs used for letters.
LOOKALIKE = str.maketrans("аесорхуіјѕԁһӏкмтвнАЕСОРХУІЈЅКМТВНαοε", "aecopxyijsdhlkmtbhAECOPXYIJSKMTBHaoe")
LEET = str.maketrans("013457$@!€", "oieastsaie")
HIDDEN = re.compile("[­​-‏‪-‮⁠-⁤﻿]")
SPACED = re.compile(r"(?<![\w])(?:[^\W\d_][ .\-_*]){2,}[^\W\d_](?![\w])")
FILE = re.compile(r"\b[\w/\-]+\.(?:[a-z]{1,4})\b")
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"  # scripts without blanks between words
BREAK = "\x00"
TOKEN = re.compile(rf"{BREAK}|[{UNSPACED}]|[^\W_{UNSPACED}](?:[^\W{UNSPACED}]|['’]|\*(?=[\w*])|[$@!€](?=\w))*|[$@](?=\w)[\w$@!*]+|[。！？]|[!?]+|\*{{2,}}")
SENTENCE = re.compile(r"\n\s*\n|(?<=[.!?…])[\"'”»)\]]*\s+|(?<=[。！？])|\n(?=[-*#>$@`\d])")
LONGEST = re.compile(r"(.)\1{2,}")


def _word(w: str) -> str:
    w = w.replace("’", "'")
    if w.isascii() and w.isalpha():
        pass
    else:
        if w[0].isdigit() and all(c.isdigit() or c in ".,:" for c in w):
            return "<n>"
        if any("a" <= c <= "z" for c in w):
            w = w.translate(LOOKALIKE)
        if "*" in w:
            return "<masked>"
        letters = sum(c.isalpha() for c in w)
        odd = sum(c in "013457$@!€" for c in w)
        if odd and letters >= odd and not w[-1].isdigit() or w[0] in "$@":
            w = w.translate(LEET)
        elif any(c.isdigit() for c in w):
            return "<code>"
    return LONGEST.sub(r"\1", w)


def tidy(text: str) -> str:
    s = text.lower() if text.isascii() else unicodedata.normalize("NFC", HIDDEN.sub("", text)).lower()
    s = SPACED.sub(lambda m: re.sub(r"[ .\-_*]", "", m[0]), s)
    return FILE.sub("<f>", s) if "." in s else s


def tokens_of(sentence: str) -> list[str]:
    return [_word(w) for w in TOKEN.findall(tidy(sentence)) if w != BREAK]


def number_of(word: str) -> int:
    return xxhash.xxh32_intdigest(word) >> 1 or 1


class Numbers(dict):
    """Number of each raw word, by ``name`` of the normalised one; the break between sentences is 0."""

    def __init__(self, name=number_of):
        super().__init__({BREAK: 0})
        self.name = name

    def __missing__(self, w: str) -> int:
        if len(self) >= MEMO:
            self.clear()
            self[BREAK] = 0
        self[w] = n = 0 if w == BREAK else self.name(_word(w))
        return n

    def of(self, text: str | None) -> list[int]:
        """The words of all sentences of a text, a 0 before each sentence."""
        return [self[w] for w in TOKEN.findall(BREAK + SENTENCE.sub(BREAK, tidy(text)))] if text else []


class Words:
    """Sentences in one array: numbers with the two words before each, and where sentences start.  ``w`` has a 0 before each sentence."""

    def __init__(self, w: np.ndarray):
        self.w = w
        self.at = np.nonzero(w)[0]  # places of words
        self.c = w[self.at]
        self.b = w[self.at - 1]
        self.a = np.where(self.b == 0, 0, w[self.at - 2])
        self.first = np.nonzero(self.b == 0)[0]  # the first word of each sentence, as a place among the words
        self.size = np.diff(np.append(self.first, len(self.c)))
        self.sentence = np.repeat(np.arange(len(self.first)), self.size)


def pair(b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (b.astype(np.uint64) << np.uint64(32)) | c.astype(np.uint64)


def triple(a: np.ndarray, bc: np.ndarray) -> np.ndarray:
    """A hash of three words of 64 bits."""
    with np.errstate(over="ignore"):
        x = (bc ^ (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        return x * np.uint64(0x94D049BB133111EB) ^ (x >> np.uint64(32))


class Table:
    """Numbers for keys, by binary search."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]

    def find(self, keys: np.ndarray, default: float) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), default)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], default)


class KneserNey:
    """Interpolated trigram model from counted triples, over a lowest order that comes with each look-up."""

    def __init__(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, times: np.ndarray):
        d = DISCOUNT
        _, one_of, at = np.unique(triple(a, pair(b, c)), return_index=True, return_inverse=True)
        n3 = np.bincount(at, times, len(one_of))
        a, b, c = a[one_of], b[one_of], c[one_of]
        # the lower orders count in how many contexts a word stands, not how often
        bc, n2 = np.unique(pair(b, c), return_counts=True)
        one, n1 = np.unique(bc & np.uint64(0xFFFFFFFF), return_counts=True)
        self.tri, self.from3 = self._order(triple(a, pair(b, c)), n3, pair(a, b), d)
        self.bi, self.from2 = self._order(bc, n2, bc >> np.uint64(32), d)
        total = max(1, int(n1.sum()))
        self.uni = Table(one, np.maximum(n1 - d, 0) / total)
        self.from1 = d * len(one) / total if len(one) else 1.0

    @staticmethod
    def _order(key: np.ndarray, n: np.ndarray, context: np.ndarray, d: float) -> tuple[Table, Table]:
        ctx, at = np.unique(context, return_inverse=True)
        total, types = np.bincount(at, n, len(ctx)), np.bincount(at, minlength=len(ctx))
        return Table(key, np.maximum(n - d, 0) / total[at] if len(key) else n), Table(ctx, d * types / np.maximum(total, 1))


class Lookup:
    """All models over one vocabulary, one list of pairs and one of triples, so that a word is looked up once for all of them."""

    def __init__(self, shared_total: int, shared: Table, models: list[KneserNey]):
        self.vocabulary = np.unique(np.concatenate([shared.keys, *(m.uni.keys for m in models)]))
        self.number = np.concatenate([[0, 0], self.vocabulary]).astype(np.int64)  # 0 is the break, 1 a word no model knows
        self.pairs = np.unique(np.concatenate([k for m in models for k in (m.bi.keys, m.from3.keys)]))
        self.triples = np.unique(np.concatenate([m.tri.keys for m in models]))
        words, pairs, triples = self.number.astype(np.uint64), self.pairs, self.triples
        self.base = shared.find(words, 0.5) / shared_total
        self.base[1] = 0.5 / shared_total

        def listed(t: Table, keys: np.ndarray, default: float) -> np.ndarray:
            return np.concatenate([[default], t.find(keys, default)])

        self.models = []
        for m in models:
            uni, from2 = m.uni.find(words, 0.0), m.from2.find(words, 1.0)
            uni[:2], from2[1] = 0.0, 1.0
            self.models.append((uni, m.from1, from2, listed(m.bi, pairs, 0.0), listed(m.from3, pairs, 1.0), listed(m.tri, triples, 0.0)))
        self.dense = dict(zip(self.vocabulary.tolist(), range(2, len(self.vocabulary) + 2)))

    def name(self, word: str) -> int:
        return self.dense.get(number_of(word), 1)

    @staticmethod
    def _place(keys: np.ndarray, wanted: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(n, np.int64)
        if len(keys) and len(at):
            k = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            out[at] = np.where(keys[k] == wanted, k + 1, 0)
        return out

    def gains(self, x: Words) -> list[np.ndarray]:
        """Gain in nats of each word over ordinary text, by category; the words are those of ``name``."""
        n, a, b, c = len(x.c), x.a, x.b, x.c
        known = np.nonzero((b != 1) & (c != 1))[0]
        bc = self._place(self.pairs, pair(self.number[b[known]], self.number[c[known]]), known, n)
        # the pair before a word ends the triple before it
        ab = np.zeros(n, np.int64)
        ab[1:] = bc[:-1]
        ab[b == 0] = self._place(self.pairs, np.zeros(1, np.uint64), np.zeros(1, np.int64), 1)[0]
        full = np.nonzero((ab > 0) & (bc > 0))[0]
        abc = self._place(self.triples, triple(self.number[a[full]], pair(self.number[b[full]], self.number[c[full]])), full, n)

        def relative(m: tuple, below: np.ndarray) -> np.ndarray:
            """Likelihood of each word over ``below``, the likelihood in the model it backs off to."""
            uni, from1, from2, bi, from3, tri = m
            r = uni[c] / below + from1
            r = bi[bc] / below + from2[b] * r
            return tri[abc] / below + from3[ab] * r

        base = self.base[c]
        ordinary = relative(self.models[0], base) * base
        return [np.log(relative(m, ordinary)) for m in self.models[1:]]


def stretches(gain: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(total, from, to) of the stretch of each sentence with the greatest total gain, of at least SHORTEST words or the whole sentence; places among the words."""
    far = 1e4 + float(np.abs(gain).max(initial=0.0)) * int(words.size.max(initial=0))  # more than any total of a sentence
    n = len(gain)
    sums = np.cumsum(gain)
    sums -= np.repeat(sums[words.first] - gain[words.first], words.size)  # of the sentence up to each word
    k = np.arange(n) - words.first[words.sentence]  # place in the sentence
    # least sum before a start that leaves SHORTEST words, by a running minimum that later sentences cannot look behind
    lag = SHORTEST
    before = np.full(n, np.inf)
    ok = k >= lag
    before[ok] = sums[np.nonzero(ok)[0] - lag]
    before[k == lag - 1] = 0.0
    before[(k + 1 == words.size[words.sentence]) & (k < lag - 1)] = 0.0
    shifted = np.where(np.isinf(before), far, before) - words.sentence * 2 * far
    low = np.minimum.accumulate(shifted)
    start = np.maximum.accumulate(np.where(shifted <= low, np.arange(n), 0))
    total = np.where(low + words.sentence * 2 * far < far / 2, sums - (low + words.sentence * 2 * far), -np.inf)
    best = np.maximum.reduceat(total, words.first) if n else np.zeros(0)
    to = np.maximum.accumulate(np.where(total == best[words.sentence], np.arange(n), -1)) if n else np.zeros(0, np.int64)
    last = to[words.first + words.size - 1] if n else to
    s = start[last]
    begin = np.where(k[s] >= lag, s - lag + 1, words.first) if n else last
    return best, begin, last + 1


class Models:
    def __init__(self, docs: Iterable[tuple[str, str]] = ()):
        """docs: (label, text)."""
        words = Numbers()
        rows = [(label, np.array(words.of(text), np.int64)) for label, text in docs]
        self._fit([r[0] for r in rows], [r[1] for r in rows])

    @classmethod
    def of_numbers(cls, labels: list[str], docs: list[np.ndarray]) -> Models:
        m = cls.__new__(cls)
        m._fit(labels, docs)
        return m

    def _fit(self, labels: list[str], docs: list[np.ndarray]) -> None:
        size = {k: labels.count(k) for k in CLASSES}
        words = Words(np.concatenate(docs).astype(np.int64) if docs else np.zeros(0, np.int64))
        doc = np.repeat(np.arange(len(docs)), [int(np.count_nonzero(d)) for d in docs]) if docs else np.zeros(0, np.int64)
        kind = np.array([CLASSES.index(k) if k in CLASSES else 0 for k in labels], np.int64)[doc] if docs else doc
        keys = pair(words.b, words.c)
        # in how many documents of each class each pair of words stands
        known, at = np.unique(keys, return_inverse=True)
        first = np.unique(at * max(1, len(docs)) + doc, return_index=True)[1]
        df = np.zeros((len(CLASSES), len(known)))
        np.add.at(df, (kind[first], at[first]), 1)
        toxic = sum(size[k] for k in CATEGORIES)
        base = toxic / max(1, toxic + size["fine"])
        n = df[1:].sum(0)
        # share of toxic documents among those that hold the pair, drawn to the base rate where few do
        excess = ((n + base * PRIOR) / (n + df[0] + PRIOR) - SUSPECT)[at]
        role = np.zeros(len(words.c), np.int64)  # class of each word
        part = np.full(len(words.c), -1, np.int64)  # toxic stretch of each word
        if len(words.c):
            evidence, begin, end = widest(excess, words)
            fit = np.log((df[1:] + 0.1) / (np.array([size[k] for k in CATEGORIES]) + 1)[:, None])
            for i, s in enumerate(np.nonzero(evidence >= EVIDENCE)[0].tolist()):
                x, z = begin[s], end[s]
                role[x:z] = 1 + int(fit[:, at[x:z]].sum(1).argmax())
                part[x:z] = i
        seeds = [(CLASSES.index(k), np.array([0, *map(number_of, tokens_of(t))], np.int64)) for k, ts in SEEDS.items() for t in ts]
        # words of a stretch and those around it are sentences of their own
        cut = np.ones(len(part), bool)
        cut[1:] = (part[1:] != part[:-1]) | (words.b[1:] == 0)
        text = Words(np.insert(words.c, np.nonzero(cut)[0], 0)) if len(part) else words
        seed = Words(np.concatenate([x for _, x in seeds]))
        seed_role = np.repeat([k for k, _ in seeds], [len(x) - 1 for _, x in seeds])
        a, b, c = (np.concatenate([getattr(text, x), getattr(seed, x)]) for x in "abc")
        times = np.concatenate([np.ones(len(text.c)), np.full(len(seed.c), 2.0)])
        # the lowest order counts the pairs of all classes
        # the more ordinary text there is, the greater the gains that chance gives somewhere in it
        ordinary = int(((role == 0) & (kind == 0)).sum() + (seed_role == 0).sum())
        self.least = TOTAL + max(0.0, math.log(ordinary / WORDS))
        total, shared = shared_order(np.unique(pair(b, c)))
        for r in range(ROUNDS):
            # what is left of a toxic document beside its stretches may be toxic too: it is in no model
            of = np.concatenate([np.where((role == 0) & (kind > 0), -1, role), seed_role])
            self.lookup = Lookup(total, shared, [KneserNey(a[of == k], b[of == k], c[of == k], times[of == k]) for k in range(len(CLASSES))])
            if r < ROUNDS - 1 and role.any():
                # stretches that look like another category's move there; seeds stay
                number = self.lookup.vocabulary.astype(np.int64)
                best = np.stack([stretches(g, text)[0] for g in self.lookup.gains(Words(np.where(text.w > 0, np.searchsorted(number, text.w) + 2, 0)))])
                now = np.where(best.max(0) > 0, best.argmax(0) + 1, 0)
                role = np.where(role > 0, now[text.sentence], 0)

    def judge(self, t: list[str]) -> tuple[str | None, float, float]:
        """(category, total, mean) of the category with the greatest gain over ordinary text, if any."""
        if not t:
            return None, 0.0, 0.0
        x = Words(np.array([0, *map(self.lookup.name, t)], np.int64))
        found = [stretches(g, x) for g in self.lookup.gains(x)]
        k = max(range(len(found)), key=lambda k: found[k][0][0])
        total, i, j = (v[0] for v in found[k])
        return (CATEGORIES[k], float(total), float(total / (j - i))) if total > 0 else (None, 0.0, 0.0)

    def score(self, docs: list[list[int]]) -> tuple[np.ndarray, np.ndarray, list[list[list[tuple[float, float]]]]]:
        """Of documents as numbers of the look-up: totals and means (categories by documents), and the listed passages of each category."""
        n = len(docs)
        totals, means = np.zeros((len(CATEGORIES), n)), np.zeros((len(CATEGORIES), n))
        listed: list[list[list[tuple[float, float]]]] = [[[] for _ in range(n)] for _ in CATEGORIES]
        x = Words(np.fromiter(chain.from_iterable(docs), np.int64, sum(map(len, docs))))
        if not len(x.c):
            return totals, means, listed
        doc = np.repeat(np.arange(n), list(map(len, docs)))[x.at[x.first]]  # of each sentence
        gains = self.lookup.gains(x)
        best = []
        for k, g in enumerate(gains):
            total, i, j = stretches(g, x)
            best.append(total)
            order = np.lexsort((total, doc))
            top = order[np.append(doc[order][1:] != doc[order][:-1], True)]
            up = top[total[top] > 0]
            totals[k, doc[up]], means[k, doc[up]] = total[up], total[up] / (j - i)[up]
        for s in np.nonzero(np.max(best, 0) >= LISTED)[0].tolist():
            i = x.first[s]
            own = {k: g[i : i + x.size[s]].tolist() for k, g in enumerate(gains)}
            for k, total, mean in passages(own):
                if total >= LISTED:
                    listed[k][doc[s]].append((total, mean))
        return totals, means, [[front(p) for p in row] for row in listed]


def shared_order(pairs: np.ndarray) -> tuple[int, Table]:
    words, n = np.unique(pairs & np.uint64(0xFFFFFFFF), return_counts=True)
    return int(n.sum()) + len(words) + 1, Table(words, n.astype(float))


def widest(gain: np.ndarray, words: Words) -> tuple[list[float], list[int], list[int]]:
    """(total, from, to) of the stretch of each sentence with the greatest total, of any length."""
    best, begin, end = [], [], []
    hopeful = np.add.reduceat(np.maximum(gain, 0), words.first) >= EVIDENCE
    values = gain.tolist()
    for i, n, h in zip(words.first.tolist(), words.size.tolist(), hopeful.tolist()):
        top, x, z, total, start = 0.0, i, i, 0.0, i
        for j in range(i, i + n) if h else ():
            if total <= 0:
                total, start = 0.0, j
            total += values[j]
            if total > top:
                top, x, z = total, start, j + 1
        best.append(top)
        begin.append(x)
        end.append(z)
    return np.array(best), begin, end


def front(found: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Passages that no other surpasses in total and mean."""
    out: list[tuple[float, float]] = []
    for x in sorted(set(found), reverse=True):
        if not out or x[1] > out[-1][1]:
            out.append(x)
    return out


def best_part(gains: list[float]) -> tuple[float, int, int]:
    """(total, from, to) of the stretch of at least SHORTEST words, or of all where there are fewer, with the greatest total gain."""
    least = min(SHORTEST, len(gains))
    sums = [0.0]
    for g in gains:
        sums.append(sums[-1] + g)
    best, at, low = -math.inf, (0, 0), 0
    for j in range(least, len(sums)):
        if sums[j - least] < sums[low]:
            low = j - least
        if sums[j] - sums[low] > best:
            best, at = sums[j] - sums[low], (low, j)
    return best, *at


def passages(gains: dict[int, list[float]]) -> Iterator[tuple[int, float, float]]:
    """(category, total, mean) of the disjoint stretches of a sentence, each of the category that gains most and of every other that gains at least ALSO of it there."""
    parts = [(0, len(g)) for g in list(gains.values())[:1]]
    while parts:
        a, z = parts.pop()
        total, i, j, k = max(((*best_part(g[a:z]), k) for k, g in gains.items()), key=lambda x: x[0])
        if total <= 0:
            continue
        i, j = a + i, a + j
        yield k, total, total / (j - i)
        for other, g in gains.items():
            if other != k and (t := sum(g[i:j])) >= ALSO * total:
                yield other, t, t / (j - i)
        parts += [(x, y) for x, y in ((a, i), (j, z)) if y - x >= SHORTEST]


def majority_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, label): the label most raters gave, none on a tie."""
    votes = labels.where("doc_id is not null and label is not null").select("doc_id", "rater", "label").distinct().groupBy("doc_id", "label").count()
    w = Window.partitionBy("doc_id")
    return votes.withColumn("top", F.max("count").over(w)).where("count = top").withColumn("n", F.count("*").over(w)).where("n = 1").select("doc_id", "label")


def numbered(texts: DataFrame) -> DataFrame:
    """(label, doc_id, words): the words of each text as numbers, each sentence after a 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Numbers()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([words.of(t) for t in b.column(2).to_pylist()], pa.list_(pa.int32()))], names=["label", "doc_id", "words"])

    return texts.select("label", "doc_id", "text").mapInArrow(run, "label string, doc_id long, words array<int>")


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Models:
    order = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = majority_labels(labels).where(F.col("label").isin(*CLASSES)).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_label).drop("_n")
    # at most per_label rows a class, and their words only
    rows = numbered(docs.where("text is not null and doc_id is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")).toArrow().sort_by([("label", "ascending"), ("doc_id", "ascending")])
    words = rows["words"].combine_chunks()
    offsets, values = words.offsets.to_numpy(), words.values.to_numpy()
    return Models.of_numbers(rows["label"].to_pylist(), [values[a:z] for a, z in zip(offsets[:-1], offsets[1:])])


def score_documents(docs: DataFrame, models: Models) -> DataFrame:
    """(doc_id, source, abusive, hateful, sexual, then the same with _mean, then with _passages): scores of every document.

    The first two are of the category's greatest gain, however small.  Passages are the stretches that are of the category
    itself, as (total, mean), all of at least LISTED that no other surpasses in both.  ``least`` is the total from which
    a passage counts."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    names = [*CATEGORIES, *(f"{k}_mean" for k in CATEGORIES)]
    lists = [f"{k}_passages" for k in CATEGORIES]
    passage = pa.list_(pa.struct([("total", pa.float64()), ("mean", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        words = Numbers(m.lookup.name)
        for whole in batches:
            for b in bounded(whole, 2):
                totals, means, found = m.score([words.of(t) for t in b.column(2).to_pylist()])
                cols = [pa.array(v, pa.float64()) for v in (*totals, *means)]
                cols += [pa.array([[{"total": a, "mean": z} for a, z in p] for p in row], passage) for row in found]
                cols.append(pa.array([m.least] * len(b), pa.float64()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], names=["doc_id", "source", *names, *lists, "least"])

    kinds = [*(f"{n} double" for n in names), *(f"{n} array<struct<total double, mean double>>" for n in lists), "least double"]
    return docs.select("doc_id", "source", "text").mapInArrow(run, "doc_id long, source string, " + ", ".join(kinds))


def hits(category: str) -> Column:
    """Whether a document holds a passage of the category."""
    return F.exists(f"{category}_passages", lambda p: (p["total"] >= F.col("least")) & (p["mean"] >= THRESHOLD))


def flagged(scores: DataFrame) -> DataFrame:
    """(doc_id, category) of every document that holds such a passage."""
    listed = F.array(*[F.when(hits(k), k) for k in CATEGORIES])
    return scores.select("doc_id", F.explode(F.filter(listed, lambda c: c.isNotNull())).alias("category")).distinct()


def source_rates(scores: DataFrame) -> DataFrame:
    """Per source: documents, and the share with each category."""
    return scores.groupBy("source").agg(F.count("*").alias("documents"), *[F.avg(hits(k).cast("double")).alias(f"{k}_rate") for k in CATEGORIES])
