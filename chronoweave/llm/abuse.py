"""Scores for abusive, hateful or sexual language: boosted trees over dense features.

Text is cut into words once; every word is brought to a normal form that undoes
the usual disguises (look-alike letters, digits for letters, repeated letters,
masks, spaced, dotted or hyphenated spellings) and becomes a number.  All that
follows is vectorised over the words of a whole batch of documents: densities
of the seed lexicon, distance to a second-person word and to other people,
capitals, punctuation, disguise rates, and densities of a *learned lexicon* -
word sequences whose frequency in marked and unmarked documents differs.

The dense features go to gradient-boosted symmetric trees, their score through
an isotonic calibration.  Everything is fitted here, on the review labels;
features of the learned lexicon are computed out of fold for the training
documents.  The fit does not depend on the order or the partitions in which
documents come: they are brought to one row per text and sorted by its digest.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm import lexicon
from chronoweave.llm.measure import spread
from chronoweave.sources.shipping import ship_package

WORD = re.compile(r"[@$]?[^\W_]+(?:[@$!+*]+[^\W_]+)*")
#: Invisible characters that are dropped, and look-alike letters by the letter they imitate.
INVISIBLE = dict.fromkeys(map(ord, "\u00ad\u200b\u200c\u200d\u2060\ufeff"))
LOOK_ALIKE = str.maketrans("авсеіјкмнорѕтухԁɡαβερτοικνη", "abceijkmhopstyxdgabeptoikvn")
#: Digits and signs by the letter they stand for.
LEET = str.maketrans("013457@$+!", "oieastasti")
DOUBLED = re.compile(r"(.)\1+")

INSULT, SEXUAL, HOSTILE, PERSON, DISGUISED, CAPITAL, SINGLE, SECOND = (1 << k for k in range(32, 40))
EMPHASIS = re.compile(r"[!?]{2,}")
HASH = (1 << 32) - 1
#: A word of one letter carries it above the flags, so that spelled words can be read back.
LETTER = 40
WINDOW = 8
PURE = 3.0
FEATURES = (
    "cue_window", "cue_second", "cue_best", "cue_total", "cue_count", "cue_negative",
    "insults", "sexual", "hostile", "seed_window", "second_distance", "disguised_seeds",
    "capitals", "exclamations", "disguise_rate", "seed_run", "log_words",
    "pure_window", "pure_count", "purest", "lowered_beside", "seed_beside", "emphasis", "person_distance",
)


def normal(word: str) -> tuple[str, bool]:
    """The undisguised form of a word, and whether a disguise was taken off."""
    low = word.lower()
    plain = low
    if not low.isascii():
        latin = any("a" <= c <= "z" for c in low)
        if latin:
            plain = plain.translate(LOOK_ALIKE)
        plain = "".join(c for c in unicodedata.normalize("NFKD", plain) if not unicodedata.combining(c))
        hidden = latin and any("\u0370" <= c <= "\u052f" for c in low)
    else:
        hidden = False
    letters = any(c.isalpha() for c in plain)
    if letters and not plain.isalpha():
        undone = plain.translate(LEET)
        hidden = hidden or undone.isalpha()
        plain = undone
    elif not letters:
        return "#", False
    short = DOUBLED.sub(r"\1", plain)
    hidden = hidden or bool(re.search(r"(.)\1\1", plain))
    if len(word) > 3 and word[1:] != low[1:] and not word.isupper() and sum(a.isupper() != b.isupper() for a, b in zip(word, word[1:])) > 2:
        hidden = True
    return short, hidden


def _flags() -> dict[str, int]:
    found: dict[str, int] = {}
    for words, flag in ((lexicon.INSULTS, INSULT), (lexicon.SEXUAL, SEXUAL), (lexicon.HOSTILE, HOSTILE), (lexicon.SECOND, SECOND), (lexicon.PEOPLE, PERSON)):
        for w in words:
            form = normal(w)[0]
            found[form] = found.get(form, 0) | flag
    return found


SEEDS = _flags()
SEED_BITS = INSULT | SEXUAL | HOSTILE


def _hash(text: str) -> int:
    return zlib.crc32(text.encode())


def _masks() -> dict[tuple[str, int, str], str]:
    """Masked spellings keep the first and last letter and the length."""
    found: dict[tuple[str, int, str], str] = {}
    for w in sorted({*lexicon.INSULTS, *lexicon.SEXUAL, *lexicon.HOSTILE}):
        if len(w) > 3:
            found.setdefault((w[0], len(w), w[-1]), normal(w)[0])
    return found


MASKS = _masks()
#: Pairs of fragments that a hyphen or the like has cut out of one seed word.
FRAGMENTS = {
    (_hash(f[:k]) * 1_000_003 + _hash(f[k:])) & ((1 << 62) - 1): _hash(f) | b
    for f, b in SEEDS.items() if b & SEED_BITS and len(f) > 4 for k in range(2, len(f) - 1)
}
_FRAGMENT_KEYS = np.array(sorted(FRAGMENTS), dtype=np.int64)
_FRAGMENT_BITMAP = np.zeros(1 << 20, dtype=bool)
_FRAGMENT_BITMAP[_FRAGMENT_KEYS & ((1 << 20) - 1)] = True


#: The words of an identifier like tellThatBoss; short parts are rather a disguise, as in mOrOn.
CAMEL = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[^A-Za-z]+")


class Words(dict):
    """Word to its numbers: 32 bits of hash and, above, the flags; remembers what it has seen.

    An identifier in camel case has one number per part, anything else one.
    """

    LIMIT = 1_000_000

    def __missing__(self, word: str) -> tuple[int, ...]:
        parts = [word]
        if len(word) > 5 and word.isascii() and not (word.islower() or word.isupper() or word[1:].islower()):
            split = CAMEL.findall(word)
            if len(word) >= 3 * len(split):
                parts = split
        codes = tuple(self.encode(p) for p in parts)
        if len(self) < self.LIMIT:
            self[word] = codes
        return codes

    @staticmethod
    def encode(word: str) -> int:
        if "*" in word:
            first, last = word[0].lower(), word[-1].lower()
            form = MASKS.get((first, len(word), last))
            if form:
                return _hash(form) | SEEDS[form] | DISGUISED
        form, hidden = normal(word)
        code = _hash(form) | SEEDS.get(form, 0)
        if hidden:
            code |= DISGUISED
        if len(word) == 1:
            code |= SINGLE | ord(word) << LETTER
        elif len(word) > 2 and word.isupper():
            code |= CAPITAL
        return code


def encode_texts(texts: Iterable[str | None], words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes of all words, offset of each document, exclamation marks and emphatic runs of each document)."""
    parts, offsets, marks = [], [0], []
    total = 0
    for text in texts:
        text = text or ""
        if not text.isascii():
            text = text.translate(INVISIBLE)
        codes = np.fromiter(chain.from_iterable(map(words.__getitem__, WORD.findall(text))), dtype=np.int64)
        codes = _join_spelled(codes)
        parts.append(codes)
        total += len(codes)
        offsets.append(total)
        marks.append((text.count("!"), len(EMPHASIS.findall(text)) if "!" in text or "?" in text else 0))
    flat = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
    return flat, np.asarray(offsets, dtype=np.int64), np.asarray(marks, dtype=np.float64).reshape(-1, 2)


def _join_spelled(codes: np.ndarray) -> np.ndarray:
    """Put words together again that were spelled out (a b c) or cut in two (ab-c)."""
    if len(codes) < 2:
        return codes
    single = (codes & SINGLE) != 0
    if single.any():
        edge = np.flatnonzero(np.diff(np.r_[0, single.astype(np.int8), 0]))
        for a, b in zip(edge[::2], edge[1::2]):
            if b - a > 3:
                letters = [chr(c >> LETTER) for c in codes[a:b].tolist()]
                # The run may hold further one-letter words at its borders.
                for i, j in ((a, b), (a + 1, b), (a, b - 1)):
                    form = normal("".join(letters[i - a : j - a]) or "#")[0]
                    if SEEDS.get(form, 0) & SEED_BITS:
                        codes[i] = _hash(form) | SEEDS[form] | DISGUISED
                        codes[i + 1 : j] = 0
                        break
                else:
                    codes[a] = _hash(normal("".join(letters) or "#")[0]) | DISGUISED
                    codes[a + 1 : b] = 0
        codes = codes[codes != 0]
        if len(codes) < 2:
            return codes
    h = codes & HASH
    pair = (h[:-1] * 1_000_003 + h[1:]) & ((1 << 62) - 1)
    for k in np.flatnonzero(_FRAGMENT_BITMAP[pair & ((1 << 20) - 1)]):
        whole = FRAGMENTS.get(int(pair[k]))
        if whole is not None:
            codes[k] = whole | DISGUISED
            codes[k + 1] = 0
    return codes[codes != 0]


def grams(codes: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Hashes of the word sequences that end at each word: 1, 2, 3 words, and 2 around one left out.

    Zero where the sequence would reach over the start of its document.
    """
    h = (codes & HASH).astype(np.uint64)
    n = len(h)
    place = np.arange(n) - np.repeat(offsets[:-1], np.diff(offsets))
    one = h * np.uint64(0x9E3779B97F4A7C15)
    found = [one ^ np.uint64(1)]
    for lags, salt in (((1,), 2), ((1, 2), 3), ((2,), 4)):
        g = one.copy()
        for lag in lags:
            shifted = np.zeros(n, dtype=np.uint64)
            shifted[lag:] = one[:-lag]
            g = (g ^ (shifted >> np.uint64(7 * lag))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * lag)
        g ^= np.uint64(salt)
        g[place < max(lags)] = 0
        found.append(g)
    return found


class Cues:
    """Word sequences with their log-odds weight, looked up through a bitmap and a sorted array."""

    BITS = 22

    def __init__(self, keys: np.ndarray, weights: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.weights = keys[order], weights[order].astype(np.float32)
        self._bitmap: np.ndarray | None = None

    def __getstate__(self):
        return {"keys": self.keys, "weights": self.weights, "_bitmap": None}

    def weigh(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), dtype=np.float32)
        if not len(self.keys) or not len(hashes):
            return out
        shift = np.uint64(64 - self.BITS)
        if self._bitmap is None:
            self._bitmap = np.zeros(1 << self.BITS, dtype=bool)
            self._bitmap[self.keys >> shift] = True
        hit = np.flatnonzero(self._bitmap[hashes >> shift])
        at = np.minimum(np.searchsorted(self.keys, hashes[hit]), len(self.keys) - 1)
        same = self.keys[at] == hashes[hit]
        out[hit[same]] = self.weights[at[same]]
        return out


def learn_cues(keys: np.ndarray, marked: np.ndarray, seen: np.ndarray, rate: float, least: int = 3) -> Cues:
    """Cues from sequences, the number of marked documents and of all documents they are in, and the rate of marked ones.

    Kept: sequences in at least ``least`` marked documents with clearly raised
    odds, and sequences of many unmarked documents with clearly lowered ones.
    """
    rate = min(max(rate, 1e-3), 1 - 1e-3)
    odds = np.log((marked + 0.3) / (seen - marked + 0.7)) - math.log(rate / (1 - rate))
    keep = ((marked >= least) & (odds > 1.2)) | ((seen >= 8) & (odds < -1.0))
    keep &= keys != 0
    return Cues(keys[keep], np.clip(odds[keep], -3, 5))


def dense(codes: np.ndarray, offsets: np.ndarray, marks: np.ndarray, cues: Cues) -> np.ndarray:
    """The dense feature matrix, one row per document, columns as in FEATURES."""
    n, docs = len(codes), len(offsets) - 1
    out = np.zeros((docs, len(FEATURES)), dtype=np.float32)
    size = np.diff(offsets)
    out[:, [10, 23]] = 30
    if not n or not docs:
        return out
    full = np.flatnonzero(size)
    starts = offsets[full]

    def total(x: np.ndarray) -> np.ndarray:
        r = np.zeros(docs)
        r[full] = np.add.reduceat(x, starts)
        return r

    def most(x: np.ndarray) -> np.ndarray:
        r = np.zeros(docs)
        r[full] = np.maximum.reduceat(x, starts)
        return r

    def windowed(x: np.ndarray) -> np.ndarray:
        """Sum over the WINDOW words that end at each word, cut at the start of the document."""
        c = np.r_[0.0, np.cumsum(x, dtype=np.float64)]
        end = np.arange(1, n + 1)
        begin = np.maximum(end - WINDOW, np.repeat(offsets[:-1], size))
        return c[end] - c[begin]

    weights = [cues.weigh(h) for h in grams(codes, offsets)]
    raised = np.maximum(weights[0], 0) * 0.5 + sum(np.maximum(w, 0) for w in weights[1:])
    lowered = np.minimum(weights[0], 0) * 0.5 + sum(np.minimum(w, 0) for w in weights[1:])
    win = windowed(raised + lowered * 0.5)
    best = most(win)
    out[:, 0] = best
    # The best window that does not overlap the first one: evidence in a second place.
    owner = np.repeat(np.arange(docs), size)
    near = np.zeros(n, dtype=bool)
    top = np.flatnonzero((win >= best[owner] - 1e-9) & (win > 0))
    for shift in range(-WINDOW, WINDOW + 1):
        beside = np.clip(top + shift, 0, n - 1)
        near[beside[owner[beside] == owner[top]]] = True
    out[:, 1] = most(np.where(near, 0, win))
    out[:, 2] = most(np.maximum.reduce(weights))
    words = np.maximum(size, 1)
    out[:, 3] = total(raised + lowered) / np.sqrt(words)
    out[:, 4] = total((raised > 2).astype(np.float64))
    out[:, 5] = -total(lowered) / words

    insult, sexual, hostile = ((codes & b) != 0 for b in (INSULT, SEXUAL, HOSTILE))
    seed = insult | sexual | hostile
    out[:, 6], out[:, 7], out[:, 8] = (total(x.astype(np.float64)) / np.sqrt(words) for x in (insult, sexual, hostile))
    out[:, 9] = most(windowed(seed.astype(np.float64)))
    seeds = np.flatnonzero(seed)
    for column, flag in ((10, SECOND), (23, PERSON)):
        person = np.flatnonzero((codes & flag) != 0)
        if len(person) and len(seeds):
            after = np.searchsorted(person, seeds)
            gap = np.full(len(seeds), 30)
            for side in (np.minimum(after, len(person) - 1), np.maximum(after - 1, 0)):
                distance = np.abs(person[side] - seeds)
                gap = np.where(owner[person[side]] == owner[seeds], np.minimum(gap, distance), gap)
            np.minimum.at(out[:, column], owner[seeds], gap)
    hidden = (codes & DISGUISED) != 0
    out[:, 11] = total((seed & hidden).astype(np.float64))
    out[:, 12] = total(((codes & CAPITAL) != 0).astype(np.float64)) / words
    out[:, 13] = marks[:, 0] / words
    out[:, 22] = marks[:, 1] / np.sqrt(words)
    out[:, 14] = total(hidden.astype(np.float64)) / words
    run = seed.astype(np.float64)
    for _ in range(2):
        run[1:] = np.where(seed[1:] & seed[:-1] & (owner[1:] == owner[:-1]), run[:-1] + 1, run[1:])
    out[:, 15] = most(run)
    out[:, 16] = np.log1p(size)
    # Cues that hardly occur in unmarked documents, and what stands beside the best of them.
    sharp = sum((w > PURE).astype(np.float64) for w in weights)
    pure = windowed(sharp)
    out[:, 17] = most(pure)
    out[:, 18] = total((sharp > 0).astype(np.float64))
    out[:, 19] = most(np.maximum.reduce(weights[1:]))
    low, seeded = windowed(-lowered), windowed(seed.astype(np.float64))
    at_best = (win >= best[owner] - 1e-9) & (win > 0)
    out[:, 20] = most(np.where(at_best, low, 0.0))
    out[:, 21] = most(np.where(at_best, seeded, 0.0))
    return out


class Trees:
    """Gradient-boosted symmetric trees for a logistic loss."""

    def __init__(self, rounds: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 32, shrink: float = 4.0):
        self.rounds, self.depth, self.rate, self.bins, self.shrink = rounds, depth, rate, bins, shrink
        self.base = 0.0
        self.splits: list[list[tuple[int, float]]] = []
        self.leaves: list[np.ndarray] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Trees":
        n, width = x.shape
        rate = min(max(float(y.mean()) if n else 0.0, 1e-4), 1 - 1e-4)
        self.base = math.log(rate / (1 - rate))
        if n < 2:
            return self
        edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, self.bins + 1)[1:-1])) for k in range(width)]
        binned = np.stack([np.searchsorted(edges[k], x[:, k], side="left") for k in range(width)], axis=1)
        score = np.full(n, self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
            leaf = np.zeros(n, dtype=np.int64)
            split: list[tuple[int, float]] = []
            for level in range(self.depth):
                best = (1e-9, -1, 0)
                for k in range(width):
                    m = len(edges[k]) + 1
                    if m < 2:
                        continue
                    cell = leaf * m + binned[:, k]
                    g = np.bincount(cell, weights=grad, minlength=(1 << level) * m).reshape(-1, m)
                    h = np.bincount(cell, weights=hess, minlength=(1 << level) * m).reshape(-1, m)
                    gl, hl = g.cumsum(1)[:, :-1], h.cumsum(1)[:, :-1]
                    gt, ht = g.sum(1, keepdims=True), h.sum(1, keepdims=True)
                    gain = (gl**2 / (hl + self.shrink) + (gt - gl) ** 2 / (ht - hl + self.shrink) - gt**2 / (ht + self.shrink)).sum(0)
                    at = int(gain.argmax())
                    if gain[at] > best[0]:
                        best = (float(gain[at]), k, at)
                if best[1] < 0:
                    break
                split.append((best[1], float(edges[best[1]][best[2]])))
                leaf = leaf * 2 + (binned[:, best[1]] > best[2])
            if not split:
                break
            count = 1 << len(split)
            value = np.bincount(leaf, weights=grad, minlength=count) / (np.bincount(leaf, weights=hess, minlength=count) + self.shrink)
            self.splits.append(split)
            self.leaves.append(value * self.rate)
            score += self.leaves[-1][leaf]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for split, leaves in zip(self.splits, self.leaves):
            leaf = np.zeros(len(x), dtype=np.int64)
            for k, at in split:
                leaf = leaf * 2 + (x[:, k] > at)
            out += leaves[leaf]
        return out


class Isotonic:
    """Monotone map from score to probability (pool adjacent violators)."""

    def __init__(self, score: np.ndarray, y: np.ndarray):
        order = np.argsort(score, kind="stable")
        blocks: list[list[float]] = []  # mean, weight, first score, last score
        for s, v in zip(score[order].tolist(), y[order].tolist()):
            blocks.append([v, 1.0, s, s])
            while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
                b, a = blocks.pop(), blocks.pop()
                w = a[1] + b[1]
                blocks.append([(a[0] * a[1] + b[0] * b[1]) / w, w, a[2], b[3]])
        self.x = np.array([v for b in blocks for v in (b[2], b[3])] or [0.0])
        self.y = np.array([v for b in blocks for v in (b[0], b[0])] or [0.0])

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.x, self.y)


class Model:
    """What scoring needs: cues, trees and calibration."""

    def __init__(self, cues: Cues, trees: Trees, calibration: Isotonic):
        self.cues, self.trees, self.calibration = cues, trees, calibration
        self._words: Words | None = None

    def __getstate__(self):
        return {"cues": self.cues, "trees": self.trees, "calibration": self.calibration, "_words": None}

    def score(self, texts: Iterable[str | None]) -> np.ndarray:
        if self._words is None:
            self._words = Words()
        codes, offsets, marks = encode_texts(texts, self._words)
        return self.calibration(self.trees.score(dense(codes, offsets, marks, self.cues)))


def train(batches: Iterable[tuple[list[str | None], np.ndarray]], folds: int = 4) -> Model:
    """Fit on batches of (texts, labels between 0 and 1)."""
    words = Words()
    coded: list[tuple[np.ndarray, np.ndarray, float]] = []
    for texts, y in batches:
        codes, offsets, marks = encode_texts(texts, words)
        coded += [(codes[offsets[k] : offsets[k + 1]], marks[k], float(y[k])) for k in range(len(texts))]
    return train_coded(coded, folds)


def train_coded(rows: list[tuple[np.ndarray, np.ndarray, float]], folds: int = 4) -> Model:
    """Fit on (word codes, punctuation, label) per document.

    Documents with the same words and punctuation count once, with the mean of
    their labels, so copies cannot make a chance sequence look like a cue;
    where the marks of copies balance out there is no label, and the text is
    left out.  Folds go by the digest of a text and rows are sorted by it, so
    the order in which documents come does not matter.
    """
    texts: dict[bytes, tuple[np.ndarray, np.ndarray, list[float]]] = {}
    for codes, marks, y in rows:
        digest = hashlib.blake2b(codes.tobytes() + marks.tobytes(), digest_size=16).digest()
        texts.setdefault(digest, (codes, marks, []))[2].append(y)
    one = {d: (c, m, sum(sorted(y)) / len(y)) for d, (c, m, y) in sorted(texts.items())}
    one = {d: row for d, row in one.items() if row[2] != 0.5}
    if not one:
        return Model(Cues(np.zeros(0, np.uint64), np.zeros(0)), Trees().fit(np.zeros((0, len(FEATURES))), np.zeros(0)), Isotonic(np.zeros(1), np.zeros(1)))
    coded = list(one.values())
    hard = np.array([float(y > 0.5) for *_, y in coded])
    fold = np.array([int.from_bytes(d[:4], "big") % folds for d in one])

    def features(which: np.ndarray, cues: Cues) -> np.ndarray:
        found = [np.zeros((0, len(FEATURES)), np.float32)]
        for k in range(0, len(which), 256):
            part = [coded[r] for r in which[k : k + 256]]
            offsets = np.r_[0, np.cumsum([len(c) for c, *_ in part])]
            found.append(dense(np.concatenate([c for c, *_ in part]), offsets, np.array([m for _, m, _ in part]), cues))
        return np.concatenate(found)

    keys, marked, seen = count_sequences([c for c, *_ in coded], hard, fold, folds)
    x = np.zeros((len(hard), len(FEATURES)), dtype=np.float32)
    held_out = np.zeros(len(hard))
    for f in range(folds):
        inside = fold != f
        cues = learn_cues(keys, marked.sum(1) - marked[:, f], seen.sum(1) - seen[:, f], hard[inside].mean() if inside.any() else 0.5)
        x[~inside] = features(np.flatnonzero(~inside), cues)
    for f in range(folds):
        if (fold == f).any():
            held_out[fold == f] = Trees().fit(x[fold != f], hard[fold != f]).score(x[fold == f])
    model = Model(learn_cues(keys, marked.sum(1), seen.sum(1), hard.mean()), Trees().fit(x, hard), Isotonic(held_out, hard))
    model.held_out = (held_out, hard)
    return model


def count_sequences(documents: list[np.ndarray], label: np.ndarray, fold: np.ndarray, folds: int, least: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequences, marked documents, all documents): per sequence in at least ``least`` documents, counts by fold.

    Documents are first counted per hash slot, so that sequences too rare to
    become cues are never brought together.
    """
    shift = np.uint64(64 - 22)
    own = [np.unique(np.concatenate(grams(c, np.array([0, len(c)])))) for c in documents]
    slots = np.zeros(1 << 22, dtype=np.uint16)
    for u in own:
        slots[np.unique(u >> shift)] += 1
    kept = [u[slots[u >> shift] >= least] for u in own]
    place = np.repeat(np.arange(len(kept)), [len(u) for u in kept])
    keys, index = np.unique(np.concatenate(kept) if kept else np.zeros(0, np.uint64), return_inverse=True)
    cell = index * folds + fold[place]
    count = lambda weights: np.bincount(cell, weights=weights, minlength=len(keys) * folds).reshape(-1, folds)
    return keys, count(label[place]), count(None)


def labelled(documents: DataFrame, labels: DataFrame, max_documents: int = 8_000) -> DataFrame:
    """(doc_id, text, label): the training sample, at most ``max_documents`` of the marked documents, chosen by a hash of the id.

    Marks of one document are averaged; NULL marks are ignored; documents whose
    marks balance out are left out.
    """
    marks = (
        labels.where("abusive is not null and doc_id is not null")
        .groupBy("doc_id")
        .agg(F.avg("abusive").alias("label"))
        .where("label != 0.5")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_documents)
    )
    return spread(documents.select("doc_id", "text")).join(F.broadcast(marks), "doc_id")


def fit(documents: DataFrame, labels: DataFrame, max_documents: int = 8_000, max_characters: int = 100_000_000) -> bytes:
    """Train on a sample bounded in documents and characters; only the finished model comes to the driver.

    Texts are turned into word codes where they lie; the codes of the sample
    meet in one task, in the order of a hash of their id, and that task takes
    documents until they have ``max_characters`` together.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                codes, offsets, marks = encode_texts(part.column("text").to_pylist(), words)
                own = [codes[offsets[i] : offsets[i + 1]].tobytes() for i in range(part.num_rows)]
                size = [len(t or "") for t in part.column("text").to_pylist()]
                columns = [part.column("doc_id"), pa.array(size, pa.int64()), pa.array(own, pa.binary()), pa.array([m.tobytes() for m in marks], pa.binary()), part.column("label")]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "size", "codes", "marks", "label"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, left = [], max_characters
        for row in (r for b in batches for r in b.to_pylist()):
            left -= row["size"]
            if left < 0:
                break
            rows.append((np.frombuffer(row["codes"], dtype=np.int64), np.frombuffer(row["marks"], dtype=np.float64), row["label"]))
        model = train_coded(rows)
        model.held_out = None
        yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(model)]})

    ship_package(documents.sparkSession)
    coded = labelled(documents, labels, max_documents).mapInArrow(encode, "doc_id bigint, size bigint, codes binary, marks binary, label double")
    row = coded.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").mapInArrow(run, "model binary").first()
    # No marks, no task: the model of nothing gives every text the score 0.
    return pickle.dumps(train([])) if row is None else bytes(row["model"])


def score_documents(documents: DataFrame, model: bytes) -> DataFrame:
    """(doc_id, source, score): the calibrated probability for every document.

    NULL and empty texts are scored like any other text without words; extra
    columns are ignored; repeated rows give repeated rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer: Model = pickle.loads(model)
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                score = scorer.score(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("source"), pa.array(score, pa.float64())], names=["doc_id", "source", "score"])

    ship_package(documents.sparkSession)
    return spread(documents.select("doc_id", "source", "text")).mapInArrow(run, "doc_id bigint, source string, score double")


def abusive(scored: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(doc_id) of the documents that score ``threshold`` or more, each once; a NULL id names none."""
    return scored.where((F.col("score") >= threshold) & F.col("doc_id").isNotNull()).select("doc_id").distinct()


def source_rates(scored: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Per source: documents, abusive documents, their rate and the mean score."""
    flag = (F.col("score") >= threshold).cast("int")
    return scored.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.sum(flag).cast("bigint").alias("abusive"),
        F.avg(flag).alias("rate"), F.avg("score").alias("mean_score"),
    )
