"""Toxicity by a support vector machine on a subsequence string kernel with Nyström landmarks, trained on sentences.

Words are compared by the gapped subsequences of four characters that they share within SPAN characters, each weighing
DECAY per skipped character, with marks before and after the word; a word thus stays alike if characters are inserted or
gaps opened. The word kernel is normalised by its own norm and raised to POWER; the kernel of two sentences sums it over
their pairs of distinct words. It is a sum of powers of inner products, hence positive semidefinite.

Labels are known by document, so that training picks sentences: in each round the machine learns from one sentence of
each toxic document, the one with the highest margin so far, and its others beyond what clean ones reach, against all
sentences of clean documents. Landmarks are stretches of one word, or of two words of one sentence: first those that toxic
documents hold more often than chance allows (evidence()), as many as these documents need, then the words of those
sentences. The kernel of a stretch of two words with a sentence is the product of both words' kernels with it. A document
is as toxic as its most toxic sentence.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from math import lgamma, log
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.shared import give_back, held_by_worker, let_go, slices, small_batches

#: Chosen by toxicity_settings, as are HALF and RIDGE.
SPAN, DECAY, POWER = 6, 0.6, 2
#: Where a score of 0.5 lies between the margins of clean documents and the margin of 1.
HALF = 0.2


def steps(span: int, decay: float) -> list[tuple[int, int, int, float]]:
    """The places of the other three characters of a subsequence after its first, and its weight."""
    return [(i, j, k, decay ** (k - 3)) for i in range(1, span - 2) for j in range(i + 1, span - 1) for k in range(j + 1, span)]


STEPS = steps(SPAN, DECAY)
#: Subsequences are told apart by a hash of so many bits.
BITS = 18
SPACED = re.compile(r"(?<!\S)\w(?:[ \t.*_-]{1,2}\w){2,}(?![^\s.,!?;:])")
#: Signs that stand for a letter between two letters.
SIGNS = str.maketrans("013457@$!|", "oieastasil")
BETWEEN = re.compile(r"(?<=[^\W\d_])[013457@$!|](?=[^\W\d_])")
#: A sentence ends after so many words, if no sign ends it before.
SENTENCE = 12
#: Documents of each label that training takes, by hash of their identifiers.
TOXIC_SAMPLE, CLEAN_SAMPLE = 600, 900
#: Landmarks, two thirds of them from toxic sentences at most, and rounds of training.
LANDMARKS, ROUNDS = 144, 4
#: How much more frequent in toxic documents a subsequence must be to tell something before the first round.
TELLING = 4
#: Words and pairs of words that stand out: share of false ones among those taken, by how much more frequent they are, and
#: how many are taken at most; pairs are counted by a hash of so many bits.
FALSE_SHARE, APART, MOST_WORDS, MOST_PAIRS, PAIR_BITS = 0.05, 3, 400, 100, 22
#: A word counts toward a stretch of two words from this kernel on.
LIKE = 0.25
#: The machine's ridge times the number of toxic documents, as each has so much less say the more there are.
RIDGE = 0.07
#: Weight of landmarks with inserted characters, against 1 for the sentences of toxic documents.
ALTERED = 0.05
#: Words, or sentences, that training takes at a time.
BLOCK = 4000
#: Words that a worker keeps.
CACHE_ENTRIES = 100_000


@dataclass(frozen=True)
class Model:
    """Landmarks with their weights, the machine's bias, the logistic that makes scores of margins, and the margin that
    few clean documents reach."""

    landmarks: tuple[str, ...]
    weights: tuple[float, ...]
    bias: float
    slope: float
    shift: float
    low: float = 0.0
    pairs: tuple[tuple[str, str], ...] = ()
    pair_weights: tuple[float, ...] = ()

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


def letters(token: str) -> str:
    """A token's letters; a sign that often stands for one counts as that one, if letters surround it."""
    return token if token.isalpha() else "".join(filter(str.isalpha, BETWEEN.sub(lambda m: m[0].translate(SIGNS), token)))


class Words(dict):
    """The letters of each token and whether it ends a sentence."""

    def __missing__(self, token: str) -> tuple[str, bool]:
        if len(self) > CACHE_ENTRIES:
            self.clear()
        self[token] = out = letters(token), token[-1] in ".!?"
        return out


def sentences(text: str, words: Words) -> list[list[str]]:
    """The distinct words of each sentence, in lower case; characters parted by spaces or signs are one word."""
    text = text.lower()
    out, now, n = [], {}, 0
    for token in SPACED.sub(lambda m: "".join(filter(str.isalnum, m[0])), text).split():
        word, ends = words[token]
        if word:
            now[word] = None
            n += 1
        if n and (ends or n >= SENTENCE):
            out.append(list(now))
            now, n = {}, 0
    if n:
        out.append(list(now))
    return out


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, subsequence, weight) of the distinct subsequences of each word, in order; weights are normalised."""
    raw = np.frombuffer(("\n" + "\n".join(words) + "\n").encode("utf-32-le"), "<u4").astype(np.uint64)
    mark = raw == 10
    begins, odd = np.cumsum(mark) - 1, [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
    ends = np.where(mark, begins - 1, begins)  # a mark ends one word and begins the next
    one, two, three, four = (raw * m for m in odd)
    keys, weights = [], []
    for i, j, k, weight in STEPS:
        if len(raw) > k:
            inside = np.flatnonzero(begins[:-k] == ends[k:])
            h = one[inside] + two[inside + i] + three[inside + j] + four[inside + k]
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            keys.append((begins[inside] << BITS) + (h >> np.uint64(64 - BITS)).astype(np.int64))
            weights.append(np.full(len(inside), weight))
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    weight = np.bincount(inverse, weights=np.concatenate(weights))
    word = key >> BITS
    return word, key & ((1 << BITS) - 1), weight / np.sqrt(np.bincount(word, weights=weight * weight, minlength=len(words)))[word]


class Landmarks:
    """The landmarks' subsequences as a table, a column each, of which only rows are held that some landmark has."""

    def __init__(self, words: list[str]) -> None:
        self.words = words
        word, own, weight = subsequences(words)
        rows = np.unique(own)
        self.table = np.zeros((len(rows), len(words)), np.float32)
        self.table[np.searchsorted(rows, own), word] = weight
        self.row = np.full(1 << BITS, -1, np.int32)
        self.row[rows] = np.arange(len(rows))

    def kernel(self, n: int, word: np.ndarray, own: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The word kernel of n words, given by their subsequences, with each landmark."""
        out = np.zeros((n, len(self.words)), np.float32)
        row = self.row[own]
        hit = np.flatnonzero(row >= 0)
        row, word, weight = row[hit], word[hit], weight[hit].astype(np.float32)[:, None]
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(hit) else hit
        for a in range(0, len(first), 100):
            some = first[a : a + 100]
            end = first[a + 100] if a + 100 < len(first) else len(hit)
            out[word[some]] = np.add.reduceat(self.table[row[some[0] : end]] * weight[some[0] : end], some - some[0], axis=0)
        return out**POWER


def altered(word: str, rng: random.Random) -> list[str]:
    """The word with an inserted character, at any place, and with a repeated one."""
    if len(word) < 4:
        return []
    inserted = [word[:i] + rng.choice("abcdefghijklmnopqrstuvwxyz") + word[i:] for i in range(1, len(word))]
    return inserted + [word[:i] + word[i - 1] + word[i:] for i in range(1, len(word), 2)]


def apart(documents: list[set[str]], alike: float = 0.7) -> list[int]:
    """Which documents are no near copies of earlier ones: such share ``alike`` of their words. Those that share two of
    their least hashes, in any of six ways, are compared."""
    seen: dict[tuple, list[int]] = {}
    out = []
    for k, d in enumerate(documents):
        codes = np.array([crc32(w.encode()) for w in d] or [0], np.uint64)
        least = [int((codes * np.uint64(odd) & np.uint64(0xFFFFFFFF)).min()) for odd in range(0x9E3779B1, 0x9E3779B1 + 24, 2)]
        keys = set(zip(range(6), least[::2], least[1::2], strict=True))
        if not any(len(d & documents[x]) >= alike * len(d | documents[x]) for x in {x for key in keys for x in seen.get(key, ())}):
            out.append(k)
            for key in keys:
                seen.setdefault(key, []).append(k)
    return out


def beyond_chance(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Which things, held by so many toxic and clean documents, stand out.

    If labels were dealt by chance, a thing that n documents hold would be held by a binomial number of toxic ones. Of
    all things of the same n, those above a count are taken if chance makes at most FALSE_SHARE of them, and if they
    are APART times more frequent in toxic documents. Many rare things may thus tell what one of them can't.
    """
    rate, total = n_toxic / (n_toxic + n_clean), toxic.astype(np.int64) + clean
    out = np.zeros(len(total), bool)
    often = toxic * n_clean > APART * clean.astype(np.int64) * n_toxic
    for n in np.unique(total[often & (toxic > 1)]).tolist():
        of_n = np.flatnonzero(total == n)
        counts = np.bincount(toxic[of_n], minlength=n + 1)
        logs = np.array([lgamma(n + 1) - lgamma(a + 1) - lgamma(n - a + 1) + a * log(rate) + (n - a) * log(1 - rate) for a in range(n + 1)])
        share, middle = np.exp(logs), int(n * rate) + 1
        # things that tell nothing are as many as the lower half says
        idle = min(len(of_n), (counts[:middle].sum() + 1) / share[:middle].sum())
        chance, found = np.cumsum(share[::-1])[::-1] * idle, np.cumsum(counts[::-1])[::-1]
        fits = np.flatnonzero((found > 0) & (chance <= FALSE_SHARE * found))
        if len(fits):
            out[of_n[toxic[of_n] >= fits[0]]] = True
    return out & often & (toxic > 1)


def squared_hinge(samples: list[tuple[np.ndarray, np.ndarray, np.ndarray]], ridge: float = 1e-3, steps: int = 30) -> np.ndarray:
    """Newton's method on ridge |w|^2 / 2 + mean of the squared hinge losses; the last weight is the bias.

    samples are (features, labels of 1 and -1, weights), of which rows of weight 0 are left out; sums are made in double
    precision over BLOCK rows at a time.
    """
    total = sum(weight.sum() for _, _, weight in samples)
    w = np.zeros(samples[0][0].shape[1] + 1)
    blocks = [(x, y, weight, rows[a : a + BLOCK]) for x, y, weight in samples for rows in [np.flatnonzero(weight)] for a in range(0, len(rows), BLOCK)]
    for _ in range(steps):
        gradient, hessian = ridge * w, ridge * np.eye(len(w))
        for x, y, weight, rows in blocks:
            part = np.append(x[rows].astype(np.float64), np.ones((len(rows), 1)), axis=1)
            margin, own = part @ w, y[rows]
            on = own * margin < 1
            part, own_weight = part[on], weight[rows][on] / total
            gradient -= 2 * part.T @ (own_weight * (own[on] - margin[on]))
            hessian += 2 * (part * own_weight[:, None]).T @ part
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < 1e-7:
            break
    return w


def logistic(margin: np.ndarray, label: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift by Platt's method, whose targets keep away from 0 and 1."""
    high, low = label.sum(), len(label) - label.sum()
    target = np.where(label > 0, (high + 1) / (high + 2), 1 / (low + 2))
    x, w = np.stack([margin, np.ones(len(margin))], axis=1), np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (p - target))
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(w[1])


class Sentences:
    """The sentences of labelled documents: the document and the words (as numbers) of each."""

    def __init__(self, documents: list[tuple[str, int]]) -> None:
        known = Words()
        split = [(sentences(text, known), label) for text, label in documents]
        split = [x for x in split if x[0]]
        split = [split[k] for k in apart([set().union(*s) for s, _ in split])]
        self.label = np.array([y for _, y in split], np.int64)
        lists = [s for d, _ in split for s in d]
        self.document = np.repeat(np.arange(len(split)), [len(d) for d, _ in split])
        self.toxic = self.label[self.document] == 1
        self.vocabulary = sorted({w for s in lists for w in s})
        number = {w: i for i, w in enumerate(self.vocabulary)}
        self.first = np.cumsum([0, *map(len, lists)])
        self.word = np.fromiter((number[w] for s in lists for w in s), np.int64, int(self.first[-1]))
        del split, lists, known
        # of each block of words: where each one's subsequences begin, the subsequences, their weights
        self.features = []
        for a in range(0, len(self.vocabulary), BLOCK):
            part = self.vocabulary[a : a + BLOCK]
            w, own, weight = subsequences(part)
            self.features.append((np.searchsorted(w, np.arange(len(part) + 1)).astype(np.int32), own.astype(np.int32), weight.astype(np.float32)))

    def kernels(self, marks: Landmarks) -> Iterator[np.ndarray]:
        """The word kernel of all words with the landmarks, a block of words at a time."""
        for begins, own, weight in self.features:
            n = len(begins) - 1
            yield marks.kernel(n, np.repeat(np.arange(n), np.diff(begins)), own, weight)

    def by_word(self, marks: Landmarks, of) -> np.ndarray:
        """of(kernel with the landmarks) for all words, a block of them at a time."""
        out = None
        for k, kernel in enumerate(self.kernels(marks)):
            own = of(kernel)
            if out is None:
                out = np.empty((len(self.vocabulary), *own.shape[1:]), own.dtype)
            out[k * BLOCK : k * BLOCK + len(own)] = own
        return out

    def mapped(self, marks: Landmarks, nystroem: np.ndarray, some: np.ndarray, pair_values: np.ndarray) -> np.ndarray:
        """The features of some sentences: their words' kernel with the landmarks @ nystroem, summed, and pair_values.

        Each block of words is added to the sentences that hold them, so that features are never held of all words.
        """
        out = np.zeros((len(some), nystroem.shape[1] + pair_values.shape[1]), np.float32)
        out[:, nystroem.shape[1] :] = pair_values[some]
        at = np.full(len(self.document), -1, np.int32)
        at[some] = np.arange(len(some))
        row = np.repeat(at, np.diff(self.first))
        held = np.flatnonzero(row >= 0)
        block = (self.word[held] // BLOCK).astype(np.int32)
        order = np.argsort(block, kind="stable")
        held, cuts = held[order].astype(np.int32), np.searchsorted(block[order], np.arange(len(self.features) + 1))
        for k, kernel in enumerate(self.kernels(marks)):
            own = (kernel @ nystroem).astype(np.float32)
            for a in range(cuts[k], cuts[k + 1], BLOCK):
                part = held[a : min(a + BLOCK, cuts[k + 1])]
                rows, first = np.unique(row[part], return_index=True)
                out[rows, : own.shape[1]] += np.add.reduceat(own[self.word[part] - k * BLOCK], first, axis=0)
        return out

    def highest(self, margin: np.ndarray) -> np.ndarray:
        """The highest margin of each document's sentences."""
        out = np.full(len(self.label), -np.inf)
        np.maximum.at(out, self.document, margin)
        return out

    def telling(self) -> np.ndarray:
        """How much each word's subsequences are more frequent in toxic documents than chance gives, to begin with."""
        held, document = np.zeros((2, 1 << BITS)), np.repeat(self.document, np.diff(self.first))
        for k, y in enumerate(self.label.tolist()):
            a, b = np.searchsorted(document, [k, k + 1])
            words = np.unique(self.word[a:b]).tolist()
            held[y, np.unique(np.concatenate([own[begins[w % BLOCK] : begins[w % BLOCK + 1]] for w in words for begins, own, _ in [self.features[w // BLOCK]]]))] += 1
        toxic, clean = (self.label == 1).sum(), (self.label == 0).sum()
        share = (held.sum(axis=0) + 1) / (toxic + clean + 2)
        z = (held[1] / toxic - held[0] / clean) / np.sqrt(share * (1 - share) * (1 / toxic + 1 / clean))
        # a language or a source that is somewhat more frequent among toxic documents tells nothing
        z = np.where((z > 3) & (held[1] / toxic > TELLING * held[0] / clean), z, 0)
        return np.concatenate([np.bincount(np.repeat(np.arange(len(begins) - 1), np.diff(begins)), weights=weight * z[own], minlength=len(begins) - 1) for begins, own, weight in self.features])

    def pair_codes(self, document: int) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of distinct words within a document's sentences, as word * vocabulary + word, and their hashes."""
        a, b = np.searchsorted(self.document, [document, document + 1])
        found = []
        for i in range(a, b):
            words = np.sort(self.word[self.first[i] : self.first[i + 1]])
            low, high = np.triu_indices(len(words), 1)
            found.append(words[low] * len(self.vocabulary) + words[high])
        code = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        return code, ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)

    def covering(self, document: np.ndarray, thing: np.ndarray, most: int) -> list[int]:
        """Of things, given with the toxic documents that hold them: those that are needed to reach all of these, the one
        that reaches most others first; of equal ones the smaller."""
        order = np.lexsort((document, thing))
        document, thing = document[order], thing[order]
        ids, first = np.unique(thing, return_index=True)
        held = np.split(document, first[1:])
        open_, out = np.ones(len(self.label), bool), []
        gain = np.array([len(h) for h in held], np.int64)
        while len(out) < most and len(gain) and (k := int(gain.argmax())) >= 0 and gain[k] > 0:
            now = int(open_[held[k]].sum())
            if now < gain[k]:  # some have been reached since
                gain[k] = now
                continue
            out.append(int(ids[k]))
            open_[held[k]] = False
            gain[k] = 0
        return out

    def evidence(self) -> tuple[list[int], list[tuple[int, int]]]:
        """The words, and pairs of words of one sentence, that stand out in toxic documents and that these need."""
        n_toxic, n_clean, size = int((self.label == 1).sum()), int((self.label == 0).sum()), len(self.vocabulary)
        held = np.unique(np.repeat(self.document, np.diff(self.first)) * size + self.word)
        document, word = held // size, held % size
        in_toxic = self.label[document] == 1
        out = beyond_chance(np.bincount(word[in_toxic], minlength=size), np.bincount(word[~in_toxic], minlength=size), n_toxic, n_clean)
        taken = out[word] & in_toxic
        words = self.covering(document[taken], word[taken], MOST_WORDS)
        # Pairs are looked for in what these words leave open.
        open_ = np.setdiff1d(np.flatnonzero(self.label == 1), document[in_toxic & np.isin(word, words)])
        if len(open_) < 10:
            return words, []
        counts = np.zeros((2, 1 << PAIR_BITS), np.uint16)
        for k in [*open_.tolist(), *np.flatnonzero(self.label == 0).tolist()]:
            counts[int(self.label[k]), np.unique(self.pair_codes(k)[1])] += 1
        seen = np.flatnonzero(counts[0] + counts[1] > 1)  # pairs of clean documents too, which say what chance does
        found = seen[beyond_chance(counts[1, seen].astype(np.int64), counts[0, seen].astype(np.int64), len(open_), n_clean)]
        documents, codes = [], []
        for k in open_.tolist():
            code, hashed = self.pair_codes(k)
            code = code[np.isin(hashed, found)]
            documents.append(np.full(len(code), k))
            codes.append(code)
        code, document = np.concatenate(codes), np.concatenate(documents)
        frequent = np.unique(code, return_counts=True)
        often = np.isin(code, frequent[0][frequent[1] > 1])
        return words, [divmod(c, size) for c in self.covering(document[often], code[often], MOST_PAIRS)]

    def pair_features(self, pairs: list[tuple[int, int]]) -> np.ndarray:
        """The product kernel of each sentence with each pair of words."""
        ends = sorted({w for pair in pairs for w in pair})
        at = {w: i for i, w in enumerate(ends)}
        by_word = self.by_word(Landmarks([self.vocabulary[w] for w in ends]), lambda k: np.where(k >= LIKE, k, 0))
        left, right = [at[a] for a, _ in pairs], [at[b] for _, b in pairs]
        out = np.empty((len(self.document), len(pairs)), np.float32)
        for a in range(0, len(out), BLOCK):
            first = self.first[a : a + BLOCK + 1]
            n = min(BLOCK, len(out) - a)
            sums = np.add.reduceat(by_word[self.word[first[0] : first[n]]], first[:n] - first[0], axis=0)
            out[a : a + n] = sums[:, left] * sums[:, right]
        return out

    def stretches(self, by_word: np.ndarray, some: np.ndarray) -> list[int]:
        """The word of each given sentence that tells most, those first that most others, but no chosen one, are like.

        Words that are like no other sentence's are left out, unless all are.
        """
        found: dict[int, int] = {}
        for i in some.tolist():
            words = self.word[self.first[i] : self.first[i + 1]]
            best = int(words[np.argmax(by_word[words])])
            if by_word[best] > 0:
                found[best] = found.get(best, 0) + 1
        if not found:
            return []
        words = sorted(found, key=lambda w: (-found[w], -by_word[w], w))[: 4 * LANDMARKS]
        marks = Landmarks([self.vocabulary[w] for w in words])
        kernel = marks.kernel(len(words), *subsequences(marks.words))
        alike = kernel @ np.array([found[w] for w in words], np.float32)
        free = alike >= 1.2 if (alike >= 1.2).any() else alike > 0
        new, out = np.ones(len(words), np.float32), []  # how much of each word no chosen one is like
        for _ in range(min(int(free.sum()), LANDMARKS)):
            k = int(np.argmax(np.where(free, np.round(alike * new, 4), -1)))
            out.append(words[k])
            free[k] = False
            new = np.minimum(new, np.maximum(1 - kernel[:, k], 1e-3))
        return out


def fit(documents: list[tuple[str, int]]) -> Model:
    """Learns from (text, label) pairs. Without documents of both labels every score is the labels' rate."""
    data = Sentences(documents)
    give_back()  # what splitting took
    rate = (sum(y for _, y in documents) + 0.5) / (len(documents) + 1)
    none = Model((), (), 0.0, 0.0, float(np.log(rate / (1 - rate))))
    if not (data.label == 1).any() or not (data.label == 0).any():
        return none
    none = replace(none, shift=min(none.shift, -1.0))  # labels of both kinds but no evidence: nothing is rejected
    clean, y = ~data.toxic, np.where(data.toxic, 1.0, -1.0)
    in_clean = np.zeros(len(data.vocabulary))
    held = np.unique(np.repeat(data.document, np.diff(data.first)) * len(data.vocabulary) + data.word)  # documents' distinct words
    np.add.at(in_clean, (held % len(data.vocabulary))[data.label[held // len(data.vocabulary)] == 0], 1)

    def chosen(margin: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The telling sentences of toxic documents, whether their margin is beyond all but a share of the clean
        documents', and all weights: each document's best sentence, and all that are beyond."""
        highest = data.highest(margin)
        order = np.lexsort((np.arange(len(margin)), -margin, data.document))
        best = np.zeros(len(margin), bool)
        best[order[np.append(True, data.document[order][1:] != data.document[order][:-1])]] = True
        over = margin > np.quantile(highest[data.label == 0], 1 - share)
        witness = np.flatnonzero(data.toxic & (best | over))
        weight = np.where(clean, 10 / clean.sum(), 0)
        # labelled documents without a toxic sentence have little say
        own = np.where(over[witness], 1.0, 0.02) / np.bincount(data.document[witness], minlength=len(highest))[data.document[witness]]
        weight[witness] = own / own.sum()
        return witness, over[witness], weight

    rng, by_word = random.Random(0), data.telling()
    telling, pairs = data.evidence()
    by_word[telling] += 100
    pair_values = data.pair_features(pairs) if pairs else np.zeros((len(y), 0), np.float32)
    margin = np.maximum.reduceat(by_word[data.word], data.first[:-1]) + 100 * pair_values.max(axis=1, initial=0)
    witness, beyond, weight = chosen(margin, 0.1)
    own = lambda found: [*telling, *[w for w in found if w not in set(telling)][: max(LANDMARKS * 2 // 3 - len(telling), LANDMARKS // 3)]]
    toxic = own(data.stretches(by_word, witness[beyond]))
    if not toxic and not pairs:
        return none
    for turn in range(ROUNDS):
        near = data.by_word(Landmarks([data.vocabulary[w] for w in toxic]), lambda k: k.max(axis=1)) if toxic else np.ones(len(data.vocabulary))
        others = np.setdiff1d(np.flatnonzero(in_clean), toxic)
        others = others[np.argsort(-near[others] * np.log1p(in_clean[others]), kind="stable")][: max(LANDMARKS - len(toxic), LANDMARKS // 3)]
        words = [data.vocabulary[w] for w in [*toxic, *others.tolist()]]
        marks = Landmarks(words)
        variants = sorted({a for w in toxic for a in altered(data.vocabulary[w], rng)}.difference(data.vocabulary))
        like = marks.kernel(len(variants), *subsequences(variants)) if variants else np.zeros((0, len(words)))
        # those that are nearly as much like a clean word would blur the border
        clear = np.flatnonzero(like[:, : len(toxic)].max(axis=1, initial=0) > 3 * like[:, len(toxic) :].max(axis=1, initial=0))
        value, vector = np.linalg.eigh(marks.kernel(len(words), *subsequences(words)).astype(np.float64))
        keep = value > 1e-3 * value.max()
        nystroem = vector[:, keep] / np.sqrt(value[keep])  # sentences map to their kernel with the landmarks @ nystroem
        used = np.flatnonzero(weight)  # of other sentences only the margin is needed, which takes a number a word
        more = np.pad(like[clear].astype(np.float64) @ nystroem, ((0, 0), (0, len(pairs))))  # each a sentence of its own
        w = squared_hinge([(data.mapped(marks, nystroem, used, pair_values), y[used], weight[used]), (more, np.ones(len(more)), np.full(len(more), ALTERED / max(1, len(more))))], RIDGE / (data.label == 1).sum())
        n = int(keep.sum())
        weights = nystroem @ w[:n]
        by_word = data.by_word(marks, lambda k: k @ weights)  # noqa: B023
        of_pairs = np.concatenate([pair_values[a : a + BLOCK] @ w[n:-1] for a in range(0, len(y), BLOCK)])
        margin = np.add.reduceat(by_word[data.word], data.first[:-1]) + of_pairs + w[-1]
        if turn < ROUNDS - 1:
            witness, beyond, weight = chosen(margin, 0.01)
            found = data.stretches(by_word, witness[beyond])
            toxic = own([*found, *(x for x in toxic if x not in set(found))])
    highest = data.highest(margin)
    # documents whose label no sentence bears out are left out of the scale
    low = np.quantile(highest[data.label == 0], 0.995)
    sure = (data.label == 0) | (highest > low)
    slope, _ = logistic(highest[sure], data.label[sure].astype(np.float64))
    slope = max(slope, 1.0)
    # an altered insult has a lower margin than those learned from
    shift = float(-slope * ((1 - HALF) * low + HALF))
    names = tuple((data.vocabulary[a], data.vocabulary[b]) for a, b in pairs)
    return Model(tuple(words), tuple(weights.tolist()), float(w[-1]), slope, shift, float(low), names, tuple(w[n:-1].tolist()))


class Scorer:
    """Scores texts by a model; what it knows of tokens and words stays with the worker."""

    def __init__(self, model: Model) -> None:
        self.model, self.landmarks, self.tokens, self.known, self.hits = model, Landmarks(list(model.landmarks)), Words(), {}, {}
        self.weights = np.array(model.weights, np.float32)
        ends = sorted({w for pair in model.pairs for w in pair})
        self.ends, at = Landmarks(ends), {w: i for i, w in enumerate(ends)}
        self.pairs = [(at[a], at[b], weight) for (a, b), weight in zip(model.pairs, model.pair_weights, strict=True)]

    def _learn(self, words: list[str]) -> None:
        for a in range(0, len(words), BLOCK):
            part = words[a : a + BLOCK]
            found = subsequences(part)
            self.known.update(zip(part, (self.landmarks.kernel(len(part), *found) @ self.weights).tolist(), strict=True))
            if self.pairs:
                for i, end in zip(*np.nonzero((like := self.ends.kernel(len(part), *found)) >= LIKE), strict=True):
                    self.hits.setdefault(part[i], []).append((int(end), float(like[i, end])))

    def _paired(self, sentence: list[str]) -> float:
        """What the stretches of two words add to a sentence."""
        sums: dict[int, float] = {}
        for w in sentence:
            for end, like in self.hits.get(w, ()):
                sums[end] = sums.get(end, 0.0) + like
        return sum(sums[a] * sums[b] * weight for a, b, weight in self.pairs if a in sums and b in sums) if len(sums) > 1 else 0.0

    def __call__(self, texts: list[str]) -> np.ndarray:
        split = [sentences(t, self.tokens) for t in texts]
        if len(self.known) > CACHE_ENTRIES:
            self.known.clear()
            self.hits.clear()
        learned = bool(self.model.landmarks or self.pairs)
        self._learn(sorted({w for d in split for s in d for w in s}.difference(self.known)) if learned else [])
        value = self.known.__getitem__ if learned else lambda w: 0.0
        of = (lambda s: sum(map(value, s)) + self._paired(s)) if self.pairs else (lambda s: sum(map(value, s)))
        return self.model.score(np.array([max(map(of, d), default=0.0) for d in split]) + self.model.bias)


def is_held_out(identifier: str) -> Column:
    return F.coalesce(F.crc32(F.col(identifier).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(documents: DataFrame, labels: DataFrame, identifier: str, text: str, label: str, toxic: int = TOXIC_SAMPLE, clean: int = CLEAN_SAMPLE) -> list[tuple[str, int]]:
    """The whole texts of the labelled documents that training takes: toxic + clean rows at most, whatever repeats.

    Labels of null identifiers and null labels are left out; of several labels of a document the highest counts, of
    several texts the least. A null text counts as empty.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(identifier).isNotNull()).groupBy(F.col(identifier).cast("long").alias("_id")).agg(F.max((F.col(label) > 0).cast("int")).alias("_label"))
    known = known.filter(~is_held_out("_id"))
    # labels of documents that are at hand, ordered by hash
    there = documents.select(F.col(identifier).cast("long").alias("_id")).filter("_id is not null").distinct()
    known = known.join(there, "_id", "left_semi")
    order = (F.xxhash64("_id"), F.col("_id"))
    chosen = known.filter("_label = 1").orderBy(*order).limit(toxic).unionByName(known.filter("_label = 0").orderBy(*order).limit(clean))
    rows = documents.select(F.col(identifier).cast("long").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")).join(F.broadcast(chosen), "_id")
    found = rows.groupBy("_id").agg(F.min("_text").alias("_text"), F.first("_label").alias("_label")).collect()
    return [(r["_text"], r["_label"]) for r in sorted(found)]


def train(documents: DataFrame, labels: DataFrame, identifier: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fits the machine on labelled documents outside the held-out fifth; see sample() for the bound."""
    model = fit(sample(documents, labels, identifier, text, label))
    let_go()
    give_back()
    return model


def scored(df: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """df's columns and the score of each row's whole text; null and empty texts score as ones without evidence."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    names, own = df.columns, df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held_by_worker("toxicity", shared.value, lambda: Scorer(shared.value))
        for part in slices(batches, f"c{own}", 1 << 19, keeps="toxicity"):
            out = scorer([t or "" for t in part.column(own).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(names))), pa.array(out)], [*(f"c{i}" for i in range(len(names))), "score"])

    schema = ", ".join([*(f"c{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(names)), "score double"])
    rows = df.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)])
    return rows.mapInArrow(run, schema).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], F.col("score").alias(column))


def toxicity(documents: DataFrame, labels: DataFrame, identifier: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """doc_id, held_out, score, predicted of every row of documents, by a model trained on the others' labels.

    Null and empty texts score as ones without evidence; rows of null or repeated identifiers are scored each, a null
    identifier is not held out. Scores that tie at 0.5 count as toxic. Long texts are scored whole, sentence by sentence.
    Empty tables give empty results, and without labels of both kinds every score is the labels' rate.
    """
    rows = documents.select(F.col(identifier).alias("doc_id"), F.col(text).alias("_t"))
    out = scored(rows, train(documents, labels, identifier, text, label), "_t").drop("_t")
    return out.select("doc_id", is_held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(documents: DataFrame, labels: DataFrame, identifier: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """documents without the rows that score 0.5 or more, its columns unchanged; null and empty texts stay."""
    names = documents.columns
    rows = documents.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(names)])
    model = train(documents, labels, identifier, text, label)
    kept = scored(rows, model, f"k{names.index(text)}", "_score").filter((F.col("_score") < 0.5) | F.coalesce(F.trim(f"k{names.index(text)}") == "", F.lit(True)))
    return kept.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(names)])
