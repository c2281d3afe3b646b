"""What the toxicity machine learns from planted insults: many, rare ones, and pairs of words of one sentence."""

import random
import tracemalloc

import numpy as np
import pytest

from tallyloom.llm import packing, toxicity


def word(rng):
    return "".join(rng.choice("bcdfghklmnprstvw") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) + rng.choice(["", "n", "s", "t"])


def texts(rng, vocabulary, n, planted):
    """Documents of sentences of ten words, into one of which planted(i) goes."""
    out = []
    for i in range(n):
        sentences = [[rng.choice(vocabulary) for _ in range(10)] for _ in range(rng.randint(4, 11))]
        for w in planted(i):
            rng.choice([sentences[i % len(sentences)]]).insert(rng.randrange(10), w)
        out.append(" ".join(" ".join(s) + "." for s in sentences))
    return out


@pytest.mark.parametrize("kind", ["60 insults", "300 insults", "20 pairs"])
def test_planted_insults_are_found(kind):
    rng = random.Random(7)
    vocabulary = sorted({word(rng) for _ in range(4000)})
    rng.shuffle(vocabulary)
    vocabulary, n = vocabulary[:2500], int(kind.split()[0])
    insults = sorted({w for w in (word(rng) + word(rng)[:3] for _ in range(900)) if w not in vocabulary})[:n]
    pairs = [(vocabulary[50 + k], vocabulary[150 + k]) for k in range(20)]
    toxic = (lambda i: pairs[i % n]) if "pairs" in kind else (lambda i: [insults[i % n]])
    clean = (lambda i: [pairs[i % n][i // n % 2]]) if "pairs" in kind else (lambda i: [])
    model = toxicity.fit([(t, 1) for t in texts(rng, vocabulary, 600, toxic)] + [(t, 0) for t in texts(rng, vocabulary, 600, clean)])
    score = toxicity.Scorer(model)
    assert (score(texts(rng, vocabulary, 300, toxic)) >= 0.5).mean() > 0.9
    assert (score(texts(rng, vocabulary, 300, clean)) >= 0.5).mean() <= 0.02


def test_nothing_stands_out_by_chance():
    """Labels dealt at random: no words, no pairs, and nobody is rejected."""
    rng = random.Random(3)
    vocabulary = sorted({word(rng) for _ in range(4000)})
    data = toxicity.Sentences([(t, i % 2) for i, t in enumerate(texts(rng, vocabulary, 400, lambda i: []))])
    words, pairs = data.evidence()
    assert len(words) + len(pairs) <= 5
    held = np.array([[9, 1], [5, 5], [2, 0], [30, 2]])
    assert toxicity.beyond_chance(np.repeat(held[:, 0], 5), np.repeat(held[:, 1], 5), 100, 100).tolist() == [True] * 5 + [False] * 5 + [False] * 5 + [True] * 5


def test_training_holds_features_of_what_it_learns_from():
    """Long documents, most of them toxic: features are held of the sentences that are learned from, once, in single precision."""
    rng = random.Random(5)
    vocabulary = sorted({word(rng) for _ in range(6000)})
    rows = [(" ".join(texts(rng, vocabulary, 50, lambda i: [insult])), 1) for insult in ["zzyzxqua", "quoxuzzy"] * 20]
    rows += [(" ".join(texts(rng, vocabulary, 50, lambda i: [])), 0) for _ in range(20)]
    sentences = len(toxicity.Sentences(rows).document)
    tracemalloc.start()
    try:
        model = toxicity.fit(rows)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert (toxicity.Scorer(model)([t for t, _ in rows]) >= 0.5).tolist() == [y == 1 for _, y in rows]
    assert peak < 3 * sentences * toxicity.LANDMARKS * 4


def test_near_copies_alone_are_left_out():
    rng = random.Random(1)
    base = [{f"w{rng.randint(0, 400)}" for _ in range(80)} for _ in range(60)]
    copies = [set(list(sorted(d))[2:]) for d in base[:20]]
    assert toxicity.apart(base + copies) == list(range(60))


@pytest.mark.parametrize("seed", range(3))
def test_packing_is_as_good_as_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(1023, rng.lognormal(5, 1, 4000).astype(np.int64) + 1)
    bins, offsets = packing.pack_lengths(lengths, 1024)
    fill = np.bincount(bins, weights=lengths).astype(int)
    order = np.lexsort((offsets, bins))
    same = bins[order][1:] == bins[order][:-1]
    assert fill.max() <= 1024 and (offsets[order][1:] == np.where(same, (offsets + lengths)[order][:-1], 0)).all()
    room: list[int] = []  # best fit decreasing, by brute force
    for n in sorted(lengths.tolist(), reverse=True):
        fits = [k for k, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits, key=room.__getitem__)] -= n
        else:
            room.append(1024 - n)
    assert len(fill) <= max(len(room) + 1, int(1.005 * len(room)))
