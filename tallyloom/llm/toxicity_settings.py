"""Chooses the settings of the toxicity machine by cross-validation inside the training rows.

``python -m tallyloom.llm.toxicity_settings FOLDER`` prints, for each setting, the F1 of toxic documents at a score of 0.5
over the folds. Rows whose crc32(doc_id as text) mod 5 is 0 are held out and never read here; near copies of an earlier
document are left out, so that no fold learns from a copy of what it is tested on.
"""

from __future__ import annotations

import itertools
import sys
from concurrent.futures import ProcessPoolExecutor
from dataclasses import replace
from zlib import crc32

import numpy as np
import pandas as pd

from tallyloom.llm import toxicity
from tallyloom.llm.toxicity import Scorer, Words, apart, fit, sentences

FOLDS = 3
SPANS, DECAYS, POWERS, RIDGES = (5, 6), (0.4, 0.6, 0.8), (1, 2, 3), (0.2, 0.07, 0.02)
#: Of settings that reject more clean documents than this share, none is chosen.
MOST_REJECTED = 0.005
#: Where a score of 0.5 lies between the clean documents' margins and the margin of 1.
HALVES = (0.2, 0.3, 0.4, 0.5)


def training_rows(folder: str) -> list[tuple[int, str, int]]:
    """(fold, text, label) of the labelled documents that aren't held out, clean ones up to the operator's bound."""
    docs = pd.read_parquet(f"{folder}/documents.parquet", columns=["doc_id", "text"])
    labels = pd.read_parquet(f"{folder}/labels.parquet").dropna(subset=["toxic"]).groupby("doc_id").toxic.max()
    docs = docs[docs.doc_id.isin(labels.index)].drop_duplicates("doc_id")
    rows = [(crc32(str(i).encode()), t or "", int(labels[i])) for i, t in zip(docs.doc_id, docs.text, strict=True)]
    rows = sorted((x for x in rows if x[0] % 5), key=lambda x: x[0])
    known = Words()
    rows = [rows[k] for k in apart([set(itertools.chain.from_iterable(sentences(t, known))) for _, t, _ in rows])]
    toxic, clean = ([x for x in rows if x[2] == y] for y in (1, 0))
    return [(h // 5 % FOLDS, t, y) for h, t, y in toxic[: toxicity.TOXIC_SAMPLE] + clean[: toxicity.CLEAN_SAMPLE]]


def f1(folder: str, span: int, decay: float, power: int, ridge: float) -> list[tuple[float, float, int, int]]:
    """(half, F1, toxic documents found, clean ones rejected) for each of HALVES, over all folds."""
    toxicity.SPAN, toxicity.DECAY, toxicity.POWER, toxicity.RIDGE = span, decay, power, ridge
    toxicity.STEPS = toxicity.steps(span, decay)
    rows, counts = training_rows(folder), np.zeros((len(HALVES), 3), int)
    for fold in range(FOLDS):
        model = fit([(t, y) for f, t, y in rows if f != fold])
        left = [(t, y) for f, t, y in rows if f == fold]
        label = np.array([y for _, y in left])
        for k, half in enumerate(HALVES):
            moved = replace(model, shift=-model.slope * ((1 - half) * model.low + half)) if model.landmarks else model
            found = Scorer(moved)([t for t, _ in left]) >= 0.5
            counts[k] += [(found & (label == 1)).sum(), (found & (label == 0)).sum(), (label == 1).sum()]
    return [(h, round(2 * a / max(1, a + b + n), 4), int(a), int(b)) for h, (a, b, n) in zip(HALVES, counts.tolist(), strict=True)]


def main(folder: str, workers: int = 8) -> None:
    grid = list(itertools.product(SPANS, DECAYS, POWERS, RIDGES))
    with ProcessPoolExecutor(workers) as pool:
        results = list(pool.map(f1, *zip(*[(folder, *g) for g in grid], strict=True)))
    found = [(score, span, decay, power, ridge, half, a, b) for (span, decay, power, ridge), r in zip(grid, results, strict=True) for half, score, a, b in r]
    for line in sorted(found, reverse=True):
        print("F1 %.4f span %d decay %.1f power %d ridge %.2f half %.1f found %d rejected clean %d" % line)
    clean = sum(y == 0 for _, _, y in training_rows(folder))
    print("chosen:", max(x for x in found if x[-1] <= MOST_REJECTED * clean))


if __name__ == "__main__":
    main(sys.argv[1])
