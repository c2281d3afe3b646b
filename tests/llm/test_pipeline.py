"""Each stage of the pipeline, on what its predecessor kept, against brute force; and run() against the stages."""

import random
from collections import defaultdict

import corpus_pipeline
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_operators import SPACE, TOKENIZER, brute_substrings, brute_survivors
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.01"
PIECE = ["doc_id", "piece", "start", "length", "ids_crc32"]


def planted(first):
    """Clean rows: a long text, an exact copy, a near copy, two texts that share 60 words, an empty and a null text."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abdefgiklmnoprstu", k=rng.randint(2, 8))) for _ in range(3000)]
    long, passage = rng.choices(words, k=900), rng.choices(words, k=60)
    near = [*long[:450], "otherword", *long[451:]]
    one, two = (" ".join([*rng.choices(words, k=80), *passage, *rng.choices(words, k=80)]) for _ in range(2))
    out = [" ".join(long), "\n".join(long), " ".join(near), one, two, "", None]
    return [(first + i, t, "en", "planted", None if t is None else len(t)) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The folder, and each stage's name, input and output as pandas frames."""
    folder = str(tmp_path_factory.mktemp("sf"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.agg(F.max("doc_id")).first()[0] + 1
    docs.unionByName(spark.createDataFrame(planted(first), docs.schema)).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    now, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = now.toPandas()
        stage(spark, now, folder).write.parquet(f"{folder}/{name}")
        now = spark.read.parquet(f"{folder}/{name}")
        out[name] = before, now.toPandas()
    return folder, first, out


def texts_of(frame):
    return {i: None if pd.isna(t) else t for i, t in zip(frame.doc_id, frame.text, strict=True)}


def test_all_but_the_last_return_documents(stages):
    for name, (before, after) in list(stages[2].items())[:-1]:
        assert list(after.columns) == list(before.columns), name
        assert set(after.doc_id) <= set(before.doc_id) and after.doc_id.is_unique, name


def labelled(stages):
    folder, _, out = stages
    before, after = out["toxicity"]
    labels = pd.read_parquet(f"{folder}/labels.parquet")
    labels = labels[labels.doc_id.isin(before.doc_id)]
    return labels, labels.doc_id.isin(after.doc_id)


def test_clean_documents_stay(stages):
    first, (_, after) = stages[1], stages[2]["toxicity"]
    assert set(range(first, first + 7)) <= set(after.doc_id)
    labels, left = labelled(stages)
    assert left[labels.toxic == 0].mean() >= 0.95


@pytest.mark.xfail(reason="known gap: of the few labelled toxic documents of sf0.01, 35 % stay", strict=True)
def test_toxic_documents_go(stages):
    labels, left = labelled(stages)
    assert left[labels.toxic == 1].mean() <= 0.2


def test_exact_copies_go(stages):
    before, after = stages[2]["exact_dedup"]
    least = {}
    for i, t in texts_of(before).items():
        key = SPACE.sub(" ", t or "")
        least[key] = min(i, least.get(key, i))
    assert set(after.doc_id) == set(least.values())


def test_one_of_each_group_of_near_copies_stays(stages):
    _, first, out = stages
    before, after = out["simhash_near_dedup"]
    assert set(after.doc_id) == brute_survivors(texts_of(before))
    assert first in set(after.doc_id) and first + 2 not in set(after.doc_id)


def test_repeated_passages_go(stages):
    before, after = stages[2]["substring_dedup"]
    rows, got = list(texts_of(before).items()), texts_of(after)
    assert len(got) == len(rows)
    cut = brute_substrings(rows, 20)
    assert sum(n > 0 for _, n, _ in cut.values()) > 0
    for k, (i, t) in enumerate(rows):
        assert got[i] == (cut[k][2] if cut[k][1] else t)


def test_packing_holds_every_token_once(stages):
    before, after = stages[2]["best_fit_packing"]
    library = Tokenizer.from_file(TOKENIZER)
    library.encode_special_tokens = True
    lengths = after.groupby("doc_id").length.sum().to_dict()
    assert lengths == {i: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in texts_of(before).items()}
    bins = defaultdict(list)
    for r in after.itertuples():
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= after.length.sum() / 1024 * 1.05 + 2


def test_run_is_the_stages_one_after_another(spark, stages):
    folder, _, out = stages
    got = corpus_pipeline.run(spark, folder).select(*PIECE).toPandas()
    want = out["best_fit_packing"][1][PIECE]
    assert sorted(got.itertuples(index=False, name=None)) == sorted(want.itertuples(index=False, name=None))
