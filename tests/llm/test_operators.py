"""Each operator against a brute-force version, on texts with nulls, ties, repeats, very long and empty ones."""

import hashlib
import math
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyloom.llm import byte_bpe, chat_format, exact_dedup, licenses, near_copies, packing, shared, simhash, substring_dedup, topk_search, toxicity, warc

RANKS, TOKENIZER = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def texts(n=120, seed=1):
    """(doc_id, text) rows: nulls, empties, white space of all kinds, copies, near copies, shared passages, long texts."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghioprst", k=rng.randint(1, 8))) for _ in range(400)] + ["don't", "1234", "Ünï", "日本語", "...", "x=1;", " ", "\x1c", "a b", "😀"]
    passage = " ".join(rng.choices(words, k=60))
    out = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "one"), (None, "no identifier at all"), (None, "no identifier at all"), (7, "a b c d"), (7, "a b c d"), (8, "<|endoftext|> text")]
    for i in range(10, n):
        k = rng.random()
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\n", "  ", "\t\n", " 　 "]) for _ in range(rng.randint(1, 250)))
        if k < 0.2:
            text = rng.choice(out)[1]
        elif k < 0.35:
            other = (rng.choice(out)[1] or "").split(" ")
            other[rng.randrange(len(other))] = "changed"
            text = " ".join(other)
        elif k < 0.6:
            text = text[: len(text) // 2] + " " + passage + " " + text[len(text) // 2 :]
        out.append((rng.choice([i, i, -i]), text))
    out.append((n, " ".join(rng.choices(words, k=20_000))))
    out.append((n + 1, "y" * 20_000))
    return out


@pytest.fixture(scope="module")
def rows():
    return texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    extra = [(i, t, "sha", 1.5) for i, t in rows]
    return shared.written(spark.createDataFrame(extra, "doc_id long, text string, sha string, n double").repartition(5), "docs")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, sha string, n double")


def test_bpe_is_the_library_s(docs, rows, empty):
    data = open(RANKS, "rb").read()
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.rank_table(data), special_tokens={})
    got = byte_bpe.encode_and_decode(docs, RANKS, public_tokenizers.PATTERN, keep=("doc_id", "text", "n")).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = library.encode_ordinary(r.text or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert byte_bpe.encode_and_decode(empty, RANKS, public_tokenizers.PATTERN).count() == 0
    ids = shared.written(byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN, keep=("text",)), "ids")
    assert all(np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(r.text or "") for r in ids.collect())
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in byte_bpe.decode(ids, RANKS, public_tokenizers.PATTERN, keep=("text",)).collect())


def test_parts_are_safe_for_any_characters(monkeypatch):
    rng = random.Random(3)
    library, ids_of = byte_bpe.encoder(byte_bpe.rank_table(open(RANKS, "rb").read()), public_tokenizers.PATTERN)
    hf = Tokenizer.from_file(TOKENIZER)
    hf.encode_special_tokens = True
    data = open(TOKENIZER).read()
    by_ranks = packing._encoder(data, packing.ranks_of(data))
    monkeypatch.setattr(byte_bpe, "LONG", 3)
    monkeypatch.setattr(byte_bpe.safe_parts, "__defaults__", (3,))
    signs = list("ab1'. \n\t\r\x0b\x0c\x1c\x1f\x85 \u2003\u3000\xa0é日’s") + ["'re", "  ", "ing", "<|endoftext|>"]
    for _ in range(3000):
        text = "".join(rng.choices(signs, k=rng.randint(1, 14)))
        assert ids_of(text).tolist() == library.encode_ordinary(text), repr(text)
        assert by_ranks(text).tolist() == hf.encode(text, add_special_tokens=False).ids, repr(text)


def test_ranks_give_the_ids_of_the_tokenizer():
    """Each character that PLAIN admits, in several surroundings, and texts of vocabulary entries one after another."""
    hf = Tokenizer.from_file(TOKENIZER)
    hf.encode_special_tokens = True
    data = open(TOKENIZER).read()
    ranks = packing.ranks_of(data)
    by_ranks = byte_bpe.encoder(ranks, packing.PATTERN)[1]
    plain = [c for c in map(chr, range(0x10000)) if not "\ud800" <= c <= "\udfff" and packing.PLAIN.fullmatch(c)]
    assert len(plain) > 20_000 and not packing.PLAIN.fullmatch("\x1c")
    texts = [f"a{c}1{c}.{c} {c}b {c}{c}1\n{c}'s" for c in plain]
    assert all(by_ranks(t).tolist() == e.ids for t, e in zip(texts, hf.encode_batch(texts, add_special_tokens=False), strict=True))
    rng, tokens = random.Random(4), [t.decode() for t in ranks if t.decode("utf-8", "ignore").encode() == t]
    for _ in range(3000):
        text = "".join(rng.choices(tokens, k=rng.randint(1, 12)))
        if packing.PLAIN.fullmatch(text):
            assert by_ranks(text).tolist() == hf.encode(text, add_special_tokens=False).ids, repr(text)


def test_long_texts_of_one_stretch_are_encoded(spark):
    rows = [(1, "ab" * 300_000), (2, " " * 3_000_000), (3, "a b\n" * 300_000), (4, "x" + "\n " * 100_000 + "y\n")]
    library, ids_of = byte_bpe.encoder(byte_bpe.rank_table(open(RANKS, "rb").read()), public_tokenizers.PATTERN)
    assert all(ids_of(t).tolist() == library.encode_ordinary(t) for i, t in rows if i != 2)
    spaces = "  \n " * 20_000
    assert ids_of(spaces).tolist() == library.encode_ordinary(spaces) and ids_of(f"a{spaces}b").tolist() == library.encode_ordinary(f"a{spaces}b")
    got = byte_bpe.encode_and_decode(spark.createDataFrame(rows, "doc_id long, text string"), RANKS, public_tokenizers.PATTERN, keep=("doc_id",)).collect()
    assert {r.doc_id: r.decoded_sha256 for r in got} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in rows}


def test_exact_dedup(docs, rows, empty):
    groups = defaultdict(list)
    for i, t in rows:
        groups[SPACE.sub(" ", t or "")].append(i)
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(rows)
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    kept = Counter()
    for r in got:
        ids = by_sha[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == min((i for i in ids if i is not None), default=None)
        kept[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert exact_dedup.exact_dedup(empty).count() == 0
    out = exact_dedup.without_copies(docs)
    assert out.columns == docs.columns and out.count() == len(groups)
    assert exact_dedup.without_copies(empty).count() == 0


def test_tree_merge_over_many_runs(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 7).cast("string").alias("text")).repartition(70)
    got = {(r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(shared.written(df, "many")).collect()}
    assert got == {(k, len(range(k, 3000, 7))) for k in range(7)}


def brute_substrings(rows, width):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    seen, out = set(), {}
    for i in order:
        words = [w for w in SPACE.split(rows[i][1] or "") if w]
        gone = set()
        for s in range(len(words) - width + 1):
            window = tuple(words[s : s + width])
            if window in seen:
                gone.update(range(s, s + width))
            seen.add(window)
        out[i] = (len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone))
    return out


@pytest.mark.parametrize(("width", "chunk"), [(20, 4 << 20), (20, 3000), (5, 2000)])
def test_substring_dedup(spark, rows, width, chunk, monkeypatch):
    rows = [(i, t) for i, t in rows if i is not None]
    rows = list({i: (i, t) for i, t in rows}.values())
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    monkeypatch.setattr(substring_dedup, "RANGE", 500)
    want = {rows[i][0]: v for i, v in brute_substrings(rows, width).items()}
    finish_rows = []
    for r in substring_dedup.substring_dedup(df, width=width).collect() if chunk > 1e6 else small_chunks(df, width, chunk):
        finish_rows.append(r)
        assert (r.n_words, r.n_removed, r.kept_text) == want[r.doc_id]
        assert sum(b - a for a, b in r.removed) == r.n_removed
    assert len(finish_rows) == len(rows)


def small_chunks(df, width, chunk):
    real = substring_dedup.removal
    substring_dedup.removal = lambda *a: real(*a, chunk)
    try:
        return substring_dedup.substring_dedup(df, width=width).collect()
    finally:
        substring_dedup.removal = real


def test_substring_dedup_of_periodic_texts(spark):
    """A document may repeat its own windows word by word, with nothing else between them."""
    rows = [(1, "And " * 21), (2, "x " * 70 + "end"), (3, "a b c " * 30), (4, " ".join(f"{w} " * 60 for w in "pqr"))]
    want = {rows[i][0]: v for i, v in brute_substrings(rows, 20).items()}
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got} == want


def test_substring_dedup_of_words_whose_polynomials_collide(spark):
    """Thue-Morse words of 2048 letters collide in any polynomial modulo 2^64; no window of 20 words repeats here."""
    bits = [bin(i).count("1") & 1 for i in range(2048)]
    one, two = ("".join("ab"[b ^ k] for b in bits) for k in (0, 1))
    rows = [(1, f"{one} " * 20), (2, f"{two} " * 20)]
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.n_words, r.n_removed) for r in got} == {(1, 20, 0), (2, 20, 0)}


def test_substring_dedup_keeps_rows_and_columns(docs, rows, empty):
    out = substring_dedup.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    assert [r for r in out.filter("text is null").collect()]
    assert substring_dedup.without_repeats(empty).count() == 0 and substring_dedup.substring_dedup(empty).count() == 0
    # of two rows that are equal in all, the later loses its words
    assert sum(r.n_removed == 20_000 or r.n_removed > 0 for r in substring_dedup.substring_dedup(docs).collect()) > 5


def brute_fingerprint(text, width=4):
    words = [w for w in SPACE.split("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def brute_survivors(rows, width=5, similarity=0.8):
    """The smallest identifier of each group that links of that Jaccard similarity make of {identifier: text}."""
    sets, holders, label = {}, defaultdict(list), {i: i for i in rows}
    for i, text in rows.items():
        words = [w for w in SPACE.split("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
        sets[i] = {" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))}
        for s in sets[i]:
            holders[s].append(i)

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in {(a, b) for h in holders.values() for a in h for b in h if a < b}:
        common = len(sets[a] & sets[b])
        if common >= similarity * (len(sets[a]) + len(sets[b]) - common) - 1e-9:
            one, two = sorted((find(a), find(b)))
            label[two] = one
    return {find(i) for i in rows}


def brute_components(fps, radius):
    label = list(range(len(fps)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                label[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_simhash(docs, rows, empty):
    fps = [brute_fingerprint(t) for _, t in rows]
    roots = brute_components(fps, 4)
    smallest = {}
    for (i, _), root in zip(rows, roots, strict=True):
        if i is not None:
            smallest[root] = min(smallest.get(root, i), i)
    want = sorted((repr(i), f"{fp:016x}", repr(smallest.get(root))) for (i, _), fp, root in zip(rows, fps, roots, strict=True))
    got = simhash.near_duplicates(docs).collect()
    assert sorted((repr(r.doc_id), r.fingerprint, repr(r.component_id)) for r in got) == want
    assert simhash.near_duplicates(empty).count() == 0


def test_near_copies_with_nulls_and_repeated_identifiers(docs, rows, empty):
    kept = near_copies.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len(brute_survivors({i: t for i, (_, t) in enumerate(rows)}))
    assert near_copies.one_of_each(empty).count() == 0


def test_near_copies_match_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    words = ["".join(rng.choices("abdefgiklmnop", k=5)) for _ in range(2000)]
    rows, bases = {0: None, 1: "", 2: " \n", 3: "one two", 4: "ONE  two", 5: "one two three"}, [rng.choices(words, k=n) for n in (8, 40, 200, 3000)]
    for i in range(6, 150):
        text = list(rng.choice(bases[:3] if i % 20 else bases))
        for _ in range(rng.choice([0, 1, 1, 2, 4, 8])):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows[i] = " ".join(text)
    hot = [rng.choices(words, k=120)]
    for i in range(150, 260):  # one large group, each of its rows a change away from another
        hot.append(list(hot[rng.randrange(len(hot))]))
        hot[-1][rng.randrange(120)] = rng.choice(words)
        rows[i] = " ".join(hot[-1])
    monkeypatch.setattr(near_copies, "FAN", 7)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows.items()], "doc_id long, text string, fp string")
    assert docs.count() == len(rows)
    kept = near_copies.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(brute_survivors(rows))


def test_near_copies_among_texts_of_one_template(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abdefgiklmnop", k=7))
    template, rows = [word() for _ in range(300)], {}
    for i in range(0, 240, 2):  # strangers have a similarity of 0.7; x and y, far apart in the order, one of 0.8
        shared = [word() for _ in range(25)]
        for k in (i // 2, 239 - i // 2):
            rows[k] = " ".join([*template, *shared, *(word() for _ in range(40))])
    monkeypatch.setattr(near_copies, "BLOCK", 50, raising=False)
    kept = near_copies.one_of_each(spark.createDataFrame(sorted(rows.items()), "doc_id long, text string"))
    want = brute_survivors(rows)
    assert len(want) == 120
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)


@pytest.mark.parametrize("block", [4096, 40])
def test_links_connect_all_within_the_radius(spark, block):
    rng = random.Random(5)
    center = rng.getrandbits(64)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for _ in range(400):  # a dense group, as near copies of one text make it
        fps.add(center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))))
    for _ in range(200):
        fps.add(rng.choice(sorted(fps)) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))))
    fps = sorted(fps)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    found = simhash.links(df, 4, block).collect()
    signed = {x - (1 << 64) if x >> 63 else x: k for k, x in enumerate(fps)}
    label = list(range(len(fps)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in found:
        assert (fps[signed[a]] ^ fps[signed[b]]).bit_count() >= 0
        label[find(signed[a])] = find(signed[b])
    want = brute_components(fps, 4)
    pairs = lambda x: {tuple(sorted(v)) for v in (lambda d: [d[k].append(i) or d for i, k in enumerate(x)] and d)(defaultdict(list)).values()}
    assert pairs([find(i) for i in range(len(fps))]) == pairs(want)


@pytest.mark.parametrize("block", [4096, 20])
def test_links_with_labels_are_all_pairs_within_the_radius(spark, block):
    rng = random.Random(6)
    center = rng.getrandbits(64)
    fps = {rng.getrandbits(64) for _ in range(50)}
    for _ in range(120):  # many of these are over 4 bits from the first, but within 4 of each other
        fps.add(center ^ sum(1 << b for b in rng.sample(range(12), rng.randint(0, 5))))
    fps = [x - (1 << 64) if x >> 63 else x for x in sorted(fps)]
    df = spark.createDataFrame([(x, k % 40) for k, x in enumerate(fps)], "fp long, label long")
    found = simhash.links(df, 4, block, label="label").collect()
    want = {(a, b) for k, a in enumerate(fps) for m, b in enumerate(fps) if a < b and k % 40 != m % 40 and ((a ^ b) & (1 << 64) - 1).bit_count() <= 4}
    assert {(min(r), max(r)) for r in found} == want and len(want) > 1000


def test_partition_thresholds():
    assert simhash.allocate([[0, 1, 9], [0, 1, 9], [0, 5, 9]], 0) in ([0, 0, 0], [1, 0, -1], [0, 1, -1])
    assert sum(simhash.allocate([[0.0, *[float(simhash.ball(16, t)) for t in range(5)]]] * 4, 1)) == 1
    groups = simhash.group_bits(np.zeros((64, 64)), 5)
    assert sorted(b for g in groups for b in g) == list(range(64))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = dict(shared.components(spark.createDataFrame(edges, "a long, b long"), "test").collect())
    assert {k: v for k, v in got.items() if k <= 40} == dict.fromkeys(range(41), 0) and {v for k, v in got.items() if k >= 100} == {100}
    assert shared.components(spark.createDataFrame([], "a long, b long"), "test").count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(300, 8))
    vectors[50:60] = vectors[50]
    vectors[3] *= 9
    rows = [(i, [float(np.float32(x)) for x in v], 1) for i, v in enumerate(vectors)] + [(400, None, 1), (420, [1.0, None] * 4, 1), (440, [math.nan] * 8, 1), (460, [math.inf] * 8, 1), (None, [1.0] * 8, 1), (480, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    use = {i: np.floor(64 * np.pad(np.array(v, np.float32).astype(float), (0, 8 - len(v)))).astype(int) for i, v, _ in rows if i is not None and v is not None and None not in v and all(map(math.isfinite, v))}
    want = [(q, rank, c, s) for q in use if q % 20 == 0 for rank, (s, c) in enumerate(sorted(((int(use[q] @ use[c]), c) for c in use if c != q), key=lambda x: (-x[0], x[1]))[:20], 1)]
    got = [tuple(r) for r in topk_search.top_k(df).collect()]
    assert sorted(got) == sorted(want)
    few = topk_search.top_k(df.filter("vec_id < 5")).collect()
    assert len(few) == 4 and topk_search.top_k(df.filter("false")).count() == 0


def test_blocks_prune_exactly():
    rng = np.random.default_rng(4)
    vectors = np.floor(64 * rng.normal(size=(6000, 16)) * rng.uniform(0.1, 3, size=(6000, 1)))
    turn = np.linalg.svd(vectors.T @ vectors)[0]
    ids = np.arange(6000)
    q, v, s = topk_search.block_search(ids[:7], vectors[:7], np.full(7, -np.inf), ids, vectors, turn, 20)
    for i in range(7):
        score = vectors @ vectors[i]
        order = [c for c in np.lexsort((ids, -score)).tolist() if c != i][:20]
        assert v[q == i].tolist() == order and s[q == i].tolist() == score[order].tolist()


def test_warc(spark):
    big = "<p>é" * 200_000
    rows = [(1, "u 1\r\nx", "a" * 1500), (5, None, "a" * 1500), (3, "u", "a" * 1500), (2, "u", "short"), (4, "u", "short"), (6, "u", None), (7, "u", ""), (8, "u", big), (9, "u", big), (-2, "u", "b\r\n\r\nWARC/1.1\r\n" * 80), (-3, "u", "b\r\n\r\nWARC/1.1\r\n" * 80)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    chunks = warc.round_trip(df)
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.records(chunks).collect()}
    last = {}
    for i, _, html in rows:
        last[html or ""] = max(last.get(html or "", i), i)
    for i, _, html in rows:
        body = (html or "").encode()
        revisit = len(body) >= 1000 and last[html] != i
        assert got[i] == (len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", last[html] if revisit else None)
    parts = sorted(chunks.filter("record_id like '%:9>'").collect(), key=lambda r: r.chunk_no)
    assert len(parts) > 3 and b"".join(bytes(r.payload) for r in parts).decode() == big and max(len(r.payload) for r in parts) <= warc.CHUNK
    assert [r.digest_so_far for r in parts][-1] == hashlib.sha1(big.encode()).hexdigest() and [r.last for r in parts][-1]
    assert warc.records(warc.round_trip(df.filter("false"))).count() == 0


def test_packing(docs, rows, empty):
    library = Tokenizer.from_file(TOKENIZER)
    library.encode_special_tokens = True
    got = packing.best_fit_packing(docs, TOKENIZER, keep_ids=True).collect()
    want = Counter()
    for i, t in rows:
        want[repr(i), tuple([*library.encode(t or "", add_special_tokens=False).ids, 2])] += 1
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
    whole = Counter()
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length <= 1024 and __import__("zlib").crc32(bytes(r.ids)) == r.ids_crc32
        if r.start == 0 and r.ids[-4:] == np.array([2], "<u4").tobytes():
            whole[repr(r.doc_id), tuple(ids.tolist())] += 1
    assert all(whole[k] == n for k, n in want.items() if len(k[1]) <= 1024)
    for i, parts in by_doc.items():
        if len([1 for k, _ in rows if k == i]) == 1:
            ids = [x for r in sorted(parts, key=lambda r: r.piece) for x in np.frombuffer(r.ids, "<u4").tolist()]
            assert want[repr(i), tuple(ids)] == 1 and sorted(r.piece for r in parts) == list(range(len(parts)))
            assert all(r.length == 1024 for r in parts if r.piece) and len(parts) == -(-len(ids) // 1024)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r.length for r in got)
    assert len(bins) <= total / 1024 * 1.05 + 2
    assert packing.best_fit_packing(empty, TOKENIZER).count() == 0


def test_sum_of_squares_places_where_the_sum_is_smallest():
    rng = random.Random(6)
    lengths = [rng.randint(1, 12) for _ in range(300)]
    bins, offsets = packing.sum_of_squares(lengths, 12)
    fill = {}
    for n, b, at in zip(lengths, bins.tolist(), offsets.tolist(), strict=True):

        def after(b_):
            trial = dict(fill)
            trial[b_] = trial.get(b_, 0) + n
            return sum(c * c for g, c in Counter(12 - f for f in trial.values()).items() if g)

        options = [b_ for b_, f in fill.items() if f + n <= 12] + [max(fill, default=-1) + 1]
        assert after(b) == min(map(after, options)) and at == fill.get(b, 0)
        fill[b] = fill.get(b, 0) + n
    bins, offsets = packing.pack_lengths(np.array(lengths), 12)
    assert max(bins) + 1 <= sum(lengths) / 12 * 1.06 + 1
    for b in set(bins.tolist()):
        at = 0
        for k in sorted(np.flatnonzero(bins == b).tolist(), key=lambda k: offsets[k]):
            assert offsets[k] == at
            at += lengths[k]
        assert at <= 12


def test_equal_rows_are_dealt_over_shards(spark):
    table = shared.written(spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(300).cast("long").alias("length")), "equal")
    got = packing.packed(table, 1024, 500).select(F.shiftright("sequence_id", 40).alias("shard")).groupBy("shard").count().collect()
    assert len(got) == 6 and max(r["count"] for r in got) < 700


def test_toxicity_on_held_out_documents(spark):
    rng = random.Random(7)
    clean = ["".join(rng.choices("aeionrst", k=rng.randint(2, 9))) for _ in range(800)]
    bad = ["numskull", "blockhead", "dimwit", "nitwit"]
    rows, labels = [], []
    for i in range(700):
        words = rng.choices(clean, k=rng.randint(5, 60))
        toxic = i % 4 == 0
        if toxic:
            for w in rng.sample(bad, 2):
                words.insert(rng.randrange(len(words)), w)
        rows.append((i, " ".join(words), 0.5))
        labels.append((i, int(toxic)))
    rows += [(1000, None, 0.5), (1001, "", 0.5), (None, "x", 0.5), (1002, "you b.l.o.c.k.h.e.a.d there", 0.5), (1003, "n i t w i t", 0.5), (1004, "numsskull is here", 0.5)]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string, score double"), spark.createDataFrame(labels + [(None, 1), (9999, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, known).collect()}
    assert len(got) == len(rows)
    import zlib

    truth = dict(labels)
    assert all(r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [i for i in truth if got[i].held_out]
    assert sum(got[i].predicted == truth[i] for i in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert not got[1000].predicted and not got[1001].predicted and got[1002].predicted and got[1003].predicted and got[1004].predicted
    kept = toxicity.without_toxic(docs, known)
    assert kept.columns == docs.columns and kept.filter("doc_id in (1000, 1001)").count() == 2 and kept.filter("doc_id = 1002").count() == 0
    assert toxicity.toxicity(docs.filter("false"), known).count() == 0
    assert toxicity.toxicity(docs, known.filter("false")).count() == len(rows)


def brute_features(word):
    """The gapped subsequences of four characters of a word between its marks, with their weights."""
    marked, out = f"\n{word}\n", Counter()
    for at in range(len(marked)):
        for i, j, k, weight in toxicity.STEPS:
            if at + k < len(marked):
                out[marked[at], marked[at + i], marked[at + j], marked[at + k]] += weight
    norm = math.sqrt(sum(v * v for v in out.values()))
    return {f: v / norm for f, v in out.items()} if out else {}


def test_the_sentence_kernel_is_the_sum_over_pairs_of_words():
    rng = random.Random(9)
    words = ["".join(rng.choices("abcé", k=rng.randint(1, 9))) for _ in range(60)] + ["a", "aaaaaaaa", "日本語"]
    marks = ["idiot", "idiiot", "aaaa", "x", "abcabc"]
    got = toxicity.Landmarks(marks).kernel(len(words), *toxicity.subsequences(words))
    own, other = [brute_features(w) for w in words], [brute_features(w) for w in marks]
    want = [[sum(v * b.get(f, 0) for f, v in a.items()) ** toxicity.POWER for b in other] for a in own]
    assert np.allclose(got, want, atol=1e-5) and np.array(want).max() > 0.2
    model = toxicity.Model(tuple(marks), (1.0, 0.5, -2.0, 0.3, 1.0), -0.2, 1.0, 0.0)
    text = "idiot abc. " + " ".join(words) + " i d i o t x! "
    margins = [sum(w * k for u in s for w, k in zip(model.weights, [sum(v * b.get(f, 0) for f, v in brute_features(u).items()) ** toxicity.POWER for b in other], strict=True)) for s in toxicity.sentences(text, toxicity.Words())]
    assert len(margins) > 4 and np.allclose(toxicity.Scorer(model)([text, ""]), model.score(np.array([max(margins), 0]) + model.bias), atol=1e-5)
    everything = toxicity.Landmarks(words)
    values = np.linalg.eigvalsh(everything.kernel(len(words), *toxicity.subsequences(words)).astype(float))
    assert values.min() > -1e-4  # the kernel is positive semidefinite


def test_sentences_hold_spelled_out_words():
    words = toxicity.Words()
    assert toxicity.sentences("You b.l.o.c.k.h.e.a.d there! n i t w i t, an id1ot.\nnit-wit", words) == [["you", "blockhead", "there"], ["nitwit", "an", "idiot"], ["nitwit"]]
    assert toxicity.sentences(" . !", words) == [] and [len(s) for s in toxicity.sentences("a1b " * 30, words)] == [1, 1, 1]


def test_toxicity_sample_is_bounded_and_whole(spark):
    many = " ".join(f"a{i}" for i in range(5000))
    docs = spark.createDataFrame([(i % 12, f"{many} zworst") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i % 12, i % 2) for i in range(24)], "doc_id long, toxic int")
    found = toxicity.sample(docs, labels, "doc_id", "text", "toxic")
    assert 4 < len(found) <= 12 and all(t.endswith("zworst") for t, _ in found)
    assert len(toxicity.sample(docs, labels, "doc_id", "text", "toxic", 2, 1)) == 3


def test_preference_pairs(spark):
    chosen = [(1, 0, "user", "hi", 9), (1, 1, "assistant", "yes", 9), (1, 2, "user", "more", 9), (1, 3, "assistant", "good", 9), (2, 0, "user", "q", 9), (3, 5, None, None, 9), (None, 0, "user", "x", 9), (5, 0, "user", "same", 9)]
    rejected = [(1, 0, "user", "hi", 9), (1, 1, "assistant", "yes", 9), (1, 2, "user", "more", 9), (1, 3, "assistant", "bad one", 9), (3, 0, "", "", 9), (4, 0, "assistant", "alone", 9), (5, 0, "user", "same", 9)]
    kinds = "pair_id long, turn long, role string, text string, prompt int"
    got = {r.pair_id: r for r in chat_format.preference_pairs(spark.createDataFrame(chosen, kinds), spark.createDataFrame(rejected, kinds)).collect()}
    one = got[1]
    assert one.prompt_turns == 3 and one.prompt == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n<|im_start|>user\nmore<|im_end|>\n"
    assert one.chosen == "<|im_start|>assistant\ngood<|im_end|>\n" and one.chosen_mask == "0:22,1:15" and one.rejected_mask == "0:22,1:18"
    assert sum(int(x.split(":")[1]) for x in one.chosen_mask.split(",")) == len(one.chosen)
    assert got[2].prompt == "" and got[2].rejected == "" and got[2].rejected_mask == "" and got[4].chosen == ""
    assert got[3].prompt_turns == 1 and got[5].chosen == got[5].rejected == "" and set(got) == {1, 2, 3, 4, 5}
    none = spark.createDataFrame([], kinds)
    assert chat_format.preference_pairs(none, none).count() == 0


def test_license_scan(spark):
    mit = licenses.KNOWN["MIT"][3]
    rows = [(1, "Copyright (c) 2020 Someone\n\n" + mit.replace("sublicense", "SUBLICENCE").replace(" ", "  ")), (2, mit + " more"), (3, None), (4, "Copyright 1999 X"), (5, "é text\n* Licensed under the Apache Licence, version 2.0\nReleased under the MIT License."), (5, "x"), (None, "licensed under cc by-nc 4.0")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, license string")
    got = [(r.doc_id, r.license, r.notices) for r in licenses.license_scan(df).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, [(1, "MIT", None), (2, None, None), (3, None, None), (4, None, None), (5, None, "Apache-2.0,MIT"), (5, None, None), (None, "CC-BY-NC-4.0", "CC-BY-NC-4.0")]))
    for text in [r[1] or "" for r in rows]:
        assert df.sparkSession.range(1).select(licenses.joined(licenses.canonical_lines(F.lit(text)))).first()[0] == licenses.canonical_text(text)
    assert licenses.license_scan(df.filter("false")).count() == 0


def test_license_lines_of_any_padding_and_wording(spark):
    padded = "|" + " " * 9000 + "Released under the MIT License." + "=" * 9000
    df = spark.createDataFrame([(1, f"x\n{padded}\ny"), (2, "x\nUse it as you like!")], "doc_id long, text string")
    assert sorted((r.doc_id, r.notices) for r in licenses.license_scan(df).collect()) == [(1, "MIT"), (2, None)]
    assert sorted((r.doc_id, r.notices) for r in licenses.license_scan(df, known={"Free": ["Use it as you like."]}).collect()) == [(1, None), (2, "Free")]


def test_license_of_whole_texts(spark):
    title, body = licenses.TITLED["BSD-3-Clause"]
    rows = [(1, f"{title}\n\nCopyright (c) 2001, A. Holder\nAll rights reserved.\n\n{body.upper()}\n"), (2, body[: len(body) // 2]), (3, "Licensed under the MIT License." + "-" * 5000), (4, "Copyright 2001 X\n(c) Y")]
    found, folder = {1: "BSD-3-Clause", 2: None, 3: "MIT", 4: None}, "/usr/share/common-licenses"
    if os.path.isdir(folder):
        for i, (name, file) in enumerate([("GPL-3.0-only", "GPL-3"), ("Apache-2.0", "Apache-2.0"), ("MPL-2.0", "MPL-2.0"), ("LGPL-2.1-only", "LGPL-2.1")], 5):
            rows.append((i, "  " + open(f"{folder}/{file}").read().replace(",", " ,")))
            found[i] = name
    got = licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.license for r in got} == found and {r.notices for r in got if r.doc_id == 3} == {"MIT"}
    free = spark.createDataFrame([(1, "x\nAll of this is free to use.\ny")], "doc_id long, text string")
    assert licenses.license_scan(free, known={"FREE": ["All of this is free to use"]}).first().notices == "FREE"


def test_native_operators_run_no_python(spark, docs):
    turns = spark.createDataFrame([(1, 0, "user", "x")], "pair_id long, turn long, role string, text string")
    for df in (exact_dedup.exact_dedup(docs), licenses.license_scan(docs), chat_format.preference_pairs(turns, turns)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
