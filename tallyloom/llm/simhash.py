"""SimHash near-dedup by a generalised pigeonhole.

Distinct fingerprints are cut into partitions of correlated bits. Each partition gets a threshold of its own (-1: it
isn't probed), such that two fingerprints within the radius must agree to within the threshold on one partition at
least: the thresholds sum to radius - partitions + 1. Dynamic programming picks them so that the candidates, estimated
from the partition's value counts over all fingerprints, are fewest. Probes meet in buckets, where links are verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.shared import as_bytes, components, slices, small_batches, spread_join, written

BITS, SEED = 64, 42
#: A-Z in lower case, byte by byte.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Byte k of the entry for b is bit k of b; eight byte counters are thus added at once.
SPREAD = np.array([sum((b >> k & 1) << 8 * k for k in range(8)) for b in range(256)], "<u8")
#: A bucket with more members is dealt out as pairs of blocks of this size.
BLOCK = 4096
#: Buckets up to this size are compared by shifts of the whole batch, larger ones by growing connected sets.
SMALL = 48
#: Cost of a compared pair in rows shuffled, for choosing the number of partitions.
PAIR_COST = 0.002
#: At most so many oversized buckets are broadcast; more of them are joined by a shuffle.
MOST_BROADCAST = 50_000


def bit_counts(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How often each bit is set in the hashes of each group that begins at starts; no group may be empty."""
    lengths = np.diff(np.append(starts, len(hashes)))
    blocks = -(-lengths // 255)
    first = np.repeat(starts, blocks) + 255 * (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    bytewise, out = np.ascontiguousarray(hashes, "<u8").view(np.uint8).reshape(-1, 8), []
    for k in range(8):
        counts = np.add.reduceat(SPREAD[bytewise[:, k]], first).view(np.uint8).reshape(-1, 8).astype(np.int64)
        out.append(np.add.reduceat(counts, np.cumsum(blocks) - blocks, axis=0))
    return np.concatenate(out, axis=1)


def shingle_hashes(texts: list[bytes | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The XXH64 of every shingle of the texts, one text after another, and how many each text has; see simhash()."""
    digest, hashes, counts = xxhash.xxh64_intdigest, [], []
    for text in texts:
        words = (text or b"").translate(LOWER).split()
        if len(words) <= width:
            hashes += [digest(b" ".join(words), SEED)] * bool(words)
            counts.append(min(len(words), 1))
            continue
        joined, ends = b" ".join(words), (np.cumsum(list(map(len, words))) + np.arange(len(words))).tolist()
        begins = [0, *[e + 1 for e in ends[: len(ends) - width]]]
        hashes += [digest(joined[i:j], SEED) for i, j in zip(begins, ends[width - 1 :], strict=True)]
        counts.append(len(begins))
    return np.array(hashes, np.uint64), np.array(counts, np.int64)


def majorities(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The fingerprint of each text whose n hashes lie one after another."""
    out = np.zeros(len(n), np.uint64)
    if full := np.flatnonzero(n).tolist():
        more = 2 * bit_counts(hashes, (np.cumsum(n) - n)[full]) > n[full][:, None]
        out[full] = np.packbits(more, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprints(texts: list[bytes | None], width: int = 4) -> np.ndarray:
    """The unsigned 64-bit fingerprint of each text; see simhash()."""
    return majorities(*shingle_hashes(texts, width))


def simhash(df: DataFrame, identifier: str = "doc_id", text: str = "text", width: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long for every row of df.

    A-Z are lowered, words are runs of anything but [\\x20\\x09-\\x0D], shingles are width words joined by a space,
    repeats included; a shorter text is one shingle. A bit is 1 if it is set in over half the shingles' XXH64. A null
    text counts as empty; a text without words has fingerprint zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text", 2 << 20):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fingerprints(as_bytes(part.column(1)), width).view(np.int64))], ["doc_id", "fp"])

    small_batches(df.sparkSession)
    kind = df.schema[identifier].dataType.simpleString()
    return df.select(F.col(identifier).alias("doc_id"), F.col(text).alias("_text")).mapInArrow(run, f"doc_id {kind}, fp long")


def bits_of(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def correlations(fps: DataFrame) -> np.ndarray:
    """The 64 x 64 absolute correlations of the bits over all fingerprints, from sums that are made in the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS + 1, BITS + 1))
        for batch in batches:
            for k in range(0, batch.num_rows, 8192):
                bits = np.pad(bits_of(batch.column(0).to_numpy()[k : k + 8192]), ((0, 0), (0, 1)), constant_values=1).astype(np.float32)
                total += bits.T @ bits
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel().astype(np.int64))], ["cell", "n"])

    sums = np.zeros((BITS + 1) ** 2)
    for cell, n in fps.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect():  # 65 x 65 rows
        sums[cell] = n
    both, n = sums.reshape(BITS + 1, -1)[:BITS, :BITS], max(sums[-1], 1)
    mean = both.diagonal() / n
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-9))
    out = np.abs((both / n - np.outer(mean, mean)) / np.outer(spread, spread))
    np.fill_diagonal(out, 0)
    return out


def group_bits(correlated: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of nearly equal width; each grows by the free bit that correlates most with it."""
    free, out = set(range(BITS)), []
    for k in range(m):
        width = BITS // m + (k < BITS % m)
        group = [min(free, key=lambda b: (-max([0.0, *(correlated[b, c] for c in free)]), b))]
        free.discard(group[0])
        while len(group) < width:
            best = min(free, key=lambda b: (-correlated[b, group].sum(), b))
            group.append(best)
            free.discard(best)
        out.append(sorted(group))
    return out


def ball(width: int, radius: int) -> int:
    """How many values differ from a given one in radius bits at most."""
    out, term = 0, 1
    for k in range(radius + 1):
        out, term = out + term, term * (width - k) // (k + 1)
    return out


def allocate(costs: list[list[float]], total: int) -> list[int]:
    """Thresholds of least cost that sum to total; costs[i][t + 1] is the cost of threshold t >= -1 in partition i."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for so_far, (cost, chosen) in best.items():
            for k, more in enumerate(row):
                if (s := so_far + k - 1) not in after or cost + more < after[s][0]:
                    after[s] = cost + more, [*chosen, k - 1]
        best = after
    return best[total][1]


def values(fp: np.ndarray, group: list[int]) -> np.ndarray:
    out = np.zeros(len(fp), np.uint64)
    for k, bit in enumerate(group):
        out |= (fp >> np.uint64(bit) & np.uint64(1)) << np.uint64(k)
    return out


def partition_plan(fps: DataFrame, n: int, radius: int) -> tuple[list[list[int]], list[int]]:
    """The partitions and their thresholds for n distinct fingerprints."""

    def guess(m: int) -> float:
        width, left = BITS / m, radius - m + 1
        probes = [ball(round(width), left // m + (k < left % m)) for k in range(m)]
        return n * sum(probes) + PAIR_COST * n * n / 2**width * sum(probes)

    groups = group_bits(correlations(fps), m := min(range(1, radius + 2), key=guess))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for i, group in enumerate(groups):
                value, count = np.unique(values(fp, group), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), i)), pa.array(value.view(np.int64)), pa.array(count)], ["i", "v", "n"])

    sizes = fps.select("fp").mapInArrow(run, "i long, v long, n long").groupBy("i", "v").agg(F.sum("n").cast("double").alias("n"))
    squares = {i: s for i, s in sizes.groupBy("i").agg(F.sum(F.col("n") * F.col("n"))).collect()}  # m rows
    # by Cauchy-Schwarz, values within t bits of each other hold at most ball(t) times the pairs that equal values hold
    costs = [[0.0, *[ball(len(g), t) * (n + PAIR_COST * squares.get(i, 0.0)) for t in range(radius + 1)]] for i, g in enumerate(groups)]
    return groups, allocate(costs, radius - m + 1)


def forest(fp: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that connect whatever is within radius in the same group; group is sorted. Fewer links than rows."""
    edges = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    sizes = np.diff(np.append(edges, len(group)))
    size = np.repeat(sizes, sizes)
    left, right = [], []
    few = np.flatnonzero((size > 1) & (size <= SMALL))
    f, g = fp[few], group[few]
    for k in range(1, int(sizes[sizes <= SMALL].max(initial=0))):
        hit = np.flatnonzero((g[k:] == g[:-k]) & (np.bitwise_count(f[k:] ^ f[:-k]) <= radius))
        left.append(few[hit])
        right.append(few[hit + k])
    if left:
        a, b = np.concatenate(left), np.concatenate(right)
        label = np.arange(len(fp))
        while len(a):
            np.minimum.at(label, a, label[b])
            np.minimum.at(label, b, label[a])
            label = label[label]
            open_ = label[a] != label[b]
            a, b = a[open_], b[open_]
        a = np.flatnonzero(label != np.arange(len(fp)))
        left, right = [label[a]], [a]
    for begin, n in zip(edges[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        rest = np.arange(begin, begin + n)
        while len(rest):
            root, rest, front = rest[0], rest[1:], rest[:1]
            while len(front) and len(rest):
                near = np.zeros(len(rest), bool)
                for k in range(0, len(front), 16):
                    far = np.flatnonzero(~near)
                    near[far] = (np.bitwise_count(fp[rest[far]][None] ^ fp[front[k : k + 16]][:, None]) <= radius).any(axis=0)
                front, rest = rest[near], rest[~near]
                left.append(np.full(len(front), root))
                right.append(front)
    if not left:
        return fp[:0], fp[:0]
    return fp[np.concatenate(left)], fp[np.concatenate(right)]


def close_pairs(fp: np.ndarray, group: np.ndarray, label: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (a, b) within radius in the same group and not of the same label; group is sorted."""
    edges = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    ends = np.append(edges[1:], len(group))
    last = np.repeat(ends, ends - edges)
    left, right, n = [fp[:0]], [fp[:0]], 0
    for k in np.flatnonzero(last - np.arange(len(fp)) > 1).tolist():
        j = np.arange(k + 1, last[k])
        j = j[(np.bitwise_count(fp[j] ^ fp[k]) <= radius) & (label[j] != label[k])]
        left.append(np.full(len(j), fp[k]))
        right.append(fp[j])
        n += len(j)
        if n > 100_000:
            yield np.concatenate(left), np.concatenate(right)
            left, right, n = [fp[:0]], [fp[:0]], 0
    yield np.concatenate(left), np.concatenate(right)


def links(fps: DataFrame, radius: int = 4, block: int = BLOCK, label: str | None = None) -> DataFrame:
    """(a, b): enough links between the distinct fingerprints ``fp`` to connect all that are within radius.

    With a label, a column of longs without nulls, these are instead all pairs within radius whose labels differ.
    """
    names = ["fp"] if label is None else ["fp", "label"]
    fps = fps.select("fp") if label is None else fps.select("fp", F.col(label).alias("label"))
    spark, n = fps.sparkSession, fps.count()
    groups, thresholds = partition_plan(fps, n, radius)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 20_000):
                part = [batch.column(c).to_numpy()[k : k + 20_000] for c in names]
                fp = part[0].view(np.uint64)
                for i, (group, threshold) in enumerate(zip(groups, thresholds, strict=True)):
                    own = values(fp, group)
                    for flips in (x for t in range(threshold + 1) for x in combinations(range(len(group)), t)):
                        mask = np.uint64(sum(1 << x for x in flips))
                        # one of two values that differ meets the other: the one that has the highest bit in which they differ
                        some = own >> np.uint64(flips[-1]) & np.uint64(1) == 1 if flips else np.ones(len(fp), bool)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(some.sum(), i)), pa.array((own[some] ^ mask).view(np.int64)), *(pa.array(x[some]) for x in part)], ["i", "v", *names])

    probes = written(fps.mapInArrow(probe, ", ".join(f"{c} long" for c in ["i", "v", *names])), "probes")
    large = written(probes.groupBy("i", "v").agg(F.count("*").alias("n")).filter(F.col("n") > 2 * block), "large")
    many = large.count()
    if many:
        # a bucket of n rows is dealt out as blocks; each two blocks, and each alone, are compared in a task's stream
        side = F.broadcast(large) if many <= MOST_BROADCAST else large
        blocks = F.ceil(F.col("n") / block).cast("int")
        own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
        dealt = probes.join(side, ["i", "v"], "left").withColumn("blocks", F.coalesce(blocks, F.lit(1))).withColumn("own", F.coalesce(own, F.lit(0)))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        probes = dealt.select("i", "v", *names, F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))
    else:
        probes = probes.select("i", "v", *names, F.lit(0).alias("p"), F.lit(0).alias("q"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(keys: np.ndarray, fp: np.ndarray, labels: np.ndarray) -> Iterator[pa.RecordBatch]:
            group = np.cumsum(np.append(False, (keys[1:] != keys[:-1]).any(axis=1)))
            for a, b in [forest(fp, group, radius)] if label is None else close_pairs(fp, group, labels, radius):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        keys, fps_, labels = np.empty((0, 4), np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.concatenate([keys, np.stack([batch.column(k).to_numpy().astype(np.int64) for k in ("i", "v", "p", "q")], axis=1)])
            fps_ = np.concatenate([fps_, batch.column("fp").to_numpy().view(np.uint64)])
            labels = np.concatenate([labels, batch.column(names[-1]).to_numpy()])
            changes = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1))
            if len(changes):
                cut = changes[-1] + 1
                yield from found(keys[:cut], fps_[:cut], labels[:cut])
                keys, fps_, labels = keys[cut:], fps_[cut:], labels[cut:]
        if len(keys):
            yield from found(keys, fps_, labels)

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    return probes.repartition(parts, "i", "v", "p", "q").sortWithinPartitions("i", "v", "p", "q").mapInArrow(verify, "a long, b long")


def near_duplicates(df: DataFrame, identifier: str = "doc_id", text: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, component_size of every row of df.

    Rows link whose fingerprints differ in radius bits at most; copies share a fingerprint and so a component, which
    is named after its smallest identifier (nulls last: a component of nulls alone has a null name). Equal fingerprints
    are one node, so that copies never become pairs. Empty tables give empty results.
    """
    rows = written(simhash(df, identifier, text, width), "fingerprints")
    fps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    total = rows.count()
    roots = components(links(fps, radius), "links")
    linked = fps.join(roots, fps.fp == roots.node, "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    linked = written(linked, "linked")
    names = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("component_size"))
    named = linked.join(names, "root").select("fp", "n", "component_id", "component_size")
    out = spread_join(rows, named, ["fp"], "n", total)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component_size")
