"""Importance resampling toward a target corpus, over inverted postings that are dealt out by bucket.

A text's features are its runs of words, and a feature's bucket is its CRC-32 modulo the number of buckets. A first
pass writes, for every batch of documents, one block per bucket: the postings (document, count) of that bucket. The
blocks then travel to their bucket, where the counts of both corpora meet and give its gain, and the gain times each
count goes back to the document as a contribution, again a block at a time; a batch's blocks, at most one per bucket,
are summed up document by document. A bucket that holds over 1/1000 of all postings ("the" alone may hold a third) isn't moved into one task:
its gain, one of fewer than 1000 rows, is broadcast to its blocks instead.

Null and empty texts, and texts without words, have no features, weight 0 and no draw. A null identifier is hashed as
an empty one and loses ties. Repeated rows are documents of their own. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.shared import as_bytes, hot_hashes, remove, slices, small_batches, written
from tallyloom.llm.words import words
from tallyloom.operators.windows import numbered

#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z, on UTF-8: digits, letters and all bytes beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: A block batch ends after so many documents or postings.
BATCH_DOCS, BATCH_POSTINGS = 1 << 13, 1 << 20


def features(text: bytes | None, longest: int) -> tuple[Counter, int]:
    """The runs of 1 to ``longest`` consecutive words with their counts, and the number of words."""
    found, n, before = Counter(), 0, []
    for part in words(text, WORD):
        found.update(part)
        n += len(part)
        if longest > 1:
            both = before + part
            for k in range(2, longest + 1):
                found.update(b" ".join(both[i - k + 1 : i + 1]) for i in range(max(len(before), k - 1), len(both)))
            before = both[-(longest - 1) :]
    return found, n


def _blocks(batch: int, parts: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """One row per bucket of a batch: its postings as 16-bit places and 32-bit counts."""
    place = np.repeat(np.array([p for p, _, _ in parts], "<u2"), [len(b) for _, b, _ in parts])
    bucket, count = np.concatenate([b for _, b, _ in parts]), np.concatenate([c for _, _, c in parts])
    order = np.argsort(bucket, kind="stable")
    bucket, place, count = bucket[order], place[order], count[order]
    at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    ends, n = np.r_[at[1:], len(bucket)], len(at)
    packed = [place[i:j].tobytes() + count[i:j].astype("<u4").tobytes() for i, j in zip(at, ends, strict=True)]
    none = lambda kind: pa.nulls(n, kind)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, batch)), none(pa.int32()), none(pa.int64()), none(pa.int64()), pa.array(bucket[at].astype(np.int32)), pa.array((ends - at).astype(np.int64)), pa.array(np.add.reduceat(count, at)), pa.array(packed, pa.binary())],
        ["batch", "place", "n_words", "n_features", "bucket", "n", "total", "packed"],
    )


def postings(df: DataFrame, text: str, identifier: str, buckets: int, longest: int) -> DataFrame:
    """Rows of two kinds: documents (batch, place, n_words, n_features, _id) and, with a bucket, blocks of postings."""
    small_batches(df.sparkSession)
    kind = df.schema[identifier].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch, place, held, parts = TaskContext.get().partitionId() << 32, 0, 0, []
        for rows in slices(batches, "_text", 4 << 20):
            first, n_words, n_features = place, [], []
            for content in as_bytes(rows.column("_text")):
                found, n = features(content, longest)
                if found:
                    of = np.fromiter((zlib.crc32(f) % buckets for f in found), np.int64, len(found))
                    each, where = np.unique(of, return_inverse=True)
                    counts = np.bincount(where, weights=np.fromiter(found.values(), np.float64, len(found))).astype(np.int64)
                    parts.append((place, each, counts))
                    held += len(each)
                n_words.append(n)
                n_features.append(sum(found.values()))
                place += 1
            size = len(n_words)
            none = lambda t: pa.nulls(size, t)
            ids = rows.column("_id")
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(size, batch)), pa.array(np.arange(first, place, dtype=np.int32)), pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), none(pa.int32()), none(pa.int64()), none(pa.int64()), none(pa.binary()), ids],
                ["batch", "place", "n_words", "n_features", "bucket", "n", "total", "packed", "_id"],
            )
            if place >= BATCH_DOCS or held >= BATCH_POSTINGS:
                if parts:
                    block = _blocks(batch, parts)
                    yield block.append_column("_id", pa.nulls(block.num_rows, ids.type))
                batch, place, held, parts = batch + 1, 0, 0, []
        if parts:
            block = _blocks(batch, parts)
            yield block.append_column("_id", pa.nulls(block.num_rows, ids.type))

    schema = f"batch long, place int, n_words long, n_features long, bucket int, n long, total long, packed binary, _id {kind.simpleString()}"
    return df.select(F.col(identifier).alias("_id"), F.col(text).alias("_text")).mapInArrow(run, schema)


def contributions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(batch, n, packed) of each block with its gain: 16-bit places and the gain times each count, in 32 bits if they fit."""
    for rows in batches:
        out = []
        for packed, n, gain in zip(rows.column("packed").to_pylist(), rows.column("n").to_pylist(), rows.column("gain").to_pylist(), strict=True):
            weights = gain * np.frombuffer(packed, "<u4", n, 2 * n).astype("<i8")
            fits = np.abs(weights).max() < 1 << 31
            out.append(packed[: 2 * n] + weights.astype("<i4" if fits else "<i8").tobytes())
        yield pa.RecordBatch.from_arrays([rows.column("batch"), rows.column("n"), pa.array(out, pa.binary())], ["batch", "n", "packed"])


def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(batch, place, weight): the contributions to each document of a batch, which come one batch after another."""

    def out(at: int, weights: np.ndarray) -> pa.RecordBatch:
        some = np.flatnonzero(weights).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(some), at)), pa.array(some), pa.array(weights[some])], ["batch", "place", "weight"])

    now, weights = None, None
    for rows in batches:
        for at, n, packed in zip(rows.column("batch").to_pylist(), rows.column("n").to_pylist(), rows.column("packed").to_pylist(), strict=True):
            if at != now:
                if now is not None:
                    yield out(now, weights)
                now, weights = at, np.zeros(BATCH_DOCS + 5000, np.int64)  # slices() gives 5000 rows at most
            width = len(packed) // n - 2
            weights[np.frombuffer(packed, "<u2", n)] += np.frombuffer(packed, f"<i{width}", n, 2 * n)
    if now is not None:
        yield out(now, weights)


def noise(identifier: Column, seed: str) -> Column:
    """floor(-1000 ln(-ln((h + 0.5) / 2^32))), h being the first eight hex digits of sha256(seed:identifier)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(identifier.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def resample(df: DataFrame, target: DataFrame, text: str = "text", identifier: str = "doc_id", target_text: str = "text", buckets: int = 10_000, longest: int = 1, least_words: int = 20, percent: int = 10, seed: str = "2024") -> DataFrame:
    """Per row of df: its identifier, n_features, weight, score and rank; the rank is null for rows that aren't drawn.

    A bucket's gain is floor(1000 ln((t + 1) (S + buckets) / ((s + 1) (T + buckets)))), s of S features of df and t of
    T features of target being in it; weight is the floored mean gain of a row's features, and the score adds
    noise(). Of the N rows with ``least_words`` words, the floor(percent N / 100) of highest scores are drawn, smaller
    identifiers first among equal ones. An empty target or table has no counts, which the formula allows.
    """
    spark = df.sparkSession
    table = written(postings(df, text, identifier, buckets, longest), "postings")
    goal = written(postings(target.withColumn("_none", F.lit(None).cast("long")).select("_none", target_text), target_text, "_none", buckets, longest), "target-postings")
    blocks = table.filter("bucket is not null").select("batch", "bucket", "n", "packed")
    own = table.filter("bucket is not null").groupBy("bucket").agg(F.sum("total").cast("double").alias("s"), F.sum("n").alias("n"))
    theirs = goal.filter("bucket is not null").groupBy("bucket").agg(F.sum("total").cast("double").alias("t"))
    counts = written(own.join(theirs, "bucket", "full").fillna(0), "bucket-counts")
    all_own, all_theirs, total = counts.agg(F.coalesce(F.sum("s"), F.lit(0.0)), F.coalesce(F.sum("t"), F.lit(0.0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    gain = F.floor(F.lit(1000.0) * F.log((F.col("t") + 1.0) * F.lit(all_own + buckets) / ((F.col("s") + 1.0) * F.lit(all_theirs + buckets))))
    gains = counts.select("bucket", "n", gain.alias("gain"))
    is_hot = F.xxhash64("bucket").isin(hot_hashes(gains, ["bucket"], "n", total))
    gains = gains.drop("n")
    cold = blocks.filter(~is_hot).repartition("bucket").join(gains.filter(~is_hot).hint("shuffle_hash"), "bucket")
    hot = blocks.filter(is_hot).join(F.broadcast(gains.filter(is_hot)), "bucket")
    columns = ["batch", "n", "packed", "gain"]
    parts = cold.select(*columns).unionByName(hot.select(*columns)).mapInArrow(contributions, "batch long, n long, packed binary")
    parts = parts.repartition("batch").sortWithinPartitions("batch").mapInArrow(sums, "batch long, place int, weight long")
    rows = table.filter("bucket is null").select("batch", "place", F.lit(0).cast("long").alias("weight"), "n_words", "n_features", F.col("_id"))
    summed = rows.unionByName(parts, allowMissingColumns=True).groupBy("batch", "place").agg(F.sum("weight").alias("sum"), F.max("n_words").alias("n_words"), F.max("n_features").alias("n_features"), F.max("_id").alias("_id"))
    mean = F.expr("CASE WHEN n_features = 0 THEN 0L ELSE (sum - pmod(sum, n_features)) DIV n_features END")
    scored = summed.select("_id", "n_words", "n_features", mean.alias("weight")).withColumn("score", F.col("weight") + noise(F.col("_id"), seed))
    scored = written(scored.withColumn("_in", F.col("n_words") >= least_words), "scored")
    drawn = scored.filter("_in").count() * percent // 100
    order = [F.col("_in").desc(), F.col("score").desc(), F.col("_id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    ranked = numbered(scored, order, name="_rank")
    for used in (table, goal, counts, scored):
        remove(used, spark)
    return ranked.select(F.col("_id").alias(identifier), "n_features", "weight", "score", F.when(F.col("_in") & (F.col("_rank") <= drawn), F.col("_rank")).alias("rank"))
