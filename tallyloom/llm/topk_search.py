"""Exact top-k inner products over norm-sorted vectors.

All vectors are turned by the right singular vectors of their second-moment matrix, which gathers their length in the
first coordinates, and are dealt into blocks by descending length. A block of queries meets each block of vectors: a
vector is left out if |q| |v|, or the partial sum over the first coordinates plus |q's rest| |v's rest|, stays below
the k-th best score known so far (Cauchy-Schwarz). The longest block is searched first, which gives each query its
first bound. What survives is scored in integers, so that the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.shared import written

#: Vectors and queries in a block; vectors come in at least FEWEST_BLOCKS blocks where there are enough of them.
VECTORS, QUERIES, FEWEST_BLOCKS, SMALLEST = 65_536, 1024, 16, 1024
#: Tasks that pairs of blocks are dealt to at most.
MOST_TASKS = 20_000
#: Coordinates of the partial sum.
HEAD = 24
#: Rounding of the turned coordinates is far below this.
SLACK = 1e-3
#: Sums of products are exact below this.
EXACT = 2**53


def as_matrix(column: pa.Array, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = np.zeros((len(column), dims))
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    row = np.repeat(np.arange(len(column)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact integer inner products; both are integers held in float64, their sums below EXACT."""
    return queries @ vectors.T


def block_search(qid: np.ndarray, queries: np.ndarray, bound: np.ndarray, vid: np.ndarray, vectors: np.ndarray, turn: np.ndarray, k: int) -> tuple:
    """The k best of the block for each query that can still enter its k best: (query ids, vector ids, scores)."""
    tq, tv = queries @ turn, vectors @ turn
    norm_q, norm_v = np.linalg.norm(tq, axis=1), np.linalg.norm(tv, axis=1)
    rest_q, rest_v = np.linalg.norm(tq[:, HEAD:], axis=1), np.linalg.norm(tv[:, HEAD:], axis=1)
    order = np.argsort(-norm_v, kind="stable")
    vid, vectors, tv, norm_v, rest_v = (x[order] for x in (vid, vectors, tv, norm_v, rest_v))
    found: tuple[list, list, list] = ([], [], [])
    best = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(qid)
    bound = bound.astype(np.float64).copy()
    step = 2048
    for begin in range(0, len(vid), step):
        part = slice(begin, begin + step)
        live = np.flatnonzero(norm_q * norm_v[begin] + SLACK >= bound)
        if not len(live):
            break
        high = tq[live, :HEAD] @ tv[part, :HEAD].T + rest_q[live][:, None] * rest_v[part][None] + SLACK
        maybe = (high >= bound[live][:, None]) & (qid[live][:, None] != vid[part][None])
        for row, q in enumerate(live.tolist()):
            at = np.flatnonzero(maybe[row]) + begin
            if not len(at):
                continue
            score = scores(queries[q : q + 1], vectors[at])[0].astype(np.int64)
            ids, all_scores = np.concatenate([best[q][0], vid[at]]), np.concatenate([best[q][1], score])
            top = np.lexsort((ids, -all_scores))[:k]
            best[q] = ids[top], all_scores[top]
            if len(top) == k:
                bound[q] = max(bound[q], all_scores[top[-1]])
    for q, (ids, score) in enumerate(best):
        found[0].append(np.full(len(ids), qid[q]))
        found[1].append(ids)
        found[2].append(score)
    return tuple(np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64) for x in found)


def top_k(df: DataFrame, identifier: str = "vec_id", embedding: str = "embedding", every: int = 20, k: int = 20, scale: float = 64.0) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose identifier is divisible by ``every``, its k best other rows.

    Components become floor(scale * x). Ties go to the smaller identifier. Null vectors, vectors with null or
    non-finite components, and rows without identifier take no part; a shorter vector is filled up with zeros. A row
    never finds rows of its own identifier, so a repeated identifier counts as one row on the query side (the first in
    order of its components). An empty table gives an empty result. It raises if components are so large that
    a sum of products could reach EXACT.
    """
    spark = df.sparkSession
    x = F.transform(F.col(embedding), lambda v: F.floor(F.lit(float(scale)) * v.cast("double")))
    whole = ~F.exists(F.col(embedding), lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    rows = df.filter(F.col(embedding).isNotNull() & F.col(identifier).isNotNull() & whole).select(F.col(identifier).cast("long").alias("id"), x.alias("x"))
    rows = rows.withColumn("n2", F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))
    rows = written(rows, "vectors")
    n, dims, largest = rows.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(0)), F.coalesce(F.max(F.array_max(F.transform("x", F.abs))), F.lit(0))).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if n == 0:
        return spark.createDataFrame([], schema)
    dims = max(dims, 1)
    if largest * largest * dims >= EXACT or largest >= 2**31:
        raise ValueError(f"components up to {largest} after scaling are too large for exact sums")

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            m = as_matrix(batch.column(0), dims)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims * dims)), pa.array(total.ravel())], ["cell", "s"])

    second = np.zeros(dims * dims)
    for cell, s in rows.select("x").mapInArrow(moments, "cell long, s double").groupBy("cell").agg(F.sum("s")).collect():  # dims x dims rows
        second[cell] = s
    turn = np.linalg.svd(second.reshape(dims, dims))[0]

    # blocks by descending length: cut points from all lengths, so that no sort of the table is needed
    size = int(min(VECTORS, max(SMALLEST, -(-n // FEWEST_BLOCKS))))
    lengths = rows.groupBy(F.floor(F.sqrt("n2")).alias("length")).agg(F.count("*").alias("n"))
    # a length class holds many vectors; within it the block follows from a hash
    over = Window.orderBy(F.desc("bucket"))
    per = lengths.withColumn("bucket", F.least(F.col("length"), F.lit(1_000_000))).groupBy("bucket").agg(F.sum("n").alias("n"))
    # at most a million rows of counts, a fixed bound
    place = per.withColumn("before", F.sum("n").over(over) - F.col("n"))
    placed = rows.withColumn("bucket", F.least(F.floor(F.sqrt("n2")), F.lit(1_000_000))).join(F.broadcast(place), "bucket")
    placed = placed.withColumn("block", F.floor((F.col("before") + F.pmod(F.xxhash64("id", "x"), F.col("n"))) / size).cast("long"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each block, or for each VECTORS rows of it."""
        def packed(block: int, ids: list, xs: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([np.concatenate(ids).astype("<i8").tobytes()], pa.binary()), pa.array([np.concatenate(xs).astype("<i4").tobytes()], pa.binary())], ["block", "ids", "xs"])

        now, ids, xs = None, [], []
        for batch in batches:
            block, own, x = batch.column("block").to_numpy(), batch.column("id").to_numpy(), as_matrix(batch.column("x"), dims)
            for b in np.unique(block).tolist():
                at = np.flatnonzero(block == b)
                if ids and (b != now or sum(map(len, ids)) + len(at) > 2 * VECTORS):
                    yield packed(now, ids, xs)
                    ids, xs = [], []
                now = b
                ids.append(own[at])
                xs.append(x[at])
        if ids:
            yield packed(now, ids, xs)

    def blocks(of: DataFrame, number: str, name: str) -> DataFrame:
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
        return written(of.select(F.col(number).alias("block"), "id", "x").repartition(parts, "block").sortWithinPartitions("block", "id").mapInArrow(pack, "block long, ids binary, xs binary"), name)

    vectors = blocks(placed, "block", "vector-blocks")
    asked = rows.filter(F.col("id") % every == 0)
    asked = asked.groupBy("id").agg(F.min("x").alias("x"))
    m = asked.count()
    if m == 0:
        return spark.createDataFrame([], schema)
    asked = asked.withColumn("q", F.pmod(F.xxhash64("id"), F.lit(-(-m // QUERIES))))
    queries = blocks(asked, "q", "query-blocks").withColumnRenamed("block", "q").withColumnsRenamed({"ids": "qids", "xs": "qxs"})
    queries = queries.withColumn("q", F.monotonically_increasing_id())
    queries = written(queries, "queries")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                qid, vid = np.frombuffer(row["qids"], "<i8"), np.frombuffer(row["ids"], "<i8")
                q, v = (np.frombuffer(row[c], "<i4").reshape(-1, dims).astype(np.float64) for c in ("qxs", "xs"))
                bound = np.frombuffer(row["bounds"], "<f8") if row["bounds"] else np.full(len(qid), -np.inf)
                a, b, s = block_search(qid, q, bound, vid, v, turn, k)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), row["q"])), pa.array(a), pa.array(b), pa.array(s)], ["q", "query_id", "vec_id", "score"])

    # a stated query set against all rows, in blocks: pairs of block numbers first, then the blocks of those that are left
    def meet(pairs: DataFrame, known: DataFrame | None, name: str) -> DataFrame:
        asking = queries.withColumn("bounds", F.lit(None).cast("binary")) if known is None else queries.join(known.select("q", "bounds"), "q", "left")
        parts = max(1, min(pairs.count(), MOST_TASKS))
        dealt = pairs.join(asking, "q").join(vectors, "block")
        return written(dealt.repartition(parts, F.col("q"), F.col("block"), F.xxhash64("ids")).mapInArrow(search, "q long, query_id long, vec_id long, score long"), name)

    def bounds_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query's bound, and the length that a vector must have to matter for some query of the block."""
        for batch in batches:
            for row in batch.to_pylist():
                kth = dict(zip(row["with_k"] or [], row["kth"] or [], strict=True))
                qid, q = np.frombuffer(row["qids"], "<i8"), np.frombuffer(row["qxs"], "<i4").reshape(-1, dims).astype(np.float64)
                bound, norm = np.array([kth.get(i, -np.inf) for i in qid.tolist()], "<f8"), np.linalg.norm(q, axis=1)
                # where |q| is 0 all scores are 0, which a bound of 0 doesn't rule out, as ties go by identifier
                least = np.where(norm > 0, (bound - SLACK) / np.maximum(norm, 1e-300), np.where(bound <= 0, -np.inf, np.inf)).min()
                yield pa.RecordBatch.from_arrays([pa.array([row["q"]]), pa.array([bound.tobytes()], pa.binary()), pa.array([float(least)])], ["q", "bounds", "least"])

    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # the longest vector of each block: a row for each VECTORS rows at most
    longest = placed.groupBy("block").agg(F.max(F.sqrt("n2")).alias("longest"))
    longest = written(longest, "longest")
    first = meet(queries.select("q", F.lit(0).cast("long").alias("block")), None, "first")
    kth = first.withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") == k)
    kth = kth.groupBy("q").agg(F.collect_list(F.struct("query_id", "score")).alias("s")).select("q", F.col("s.query_id").alias("with_k"), F.col("s.score").alias("kth"))
    known = written(queries.select("q", "qids", "qxs").join(kth, "q", "left").mapInArrow(bounds_of, "q long, bounds binary, least double"), "bounds")
    pairs = known.select("q", "least").join(longest.filter("block > 0"), F.col("longest") >= F.col("least")).select("q", "block")
    later = meet(pairs, known, "later")
    both = first.unionByName(later).withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k)
    return both.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
