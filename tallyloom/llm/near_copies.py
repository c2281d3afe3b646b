"""One document of each group of near copies, whose shingle sets have a similarity of 0.8 or more.

Candidates are the pairs of fingerprints that the SimHash operator finds (generalised pigeonhole) and, since two texts of
that similarity often differ in 10 or more of 64 bits, those of bands of minimal hashes of the same shingles. Each
candidate is verified on the whole shingle sets; verified links make the groups. At first each row is compared with the
first row of one of its buckets, then with the first and last rows of all its buckets that it isn't connected with, which
connects most of a large group; then all rows of a bucket meet that are not connected yet. Which pairs the first steps
take thus changes the work, never the groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.shared import PLACE, as_bytes, back, components, named, placed, remove, slices, small_batches, spread_join, written
from tallyloom.llm.simhash import links, majorities, shingle_hashes

#: Two texts of similarity s meet in a band with probability s ** DEPTH: at 0.8 they miss all bands once in 10,000.
BANDS, DEPTH = 24, 5
#: Candidates of one hub that meet a copy of its set; a hub of more candidates is dealt out.
FAN = 500
#: Rows of a bucket that are compared in a task's stream; a larger bucket is dealt out as pairs of blocks of this size.
BLOCK = 1024
#: Words of 64 bits that hold the parities of a text's distinct shingles, to rule pairs out.
PARITIES = 16
_odd = np.random.default_rng(11).integers(0, 1 << 63, (BANDS, DEPTH, 2), dtype=np.uint64)
MASKS, FACTORS = _odd[..., 0], _odd[..., 1] | np.uint64(1)


def bands(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A row of BANDS keys for each text whose n hashes lie one after another; no n may be 0."""
    starts, out = np.cumsum(n) - n, np.empty((len(n), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(n), b, np.uint64)
        for mask, factor in zip(MASKS[b], FACTORS[b], strict=True):
            key = (key ^ np.minimum.reduceat((hashes ^ mask) * factor, starts)) * FACTORS[0, 0]
            key ^= key >> np.uint64(29)
        out[:, b] = key
    return out


def sketches(rows: DataFrame, identifier: str, text: str, width: int) -> DataFrame:
    """row (unique), _file, _at, id, fp, keys, size and parities of every row of placed().

    keys are those of the bands, the same for all texts without words; size is the number of distinct shingles, and
    parities tell of how many of them fall in each bit, modulo 2.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text", 2 << 20):
            hashes, n = shingle_hashes(as_bytes(part.column("_text")), width)
            keys, full = np.zeros((len(n), BANDS), np.uint64), n > 0
            if full.any():
                keys[full] = bands(hashes, n[full])
            sizes, parities = [], []
            for h in np.split(hashes, np.cumsum(n)[:-1]):
                distinct = np.unique(h)
                odd = np.bincount((distinct >> np.uint64(20)).astype(np.int64) % (64 * PARITIES), minlength=64 * PARITIES) & 1
                sizes.append(len(distinct))
                parities.append(np.packbits(odd.astype(np.uint8)).tobytes())
            ends = pa.array(np.arange(0, BANDS * len(n) + 1, BANDS, dtype=np.int32))
            columns = [*(part.column(c) for c in ("row", *PLACE, "id")), pa.array(majorities(hashes, n).view(np.int64)), pa.ListArray.from_arrays(ends, pa.array(keys.view(np.int64).ravel()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int64()), pa.array(parities, pa.binary())], ["row", *PLACE, "id", "fp", "keys", "size", "parities"])

    kind = rows.schema[identifier].dataType.simpleString()
    chosen = rows.select(F.monotonically_increasing_id().alias("row"), *PLACE, F.col(identifier).alias("id"), F.col(text).alias("_text"))
    return chosen.mapInArrow(run, f"row long, _file string, _at long, id {kind}, fp long, keys array<long>, size long, parities binary")


def shingle_sets(rows: DataFrame, text: str, width: int) -> DataFrame:
    """(row, shingles): the distinct shingles' hashes of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text", 2 << 20):
            hashes, n = shingle_hashes(as_bytes(part.column("_text")), width)
            sets = [np.unique(h) for h in np.split(hashes, np.cumsum(n)[:-1])]
            ends = np.append(0, np.cumsum([len(s) for s in sets])).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))], ["row", "shingles"])

    return rows.select("row", F.col(text).alias("_text")).mapInArrow(run, "row long, shingles array<long>")


def bucket_members(found: DataFrame) -> DataFrame:
    """A written table (row, band, key, first, last, n): the rows of each bucket of several; band BANDS is the fingerprint."""
    keyed = found.select("row", F.posexplode(F.concat("keys", F.array("fp"))).alias("band", "key"))
    buckets = keyed.groupBy("band", "key").agg(F.min("row").alias("first"), F.max("row").alias("last"), F.count("*").alias("n")).filter("n > 1")
    buckets = written(buckets, "buckets")
    out = written(spread_join(keyed, buckets, ["band", "key"], "n", found.count() * (BANDS + 1)), "members")
    remove(buckets, found.sparkSession)
    return out


def hub_pairs(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(row, hub): a written table of the rows of buckets of several roots, each with the first and last rows of its
    buckets that it isn't connected with. At most 2 (BANDS + 1) pairs a row, whatever the bucket's size."""
    rooted = roots.withColumnRenamed("node", "row")
    known = members.join(rooted, "row", "left").withColumn("root", F.coalesce("root", "row"))
    known = written(known, "rooted")
    open_ = known.groupBy("band", "key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min_by("root", "row").alias("of_first"), F.max_by("root", "row").alias("of_last"), F.count("*").alias("n")).filter("low <> high")
    open_ = written(open_.drop("low", "high"), "open")
    met = spread_join(known.select("row", "root", "band", "key", "first", "last"), open_, ["band", "key"], "n", known.count())
    hubs = F.array_compact(F.array(F.when(F.col("root") != F.col("of_first"), F.col("first")), F.when(F.col("root") != F.col("of_last"), F.col("last"))))
    pairs = met.select("row", F.explode(hubs).alias("hub")).select(F.greatest("row", "hub").alias("row"), F.least("row", "hub").alias("hub")).distinct()
    out = written(pairs, "hub-pairs")
    for table in (known, open_):
        remove(table, members.sparkSession)
    return out


def open_pairs(found: DataFrame, members: DataFrame, roots: DataFrame, similarity: float, radius: int) -> DataFrame:
    """(row, hub): a written table of all pairs of a bucket that ``roots`` doesn't connect yet and whose sets may be that similar.

    Buckets are the bands', those of equal fingerprints, and one for each two fingerprints within radius.

    Ruled out are pairs of too different sizes, and those of more odd parities that differ than their sets' difference
    may have elements; neither loses a link. A pair is given by the first of its buckets alone.
    """
    spark = found.sparkSession
    nodes = found.select("row", "fp", "keys", "size", "parities").join(roots.withColumnRenamed("node", "row"), "row", "left")
    nodes = written(nodes.select("row", F.coalesce("root", "row").alias("root"), "fp", F.concat("keys", F.array("fp")).alias("keys"), "size", "parities"), "nodes")
    own = nodes.select("row", "root", "fp")
    # a fingerprint whose rows are all connected needs no pair with another of the same root; one of several roots needs all
    fps = own.groupBy("fp").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("row").alias("least"), F.count("*").alias("n"))
    fps = written(fps.select("fp", "n", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(-1 - F.col("least")).alias("label")), "fps")
    close = written(links(fps, radius, label="label").distinct(), "close")
    near = close.select(F.explode(F.array("a", "b")).alias("fp"), F.xxhash64(F.least("a", "b"), F.greatest("a", "b")).alias("key"))
    near = near.groupBy("fp").agg(F.collect_list("key").alias("near")).join(fps.select("fp", "n"), "fp")
    near = spread_join(own, near, ["fp"], "n", nodes.count()).select("row", "root", F.lit(BANDS + 1).alias("band"), F.explode("near").alias("key"))
    keyed = members.select("row", "band", "key").join(roots.withColumnRenamed("node", "row"), "row", "left").select("row", F.coalesce("root", "row").alias("root"), "band", "key")
    keyed = written(keyed.unionByName(near), "keyed")
    buckets = keyed.groupBy("band", "key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).filter("low <> high")
    buckets = written(buckets.select("band", "key", "n"), "open")
    still = written(spread_join(keyed.select("row", "band", "key"), buckets, ["band", "key"], "n", keyed.count()), "still")
    known = written(nodes.drop("fp").join(still.select("row").distinct(), "row", "left_semi"), "known")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    # rows meet what is known of them once a bucket, and are dealt out to pairs of blocks after that
    dealt = still.join(known, "row").withColumn("own", F.pmod(F.xxhash64("row"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("row", "root", "keys", "size", "parities", "band", "key", "own", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))
    least = (1 - similarity) / (1 + similarity)

    def pairs(part: pa.Table) -> pa.RecordBatch:
        row, root, own, size = (part.column(c).to_numpy() for c in ("row", "root", "own", "size"))
        band, p, q = (part.column(c)[0].as_py() for c in ("band", "p", "q"))
        odd = np.frombuffer(b"".join(part.column("parities").to_pylist()), np.uint64).reshape(len(row), PARITIES)
        keys = part.column("keys").combine_chunks().flatten().to_numpy().reshape(len(row), -1)[:, :band]
        left, right = [], []
        for k in range(len(row) - 1):
            j = np.arange(k + 1, len(row))
            j = j[(root[j] != root[k]) & (np.minimum(size[j], size[k]) >= similarity * np.maximum(size[j], size[k]) - 1e-9)]
            j = j[own[j] != own[k]] if p != q else j
            j = j[np.bitwise_count(odd[j] ^ odd[k]).sum(axis=1, dtype=np.int64) <= least * (size[j] + size[k]) + 1e-6]
            j = j[~(keys[j] == keys[k]).any(axis=1)]
            left.append(np.full(len(j), row[k]))
            right.append(row[j])
        a, b = (np.concatenate(x) if x else row[:0] for x in (left, right))
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["row", "hub"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rest = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            keys = np.stack([rest.column(c).to_numpy().astype(np.int64) for c in ("band", "key", "p", "q")], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for begin, end in zip([0, *cuts[:-1]], cuts, strict=False):
                yield pairs(rest.slice(begin, end - begin))
            rest = rest.slice(cuts[-1]) if len(cuts) else rest
        if rest is not None:
            yield pairs(rest)

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    by_bucket = dealt.repartition(parts, "band", "key", "p", "q").sortWithinPartitions("band", "key", "p", "q")
    out = written(by_bucket.mapInArrow(run, "row long, hub long").distinct(), "rest")
    for table in (nodes, fps, close, keyed, buckets, still, known):
        remove(table, spark)
    return out


def verified(pairs: DataFrame, found: DataFrame, rows: DataFrame, text: str, width: int, similarity: float) -> DataFrame:
    """A written table of the pairs (row, hub) whose shingle sets are that similar; two sets without shingles are equal.

    The set of a hub of many pairs is copied once for each FAN of them, so that none meets all its pairs in one task.
    """
    spark = found.sparkSession
    involved = pairs.select("row").unionByName(pairs.select(F.col("hub").alias("row"))).distinct()
    places = written(found.select("row", *PLACE).join(involved, "row", "left_semi"), "involved")
    sets = written(shingle_sets(named(rows, places, "inner", "row"), text, width), "sets")
    hubs = pairs.groupBy("hub").agg(F.ceil(F.count("*") / FAN).cast("int").alias("copies"), F.count("*").alias("n"))
    hubs = written(hubs, "hubs")
    dealt = spread_join(pairs, hubs, ["hub"], "n", pairs.count()).select("row", "hub", F.pmod(F.xxhash64("row"), "copies").cast("int").alias("copy"))
    copied = hubs.select("hub", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    hub_sets = copied.join(sets.select(F.col("row").alias("hub"), F.col("shingles").alias("others")), "hub")
    both = dealt.join(sets, "row").join(hub_sets, ["hub", "copy"])
    common, one, two = F.size(F.array_intersect("shingles", "others")), F.size("shingles"), F.size("others")
    out = written(both.filter(common >= F.lit(similarity) * (one + two - common) - 1e-9).select(F.col("row").alias("a"), F.col("hub").alias("b")), "verified")
    for table in (places, sets, hubs):
        remove(table, spark)
    return out


def one_of_each(df: DataFrame, identifier: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8, radius: int = 4) -> DataFrame:
    """df with one row of each group of near copies: its smallest identifier, the first row if that repeats.

    Texts link when the sets of their shingles of width words (A-Z lowered; a shorter text is one shingle) have a
    Jaccard similarity of at least ``similarity``; null and empty texts, and those of white space alone, are equal.
    Groups are what links connect. Rows of a null identifier stay only where their whole group has none, one of them.
    Empty tables give empty results; other columns, whatever their names, are carried along.
    """
    spark, names = df.sparkSession, df.columns
    small_batches(spark)
    rows, own_text = placed(df, "documents"), f"c{names.index(text)}"
    found = written(sketches(rows, f"c{names.index(identifier)}", own_text, width), "sketches")
    members = bucket_members(found)
    pairs = written(members.filter("row <> first").groupBy("row").agg(F.min("first").alias("hub")), "pairs")
    first = verified(pairs, found, rows, own_text, width, similarity)
    edges = lambda roots: roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    start = components(first, "links")
    more = hub_pairs(members, start)
    by_hub = verified(more, found, rows, own_text, width, similarity)
    connected = components(edges(start).unionByName(by_hub), "links")
    rest = open_pairs(found, members, connected, similarity, radius)
    second = verified(rest, found, rows, own_text, width, similarity)
    roots = components(edges(connected).unionByName(second), "links")
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("row"))
    grouped = written(found.select("row", *PLACE, order.alias("rank")).join(roots.withColumnRenamed("node", "row"), "row"), "grouped")
    kept = grouped.groupBy("root").agg(F.min("rank").alias("rank")).select("rank.row")
    dropped = written(grouped.select("row", *PLACE).join(kept, "row", "left_anti").select(*PLACE), "dropped")
    for table in (found, members, pairs, first, start, more, by_hub, connected, rest, second, roots, grouped):
        remove(table, spark)
    return back(named(rows, dropped, "left_anti"), names)
