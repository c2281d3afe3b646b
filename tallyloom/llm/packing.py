"""Sum-of-squares packing of token sequences.

Texts become ids and pieces of at most ``capacity`` tokens in one pass; only piece lengths go on. Pieces shorter than
the capacity are dealt at random into shards of a bounded size, and each shard is packed alone: a piece goes where the
sum over all gaps of the squared number of open bins with that gap becomes smallest. A shard keeps bin counts by gap,
never a search over bins, so that a step costs the capacity at most, however many bins are open.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from pathlib import Path
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.byte_bpe import encoded, encoder
from tallyloom.llm.shared import held_by_worker, slices, small_batches, written

#: Pieces in a shard, about. Its open bins at the end are what sharding costs: a few in tens of thousands.
SHARD = 60_000
#: The tokenizer's split pattern, a fixed value of its kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of these characters alone, whose classes both libraries know alike, are encoded by ranks.
PLAIN = re.compile("[\t-\r\x20-\x7e\xa0-\u017f\u0391-\u03a1\u03b1-\u03c9\u0410-\u044f\u2010-\u2027\u2030-\u205e\u20ac\u3001-\u3003\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5]*")


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def ranks_of(data: str) -> dict[bytes, int] | None:
    """The vocabulary of a tokenizer file as ranks, if merging by ranks gives the tokenizer's ids; else None.

    It does if merges make their tokens in the order of the ids, each from one pair only, and every token's own
    characters merge to that token: two neighbours that together spell a token are then always the pair that makes it,
    as what goes on within a token's characters doesn't depend on what surrounds them.
    """
    from tokenizers import Tokenizer

    model, bytes_ = json.loads(data)["model"], byte_of()
    vocabulary, pairs = model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    made = ["".join(p) for p in pairs]
    ids = [vocabulary[m] for m in made]
    if ids != sorted(set(ids)) or any(c not in vocabulary for c in bytes_):
        return None
    whole = Tokenizer.from_str(data).model
    if any([t.id for t in whole.tokenize(m)] != [i] for m, i in zip(made, ids, strict=True)):
        return None
    return {bytes(bytes_[c] for c in token): vocabulary[token] for token in (*bytes_, *made)}


def _encoder(data: str, ranks: dict[bytes, int] | None):
    """The worker's function from texts to ids for a tokenizer file."""

    def load():
        library: list = []

        def by_library(part: str) -> np.ndarray:
            if not library:  # only texts beyond PLAIN need it
                from tokenizers import Tokenizer

                library.append(Tokenizer.from_str(data))
                library[0].encode_special_tokens = True  # special tokens' strings in a text are ordinary text
            return np.array(library[0].encode(part, add_special_tokens=False).ids, np.uint32)

        if ranks is None:
            return lambda text: encoded(text, by_library)
        by_ranks = encoder(ranks, PATTERN)[1]
        return lambda text: by_ranks(text) if PLAIN.fullmatch(text) else encoded(text, by_library)

    return held_by_worker("tokenizer", hash(data), load)


def byte_level(data: str) -> bool:
    """Whether a tokenizer file is byte-level BPE by the usual pattern, nothing else."""
    x = json.loads(data)
    pre = x.get("pre_tokenizer") or {}
    return x["model"]["type"] == "BPE" and x.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)


def pieces(df: DataFrame, tokenizer_file: str, capacity: int = 1024, end_id: int = 2, identifier: str = "doc_id", text: str = "text", keep_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids (binary) of every piece of every row of df.

    A row's ids are those of its text (null: empty), without special tokens, then end_id. Up to capacity ids are one
    piece; more are cut into pieces of capacity ids, of which the first may be shorter.
    """
    data = Path(tokenizer_file).read_text()
    if not byte_level(data):
        raise ValueError(f"{tokenizer_file} isn't a plain byte-level BPE")
    small_batches(df.sparkSession)
    shared, kind = df.sparkSession.sparkContext.broadcast((data, ranks_of(data))), df.schema[identifier].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end = _encoder(*shared.value), np.array([end_id], "<u4").tobytes()
        for part in slices(batches, "_text", 2 << 20, keeps="tokenizer"):
            row, number, start, length, crc, out = [], [], [], [], [], []
            for i, t in enumerate(part.column("_text").to_pylist()):
                ids = ids_of(t or "").astype("<u4", copy=False).tobytes() + end
                n = len(ids) // 4
                cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    own = ids[4 * a : 4 * b]
                    row.append(i)
                    number.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(crc32(own))
                    if keep_ids:
                        out.append(own)
            columns = [part.column("doc_id").take(pa.array(row, pa.int64())), pa.array(number, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), *[pa.array(out, pa.binary())] * keep_ids]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = df.select(F.col(identifier).alias("doc_id"), F.col(text).alias("_text"))
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


def sum_of_squares(lengths: list[int], capacity: int, any_fit: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, in the given order: each goes where the sum of squared counts becomes smallest.

    Placing a piece of n into a bin of gap g turns counts[g], counts[g - n] into one less and one more; a new bin has
    gap capacity, and with any_fit is opened only for a piece that fits no open one. Full bins are not counted. Of equal
    sums an open bin comes before a new one, then the smallest gap.
    """
    counts = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    far = np.iinfo(np.int64).max
    for i, n in enumerate(lengths):
        gaps = counts[n:capacity]  # gaps n .. capacity - 1
        left = counts[: capacity - n]
        change = np.where(gaps > 0, 2 * (left - gaps) + 2, far)
        new = 2 * counts[capacity - n] + 1 if n < capacity else 0
        if len(change):
            if gaps[0]:
                change[0] = 1 - 2 * gaps[0]  # fills the bin, which is then no longer counted
            k = int(change.argmin())
            fits = change[k] <= new or any_fit and change[k] < far
        else:
            fits = False
        if fits:
            gap = n + k
            b = open_bins[gap].pop()
            counts[gap] -= 1
        else:
            gap, b, made = capacity, made, made + 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > n:
            counts[gap - n] += 1
            open_bins[gap - n].append(b)
    return bins, offsets


def _by_rule_and_repair(lengths: np.ndarray, capacity: int, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rule leaves bins open that it has no pieces for any more, so that the pieces of bins that aren't full (a
    twelfth, about) are then taken out and packed among themselves, without opening a bin where an open one has room."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    bins[order], offsets[order] = sum_of_squares(lengths[order].tolist(), capacity)
    fill = np.zeros(int(bins.max(initial=-1)) + 1, np.int64)
    np.add.at(fill, bins, lengths)
    full = fill == capacity
    left = order[~full[bins[order]]]
    kept = full[bins]
    bins[kept] = (np.cumsum(full) - 1)[bins[kept]]
    again, offsets[left] = sum_of_squares(lengths[left].tolist(), capacity, any_fit=True)
    bins[left] = again + full.sum()
    return bins, offsets


def pack_lengths(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, longest first by the sum of squares, in the better of two ways: as the rule says
    with a repair of what it leaves open, or never opening a bin where an open one has room. Of equal numbers of bins
    the first way counts."""
    lengths = np.asarray(lengths, np.int64)
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = _by_rule_and_repair(lengths, capacity, order)
    other, at = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    other[order], at[order] = sum_of_squares(lengths[order].tolist(), capacity, any_fit=True)
    return (other, at) if other.max(initial=-1) < bins.max(initial=-1) else (bins, offsets)


def packed(table: DataFrame, capacity: int = 1024, shard: int = SHARD) -> DataFrame:
    """table's columns (length among them, 1 to capacity) with sequence_id and offset.

    table must be one that gives the same rows whenever it is read, such as a written one. Sequence numbers are unique
    over all shards; offsets have no gaps. Shards, and the order of rows within one, follow from a hash of all columns
    and of the row's place, so that equal rows are dealt out like any others.
    """
    n = table.filter(F.col("length") < capacity).count()
    shards = max(1, -(-n // shard))
    names = table.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            all_ = pa.Table.from_batches(rows).combine_chunks()
            bins, offsets = pack_lengths(all_.column("length").to_numpy(), capacity)
            base = all_.column("_shard")[0].as_py() << 40
            done_rows = 0
            for batch in all_.to_batches(10_000):
                here = slice(done_rows, done_rows + batch.num_rows)
                done_rows += batch.num_rows
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(bins[here] + base), pa.array(offsets[here])], [*names, "sequence_id", "offset"])

        now, rows = None, []
        for batch in batches:
            shard_of = batch.column("_shard").to_numpy()
            cuts = [0, *(np.flatnonzero(shard_of[1:] != shard_of[:-1]) + 1).tolist(), len(shard_of)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b > a:
                    if rows and shard_of[a] != now:
                        yield from done(rows)
                        rows = []
                    now = shard_of[a]
                    rows.append(batch.slice(a, b - a))
        if rows:
            yield from done(rows)

    part = table.filter(F.col("length") < capacity).withColumn("_order", F.xxhash64(*names, F.monotonically_increasing_id())).withColumn("_shard", F.pmod(F.col("_order"), F.lit(shards)))
    part = part.repartition(shards, "_shard").sortWithinPartitions("_shard", "_order", *names)
    schema = ", ".join([*(f"`{c}` {table.schema[c].dataType.simpleString()}" for c in names), "sequence_id long, offset long"])
    # a full piece is a sequence of its own
    full = table.filter(F.col("length") == capacity).withColumn("sequence_id", F.monotonically_increasing_id() + F.lit(1 << 61)).withColumn("offset", F.lit(0).cast("long"))
    return part.select(*names, "_shard").mapInArrow(run, schema).unionByName(full)


def best_fit_packing(df: DataFrame, tokenizer_file: str, capacity: int = 1024, end_id: int = 2, identifier: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for) of every piece.

    Every row is packed, whatever its identifier: null, repeated or not. A null or empty text is the piece of end_id
    alone. An empty table gives an empty result. Other columns are not read.
    """
    return packed(written(pieces(df, tokenizer_file, capacity, end_id, identifier, text, keep_ids), "pieces"), capacity)
