"""Byte-level BPE encoding and decoding with a local rank file.

A long text is first cut at safe boundaries. The split pattern lets white space join what follows it, never what goes
before, so a match always ends where a non-space character is followed by white space; and only a run of white space
looks ahead, never past its own end. What lies between such places therefore encodes alike alone and in place, which
bounds the work on very long texts.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.shared import held_by_worker, slices, small_batches

#: A place where a text may be cut. White space is what the split pattern knows as such: Python's, less four separators.
BOUNDARY = re.compile("[\\S\x1c-\x1f](?=[^\\S\x1c-\x1f])")
#: Characters that are encoded at a time, up to the next boundary.
LONG = 1 << 16


def safe_parts(text: str, most: int = LONG) -> Iterator[str]:
    """text in parts that encode alike alone and in place, each ending at the first boundary after ``most`` characters."""
    begin = 0
    while len(text) - begin > most and (cut := BOUNDARY.search(text, begin + most)):
        yield text[begin : cut.end()]
        begin = cut.end()
    yield text[begin:]


def encoded(text: str, encode_part: Callable[[str], np.ndarray]) -> np.ndarray:
    """The ids of a text as uint32, part by part."""
    return encode_part(text) if len(text) <= LONG else np.concatenate([encode_part(x) for x in safe_parts(text)])


def rank_table(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


#: Runs of white space that are too long for the library's pattern engine.
RUN = re.compile("[^\\S\x1c-\x1f]{50000,}")


def encoder(ranks: dict[bytes, int], pattern: str) -> tuple:
    """The library's encoding, and a function that gives a text's ids as uint32."""
    import tiktoken

    encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def part_ids(part: str) -> np.ndarray:
        out, at = [], 0
        for run in RUN.finditer(part) if len(part) > 50_000 else ():
            # all but the last character of a run are one match, or all of them at the text's end
            end = run.end() if run.end() == len(part) else run.end() - 1
            out += [encoding.encode_to_numpy(part[at : run.start()], disallowed_special=()), np.array(encoding._encode_single_piece(part[run.start() : end]), np.uint32)]
            at = end
        return np.concatenate([*out, encoding.encode_to_numpy(part[at:], disallowed_special=())]) if out else encoding.encode_to_numpy(part, disallowed_special=())

    return encoding, lambda text: encoded(text, part_ids)


def _encoding(data: bytes, pattern: str) -> tuple:
    """The worker's encoder for a rank file."""
    return held_by_worker("ranks", hashlib.sha256(data + pattern.encode()).digest(), lambda: encoder(rank_table(data), pattern))


def encode(df: DataFrame, rank_file: str, pattern: str, text: str = "text", keep: tuple[str, ...] = (), max_bytes: int = 4 << 20) -> DataFrame:
    """The columns ``keep``, then ``ids`` (binary, little-endian uint32) and ``n_tokens`` for every row of df.

    rank_file is read on the driver and travels as a broadcast variable. A null text counts as empty; an empty one
    has no ids; repeated rows are encoded each. Other columns of df, whatever their names, are not read.
    """
    small_batches(df.sparkSession)
    ranks = df.sparkSession.sparkContext.broadcast(Path(rank_file).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, ids_of = _encoding(ranks.value, pattern)
        for part in slices(batches, "_text", max_bytes, keeps="ranks"):
            ids = [ids_of(t or "").astype("<u4").tobytes() for t in part.column("_text").to_pylist()]
            columns = [*(part.column(i) for i in range(len(keep))), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "ids", "n_tokens"])

    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), "ids binary", "n_tokens long"])
    return df.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)


def decode(df: DataFrame, rank_file: str, pattern: str, ids: str = "ids", keep: tuple[str, ...] = (), max_bytes: int = 4 << 20) -> DataFrame:
    """The columns ``keep``, then ``decoded`` (binary): the raw bytes of the ids, which need not be valid UTF-8.

    Null ids give null. An id that the rank file lacks raises, as does a number of bytes that four doesn't divide.
    """
    small_batches(df.sparkSession)
    ranks = df.sparkSession.sparkContext.broadcast(Path(rank_file).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, _ = _encoding(ranks.value, pattern)
        for part in slices(batches, "_ids", max_bytes, keeps="ranks"):
            raw = [None if x is None else encoding.decode_bytes(np.frombuffer(x, "<u4").tolist()) for x in part.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(raw, pa.binary())], [*keep, "decoded"])

    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), "decoded binary"])
    return df.select(*keep, F.col(ids).alias("_ids")).mapInArrow(run, schema)


def encode_and_decode(df: DataFrame, rank_file: str, pattern: str, text: str = "text", keep: tuple[str, ...] = (), max_bytes: int = 4 << 20) -> DataFrame:
    """encode() and decode() in one pass over the texts: ``keep``, n_tokens, ids_sha256 and decoded_sha256.

    ids_sha256 is the lower-case hex SHA-256 of the decimal ids joined by commas, decoded_sha256 that of the decoded
    bytes. Nulls and empty texts as there; only digests leave the worker.
    """
    small_batches(df.sparkSession)
    ranks = df.sparkSession.sparkContext.broadcast(Path(rank_file).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, ids_of = _encoding(ranks.value, pattern)
        decimal = [str(i).encode() for i in range(encoding.max_token_value + 1)]
        for part in slices(batches, "_text", max_bytes, keeps="ranks"):
            sizes, digests, decoded = [], [], []
            for t in part.column("_text").to_pylist():
                ids = ids_of(t or "").tolist()
                sizes.append(len(ids))
                digests.append(hashlib.sha256(b",".join(map(decimal.__getitem__, ids))).hexdigest())
                decoded.append(hashlib.sha256(encoding.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(sizes, pa.int64()), pa.array(digests), pa.array(decoded)], [*keep, "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), "n_tokens long, ids_sha256 string, decoded_sha256 string"])
    return df.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)
