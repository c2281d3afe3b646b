"""Removal of repeated passages by Rabin-Karp hashes of every window of ``width`` words.

Documents are packed into chunks in the shared folder. Three passes over the chunks follow, and what passes between
them is bits:

1. anchors: of the short-gram hashes in each window the smallest is its anchor. Equal windows have equal anchors, and
   neighbouring windows mostly share one, so counting anchors in Spark (a seventh of the windows) shows which windows
   can't repeat.
2. windows: the hashes of all others, each once a chunk with the first document that has it, are counted in Spark by
   hash range, which tells each chunk which of its windows start earlier elsewhere.
3. removal: repeated windows merge into maximal intervals, which are cut out.

Hashes are polynomials modulo 2^64 with prefix sums over the words' XXH3, made by vector operations over whole chunks.
A window counts as repeated only if two such polynomials over different halves of the words' 128-bit hashes agree, of
different bases; one alone decides only where to look. A passage in a third of all documents travels once a chunk, not
once a document: a range holds RANGE hashes, and of a hash that is in all chunks one entry a chunk (CHUNK_BYTES of text).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.shared import as_bytes, give_back, let_go, small_batches, written

#: Words of an anchor's gram.
GRAM = 8
#: Text of a chunk; a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 20
#: Text whose bytes are hashed at a time.
BLOCK_BYTES = 1 << 19
#: Hashes in a range, about.
RANGE = 400_000
#: Chunks that a task of a later pass takes, about.
CHUNKS_A_TASK = 16
RECORDS = "chunk long, kind int, part int, data binary"
#: Bases of the two polynomials.
BASES = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15))


@cache
def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n; base is odd."""
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.empty(n, np.uint64)
        p[0] = 1
        done = 1
        while done < n:
            more = min(done, n - done)
            p[done : done + more] = p[:more] * np.uint64(pow(b, done, 1 << 64))
            done += more
        out.append(p)
    return out[0], out[1]


def tables(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers(int(base), 1 << max(18, (n - 1).bit_length()))
    return up[:n], down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Chunk:
    """The words of a chunk: text holds documents ended by newlines, their words parted by one space."""

    def __init__(self, text: bytes, width: int) -> None:
        self.text, self.width = text, width
        raw = np.frombuffer(text, np.uint8)
        parted = np.flatnonzero((raw == 32) | (raw == 10))
        ends_document = raw[parted] == 10
        begins = np.append(0, parted[:-1] + 1) if len(parted) else parted
        full = parted > begins  # an empty document's newline ends no word
        self.begin, self.end = begins[full], parted[full]
        #: words before each document, and after the last
        self.first = np.append(0, np.cumsum(full)[ends_document]).astype(np.int64)
        self.word = self.word_hashes()
        n = self.word.shape[1]
        document = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        #: starts of the windows that lie in one document
        self.starts = np.flatnonzero(document[: n - width + 1] == document[width - 1 :]) if n >= width else np.empty(0, np.int64)
        self.document = document

    def word_hashes(self) -> np.ndarray:
        """The two halves of each word's hash, a row each; BLOCK_BYTES of text at a time, as words are objects meanwhile."""
        out, i, digest = np.empty((2, len(self.begin)), np.uint64), 0, xxhash.xxh3_128_digest
        while i < len(self.begin):
            j = max(i + 1, int(np.searchsorted(self.end, self.begin[i] + BLOCK_BYTES)))
            words = self.text[self.begin[i] : self.end[j - 1]].split()
            out[:, i:j] = np.frombuffer(b"".join(map(digest, words)), "<u8").reshape(-1, 2).T
            i = j
        return out

    def grams(self, width: int, half: int = 0) -> np.ndarray:
        n = self.word.shape[1]
        if n < width:
            return np.empty(0, np.uint64)
        up, down = tables(BASES[half], n + 1)
        sums = np.append(np.uint64(0), np.cumsum(self.word[half] * up[:n], dtype=np.uint64))
        return mix((sums[width:] - sums[:-width]) * down[: n - width + 1])

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both hashes of the windows at the given places among starts."""
        chosen = self.starts[at]
        return self.grams(self.width)[chosen], self.grams(self.width, 1)[chosen]

    def anchors(self) -> np.ndarray:
        """The anchor of each window."""
        gram = min(GRAM, self.width)
        least, have, want = self.grams(gram), 1, self.width - gram + 1
        while have < want:
            more = min(have, want - have)
            least = np.minimum(least[: len(least) - more], least[more:])
            have += more
        return least[self.starts]


def ranges_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Where each of the ranges begins in sorted hashes, and their end."""
    cuts = np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)
    return np.concatenate([[0], np.searchsorted(hashes, cuts), [len(hashes)]])


def anchor_set(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The anchor of each window, the distinct anchors, and which of these occur as grams twice in the chunk.

    Equal windows have their anchor at equal distance, so at two places; a run of one word counts too."""
    anchors = chunk.anchors()
    if not len(anchors):
        return anchors, anchors, np.empty(0, bool)
    distinct, grams = np.unique(anchors), np.sort(chunk.grams(min(GRAM, chunk.width)))
    return anchors, distinct, np.searchsorted(grams, distinct, "right") - np.searchsorted(grams, distinct, "left") > 1


def candidates(chunk: Chunk, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows that may repeat: their places among the chunk's windows, which distinct window each is, and of these, in
    the order of their hashes, both hashes (a row each) and the index of the first place. shared tells which distinct
    anchors other chunks have."""
    anchors, distinct, twice = anchor_set(chunk)
    at = np.flatnonzero((shared | twice)[np.searchsorted(distinct, anchors)]) if len(anchors) else np.empty(0, np.int64)
    hashes = np.stack(chunk.windows(at))
    order = np.lexsort((hashes[1], hashes[0]))
    new = np.append(True, (hashes[:, order[1:]] != hashes[:, order[:-1]]).any(axis=0)) if len(at) else np.empty(0, bool)
    which = np.empty(len(at), np.int64)
    which[order] = np.cumsum(new) - 1
    return at, which, hashes[:, order[new]], order[new]


def record(chunk: int, kind: int, part: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([kind], pa.int32()), pa.array([part], pa.int32()), pa.array([data], pa.binary())], ["chunk", "kind", "part", "data"])


#: Kinds of records, in the order in which a pass meets them: bits from the passes, the rows; and what passes count.
ANCHOR_BITS, WINDOW_BITS, ROWS, HASHES = range(4)
#: Bytes of an entry that a pass counts: an anchor; a window's two hashes and the first document that has it.
ENTRY = {ANCHOR_BITS: 8, WINDOW_BITS: 24}


def packed(df: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """df, whose first two columns are identifier and text, as chunk records: rows in the order of their identifiers."""
    small_batches(df.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        let_go()
        number = TaskContext.get().partitionId() << 32

        def chunk(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(rows)
            ids = table.column(0).to_pylist()
            order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0))
            sink = pa.BufferOutputStream()
            table = table.take(pa.array(order, pa.int64())).combine_chunks()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table)
            return record(number, ROWS, 0, sink.getvalue().to_pybytes())

        rows, size = [], 0
        for batch in batches:
            begin = 0
            for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()):
                size += n + 1
                if size >= chunk_bytes:
                    yield chunk([*rows, batch.slice(begin, i + 1 - begin)])
                    number, begin, rows, size = number + 1, i + 1, [], 0
            if begin < batch.num_rows:
                rows.append(batch.slice(begin))
        if rows:
            yield chunk(rows)
        give_back()

    return written(df.mapInArrow(pack, RECORDS), "chunks")


def unpacked(data: bytes, width: int) -> tuple[pa.Table, Chunk]:
    """The rows of a chunk and their words."""
    table = pa.ipc.open_stream(data).read_all().combine_chunks()
    texts = as_bytes(table.column(1))
    return table, Chunk(b"".join(x for t in texts for x in (b" ".join((t or b"").split()), b"\n")), width)


def by_chunk(records: DataFrame, chunks: int, function) -> DataFrame:
    """Runs function over (chunk, {kind: {part: data}}) of each chunk; a task streams over its chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, have = None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                chunk, kind, part = (batch.column(c)[i].as_py() for c in ("chunk", "kind", "part"))
                if chunk != now:
                    if now is not None:
                        yield from function(now, have)
                    now, have = chunk, {}
                have.setdefault(kind, {})[part] = batch.column("data")[i].as_py()
        if now is not None:
            yield from function(now, have)
        give_back()

    return records.repartition(max(1, chunks // CHUNKS_A_TASK), "chunk").sortWithinPartitions("chunk", "kind", "part"), run


def bits(have: dict, kind: int, lengths: np.ndarray) -> np.ndarray:
    """The flags that the ranges of a pass have sent back, in the order of the sorted hashes."""
    out = np.zeros(lengths[-1], bool)
    for part, data in have.get(kind, {}).items():
        n = lengths[part + 1] - lengths[part]
        out[lengths[part] : lengths[part + 1]] = np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)
    return out


def counted(blobs: DataFrame, parts: int, kind: int, flag) -> DataFrame:
    """Brings each hash range together; flag gets its entries (a row for each field) and chunks and tells which to mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def range_(part: int, rows: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
            entry = ENTRY[kind]
            sizes = np.array([len(d) // entry for _, d in rows])
            fields = np.concatenate([np.frombuffer(d, "<u8").reshape(entry // 8, -1) for _, d in rows], axis=1)
            marked = flag(fields, np.repeat(np.array([c for c, _ in rows], np.int64), sizes))
            for (chunk, _), end, n in zip(rows, np.cumsum(sizes).tolist(), sizes.tolist(), strict=True):
                if (own := marked[end - n : end]).any():
                    yield record(chunk, kind, part, np.packbits(own).tobytes())

        now, rows = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.column("part")[i].as_py()
                if part != now and rows:
                    yield from range_(now, rows)
                    rows = []
                now = part
                rows.append((batch.column("chunk")[i].as_py(), batch.column("data")[i].as_py()))
        if rows:
            yield from range_(now, rows)
        give_back()

    return blobs.repartition(parts, "part").sortWithinPartitions("part", "chunk").mapInArrow(run, RECORDS)


def elsewhere(fields: np.ndarray, chunks: np.ndarray) -> np.ndarray:
    hashes = fields[0]
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    out = np.zeros(len(hashes), bool)
    out[order[1:][same]] = out[order[:-1][same]] = True
    return out


def not_first(fields: np.ndarray, chunks: np.ndarray) -> np.ndarray:
    order = np.lexsort((chunks, fields[2].view(np.int64), fields[1], fields[0]))
    out = np.zeros(len(order), bool)
    out[order[1:]] = (fields[:2, order[1:]] == fields[:2, order[:-1]]).all(axis=0)
    return out


def order_keys(ids: pa.Array) -> np.ndarray:
    return ids.cast(pa.int64()).fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)


def removal(df: DataFrame, width: int, finish, schema: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The three passes over df, whose first two columns are identifier and text; finish(rows, documents) makes the
    result's batches of a chunk's rows and, for each, its words, its kept text and its removed intervals."""
    records = packed(df, chunk_bytes)
    sizes = records.agg(F.count("*"), F.coalesce(F.sum(F.length("data")), F.lit(0))).first()
    chunks, ranges = max(1, sizes[0]), max(1, int(sizes[1] * 3 / 6) // 5 // RANGE + 1)

    def send_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                distinct = anchor_set(unpacked(batch.column("data")[i].as_py(), width)[1])[1]
                cuts = ranges_of(distinct, ranges)
                for part, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                    if b > a:
                        yield record(batch.column("chunk")[i].as_py(), HASHES, part, distinct[a:b].astype("<u8").tobytes())

    shared = written(counted(records.mapInArrow(send_anchors, RECORDS), ranges, ANCHOR_BITS, elsewhere), "anchor-bits")

    def known(chunk: Chunk, have: dict) -> tuple:
        return candidates(chunk, bits(have, ANCHOR_BITS, ranges_of(anchor_set(chunk)[1], ranges)))

    def send_windows(number: int, have: dict) -> Iterator[pa.RecordBatch]:
        table, chunk = unpacked(have[ROWS][0], width)
        ids = order_keys(table.column(0).combine_chunks())
        at, _, own, first = known(chunk, have)
        whose = ids[chunk.document[chunk.starts[at[first]]]] if len(first) else np.empty(0, np.int64)
        fields = np.concatenate([own, whose.view(np.uint64)[None]])
        cuts = ranges_of(own[0], ranges)
        for part, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            if b > a:
                yield record(number, HASHES, part, np.ascontiguousarray(fields[:, a:b]).astype("<u8").tobytes())

    dealt, run = by_chunk(records.unionByName(shared), chunks, send_windows)
    later = written(counted(dealt.mapInArrow(run, RECORDS), ranges, WINDOW_BITS, not_first), "window-bits")

    def cut_out(_: int, have: dict) -> Iterator[pa.RecordBatch]:
        table, chunk = unpacked(have[ROWS][0], width)
        at, which, own, first = known(chunk, have)
        gone = np.zeros(0, bool)
        if len(first):
            local = np.ones(len(at), bool)
            local[first] = False  # all but the first in the chunk start later than that
            gone = bits(have, WINDOW_BITS, ranges_of(own[0], ranges))[which] | local
        starts = chunk.starts[at[gone]]
        cover = np.zeros(chunk.word.shape[1] + 1, np.int64)
        cover += np.bincount(starts, minlength=len(cover)) - np.bincount(starts + width, minlength=len(cover))
        removed = np.cumsum(cover)[:-1] > 0
        documents = []
        for a, b in zip(chunk.first[:-1].tolist(), chunk.first[1:].tolist(), strict=True):
            own_removed = removed[a:b]
            if not own_removed.any():
                documents.append((b - a, chunk.text[chunk.begin[a] : chunk.end[b - 1]] if b > a else b"", []))
                continue
            edges = np.flatnonzero(np.diff(np.concatenate([[False], own_removed, [False]]))).tolist()
            kept = [0, *edges, b - a]
            pieces = [chunk.text[chunk.begin[a + i] : chunk.end[a + j - 1]] for i, j in zip(kept[::2], kept[1::2], strict=True) if j > i]
            documents.append((b - a, b" ".join(pieces), list(zip(edges[::2], edges[1::2], strict=True))))
        yield from finish(table, documents)

    dealt, run = by_chunk(records.unionByName(shared).unionByName(later), chunks, cut_out)
    return dealt.mapInArrow(run, schema)


def substring_dedup(df: DataFrame, identifier: str = "doc_id", text: str = "text", width: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text and removed (array of begin, end in words) for every row of df.

    Words are runs of anything but [\\x20\\x09-\\x0D]. Every word goes that is covered by a window of ``width`` words
    whose sequence also starts earlier: in a document of a smaller identifier, or earlier in the same. Null identifiers
    come last; rows of equal identifiers come in the order of chunks, as read. Identifiers are whole numbers of 64 bits at
    most; others raise. A null text has no words, an empty table gives an empty result, and columns beside the two are
    not read.
    """
    kind = df.schema[identifier].dataType.simpleString()

    def finish(table: pa.Table, documents: list) -> Iterator[pa.RecordBatch]:
        removed = pa.array([[{"begin": a, "end": b} for a, b in d[2]] for d in documents], pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))
        columns = [table.column(0).combine_chunks(), pa.array([d[0] for d in documents], pa.int64()), pa.array([sum(b - a for a, b in d[2]) for d in documents], pa.int64()), pa.array([d[1] for d in documents], pa.binary()).cast(pa.string()), removed]
        yield pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns], ["doc_id", "n_words", "n_removed", "kept_text", "removed"])

    schema = f"doc_id {kind}, n_words long, n_removed long, kept_text string, removed array<struct<begin:int,end:int>>"
    return removal(df.select(F.col(identifier).alias("b0"), F.col(text).alias("b1")), width, finish, schema)


def without_repeats(df: DataFrame, identifier: str = "doc_id", text: str = "text", width: int = 20) -> DataFrame:
    """df with the repeated words cut out of its texts; texts that lose none stay as they are, white space included.

    Every row stays, with all its columns. A text of which nothing is left is empty; a null text stays null.
    """
    names = df.columns
    order = [names.index(identifier), names.index(text), *(i for i, c in enumerate(names) if c not in (identifier, text))]
    source = df.select(*[F.col(names[i]).alias(f"b{i}") for i in order])

    def finish(table: pa.Table, documents: list) -> Iterator[pa.RecordBatch]:
        columns = [c.combine_chunks() for c in table.columns]
        columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
        columns[1] = pa.array([d[1].decode() if d[2] else w for d, w in zip(documents, columns[1].to_pylist(), strict=True)], pa.string())
        yield pa.RecordBatch.from_arrays(columns, [f"b{i}" for i in order])

    schema = ", ".join(f"b{i} {df.schema[names[i]].dataType.simpleString()}" for i in order)
    return removal(source, width, finish, schema).select(*[F.col(f"b{i}").alias(c) for i, c in enumerate(names)])
