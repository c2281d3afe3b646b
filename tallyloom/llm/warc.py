"""WARC archives as a chunked record table.

Records are written to gzip archives, a member each, by streaming the payload through a compressor. Reading streams
the archives back: a payload becomes rows of (record, chunk number, bytes, digest so far), so that no task ever holds
a whole record, however large. Archives go through pyarrow's file systems to the shared folder; a task's archive
counts only once its name is in the manifest, which Spark writes from the tasks that succeeded.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.shared import new_path, small_batches, spread_join, written

#: Bytes that are read or compressed at a time, and payload bytes of a chunk row.
BLOCK, CHUNK = 1 << 18, 1 << 18
#: Payloads from this size on are revisited rather than written again.
LEAST_REVISIT = 1000
#: Rows sent to Python at a time hold this many chunk bytes at most.
BATCH_BYTES = 8 << 20
VERSION = b"WARC/1.1"


def record_id(identifier: object) -> str:
    return f"<urn:tallyloom:record:{identifier}>"


def header(kind: str, identifier: object, url: str | None, length: int, digest: str, refers_to: object = None, payload_length: int | None = None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    uri = "".join(c for c in url or "" if c.isprintable() and not c.isspace()) or f"urn:tallyloom:page:{identifier}"
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(identifier)}", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: text/html; charset=utf-8"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Payload-Length: {payload_length}"]
    return VERSION + b"\r\n" + "\r\n".join([*lines, f"Content-Length: {length}"]).encode() + b"\r\n\r\n"


def payload(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def plan(df: DataFrame, identifier: str = "page_id", body: str = "html", url: str = "url") -> DataFrame:
    """Each row of df with its record type: id, url, payload, digest, n_bytes, refers_to (null for a response).

    Of records whose payloads of LEAST_REVISIT bytes or more are equal (by SHA-1, length and another 64-bit hash), the
    one with the largest identifier is the response and the others refer to it; of several rows with that identifier,
    all are responses. Null payloads are empty ones; null identifiers refer to the largest one that isn't null, and are
    responses where there is none.
    """
    rows = df.select(F.col(identifier).cast("long").alias("id"), F.col(url).cast("string").alias("url"), payload(body).alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "check": F.xxhash64("payload"), "n_bytes": F.octet_length("payload").cast("long")})
    key = ["digest", "check", "n_bytes"]
    groups = rows.drop("payload").filter(F.col("n_bytes") >= LEAST_REVISIT).groupBy(*key).agg(F.max("id").alias("last"), F.count("*").alias("n")).filter("n > 1")
    groups = written(groups, "equal-payloads")
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # only identifiers travel; the payloads stay where they are read unless they have copies
    some = rows.join(groups.select(*key), key, "left_anti").withColumn("last", F.lit(None).cast("long"))
    copies = spread_join(rows, groups, key, "n", total).drop("n")
    return some.unionByName(copies).withColumn("refers_to", F.when(~F.col("id").eqNullSafe(F.col("last")), F.col("last"))).drop("last", "check")


def write_archives(records: DataFrame, folder: str, created: str | None = None) -> DataFrame:
    """Writes the rows of plan() as gzip archives below folder; returns the written manifest (path, records, bytes)."""
    small_batches(records.sparkSession)
    date = created or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, base = arrow_fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        task = TaskContext.get()
        path = f"{base}/part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        count = size = 0
        out = None
        for batch in batches:
            out = out or fs.open_output_stream(path)
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                refers, body, n = row["refers_to"].as_py(), memoryview(row["payload"].as_buffer()), row["n_bytes"].as_py()
                kind = "response" if refers is None else "revisit"
                member = zlib.compressobj(1, zlib.DEFLATED, 31)

                def put(data: bytes) -> int:
                    return out.write(data) or len(data)

                size += put(member.compress(header(kind, row["id"].as_py(), row["url"].as_py(), n if kind == "response" else 0, row["digest"].as_py(), refers, n, date)))
                for k in range(0, n if kind == "response" else 0, BLOCK):
                    size += put(member.compress(body[k : k + BLOCK]))
                size += put(member.compress(b"\r\n\r\n") + member.flush())
                count += 1
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([count]), pa.array([size])], ["path", "records", "bytes"])

    columns = records.select("id", "url", "payload", "digest", "n_bytes", "refers_to")
    return written(columns.mapInArrow(run, "path string, records long, bytes long"), "manifest")


class Members:
    """The uncompressed bytes of an archive's members, without holding more than a block of them."""

    def __init__(self, stream) -> None:
        self.stream, self.raw, self.text, self.member, self.over = stream, b"", bytearray(), zlib.decompressobj(31), False

    def more(self) -> bool:
        """Uncompresses a little more; False at the end."""
        while not self.over:
            if self.member.eof:
                self.raw, self.member = self.member.unused_data, zlib.decompressobj(31)
            self.raw = self.raw or self.member.unconsumed_tail or self.stream.read(BLOCK)
            if not self.raw:
                self.over = True
                break
            data = self.member.decompress(self.raw, BLOCK)
            self.raw = self.member.unconsumed_tail
            if data:
                self.text += data
                return True
        return False

    def line_end(self) -> bytes | None:
        """Everything up to an empty line; None at the end of the archive."""
        while (at := self.text.find(b"\r\n\r\n")) < 0:
            if not self.more():
                if self.text.strip():
                    raise ValueError("the archive ends within a header")
                return None
        found = bytes(self.text[:at])
        del self.text[: at + 4]
        return found

    def take(self, n: int) -> bytes:
        while len(self.text) < n:
            if not self.more():
                raise ValueError("the archive ends within a record")
        found = bytes(self.text[:n])
        del self.text[:n]
        return found


def read_chunks(manifest: DataFrame, folder: str, chunk: int = CHUNK) -> DataFrame:
    """The chunked record table of the archives that a manifest names.

    record_id, chunk_no (from 0; a record without payload has one empty chunk), payload (the chunk's bytes), so_far
    (payload bytes up to and with this chunk), digest_so_far (their SHA-1), last (whether the record ends here), and
    from the header: record_type, refers_to, payload_length, payload_digest. A payload that differs from its
    header's digest raises.
    """
    names = ["record_id", "chunk_no", "payload", "so_far", "digest_so_far", "last", "record_type", "refers_to", "payload_length", "payload_digest"]
    types = [pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.int64(), pa.string()]

    def rows_of(members: Members) -> Iterator[tuple]:
        while (head := members.line_end()) is not None:
            first, *lines = head.split(b"\r\n")
            if first != VERSION:
                raise ValueError(f"no record begins with {first[:40]!r}")
            fields = {k.lower(): v for k, v in (x.decode().split(": ", 1) for x in lines)}
            n, sha, at, number = int(fields["content-length"]), hashlib.sha1(), 0, 0
            kind, claimed = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
            total = n if kind == "response" else int(fields["x-payload-length"])
            while True:
                part = members.take(min(chunk, n - at))
                at += len(part)
                sha.update(part)
                if at == n and kind == "response" and sha.hexdigest() != claimed:
                    raise ValueError(f"{fields['warc-record-id']}: its payload has another digest")
                yield fields["warc-record-id"], number, part, at, sha.hexdigest(), at == n, kind, fields.get("warc-refers-to"), total, claimed
                number += 1
                if at == n:
                    break
            if members.take(4) != b"\r\n\r\n":
                raise ValueError("a record is longer than its header says")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = arrow_fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with fs.open_input_stream(path) as stream:
                    rows, size = [], 0
                    for row in rows_of(Members(stream)):
                        rows.append(row)
                        size += len(row[2]) + 300
                        if size > BATCH_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    schema = "record_id string, chunk_no int, payload binary, so_far long, digest_so_far string, last boolean, record_type string, refers_to string, payload_length long, payload_digest string"
    small_batches(manifest.sparkSession)
    files = max(1, manifest.count())
    return manifest.select("path").repartition(files).mapInArrow(run, schema)


def round_trip(df: DataFrame, identifier: str = "page_id", body: str = "html", url: str = "url") -> DataFrame:
    """Writes df's pages as archives and reads them back: the chunked record table of read_chunks()."""
    folder = new_path(df.sparkSession, "warc")
    return read_chunks(write_archives(plan(df, identifier, body, url), folder), folder)


def records(chunks: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record, from its last chunk.

    A response's length and digest come from its payload as read, a revisit's from its header.
    """
    number = lambda c: F.regexp_extract(c, r":(-?\d+)>$", 1).try_cast("long")
    revisit = F.col("record_type") == "revisit"
    return chunks.filter("last").select(
        number("record_id").alias("page_id"),
        F.when(revisit, F.col("payload_length")).otherwise(F.col("so_far")).alias("payload_bytes"),
        F.when(revisit, F.col("payload_digest")).otherwise(F.col("digest_so_far")).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )
