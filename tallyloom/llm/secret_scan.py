"""Secrets in texts: fixed forms, and values beside words of credentials that would stand many guesses.

Three forms are base: assignments, access key identifiers and long hexadecimal runs. Beyond these, every value that
stands beside a word of credentials ("pwd:", "passphrase is", "Bearer") is priced by the guess-cost program of
guess_cost.py, words being those of a rank file; a value of ``least_cost`` or more is a span of kind ``guess`` unless a
base span holds it. Values that are all letters in one case read as prose and must cost twice that; addresses of mail
and web are no values.

Null and empty texts have no spans. Positions are code points, ends exclusive. Repeated rows are scanned each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.byte_bpe import rank_table
from tallyloom.llm.guess_cost import guess_cost, words_by_rank
from tallyloom.llm.shared import as_bytes, held_by_worker, slices, small_batches

KINDS = ("assign", "access", "hex", "guess")
#: The base forms. ASSIGN is for text with A-Z lower-cased, which all its classes allow for.
ASSIGN = re.compile(rb"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]+)")
ASSIGN_WORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
LEAST_ASSIGNED = 6
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")  # AKIA[A-Z0-9]+ of 20 characters or more: a run ends where its tails end
HEX = re.compile(rb"[0-9a-f]{24,}")
#: Words of credentials, for text with A-Z lower-cased, what may stand between them and a value, and the value.
CONTEXT = re.compile(
    rb"(?<![a-z0-9])(?:(?:[a-z0-9]{1,20}[_.-])?(?:passwords?|passwd|passphrase|passcode|passwort|contrase\xc3\xb1a|mot\x20de\x20passe|pwd|pass|secret|token|api[_-]?key|(?:access|private|secret|signing|encryption)[_-]?key|credentials?|auth|authorization|login)"
    rb"[\"']?(?:\x20{0,4}(?:=>|:=|[:=])\x20{0,4}|\x20(?:is|was|ist|est|es)\x20)|bearer\x20)[\"'`]?(?:(?:bearer|basic)\x20)?([!#-&(-_a-~]+)"
)
CONTEXT_WORDS = (b"pass", b"pwd", b"secret", b"token", b"key", b"credential", b"auth", b"login", b"bearer", b"contrase")
ADDRESS = re.compile(r"(?i)[a-z][a-z0-9+.-]*://|[\w.+-]+@[\w-]+(\.[\w-]+)+$|www\.")
WORDLIKE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
TRAILING = ".,;:!?)]}>"


def spans(text: bytes, ranks: dict[str, int], least_cost: float, least_length: int) -> list[tuple[int, int, int, float | None]]:
    """(start, kind, end, cost) in bytes, in order; the cost of base spans is null."""
    low, out = text.lower(), []
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end(), None) for m in ASSIGN.finditer(low) if m.end(1) - m.start(1) >= LEAST_ASSIGNED]
    if b"AKIA" in text:
        out += [(m.start(), 1, m.end(), None) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), None) for m in HEX.finditer(text)]
    if any(w in low for w in CONTEXT_WORDS):
        base = sorted(out)
        for m in CONTEXT.finditer(low):
            value = text[m.start(1) : m.end(1)].decode("ascii").rstrip(TRAILING)
            end = m.start(1) + len(value)
            if len(value) < least_length or ADDRESS.match(value) or any(s <= m.start(1) and end <= e for s, _, e, _ in base):
                continue
            cost = guess_cost(value, ranks)
            if cost >= (2 * least_cost if WORDLIKE.fullmatch(value) else least_cost):
                out.append((m.start(1), 3, end, cost))
    return sorted(out, key=lambda s: s[:3])


def in_code_points(text: bytes, found: list[tuple]) -> list[dict]:
    """spans() with places in code points instead of bytes, as structs."""
    at = {0: 0}
    before = 0
    for place in sorted({p for start, _, end, _ in found for p in (start, end)}):
        at[place] = at[before] + len(text[before:place].decode("utf-8", "replace"))
        before = place
    return [{"kind": KINDS[kind], "start": at[start], "end": at[end], "cost": cost} for start, kind, end, cost in found]


def secret_spans(df: DataFrame, rank_file: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), least_cost: float = 10.0, least_length: int = 8) -> DataFrame:
    """The columns ``keep``, then ``spans``: array of (kind, start, end, cost) by start, then kind as in KINDS.

    The rank file lists tokens by falling frequency, which are the words of the guess costs.
    """
    spark = df.sparkSession
    small_batches(spark)
    data = spark.sparkContext.broadcast(Path(rank_file).read_bytes())

    def make() -> dict[str, int]:
        table = rank_table(data.value)
        return words_by_rank(sorted(table, key=table.get))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = held_by_worker("guess-words", rank_file, make)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cost", pa.float64())]))
        for part in slices(batches, "_text", 4 << 20, keeps="guess-words"):
            found = [in_code_points(t, spans(t, ranks, least_cost, least_length)) if t else [] for t in as_bytes(part.column("_text"))]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(found, kind)], [*keep, "spans"])

    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), "spans array<struct<kind:string,start:bigint,end:bigint,cost:double>>"])
    return df.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)


def listed(found: Column) -> Column:
    """``kind:start:end`` of spans, joined by commas; '' without any."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(found: Column, *kinds: str) -> Column:
    return F.filter(found, lambda s: s["kind"].isin(*kinds))
