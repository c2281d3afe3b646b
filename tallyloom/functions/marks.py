"""Marks, times, places and winds as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres of a foot and of an inch, and vulgar fractions.
FOOT, INCH = 0.3048, 0.0254
FRACTIONS = [("½", ".5"), ("¼", ".25"), ("¾", ".75")]
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"
#: Marks that are none, hyphens that count as plain ones, and signs and letters that annotate a mark.
NO_MARK = ("nt", "n")
HYPHENS = "[‐‑‒–—]"
ANNOTATIONS = "[+*;?¶hHiIyY]"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once, however often f names it; keeps the code of nested parsers small."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def to_number(text: Column) -> Column:
    """text as a double if it is a plain decimal number, else null."""
    text = F.trim(text)
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def seconds(text: Column) -> Column:
    """Seconds of ``ss``, ``mm:ss`` or ``hh:mm:ss``; null for anything else."""
    parts = F.split(text, ":")
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a * F.lit(60.0) + to_number(x))
    return F.when(F.size(parts) <= 3, total)


def clean_mark(text: Column) -> Column:
    """The part of a mark that counts: without wind, annotations and what follows a slash, hyphens and fractions plain."""
    text = F.regexp_replace(text, "[wW]", "")
    text = F.trim(F.regexp_replace(F.regexp_replace(text, "^[cC]", ""), ANNOTATIONS, ""))
    text = F.trim(F.regexp_replace(F.split(text, "/")[0], r"\([Aa]\)$", ""))
    text = F.regexp_replace(text, HYPHENS, "-")
    for sign, decimal in FRACTIONS:
        text = F.replace(text, F.lit(sign), F.lit(decimal))
    return text


def metres(text: Column) -> Column:
    """Metres of ``feet-inches`` or ``feet-inches-fraction``, whose fraction may be empty."""
    parts = F.split(text, "-")
    fraction = F.when(F.size(parts) == 2, F.lit(0.0)).otherwise(F.when(F.get(parts, F.lit(2)) == "", F.lit(0.0)).otherwise(to_number(F.get(parts, F.lit(2)))))
    return F.when(F.size(parts).isin(2, 3), to_number(F.get(parts, F.lit(0))) * F.lit(FOOT) + (to_number(F.get(parts, F.lit(1))) + fraction) * F.lit(INCH))


def parse_mark(text: Column) -> Column:
    """Struct (num, cleaned, wind_aided, converted) of an outdoor mark; nulls and false where there is none.

    A time is minutes and seconds, a length feet and inches or metres; a mark is wind aided if it holds a w, and
    converted if it ends with a plus sign.
    """
    none = text.isNull() | (text == "") | (F.trim(text) == "?") | F.lower(text).isin(*NO_MARK)

    def number(cleaned: Column) -> Column:
        time = F.when(F.size(F.split(cleaned, ":")) == 2, to_number(F.split(cleaned, ":")[0]) * F.lit(60.0) + to_number(F.split(cleaned, ":")[1]))
        return F.when(cleaned.contains(":"), time).when(cleaned.contains("-") & ~cleaned.startswith("-"), metres(cleaned)).otherwise(to_number(F.regexp_replace(cleaned, "[my]", "")))

    return F.struct(
        F.when(~none, let(clean_mark(text), number)).alias("num"),
        F.when(~none, clean_mark(text)).alias("cleaned"),
        F.coalesce(~none & F.lower(text).contains("w"), F.lit(False)).alias("wind_aided"),
        F.coalesce(~none & F.rtrim(text).endswith("+"), F.lit(False)).alias("converted"),
    )


def parse_indoor_mark(text: Column, kind: Column) -> Column:
    """Struct (num, cleaned, converted) of an indoor mark by event kind: multi (points), track or relay (time), field (metres).

    Dashes and zeros with letters at most are a placeholder, not a mark; what follows `` = `` is another form of it.
    """
    left = F.split(F.coalesce(text, F.lit("")), " = ")[0]
    bare = F.regexp_replace(left, r"\s+", "")
    none = bare.rlike("^[-0]+[A-Za-z]*$") | text.isNull()
    points = F.regexp_extract(F.replace(bare, F.lit(",")), r"^(\d+)", 1)
    time, clock = F.regexp_extract(F.trim(left), r"^([\d:.]+)", 1), F.regexp_extract(bare, r"^([\d:.]+)", 1)
    length = F.regexp_extract(bare, r"^([\d.]+m)", 1)
    by_kind = lambda multi, timed, field: F.when(kind == "multi", multi).when(kind.isin("track", "relay"), timed).when(kind == "field", field)
    number = by_kind(points.try_cast("double"), seconds(time), to_number(F.regexp_extract(left, r"^([\d.]+)m", 1)))
    cleaned = by_kind(points, clock, length)
    cleaned = F.when(cleaned != "", cleaned).when(kind == "multi", F.replace(bare, F.lit(","))).otherwise(bare)
    return F.struct(F.when(~none, number).alias("num"), F.when(~none, cleaned).alias("cleaned"), F.coalesce(~none & bare.endswith("c"), F.lit(False)).alias("converted"))


def parse_missing_mark(text: Column) -> Column:
    """Struct (num, cleaned, altitude, converted) of a mark entered by hand: ``A`` or ``(A)`` at its end is altitude, ``+``
    or ``c`` before it a conversion; times, metres, centimetres, feet-inches or a plain number; else no number."""
    original = F.trim(text)
    none = text.isNull() | (text == "") | (original == "?")
    altitude = original.rlike(r"A\)?$")
    bare = F.regexp_replace(original, r"\s*\(?A\)?$", "")
    plain = F.trim(F.regexp_replace(F.regexp_replace(bare, r"[+c]+$", ""), "y+$", ""))
    group = lambda form, k: F.regexp_extract(plain, form, k).try_cast("double")
    time, length, feet = r"^(\d+):(\d+\.?\d*)$", r"^(\d+\.?\d*)(m|cm)?$", r"^(\d+)-(\d+\.?\d*)$"
    number = (
        F.when(plain.rlike(time), group(time, 1) * F.lit(60.0) + group(time, 2)).when(plain.rlike(r"cm$") & plain.rlike(length), group(length, 1) / F.lit(100.0))
        .when(plain.rlike(length), group(length, 1)).when(plain.rlike(feet), group(feet, 1) * F.lit(FOOT) + group(feet, 2) * F.lit(INCH)).otherwise(to_number(plain))
    )
    return F.struct(F.when(~none, number).alias("num"), F.when(none, text).otherwise(original).alias("cleaned"), F.coalesce(~none & altitude, F.lit(False)).alias("altitude"), F.coalesce(~none & bare.rlike("[+c]$"), F.lit(False)).alias("converted"))


def cast_prefix(text: Column) -> Column:
    """The number that a text begins with, 0 if it begins with none, as a cast of loose databases does it; null for null."""
    found = F.regexp_extract(text, r"^\s*([+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?))", 1)
    return F.when(text.isNotNull(), F.coalesce(F.trim(found).try_cast("double"), F.lit(0.0)))


def parse_wind(text: Column) -> Column:
    return F.when(F.lower(text).contains("wind"), F.regexp_extract(text, r"(?i)wind\s+([+-]?\d+\.?\d*)", 1).try_cast("double"))


def parse_place(text: Column) -> Column:
    """Struct (place, status) of a place in parentheses: ``(3)``, ``(DQ)``, ``(3 DNF)``; a place of zero is DNF."""
    text = F.trim(text)
    inner = F.upper(F.regexp_extract(text, r"^\(([^)]*)\)", 1))
    status, digits = F.lit(None).cast("string"), F.regexp_extract(inner, r"(\d+)", 1).try_cast("int")
    for word in ("DNS", "DNF", "DQ"):
        status = F.when(inner.rlike(rf"\b{word}\b"), F.lit(word)).otherwise(status)
    place = F.regexp_extract(text, r"^\((\d+)\)", 1).try_cast("int")
    return F.struct(F.when(status.isNotNull(), digits).otherwise(F.nullif(place, F.lit(0))).alias("place"), F.when(status.isNotNull(), status).when(place == 0, F.lit("DNF")).alias("status"))


def sentinel_status(place: Column, mark: Column, sentinel: int = 999) -> Column:
    """DQ for the sentinel place with a mark, DNF without one; an empty mark is none."""
    return F.when(place == sentinel, F.when(F.trim(mark) != "", F.lit("DQ")).otherwise(F.lit("DNF")))


def span_gap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Years between two spans, 0 if they overlap."""
    return F.greatest(b0 - a1, a0 - b1, F.lit(0))


def duration_key(text: Column) -> Column:
    """Seconds of m:ss.f or s.f for sorting; the first colon parts minutes from seconds."""
    return F.when(text.contains(":"), to_number(F.substring_index(text, ":", 1)) * 60 + to_number(F.regexp_replace(text, "^[^:]*:", ""))).otherwise(to_number(text))
