"""Names, schools and classes: cleaning, matching and display."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

QUOTES = ("‘’“”", "''\"\"")
SPAN_DASH = "–"


def straight_quotes(text: Column) -> Column:
    return F.translate(text, *QUOTES)


@F.pandas_udf(StringType())
def strip_diacritics(text: pd.Series) -> pd.Series:
    """Without combining marks; Spark has no function that decomposes characters."""
    return text.map(lambda s: None if s is None else "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn"))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends; Spark's trim() knows the space alone."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def cased(text: Column) -> Column:
    """A name whose last name is in capitals: all words but the first are capitalised, at hyphens and quotes too.

    Names without a word of two capitals or more stay; trailing ``*`` and ``?`` go. Capitalised as the reference's
    name parser does it for one-word parts; particles in capitals ("DE LA") become "De La".
    """
    text = F.regexp_replace(text, r"[*?]+$", "")
    upper_first = lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1 << 30)))
    one = lambda w: F.when(w.rlike("^(II|III|IV)[.]?$"), w).otherwise(F.array_join(F.transform(F.split(w, r"(?<=[-'’])"), upper_first), ""))
    words = F.split(squeeze(text), " ")
    fixed = F.array_join(F.concat(F.slice(words, 1, 1), F.transform(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(1))), one)), " ")
    return F.when(text.rlike(r"(?U)\b[A-ZÀ-Ý]{2,}\b"), fixed).otherwise(text)


def mapped(value: Column, aliases: dict[str, str]) -> Column:
    """value's canonical spelling, itself where it has none."""
    if not aliases:
        return value
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]), value), value)


def clean_school(name: Column, aliases: dict[str, str], year: Column | None = None, splits: list[tuple[set, int, str, str]] = ()) -> Column:
    """Without dot leaders and trailing marks, by its canonical spelling; a split is (names, year, before, from then).

    Without a year, or with a null one, a split gives the earlier name.
    """
    name = stripped(F.regexp_replace(name, r"\.{2,}", ""))
    for mark in (r"\*", "¶"):
        name = stripped(F.regexp_replace(name, f"{mark}+$", ""))
    name = mapped(name, aliases)
    for names, at, before, after in splits:
        earlier = F.lit(True) if year is None else F.coalesce(year < at, F.lit(True))
        name = F.when(name.isin(*names), F.when(earlier, F.lit(before)).otherwise(F.lit(after))).otherwise(name)
    return name


def parse_class(text: Column, codes: dict[str, str]) -> Column:
    """The class of a code; else of the first code that the text holds, in order; else null."""
    text = stripped(text)
    exact = F.try_element_at(F.create_map(*[F.lit(x) for pair in codes.items() for x in pair]), text)
    held = F.filter(F.array(*map(F.lit, codes)), lambda code: text.contains(code))
    table = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    return F.coalesce(exact, F.try_element_at(table, F.get(held, F.lit(0))))


def name_and_class(text: Column, codes: dict[str, str]) -> Column:
    """Struct (name, class) where a class code is glued to the end of a name."""
    pattern = "^(.*?)(" + "|".join(codes) + ")$"
    code = F.nullif(F.regexp_extract(text, pattern, 2), F.lit(""))
    return F.struct(F.trim(F.when(code.isNotNull(), F.regexp_extract(text, pattern, 1)).otherwise(text)).alias("name"), F.try_element_at(F.create_map(*[F.lit(x) for p in codes.items() for x in p]), code).alias("class"))


def first_name(name: Column) -> Column:
    return F.split(F.lower(name), " ")[0]


def last_name(name: Column) -> Column:
    return F.element_at(F.split(F.lower(name), " "), -1)


def initials_match(a: Column, b: Column) -> Column:
    """First names equal without dots and quotes, one of up to three capitals at least, and last names equal but for case."""
    bare = lambda n: F.regexp_replace(F.split(n, " ")[0], r"[.']", "")
    short = lambda n: bare(n).rlike("^[A-Z]{1,3}$")
    return (bare(a) == bare(b)) & (short(a) | short(b)) & (last_name(a) == last_name(b))


def international(name: Column) -> Column:
    """Struct (name, is_international): a trailing quote marks a foreign athlete."""
    return F.struct(F.regexp_replace(name, "['’]$", "").alias("name"), name.rlike("['’]$").alias("is_international"))


def capitalised(text: Column) -> Column:
    return F.concat(F.upper(F.left(text, F.lit(1))), F.substring(text, 2, 1 << 30))


def page_url(base: str, title: Column) -> Column:
    return F.concat(F.lit(base), F.url_encode(F.replace(title, F.lit(" "), F.lit("_"))))


def nicknames(men: Column, women: Column) -> Column:
    return F.array_distinct(F.array_compact(F.array(men, women)))


def year_span(first: Column, last: Column) -> Column:
    return F.when(first == last, first.cast("string")).otherwise(F.concat(first.cast("string"), F.lit(SPAN_DASH), last.cast("string")))
