"""Faceted browsing and search: a specification becomes one plan of filters, a total order and a page."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Spec:
    """equals, at_least, at_most: by column, where a null value is no filter; nocase: equality whatever the case;
    contains: a text that one of the given columns holds; order: (column, descending) with unique columns last."""

    equals: dict = field(default_factory=dict)
    nocase: dict = field(default_factory=dict)
    at_least: dict = field(default_factory=dict)
    at_most: dict = field(default_factory=dict)
    contains: dict = field(default_factory=dict)
    order: tuple = ()
    limit: int = 100
    offset: int = 0


def predicate(spec: Spec) -> Column:
    terms = [F.col(c) == v for c, v in spec.equals.items() if v is not None]
    terms += [F.lower(F.col(c)) == F.lower(F.lit(v)) for c, v in spec.nocase.items() if v is not None]
    terms += [F.col(c) >= v for c, v in spec.at_least.items() if v is not None]
    terms += [F.col(c) <= v for c, v in spec.at_most.items() if v is not None]
    terms += [reduce(or_, [F.col(c).ilike(f"%{text}%") for c in columns]) for text, columns in spec.contains.items()]
    return reduce(and_, terms, F.lit(True))


def ordering(order: tuple, allowed: set[str], fallback: str) -> list[Column]:
    """Nulls last either way; a column that isn't allowed becomes the fallback."""
    columns = [(c if c in allowed else fallback, d) for c, d in order] or [(fallback, False)]
    return [F.col(c).desc_nulls_last() if d else F.col(c).asc_nulls_last() for c, d in columns]


def page(df: DataFrame, spec: Spec, fallback: str) -> DataFrame:
    return df.filter(predicate(spec)).orderBy(*ordering(spec.order, set(df.columns), fallback)).offset(spec.offset).limit(spec.limit)


def count(df: DataFrame, spec: Spec, size: int = 100) -> DataFrame:
    return df.filter(predicate(spec)).agg(F.count("*").alias("n")).withColumn("pages", F.ceil(F.col("n") / size))


def retain_top(df: DataFrame, place: str, most: int, dropped: Column) -> DataFrame:
    """Drops rows beyond a place or flagged; a predicate that is unknown keeps its row."""
    return df.filter(~F.coalesce((F.col(place) > most) | dropped, F.lit(False)))
