"""The search of the results table: sixteen optional predicates, one builder for page and count."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.quality import flag
from tallyloom.operators.query import ordering

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SORTABLE = {"year", "name", "school", "discipline", "place", "mark_num", "gender"}
FLAGS = ("is_dq", "is_dnf", "is_dns", "is_wind_aided", "is_international", "is_relay")


def like(column: Column, text: str) -> Column:
    """Whether text stands in the column, A-Z whatever the case; ``%`` and ``_`` of the text stay wildcards."""
    return F.translate(column, UPPER, LOWER).like("%" + text.translate(str.maketrans(UPPER, LOWER)).replace("\\", "\\\\") + "%")


@dataclass(frozen=True)
class Search:
    """What isn't given filters nothing; empty texts count as not given. Flags that are null count as unset."""

    query: str | None = None
    year: int | None = None
    year_min: int | None = None
    year_max: int | None = None
    name: str | None = None
    school: str | None = None
    discipline: str | None = None
    gender: str | None = None
    place: int | None = None
    place_max: int | None = None
    is_dq: bool | None = None
    is_dnf: bool | None = None
    is_dns: bool | None = None
    is_wind_aided: bool | None = None
    is_international: bool | None = None
    is_relay: bool | None = None
    environment: str | None = None
    limit: int = 100
    offset: int = 0
    order_by: str = "year"
    descending: bool = False

    def predicate(self) -> Column:
        terms = [F.lit(True)]
        if self.query:
            terms.append(like(F.col("name"), self.query) | like(F.col("school"), self.query))
        terms += [like(F.col(c), getattr(self, c)) for c in ("name", "school", "discipline") if getattr(self, c)]
        terms += [F.col(c) == getattr(self, c).lower() for c in ("gender", "environment") if getattr(self, c)]
        terms += [F.col(c) == getattr(self, c) for c in ("year", "place") if getattr(self, c) is not None]
        bounds = (("year", self.year_min, ">="), ("year", self.year_max, "<="), ("place", self.place_max, "<="))
        terms += [F.col(c) >= v if sign == ">=" else F.col(c) <= v for c, v, sign in bounds if v is not None]
        terms += [flag(F.col(c)) == int(getattr(self, c)) for c in FLAGS if getattr(self, c) is not None]
        return reduce(and_, terms)


def search(df: DataFrame, wanted: Search, unique: str) -> DataFrame:
    """A page of the rows that are wanted; a sort column that isn't allowed becomes the year, ``unique`` breaks ties."""
    order = ((wanted.order_by if wanted.order_by in SORTABLE else "year", wanted.descending), (unique, False))
    return df.filter(wanted.predicate()).orderBy(*ordering(order, {*SORTABLE, unique}, "year")).offset(wanted.offset).limit(wanted.limit)


def count(df: DataFrame, wanted: Search) -> DataFrame:
    return df.filter(wanted.predicate()).agg(F.count("*").alias("n"))


def one_line(columns: dict[str, Column]) -> Column:
    """A record as ``name: value`` parts; nulls and unset flags are left out."""
    return F.concat_ws(" | ", *[F.when(c.isNotNull(), F.concat(F.lit(f"{n}: "), c.cast("string"))) for n, c in columns.items()])
