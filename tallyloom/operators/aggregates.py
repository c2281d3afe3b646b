"""Rollups of profiles and searches: spans, bests, placings, modes, missing slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def joined_set(column: str, kind: str = "string") -> Column:
    """The distinct values in order, joined by commas; null if there is none."""
    return F.nullif(F.array_join(F.transform(F.array_sort(F.collect_set(column)), lambda x: x.cast("string")), ","), F.lit(""))


def joined_list(column: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(column)), lambda x: x.cast("string")), ",")


def spans(df: DataFrame, key: list[str], year: Column) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n"), F.min(year).alias("first_year"), F.max(year).alias("last_year"))


def conflicts(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """Keys with more than one distinct value, and these."""
    return df.groupBy(*key).agg(F.count_distinct(value).alias("n_values"), joined_set(value).alias("value_list")).filter("n_values > 1")


def best(df: DataFrame, key: list[str], mark: str, ties: list[str], ascending: Column) -> DataFrame:
    """The best row of each key by a direction of its own; earlier in ``ties`` wins.

    The signed mark makes it one aggregation that combines before the shuffle, whatever the size of a key.
    """
    signed = F.when(ascending, F.col(mark)).otherwise(-F.col(mark))
    rest = [c for c in df.columns if c not in key]
    return df.filter(F.col(mark).isNotNull()).groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(signed.alias("s"), *ties)).alias("b")).select(*key, "b.*")


def by_first_mark(df: DataFrame, key: list[str], mark: str, order: list[str], below: float = 1000) -> DataFrame:
    """df with ``ascending``: whether the first mark of its key is below a threshold, as the profile view decides it."""
    first = df.groupBy(*key).agg((F.min_by(mark, F.struct(*order)) < below).alias("ascending"))
    return df.join(first, key)


def placings(df: DataFrame, key: list[str], place: str, top: int = 8) -> DataFrame:
    p = F.col(place)
    return df.filter(p.isNotNull()).groupBy(*key).agg(F.count_if(p == 1).alias("gold"), F.count_if(p == 2).alias("silver"), F.count_if(p == 3).alias("bronze"), F.count_if(p <= top).alias("top"), F.count("*").alias("total"))


def notable(df: DataFrame, key: str, limit: int = 20) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(limit)


def modes(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """The most frequent value of each key, the smallest of several."""
    counts = df.groupBy(*key, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*key).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias("x")).select(*key, F.col("x.v").alias("mode"), (-F.col("x.m")).alias("n"))


def missing_slots(df: DataFrame, key: list[str], count: Column, most: int = 8) -> DataFrame:
    """A row for each slot from count + 1 to most."""
    counted = df.groupBy(*key).agg(count.alias("n")).filter(F.col("n") < most)
    return counted.select(*key, F.explode(F.sequence(F.col("n").cast("int") + 1, F.lit(most))).alias("slot"))


def exact_groups(df: DataFrame, key: list[str], n: int) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") == n)


def top_rows(df: DataFrame, key: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("rank") <= k)


def entity_search(df: DataFrame, identifier: str, name: str, school: str, gender: str, year: str, text: str, limit: int = 50) -> DataFrame:
    """The entities some row of which has a name with the text in it: all their rows, by entity and gender, by name.

    Matching identifiers are found first, so that only their rows are grouped.
    """
    hits = df.filter(F.col(name).ilike(f"%{text}%")).select(identifier).distinct()
    grouped = df.join(hits, identifier, "left_semi").groupBy(identifier, gender).agg(
        F.min(name).alias("name"), F.array_sort(F.array_compact(F.collect_set(school))).alias("schools"), F.count("*").alias("performances"), F.min(year).alias("first_year"), F.max(year).alias("last_year")
    )
    return grouped.orderBy("name", identifier, gender).limit(limit)
