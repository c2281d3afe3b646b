"""Data-quality rules as one long table (rule, key, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.windows import islands

#: Name rules: what makes a name suspicious.
NAME_RULES = {
    "empty": lambda c: c.isNull() | (F.trim(c) == ""),
    "single_word": lambda c: ~c.contains(" "),
    "long": lambda c: F.length(c) > 50,
    "parentheses": lambda c: c.contains("(") | c.contains(")"),
    "odd_characters": lambda c: c.rlike("[0-9:?*]|—|--"),
}


def name_issues(df: DataFrame, key: str, name: str) -> DataFrame:
    """One pass over the names: a row for each rule that a name breaks."""
    c = F.col(name)
    broken = F.array_compact(F.array(*[F.when(rule(c), F.lit(rule_name)) for rule_name, rule in NAME_RULES.items()]))
    return df.select(F.explode(broken).alias("rule"), F.col(key).cast("string").alias("key"), c.alias("detail"))


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def uncovered(df: DataFrame, coverage: DataFrame, key: list[str]) -> DataFrame:
    """Distinct keys that the reference data lacks."""
    return df.select(*key).distinct().join(coverage, key, "left_anti")


def coverage(df: DataFrame, ranges: DataFrame, key: list[str], year: str, exclude: tuple[int, ...] = (), before: int = 9999) -> DataFrame:
    """Reference ranges (key.., start, end or null) against the years of df, in both directions: (side, key.., years).

    ``fail`` rows are keys and years of df that no range holds, one each; ``warn`` rows are what ranges promise and df
    lacks, ``exclude`` and years from ``before`` on left out, consecutive years as one ``1931-1935``. A null in a key is a
    value like any other.
    """
    last = F.least(F.coalesce(F.col("end"), F.lit(before)), F.lit(before))
    promised = ranges.filter(F.col("start") <= last).select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in key], F.explode(F.sequence("start", last)).alias(year)).distinct()
    have = df.filter(F.col(year).isNotNull()).select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in key], F.col(year).cast("int").alias(year)).distinct()
    fail = have.join(promised, [*key, year], "left_anti").select(F.lit("fail").alias("side"), *key, F.col(year).cast("string").alias("years"))
    lacking = promised.join(have, [*key, year], "left_anti").filter((F.col(year) < before) & ~F.col(year).isin(*exclude) if exclude else F.col(year) < before)
    runs = islands(lacking, year, key)
    span = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat_ws("-", F.col("first").cast("string"), F.col("last").cast("string")))
    return fail.unionByName(runs.select(F.lit("warn").alias("side"), *key, span.alias("years")))


def mark_order(df: DataFrame, group: list[str], place: str, mark: str, identifier: str, is_field: Column, sentinel: int = 999) -> DataFrame:
    """Rows whose mark is worse ordered than that of the row before, by place: rising for races, falling for field events.

    Rows without mark or place, of the sentinel place, flagged ones and legs of relays take no part; the identifier
    orders equal places.
    """
    flagged = F.lit(False)
    for c in ("is_dq", "is_dnf", "is_dns"):
        flagged = flagged | (F.coalesce(F.col(c).cast("int"), F.lit(0)) != 0)
    leg = F.coalesce(F.col("is_relay").cast("int"), F.lit(0)).eqNullSafe(F.lit(1)) & F.col("leg_idx").isNotNull()
    rows = df.filter(F.col(mark).isNotNull() & F.col(place).isNotNull() & (F.col(place) != sentinel) & ~flagged & ~leg)
    own = Window.partitionBy(*group).orderBy(place, identifier)
    rows = rows.withColumns({"previous_place": F.lag(place).over(own), "previous_mark": F.lag(mark).over(own), "kind": F.when(is_field, "field").otherwise("running")})
    wrong = F.when(F.col("kind") == "field", F.col("previous_mark") < F.col(mark)).otherwise(F.col("previous_mark") > F.col(mark))
    return rows.filter(wrong).select(*group, "previous_place", "previous_mark", place, mark, "kind")


def report(issues: list[tuple[str, DataFrame]]) -> DataFrame:
    """(rule, n, failed) of each rule and of all together, ``total``."""
    each = summary(issues)
    total = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("total").alias("rule"), "n")
    return each.unionByName(total).withColumn("failed", F.col("n") > 0)


def summary(issues: list[tuple[str, DataFrame]]) -> DataFrame:
    return reduce(DataFrame.unionByName, [d.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n") for rule, d in issues])


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")
