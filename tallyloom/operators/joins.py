"""Lookups, interval lookups, orphans and team members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup(df: DataFrame, dimension: DataFrame, key: list[str], unique: bool = False) -> DataFrame:
    """Left join to a dimension; if its key repeats, the least row of it is taken, so that no row of df is multiplied;
    with ``unique``, a repeated key fails the job instead."""
    rest = [c for c in dimension.columns if c not in key]
    one = dimension.groupBy(*key).agg(F.count("*").alias("_n"), F.min(F.struct(*rest)).alias("_one")) if rest else dimension.distinct()
    if unique and rest:
        failed = F.raise_error(F.concat(F.lit("a key twice: "), F.concat_ws(", ", *[F.col(c).cast("string") for c in key])))
        one = one.withColumn(key[0], F.when(F.col("_n") > 1, failed.cast(dimension.schema[key[0]].dataType)).otherwise(F.col(key[0])))
    return df.join(one.select(*key, *[F.col("_one")[c].alias(c) for c in rest]), key, "left")


#: Keys that hold more than 1/HUB_SHARE of the rows of a join meet their one row by broadcast; there are fewer than that.
HUB_SHARE = 1000


def hub_join(rows: DataFrame, one: DataFrame, key: str, weight: str) -> DataFrame:
    """Inner join of rows with one row per key, ``weight`` being how many rows of the key there are.

    Keys of a great share go to all tasks, so that their rows stay where they are; all others meet in a shuffle.
    """
    total = one.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    hubs = [r[0] for r in one.filter(F.col(weight) * HUB_SHARE > total).select(F.xxhash64(key)).distinct().collect()] if total > HUB_SHARE else []
    if not hubs:
        return rows.join(one, key)
    is_hub = F.xxhash64(key).isin(hubs)
    return rows.filter(is_hub).join(F.broadcast(one.filter(is_hub)), key).unionByName(rows.filter(~is_hub).join(one.filter(~is_hub), key))


def orphans(df: DataFrame, other: DataFrame, key: list[str]) -> DataFrame:
    return df.join(other, key, "left_anti")


def interval_lookup(df: DataFrame, ranges: DataFrame, value: str, key: list[str], label: str, first: int, last: int) -> DataFrame:
    """The label of the first range (by ``ordinal``) of the row's key that holds the row's value; null if none does.

    Ranges (key.., start, end or null, ordinal, label) of whole numbers are opened up into one row per value within
    first..last and reduced to the first of each, which makes the lookup an equality join that shuffles nothing but df.
    """
    open_end = F.least(F.coalesce(F.col("end"), F.lit(last)), F.lit(last))
    start = F.greatest(F.col("start"), F.lit(first))
    each = ranges.filter(start <= open_end).select(*key, F.explode(F.sequence(start, open_end)).alias(value), "ordinal", label)
    chosen = each.groupBy(*key, value).agg(F.min_by(label, "ordinal").alias(label))
    return df.join(chosen, [*key, value], "left")


def teams(df: DataFrame, key: list[str], member: list[str]) -> DataFrame:
    """Members of each team in order as a string, and their number."""
    each = F.struct(*member)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(each)), lambda x: F.concat_ws(":", *[x[m].cast("string") for m in member])), ",")
    return df.groupBy(*key).agg(F.count("*").alias("n"), text.alias("members"))


def null_safe_match(a: DataFrame, b: DataFrame, equal: list[str], same: list[str]) -> DataFrame:
    """Inner join in which nulls of the columns ``same`` match each other."""
    b = b.select(*[F.col(c).alias(f"_{c}") if c in equal + same else F.col(c) for c in b.columns])
    on: Column = F.lit(True)
    for c in equal:
        on = on & (F.col(c) == F.col(f"_{c}"))
    for c in same:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return a.join(b, on).drop(*[f"_{c}" for c in equal + same])


def inherited(rows: DataFrame, listing: DataFrame, key: list[str], columns: list[str], blank: list[str]) -> DataFrame:
    """rows with ``columns`` of the listing's row of their key; without one, ``blank`` become null and the rest stays.

    The listing has a row for each key at most. Values that it holds count also where they are null. A null in the key
    meets nothing.
    """
    other = listing.select(*key, F.lit(True).alias("_met"), *[F.col(c).alias(f"_{c}") for c in columns])
    met = rows.join(other, key, "left")
    own = {c: F.when(F.col("_met"), F.col(f"_{c}")) if c in blank else F.when(F.col("_met"), F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}
    return met.withColumns(own).select(*rows.columns)


def zipped(left: DataFrame, other: DataFrame, key: list[str], items: str, values: str, item: str, value: str, slots: int) -> DataFrame:
    """A row for each item of left's array with the value at its place in other's, of unequal length and outer on both.

    Keys without items (or without any row in other) have ``slots`` rows of a null item; values beyond the items go.
    ``position`` counts from 1.
    """
    both = left.join(other, key, "left")
    listed = F.when(F.size(items) > 0, F.col(items)).otherwise(F.array_repeat(F.lit(None).cast(left.schema[items].dataType.elementType), slots))
    rest = [c for c in both.columns if c not in (items, values)]
    rows = both.withColumn("_items", listed).select(*rest, values, F.posexplode("_items").alias("_at", item))
    return rows.select(*rest, (F.col("_at") + 1).alias("position"), item, F.get(values, F.col("_at")).alias(value))
