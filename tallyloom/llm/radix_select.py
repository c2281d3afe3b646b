"""The k greatest rows of every group by radix selection: histograms instead of sorted groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.shared import remove, spread_join, written

#: Hex digits that a round looks at: a histogram has up to 65,536 bins.
AT_ONCE = 4
ROUNDS_OF_VALUE = 16 // AT_ONCE
#: A group whose threshold bin holds no more rows is refined no further; sorting these finds the rest.
FEW = 4096


def _digits(value: Column, item: Column, k: int) -> Column:
    """The k-th digits of a key whose ascending order is value descending, then item's UTF-8 bytes ascending."""
    if k < ROUNDS_OF_VALUE:
        ordered = F.bitwise_not(value.bitwiseXOR(F.lit(-(1 << 63))))
        return F.substring(F.lpad(F.hex(ordered), 16, "0"), AT_ONCE * k + 1, AT_ONCE)
    width = AT_ONCE // 2
    return F.hex(F.substring(item.cast("binary"), width * (k - ROUNDS_OF_VALUE) + 1, width))


def greatest(df: DataFrame, group: list[str], value: str, item: str, k: int, few: int = FEW) -> DataFrame:
    """The columns of df and rank (from 1) for the k rows of each group with the greatest value (long), smaller items
    first among equal values. Items of a group are distinct; neither is null.

    Each round takes the next digits of the rows that are still open, counts them by group and digits (combined before
    the shuffle), and finds the bin that the k-th row falls in: rows before it are in, rows behind it are out, rows in
    it stay open for the next round: 64 bits of the value first, then the item's bytes. Groups with a great share of
    the rows meet their threshold by broadcast. The table that the result reads stays.
    """
    spark = df.sparkSession
    most, longest = df.agg(F.max(value), F.max(F.octet_length(item))).first()
    if most is None:
        return df.withColumn("rank", F.lit(None).cast("int"))
    least = df.agg(F.min(value)).first()[0]
    shared_bits = 64 - most.bit_length() if least >= 0 else 0
    first = min(shared_bits // (4 * AT_ONCE), ROUNDS_OF_VALUE - 1)
    last = ROUNDS_OF_VALUE + -(-longest // (AT_ONCE // 2)) + 1
    names, open_rows, found = df.columns, df.withColumn("_k", F.lit(k).cast("long")), []
    for step in range(first, last + 1):
        rows = open_rows.withColumn("_d", _digits(F.col(value), F.col(item), step))
        bins = rows.groupBy(*group, "_d").agg(F.count("*").alias("_n"), F.max("_k").alias("_k"))
        own = Window.partitionBy(*group)
        bins = bins.withColumn("_upto", F.sum("_n").over(own.orderBy("_d").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_n").over(own))
        # The threshold bin of each group, or its last bin where all rows are in.
        cut = bins.filter((F.col("_upto") >= F.col("_k")) & (F.col("_upto") - F.col("_n") < F.col("_k")) | (F.col("_upto") == F.col("_all")) & (F.col("_all") < F.col("_k")))
        cut = written(cut.select(*group, F.col("_d").alias("_at"), F.col("_n").alias("_open"), (F.col("_k") - F.col("_upto") + F.col("_n")).alias("_left"), F.col("_all").alias("_rows"), (F.col("_all") <= F.col("_k")).alias("_whole")), "radix-cut")
        total = cut.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]
        met = spread_join(rows.drop("_k"), cut, group, "_rows", total).filter("_d <= _at")
        unsure = (F.col("_d") == F.col("_at")) & ~F.col("_whole") & (F.col("_open") > few)
        met = written(met.select(*names, F.col("_left").alias("_k"), unsure.alias("_unsure")), "radix-rows")
        remove(cut, spark)
        found.append(met)
        open_rows = met.filter("_unsure").drop("_unsure")
        if step == last or open_rows.isEmpty():
            break
    # After the last digits of the longest item, what is still open is one row per group.
    pool = reduce(DataFrame.unionByName, [f.filter("NOT _unsure") for f in found[:-1]] + [found[-1]])
    best = Window.partitionBy(*group).orderBy(F.col(value).desc(), item)
    return pool.select(*names, F.row_number().over(best).cast("int").alias("rank")).filter(F.col("rank") <= k)
