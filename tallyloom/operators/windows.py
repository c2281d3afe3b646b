"""Windows over ordered rows: gaps, clusters, islands, carried values, first rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.stages import kept


def rank_gaps(df: DataFrame, group: list[str], place: str) -> DataFrame:
    """The first place of each group of two rows or more that doesn't follow from ties and order: expected and got."""
    w = Window.partitionBy(*group)
    ranked = df.filter(F.col(place).isNotNull()).select(*group, place, F.rank().over(w.orderBy(place)).alias("expected"), F.count("*").over(w).alias("n"))
    wrong = ranked.filter((F.col(place) != F.col("expected")) & (F.col("n") > 1))
    return wrong.groupBy(*group).agg(F.min(F.struct("expected", F.col(place).alias("got"))).alias("x")).select(*group, F.col("x.expected").cast("int").alias("expected"), F.col("x.got").cast("int").alias("got"))


def out_of_order(df: DataFrame, group: list[str], order: list[str], mark: str, ascending: bool = True) -> DataFrame:
    """Rows whose mark is on the wrong side of the one before them."""
    before = df.withColumn("previous", F.lag(mark).over(Window.partitionBy(*group).orderBy(*order)))
    return before.filter(F.col(mark) < F.col("previous") if ascending else F.col(mark) > F.col("previous"))


def gap_clusters(df: DataFrame, group: list[str], value: str, gap: int) -> DataFrame:
    """Stretches of distinct values without a gap over ``gap``: cluster (from 1), first, last and n."""
    w = Window.partitionBy(*group).orderBy(value)
    new = (F.col(value) - F.lag(value).over(w) > gap).cast("int")
    marked = df.select(*group, value).distinct().withColumn("new", F.coalesce(new, F.lit(1))).withColumn("cluster", F.sum("new").over(w))
    return marked.groupBy(*group, "cluster").agg(F.min(value).alias("first"), F.max(value).alias("last"), F.count("*").alias("n"))


def islands(df: DataFrame, value: str, group: list[str] = ()) -> DataFrame:
    """Runs of consecutive whole numbers: first, last. Without a group, rows are numbered by numbered(), not in one task."""
    rows = df.select(*group, value).distinct()
    if group:
        keyed = rows.withColumn("island", F.col(value) - F.row_number().over(Window.partitionBy(*group).orderBy(value)))
    else:
        keyed = numbered(rows, [value], name="island").withColumn("island", F.col(value) - F.col("island"))
    return keyed.groupBy(*group, "island").agg(F.min(value).alias("first"), F.max(value).alias("last")).drop("island")


def carried(df: DataFrame, group: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The last value that isn't null, up to and with each row."""
    return df.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def first_wins(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_place = 1").drop("_place")


def numbered(df: DataFrame, order: list[str], base: int = 0, name: str = "row_id") -> DataFrame:
    """Row numbers from base + 1 over a total order (nulls first), without bringing all rows into one task.

    Rows are dealt out by range and sorted; each partition's numbers are shifted by the rows before it. Only a count a
    partition is summed up in one place. The dealt rows are written first, as another run could draw other ranges.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    dealt = kept(dealt.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return dealt.join(F.broadcast(sizes), "_part").withColumn(name, F.col("_at") + F.col("_before") + F.lit(base + 1)).select(*df.columns, name)


def sections(df: DataFrame, group: list[str], order: list[str], header: Column, name: str = "section") -> DataFrame:
    """The number of headers up to and with each row of its group: 0 before the first."""
    return df.withColumn(name, F.count(F.when(header, F.lit(1))).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def filled(df: DataFrame, group: list[str], order: list[str], values: dict[str, Column]) -> DataFrame:
    """The last value that isn't null of each expression, up to and with each row of its group."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(v, ignorenulls=True).over(w) for c, v in values.items()})


def padded(df: DataFrame, slots: Column, name: str) -> DataFrame:
    """A row for each of the slots 1, 2, ... of a row; where ``slots`` is 0, the row once, with a null slot."""
    return df.withColumn(name, F.explode_outer(F.when(slots > 0, F.sequence(F.lit(1), slots))))


def with_next_row(df: DataFrame, group: list[str], order: list[str], takes: Column, value: Column, name: str) -> DataFrame:
    """Rows that ``takes`` picks get ``value`` of the row behind them if that isn't null, and that row goes.

    A row that is itself taken takes none: of rows that follow one another, the first takes, as in a scan.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    ahead = df.withColumns({"_takes": F.coalesce(takes, F.lit(False)), "_value": value}).withColumn("_next", F.lead("_value").over(w))
    ahead = ahead.withColumn("_can", F.col("_takes") & F.col("_next").isNotNull())
    # In a run of rows that could take, every second one is taken itself.
    ahead = ahead.withColumn("_run", F.sum(F.when(F.col("_can"), F.lit(0)).otherwise(F.lit(1))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.row_number().over(Window.partitionBy(*group, "_run", "_can").orderBy(*order))
    ahead = ahead.withColumn("_does", F.col("_can") & (place % 2 == 1)).withColumn("_gone", F.coalesce(F.lag("_does").over(w), F.lit(False)))
    return ahead.filter("NOT _gone").withColumn(name, F.when(F.col("_does"), F.col("_next"))).drop("_takes", "_value", "_next", "_can", "_run", "_does", "_gone")
