"""Exact dedup by a tree-merge of digest runs, in DataFrame operations only.

Every input partition is a run of (digest, smallest identifier, copies). In each round, FAN_IN neighbouring runs are
exchanged into one (three binomial rounds at a time), sorted by digest and identifier, and merged: of equal digests
the smallest identifier stays and the copies add up. Runs stay spread over all tasks by digest; only digests travel,
never texts. Two digests are taken as equal only if SHA-256, an independent 64-bit hash and the length all agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.shared import PLACE, back, named, placed, remove, spread_join, written

FAN_IN = 8
KEY = ["sha", "check", "n_bytes"]
#: White space that one space replaces.
SPACES = r"[\x20\x09-\x0D]+"


def canonical(text: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACES, " ")


def merge_round(runs: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """Merges each fan_in neighbouring runs into one; at most fan_in rows meet per digest and run."""
    same = Window.partitionBy("run", *KEY)
    return (
        runs.withColumn("run", F.floor(F.col("run") / fan_in))
        .withColumn("place", F.row_number().over(same.orderBy("best")))
        .withColumn("copies", F.sum("copies").over(same))
        .filter("place = 1")
        .drop("place")
    )


def decide(table: DataFrame) -> DataFrame:
    """(sha, check, n_bytes, keep_id, keep_row, group_size) of each distinct text of a written table of digests()."""
    last = table.agg(F.coalesce(F.max("run"), F.lit(0))).first()[0]
    runs = table.groupBy("run", *KEY).agg(F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), "row")).alias("best"), F.count("*").alias("copies"))
    n = last + 1
    while True:
        runs, n = merge_round(runs), -(-n // FAN_IN)
        if n == 1:
            break
    return written(runs.select(*KEY, F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row"), F.col("copies").alias("group_size")), "roots")


def digests(rows: DataFrame, identifier: str, text: str, *more: str) -> DataFrame:
    """A written table of row (unique), _id, sha, check, n_bytes and run of every row, and the columns ``more``."""
    table = rows.select(F.col(identifier).alias("_id"), canonical(text).alias("_canonical"), *more).select(
        "_id", F.unhex(F.sha2(F.col("_canonical").cast("binary"), 256)).alias("sha"), F.xxhash64("_canonical").alias("check"), F.octet_length("_canonical").alias("n_bytes"),
        F.spark_partition_id().cast("long").alias("run"), F.monotonically_increasing_id().alias("row"), *more)
    return written(table, "digests")


def exact_dedup(df: DataFrame, identifier: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of df.

    A null text counts as empty. Rows are equal if their texts are after SPACES became one space; the row with the
    smallest identifier stays, nulls last. Of rows equal in both, one stays: the first as they were read. Empty
    tables give empty results; other columns, whatever their names, are not read.
    """
    table = digests(df.select(F.col(identifier).alias("c0"), F.col(text).alias("c1")), "c0", "c1")
    out = spread_join(table.select("row", "_id", *KEY), decide(table), KEY, "group_size", table.count())
    return out.select(F.col("_id").alias("doc_id"), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def without_copies(df: DataFrame, identifier: str = "doc_id", text: str = "text") -> DataFrame:
    """df without the rows that exact_dedup() drops, its columns unchanged, whatever they are called.

    Decisions are made on digests; then the dropped rows' places in their files leave them out of a second scan.
    """
    spark, names = df.sparkSession, df.columns
    rows = placed(df, "documents")
    table = digests(rows, f"c{names.index(identifier)}", f"c{names.index(text)}", *PLACE)
    roots = decide(table)
    several = roots.filter("group_size > 1")
    members = spread_join(table.select("row", *PLACE, *KEY), several.select(*KEY, "keep_row", "group_size"), KEY, "group_size", table.count())
    dropped = written(members.filter("row <> keep_row").select(*PLACE), "dropped")
    remove(table, spark)
    remove(roots, spark)
    return back(named(rows, dropped, "left_anti"), names)
