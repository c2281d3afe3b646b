"""Sinks: the results table, JSON documents, and appends that resume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.operators.stages import kept, removed


def with_flags_as_integers(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f.name).cast("int").alias(f.name) if isinstance(f.dataType, T.BooleanType) else F.col(f.name) for f in df.schema])


def append_sources(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def write_results(df: DataFrame, path: str, partition_by: list[str], sort_by: list[str]) -> None:
    """Parquet by partition columns, sorted in its files so that row groups can be skipped."""
    with_flags_as_integers(df).repartition(*partition_by).sortWithinPartitions(*partition_by, *sort_by).write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def as_json(*columns: str) -> Column:
    return F.to_json(F.struct(*columns))


def append_new(df: DataFrame, path: str, key: list[str]) -> int:
    """Appends the rows whose key the table at path doesn't have, the least row of a key that repeats; returns how many.

    The first run makes the table.
    """
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    rest = [c for c in df.columns if c not in key]
    new = df.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_one")).select(*key, *[F.col("_one")[c].alias(c) for c in rest]).select(*df.columns) if rest else df.distinct()
    if there:
        new = new.join(spark.read.parquet(path).select(*key), key, "left_anti")
    new = kept(new)
    n = new.count()
    new.write.mode("append").parquet(path)
    removed(new)
    return n
