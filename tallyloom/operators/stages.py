"""Tables that cut a plan in two, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def kept(df: DataFrame) -> DataFrame:
    """df, written to the checkpoint folder and read again. Only a local session may do without such a folder."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
        folder = f"file://{tempfile.mkdtemp(prefix='tallyloom-')}"
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder.rstrip('/')}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *key: str) -> DataFrame:
    """df dealt out by a key over four tasks a core, for work whose cost lies in the row and not in its bytes.

    A table of few bytes comes in as few tasks as its files have row groups; those would hold all of the work.
    """
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *key)


def removed(df: DataFrame) -> None:
    """Deletes a table of kept() that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
