"""What the corpus operators share: written intermediate tables, ordered Arrow streams, and joins
that stay even when one key holds a large share of the rows."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys holding more than 1/HOT_SHARE of all rows are joined by broadcast; there are fewer than HOT_SHARE of them.
HOT_SHARE = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local session that has none gets a temporary folder of its own; on a cluster its absence is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    folder = f"file://{tempfile.mkdtemp(prefix='tallyloom-')}"
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back, which cuts its lineage. It belongs to its caller."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(df_or_path: DataFrame | str, spark: SparkSession) -> None:
    """Deletes a table of written() once nothing reads it any more."""
    paths = [df_or_path] if isinstance(df_or_path, str) else {f.rpartition("/")[0] for f in df_or_path.inputFiles()}
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Rows that are named to all tasks by broadcast; more of them meet the table in a shuffle.
MOST_NAMED = 50_000
PLACE = ["_file", "_at"]


def _is_scan(df: DataFrame) -> bool:
    """Whether df is one Parquet scan with projections and fixed filters only, so that file and row number name a row."""
    node, has_scan = df._jdf.queryExecution().analyzed(), False
    while not has_scan:
        kind = node.getClass().getSimpleName()
        if kind not in ("Project", "Filter", "SubqueryAlias", "LogicalRelation") or not node.deterministic():
            return False
        if kind == "LogicalRelation":
            return "parquet" in node.relation().toString().lower()
        node = node.children().head()
    return False


def placed(df: DataFrame, name: str) -> DataFrame:
    """df's columns as c0, c1, ... and _file, _at, which name each row whenever the result is read.

    A table of Parquet files is read where it is; anything else is written first.
    """
    if "_metadata" in df.columns or not _is_scan(df):
        df = written(df.toDF(*[f"c{i}" for i in range(len(df.columns))]), name)
    names = df.columns
    return df.toDF(*[f"c{i}" for i in range(len(names))]).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))


def named(rows: DataFrame, places: DataFrame, how: str, *more: str) -> DataFrame:
    """The rows of placed() that ``places`` names ("left_semi", or "inner" with its columns ``more``) or doesn't ("left_anti").

    places is a written table without repeated places.
    """
    side = places.select(*PLACE, *more)
    return rows.join(F.broadcast(side) if places.count() <= MOST_NAMED else side.hint("merge"), PLACE, how)


def back(rows: DataFrame, names: list[str]) -> DataFrame:
    """The columns of placed() under their own names again."""
    return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


#: Rows, and bytes where Spark knows that setting, that go to a Python worker at a time.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_ROWS and BATCH_BYTES, as rows here hold whole texts.

    Batches are held on both sides of the pipe and by two tasks at a time; the default of 10,000 rows is meant for
    rows of a few numbers. A session that has smaller ones keeps them.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, None)
        number = int(now) if now and now.lstrip("-").isdigit() else None
        if now is None or (number is not None and 0 < number <= most):
            continue
        spark.conf.set(key, str(most))


def slices(batches: Iterable[pa.RecordBatch], column: str, max_bytes: int, max_rows: int = 5000, keeps: str | None = None) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that the values of a string or binary column come to max_bytes or to one row.

    As a task begins, the worker lets go of what it holds for other names than ``keeps``; as it ends, memory that is
    free goes back to the system.
    """
    if _held and _held["name"][0] != keeps:
        let_go()
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        begin = size = 0
        for i, n in enumerate(lengths):
            if i > begin and (size + n > max_bytes or i - begin >= max_rows):
                yield batch.slice(begin, i - begin)
                begin, size = i, 0
            size += int(n)
        if batch.num_rows > begin:
            yield batch.slice(begin)
    give_back()


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """A string column's UTF-8, without decoding it."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def hot_hashes(keyed: DataFrame, keys: list[str], weight: str, total: int) -> list[int]:
    """The hashes of the keys that hold over total / HOT_SHARE rows by ``weight``: fewer than HOT_SHARE of them."""
    return [r[0] for r in keyed.filter(F.col(weight) * F.lit(HOT_SHARE) > F.lit(total)).select(F.xxhash64(*keys)).distinct().collect()]


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """Inner join of many rows with one row per key, where ``weight`` counts the left rows of each key.

    A key with over total / HOT_SHARE rows is hot. As the weights sum to total, there are fewer than HOT_SHARE hot
    keys, so that their rows can be broadcast whatever the input's size; all others meet in an ordinary shuffle. Both
    sides are parted by the hash of the key, so that a cold key of a hot one's hash goes with it.
    """
    hashes = hot_hashes(right, keys, weight, total)
    if not hashes:
        return left.join(right, keys, "inner")
    is_hot = F.xxhash64(*keys).isin(hashes)
    return left.filter(is_hot).join(F.broadcast(right.filter(is_hot)), keys, "inner").unionByName(left.filter(~is_hot).join(right.filter(~is_hot), keys, "inner"))


def with_least(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """edges (a, b) with the m of their a in least (a, m, n), n being its share of total edges; hubs are met by broadcast."""
    return spread_join(edges, least, ["a"], "n", total).select("a", "b", "m")


def components(edges: DataFrame, name: str, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b), root being the smallest node it is connected with.

    Alternates large-star and small-star steps; each step is written to the shared folder, so that a lost executor
    never costs more than one. A node of one smaller neighbour alone needs no join in the second. Nothing but counters
    reaches the driver. The table that the result reads stays.
    """
    spark = edges.sparkSession
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    seen = None
    for _ in range(most_rounds):
        up = now.select(F.col("b").alias("a"), F.col("a").alias("b"))
        least = written(now.unionByName(up).groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n")), name)
        total = 2 * now.count()
        large = written(with_least(up, least, total).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), name)
        own = written(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), name)
        several = with_least(large, own.filter("n > 1"), large.count()).select(F.explode(F.array("b", "a")).alias("a"), F.col("m").alias("b"))
        after = written(own.filter("n = 1").select("a", F.col("m").alias("b")).unionByName(several).filter("a <> b").distinct(), name)
        sums = after.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0))).first()
        for table in (now, least, large, own):
            remove(table, spark)
        now = after
        if sums == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = sums
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")


_held: dict = {}
def let_go() -> None:
    _held.clear()


def give_back() -> None:
    """Returns free memory of Arrow and of the C library to the system; workers live on after their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU library alone has it
    if trim is not None:
        trim(0)


def held_by_worker(name: str, key: object, make: Callable[[], object]) -> object:
    """What make() gives, kept by the Python worker for later tasks until another name or key is asked for.

    A worker serves all operators of a job one after another; with one place for all, their caches never add up.
    """
    if _held.get("name") != (name, key):
        let_go()
        _held.update(name=(name, key), value=make())
    return _held["value"]
