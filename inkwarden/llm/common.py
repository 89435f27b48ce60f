"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import inspect
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
MAX_BUCKETS = 100_000  # Spark's own bound


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; without that setting, a local session (tests) gets a folder of its own and any other is refused."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        top = spark.conf.get("spark.checkpoint.dir", None)
        if not top and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(top or tempfile.mkdtemp(prefix="ckpt-"))
    return sc._jsc.sc().getCheckpointDir().get()


def remove(spark: SparkSession, folder: str, now: bool = True) -> None:
    """Delete a folder of intermediate results, at once or when the driver ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(path, True) if now else fs.deleteOnExit(path)


def in_shards(docs: DataFrame, id_col: str, text_col: str, shard_bytes: int) -> tuple[DataFrame, str, int]:
    """doc_id, text (null: empty) and shard, about ``shard_bytes`` a shard, as a table in :func:`shared_folder`; its folder; all bytes.

    The table is bucketed by shard: passes over shards read it where it lies and
    shuffle only what they exchange. Rows that are the same in id and text are
    dealt over the shards too. Its folder goes when the driver ends, or by
    :func:`remove` before that.
    """
    spark = docs.sparkSession
    total = docs.select(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    buckets = min(MAX_BUCKETS, max(-(-shards // 8), min(shards, 2 * spark.sparkContext.defaultParallelism)))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), F.lit(shards)))
    name = f"shards_{uuid.uuid4().hex}"
    remove(spark, folder := f"{shared_folder(spark)}/{name}", now=False)
    with freeing_shuffles(spark):
        rows.repartition(buckets, "shard").write.bucketBy(buckets, "shard").option("path", folder).saveAsTable(name, format="parquet")
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay
    return table, folder, total


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def freeing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that are made within let go of their shuffle files when they have run."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` into :func:`shared_folder`; the shuffle files behind it go at once.

    The files are on storage that all executors share, so a lost executor
    costs nothing, and Spark's cleaner removes them with the last reference.
    """
    shared_folder(df.sparkSession)
    with freeing_shuffles(df.sparkSession):
        return df.select("*").checkpoint()


def _give_back() -> None:
    """Return freed memory to the system: Arrow's pool and the C library keep what a large batch needed, in every worker."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidily(f: Callable) -> Callable:
    """A function for Arrow batches that leaves no freed memory with its worker, which stays for other tasks."""

    def done(out: object) -> object:
        _give_back()
        return out

    def generator(batches):
        yield from f(batches)
        _give_back()

    # Spark looks at how many arguments a function has.
    forms = {1: lambda a: done(f(a)), 2: lambda a, b: done(f(a, b)), 3: lambda a, b, c: done(f(a, b, c))}
    return generator if inspect.isgeneratorfunction(f) else forms[len(inspect.signature(f).parameters)]


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def key_of(name: str) -> Column:
    """A non-null string for a nullable key: null and '' stay apart."""
    return F.when(F.col(name).isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col(name).cast("string")))


def n_words(col: Column) -> Column:
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to have at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def boxed(docs: DataFrame, *names: str) -> Column:
    """A struct of ``docs``' columns (all, or those named), so that no column of theirs clashes with an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in names or docs.columns]).alias("_row")


def unboxed(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[F.col(f"_row.`{c}`").alias(c) for c in names])
