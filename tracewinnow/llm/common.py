"""What the corpus operators share: tables in the cluster's shared folder, and batches of bounded size."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text that an Arrow operator handles at once, in bytes.  A longer single text is a batch of its own.
BATCH_BYTES = 4 << 20
#: What Spark sends to a Python worker at once, in bytes.
ARROW_LIMITS = {"spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}
#: A query's shuffle files go when it ends.
CLEANUP = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Settings of the session that hold for a while."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.  Only a local session may do without; it gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = getattr(spark, "_winnow_shared", None) or tempfile.mkdtemp(prefix="winnow-")
        spark._winnow_shared = folder
    return folder.rstrip("/")


_WRITTEN: list[str] = []


def clean(spark: SparkSession) -> None:
    """Remove the tables that :func:`materialise` has written; results that still read them must have been written themselves."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(conf).delete(path, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back.

    Files there outlive executors, and later plans know their size.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/winnow-{name}-{uuid.uuid4().hex}"
    with settings(spark, CLEANUP):
        df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(docs: DataFrame) -> Column:
    """A row of ``docs`` in one column, whatever its columns are called."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def settled(docs: DataFrame, keys: dict[str, Column], fates: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns.

    ``keys`` name what a row's fate depends on; ``fates`` has them and ``kept``,
    and ``n``, the number of rows that share them; rows whose keys aren't in it
    stay.  Of ``n`` rows that are kept and share all keys the one whose JSON is
    smallest stays, and of rows that are equal in all columns one.
    """
    rows = docs.select(packed(docs).alias("row"), *[c.alias(f"k_{k}") for k, c in keys.items()])
    same = lambda fate: reduce(lambda a, b: a & b, [F.col(f"k_{k}").eqNullSafe(fate[k]) for k in keys])
    gone, again = fates.filter("NOT kept OR n > 1").select(*keys), fates.filter("kept AND n > 1").select(*keys)
    out = rows.join(gone.hint("merge"), same(gone), "left_anti").select("row")  # grows with the documents, so it's never broadcast
    if not again.isEmpty():
        one = rows.join(again, same(again), "left_semi").groupBy(*[f"k_{k}" for k in keys]).agg(F.min_by("row", F.to_json("row")).alias("row"))
        out = out.unionByName(one.select("row"))
    return out.select("row.*")


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow`` with batches of bounded size: the session's limit, 10,000 rows of any length, is joined by one in bytes."""
    conf = df.sparkSession.conf
    for key, value in ARROW_LIMITS.items():
        if conf.get(key, None) != value:
            conf.set(key, value)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(task, schema)


def give_back() -> None:
    """Return what a task has freed to the system: workers live on, and an executor's limit counts them all."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds about ``limit`` bytes in each, whole rows always."""
    for batch in batches:
        if not batch.num_rows:
            continue
        start, size = 0, 0
        for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
            if size and size + (n or 0) > limit:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n or 0
        yield batch.slice(start)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
