"""Shared helpers: the cluster's shared folder, checkpoints and running offsets."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset and all runs on this machine (tests), a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = _own.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="cairn-"))
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


BATCH_ROWS = 1024
"""Rows of a batch handed to Python in the jobs below: texts of some MB, instead of ten times as much."""


@contextlib.contextmanager
def small_batches(spark: SparkSession, limit: int = BATCH_ROWS, size: int | None = None) -> Iterator[None]:
    """Jobs run inside hand over at most ``limit`` rows at a time, of about ``size`` bytes if given, and their shuffle files go when they end."""
    rows, files, most = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(rows), spark.conf.get(files, "false"), spark.conf.get(most)
    spark.conf.set(rows, str(min(limit, int(before[0])) if int(before[0]) > 0 else limit))
    spark.conf.set(files, "true")
    if size is not None:
        spark.conf.set(most, str(size))
    try:
        yield
    finally:
        spark.conf.set(rows, before[0])
        spark.conf.set(files, before[1])
        spark.conf.set(most, before[2])


@contextlib.contextmanager
def long_rows(spark: SparkSession, rows: int, group: int) -> Iterator[None]:
    """Jobs run inside decode ``rows`` rows of a Parquet file at a time, and write row groups of about ``group`` bytes.

    By default up to 4,096 rows are decoded at once, and up to 128 MB encoded held by a writer, in each task: of rows of 0.1 MB that is most of a heap."""
    settings = {"spark.sql.parquet.columnarReaderBatchSize": str(rows), "parquet.block.size": str(group)}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


_kept: dict = {}


def worker_keeps(key: tuple | None, make: Callable | None = None):
    """What a worker keeps between tasks, one thing at a time: the same thing for the same key, else a new one.

    Without a key nothing is kept: an operator that needs no store drops that of the one before.
    """
    if key not in _kept:
        _kept.clear()
        tidy()
        if key is not None:
            _kept[key] = make()
    return _kept.get(key)


def tidy() -> None:
    """Gives memory that a worker has freed back to the system; called where a task ends."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy_driver(spark: SparkSession) -> bool:
    """Has the driver's JVM give memory that it has freed back to the system, as ``tidy`` does in a worker; whether it could.

    Each exchange and broadcast of a plan runs in a thread of its own there, and what these threads free stays with the
    process: over the jobs of a long query some hundred MB. A JVM without that command (before 17.0.9) is left as it is."""
    jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    with contextlib.suppress(Py4JError):
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        kinds, given = array(jvm.java.lang.Class, 4), array(jvm.java.lang.Object, 4)
        for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = jvm.java.lang.Class.forName(kind)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(server, given)
        return True
    return False


def stored_at(df: DataFrame, name: str, rows: int = BATCH_ROWS, size: int | None = None) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder and read again, and where: lineage is cut, lost executors cost nothing.

    ``rows``: how many at most are handed to Python at a time, fewer where they are long; ``size``: of how many bytes."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with small_batches(spark, rows, size):
        df.write.parquet(path)
    tidy_driver(spark)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str) -> DataFrame:
    return stored_at(df, name)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Deletes what ``stored_at`` wrote, once nothing reads it any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def free_name(columns: list[str], name: str) -> str:
    """``name``, with as many underscores after it as make it unlike all the columns, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_mod(column: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus
