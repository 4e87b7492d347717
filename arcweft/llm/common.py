"""What several operators share: tables, lineage cuts, a distributed row number and the hash that splits labelled rows."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words of the contracts: runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bounds of an Arrow batch where rows hold whole texts: rows, and bytes (a longer text is a batch of its own).
TEXTS_PER_BATCH, BYTES_PER_BATCH = 1000, 16 << 20


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with whole texts. Lowers the session's bounds of an Arrow batch, see `small_batches`."""
    small_batches(spark)
    return table(spark, sf_dir, name)


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's rows and bytes per Arrow batch to the bounds above, where they are larger, for what it runs from now on.

    The setting is read when a query runs, after the operator has returned, so that it cannot be put back here.
    """
    for key, most in (("maxRecordsPerBatch", TEXTS_PER_BATCH), ("maxBytesPerBatch", BYTES_PER_BATCH)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{key}", None) or "0"
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares for checkpoints and tables between steps: spark.checkpoint.dir.

    Where it is unset, a folder of our own serves a session whose tasks run in the driver's process; on a cluster that is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or f"file://{tempfile.gettempdir()}/checkpoints/arcweft")
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def tidy(spark: SparkSession) -> None:
    """Lets go of what finished steps have left: Spark removes shuffle files and broadcasts, and the driver's JVM unloads
    code and returns memory, only once their handles have been collected, which a driver with memory to spare puts off."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    _trim(spark)


def _trim(spark: SparkSession) -> None:
    """Returns to the system what the driver's JVM has freed outside its heap (mostly its compilers' memory) and the C library
    keeps, some hundred MB after many queries. Only HotSpot on Linux can, others go on as they are."""
    jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    with contextlib.suppress(Py4JError):
        find, types, values = jvm.java.lang.Class.forName, array(jvm.java.lang.Class, 4), array(jvm.java.lang.Object, 4)
        for k, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            types[k] = find(name)
        values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        find("javax.management.MBeanServerConnection").getMethod("invoke", types).invoke(server, values)  # the server's own class is hidden from py4j


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of tables between steps, in whatever store it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with as many underscores before it as it takes to be no column of `df` in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def ranked(df: DataFrame, by: Sequence[str], group: str | None = None, name: str = "rank", per_group: DataFrame | None = None) -> DataFrame:
    """Add a row number from 0 (within `group`, if given) in the order of `by`, nulls last, without one task that holds a group.

    Rows are dealt out by range over (group, by) and numbered where they lie; only one row per partition and group is
    summed up to say how many rows come before. The numbered rows are checkpointed, as a second run of the range
    exchange may draw other borders. `per_group` (one row per group, with a column named as `group`) brings further columns
    along; they go through the sums, so that a large group's rows still meet them in many tasks. Rows equal in all of `by` may swap numbers. `df` should be slim.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(c).asc_nulls_last() for c in ([group] if group else []) + list(by)]
    key = F.coalesce(F.concat(F.lit("="), F.col(group)), F.lit("-")) if group else F.lit("-")
    numbered = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    numbered = cut(numbered.withColumn("_id", F.monotonically_increasing_id()).withColumn("_group", key))
    numbered = numbered.withColumn("_part", F.shiftright("_id", 33))
    cells = numbered.groupBy("_part", "_group").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    if per_group is not None:
        cells = cells.join(per_group.withColumn("_group", key).drop(group), "_group")
    joined = numbered.join(cells, ["_part", "_group"])
    return joined.withColumn(name, F.col("_id") - F.col("_first") + F.col("_before")).drop("_id", "_group", "_part", "_first", "_before")


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`: what keeps rows apart for learning and for holding out. Null ids give null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


_held: dict[object, object] = {}


def held(key: object, make: Callable[[], object]) -> object:
    """What a Python worker keeps between batches and tasks (a model, a table of words): one thing at a time.

    Workers are reused by later stages; what another operator has left behind goes first, so that memory is that of
    the largest operator and not of all of them.
    """
    if key not in _held:
        _held.clear()
        gc.collect()
        give_back()
        _held[key] = make()
    return _held[key]


def give_back() -> None:
    """Returns freed memory to the system, where the libraries can: a process that lives on counts with what it keeps."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)
