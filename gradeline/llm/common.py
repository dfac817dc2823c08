"""What the operators share: inputs, shared folders, tables that cut lineage."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

#: Rows of documents in one batch, of Arrow and of the Parquet reader. Texts are whole, so this bounds what a worker holds.
ARROW_ROWS = "500"

#: Separators of words in the contracts: blank and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """Holds batches of Arrow and of the Parquet reader to ARROW_ROWS rows for the plans that follow in the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", ARROW_ROWS)


def remembered(key: tuple, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps under a key from task to task. It keeps one thing at a time."""
    if key not in _remembered:
        _remembered.clear()
        _remembered[key] = make()
    return _remembered[key]


def forget() -> None:
    """Drops what the worker keeps, for kernels that have no use for it."""
    _remembered.clear()


_remembered: dict[tuple, Any] = {}

Kernel = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def released(kernel: Kernel) -> Kernel:
    """The kernel, whose worker returns what it has freed to the system when the task ends, as workers wait between tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from kernel(batches)
        finally:
            give_back()

    return run


def give_back() -> None:
    """Returns memory that this process has freed; Arrow's pool and malloc keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def give_back_heap(spark: SparkSession) -> None:
    """Has the executors' JVMs, a task in each free core, and the driver's drop garbage and return heap that they no longer need."""
    n = max(1, spark.sparkContext.defaultParallelism)
    spark.range(0, n, 1, n).selectExpr("java_method('java.lang.System', 'gc') AS done").collect()
    give_back_driver(spark)


def give_back_driver(spark: SparkSession) -> None:
    """Has the driver's JVM drop garbage, return unused heap and what its compilers have freed; malloc keeps that otherwise."""
    jvm, new = spark._jvm, spark.sparkContext._gateway.new_array
    jvm.System.gc()

    def array(kind: Any, values: list) -> Any:
        out = new(kind, len(values))
        for i, v in enumerate(values):
            out[i] = v
        return out

    try:  # the server's own class isn't open to the gateway, its interface is
        kind = jvm.java.lang.Class.forName
        types = [kind(x) for x in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")]
        call = kind("javax.management.MBeanServer").getMethod("invoke", array(jvm.java.lang.Class, types))
        name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        args = [name, "systemTrimNativeHeap", new(jvm.java.lang.Object, 0), new(jvm.java.lang.String, 0)]
        call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), array(jvm.java.lang.Object, args))
    except Py4JError:  # only some JVMs have this command
        pass


def unused(name: str, columns: list[str]) -> str:
    """name, with underscores in front until none of the columns has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it.

    Only a local master may do without the setting; it then gets a temporary folder that goes with the process.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="gradeline-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


_own: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets. It goes when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, path)
    return path


def _remove(path: str) -> None:
    """Deletes a path on whatever file system it is, if the session still runs."""
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    elif path.startswith("file:"):
        shutil.rmtree(local_path(path), ignore_errors=True)


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing will read again, so that a long plan holds little disk."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str, *parts: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, survives lost executors and is read by column.

    parts are columns by whose values the files are kept apart.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.partitionBy(*parts).parquet(path) if parts else df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_path(uri: str) -> str:
    """The path of a file: URI. Memory mapping needs a mounted folder, so other schemes are refused."""
    if "://" not in uri and not uri.startswith("file:"):
        return uri
    if not uri.startswith("file:"):
        raise ValueError(f"{uri} isn't a mounted folder; token files are memory-mapped")
    return os.path.normpath("/" + uri[5:].lstrip("/"))
