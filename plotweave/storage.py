"""Shared work folders: where intermediate tables live while a job runs.

Every intermediate result that is read more than once, or that ends a lineage, is a
Parquet table below ``spark.checkpoint.dir`` (the one folder that driver and executors
share).  A lost executor therefore never takes an intermediate result with it.
"""

from __future__ import annotations

import atexit
import math
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_DEFAULT: dict[str, str] = {}
_LEFT: dict[str, SparkSession] = {}
_RECORD: ContextVar[list[str] | None] = ContextVar("record", default=None)
#: Rows of pixels a task.
TASK_ROWS = 100_000
#: Seconds between two returns of the driver's memory, and the time from which the next is due.
TRIM_S = 2.0
_DUE = {"at": 0.0}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        if "dir" not in _DEFAULT:
            _DEFAULT["dir"] = "file://" + tempfile.mkdtemp(prefix="plotweave-")
            _remove_at_exit(spark, _DEFAULT["dir"])
        return _DEFAULT["dir"]
    raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    if not _LEFT:
        atexit.register(_remove_left)
    _LEFT[path] = spark


def _remove_left() -> None:
    for path, spark in list(_LEFT.items()):
        delete_path(spark, path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system API; quiet if the session is gone."""
    sc = spark.sparkContext
    if sc._jsc is None:
        return
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
    _LEFT.pop(path, None)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/plotweave-{name}-{uuid.uuid4().hex}"
    _remove_at_exit(spark, path)
    record = _RECORD.get()
    if record is not None:
        record.append(path)
    return path


def trim_driver(spark: SparkSession) -> None:
    """Return to the machine what the driver's JVM has freed outside its heap, at most every TRIM_S seconds.

    Compilers and codecs free memory with each plan, but the allocator keeps it, some 300 MB after the many plans of a
    pipeline.  Only HotSpot on the GNU library can do this; elsewhere nothing happens.
    """
    sc = spark.sparkContext
    if sc._jsc is None or time.monotonic() < _DUE["at"]:
        return
    jvm, array = sc._jvm, sc._gateway.new_array
    try:
        call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        inner, kinds, args = array(jvm.java.lang.Object, 1), array(jvm.java.lang.String, 1), array(jvm.java.lang.Object, 4)
        inner[0], kinds[0] = array(jvm.java.lang.String, 0), "[Ljava.lang.String;"
        args[0], args[1], args[2], args[3] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap", inner, kinds
        call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
        _DUE["at"] = time.monotonic() + TRIM_S
    except Py4JError:
        _DUE["at"] = float("inf")


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths that ``new_path`` gives inside, by this thread."""
    paths: list[str] = []
    before = _RECORD.set(paths)
    try:
        yield paths
    finally:
        _RECORD.reset(before)


def materialise(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    trim_driver(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def unsent(df: DataFrame) -> DataFrame:
    """A table of pixels or points whose joins shuffle: a few MB of Parquet hold millions of such rows, and Spark would
    broadcast them by the size of the files."""
    return df.hint("merge")


def dealt(df: DataFrame, key: str, rows: int = TASK_ROWS) -> DataFrame:
    """A table that is cheap to count, dealt by ``key`` into tasks of about ``rows`` rows before they grow: Spark cuts tasks by
    the size of the files, of which a few MB hold millions of pixels."""
    tasks = math.ceil(df.count() / rows)
    return df.repartition(tasks, key) if tasks > 1 else df


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialise`` wrote for these; for tables that nothing reads any more."""
    for df in tables:
        path = df.__dict__.pop("stored_at", None)
        if path:
            delete_path(df.sparkSession, path)
