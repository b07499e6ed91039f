"""What the operators of this subpackage share: the shared folder, written tables and whole-text words."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_KEPT: dict[tuple, Any] = {}


def workspace(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a temporary one where it is unset and all run on this machine (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="quillstone-")
            atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
        base = f"file://{_OWN[app]}"
    return f"{base.rstrip('/')}/quillstone"


@contextmanager
def brief(spark: SparkSession, most: int = 4000) -> Iterator[None]:
    """Spark keeps the text of every plan, and of its changes while it runs, in the driver; within this block it is cut to ``most`` characters."""
    name = "spark.sql.maxPlanStringLength"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def settle(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: the lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = f"{workspace(spark)}/{name}-{uuid.uuid4().hex}"
    with brief(spark):
        df.write.option("compression", compression).parquet(path)
    release()
    release_driver(spark)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release() -> None:
    """Gives memory that is free back to the system, as JVM and Python workers share an executor's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    c = ctypes.CDLL(None)
    if hasattr(c, "malloc_trim"):
        c.malloc_trim(0)


def release_driver(spark: SparkSession) -> None:
    """The same for the driver's JVM, whose many threads keep freed native memory in arenas of their own. JVMs without that command are left alone."""
    jvm, new_array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    # The server's own class is not open to callers; the interface's methods are.
    method = {m.getName(): m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods()}

    def call(what: str, *args: Any) -> Any:
        given = new_array(jvm.java.lang.Object, len(args))
        for k, x in enumerate(args):
            given[k] = x
        return method[what].invoke(server, given)

    if call("isRegistered", name) and any(o.getName() == "systemTrimNativeHeap" for o in call("getMBeanInfo", name).getOperations()):
        call("invoke", name, "systemTrimNativeHeap", None, None)


def kept(make: Callable[..., Any], *args: Any) -> Any:
    """What a Python worker keeps from task to task (words it has seen, a codec): one thing at a time, so that stages do not add up."""
    key = (make, *args)
    if key not in _KEPT:
        _KEPT.clear()
        release()
        _KEPT[key] = make(*args)
    return _KEPT[key]


def modest_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Lowers Spark's default of 10,000 rows an Arrow batch for whole texts; a value that the user has set stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, str(rows))


def spans(start: np.ndarray, width: np.ndarray) -> np.ndarray:
    """start[k] to start[k] + width[k] - 1, for every k."""
    return np.repeat(start - (np.cumsum(width) - width), width) + np.arange(int(width.sum()))
