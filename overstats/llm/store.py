"""Tables written between the steps of a job, in the folder all executors share."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


#: Rows of an Arrow batch at most, here: whole texts are long, and both the JVM and Python hold batches of them.
BATCH_ROWS = 1000


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """mapInArrow with batches of at most ``BATCH_ROWS`` rows, which is set on the session if it allows more."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(setting)) <= BATCH_ROWS:
        df.sparkSession.conf.set(setting, str(BATCH_ROWS))

    trim_driver(df.sparkSession)

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return df.mapInArrow(tidy, schema)


def give_back() -> None:
    """Free memory goes back to the system: a Python worker outlives its task and waits for the next one."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def trim_driver(spark: SparkSession) -> None:
    """Free native memory of the driver's JVM goes back to the system, where the JVM has a command for it.

    The command is a management bean's; its class is closed to Py4J, so the interface's method is called.
    """
    jvm, gateway = spark._jvm, spark.sparkContext._gateway

    def array(kind, *values):
        out = gateway.new_array(kind, len(values))
        for k, value in enumerate(values):
            out[k] = value
        return out

    try:
        named = jvm.java.lang.Class.forName
        kinds = map(named, ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;"))
        invoke = named("javax.management.MBeanServer").getMethod("invoke", array(jvm.java.lang.Class, *kinds))
        bean = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        invoke.invoke(server, array(jvm.java.lang.Object, bean, "systemTrimNativeHeap", None, None))
    except Py4JError:
        pass  # an older JVM, or another system


#: Folders of our own, by application.
_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a folder of our own only where it is unset and the master local."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = spark.sparkContext.applicationId
    return _FOLDERS.setdefault(own, os.path.join(tempfile.gettempdir(), f"overstats-{own}"))


def save(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage with a written table: it survives the loss of any executor."""
    path = f"{shared_folder(df.sparkSession)}/llm-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    trim_driver(df.sparkSession)
    saved = df.sparkSession.read.schema(df.schema).parquet(path)
    saved._overstats_path = path
    return saved


def forget(*tables: DataFrame) -> None:
    """Delete saved tables that nothing reads any more."""
    for table in tables:
        path = getattr(table, "_overstats_path", None)
        if path:
            jvm = table.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
