"""Session helpers: settings the jobs rely on, checkpoints, written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "overstats", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs are tuned for.

    ``requireAllClusterKeysForCoPartition=false`` lets joins on
    (match, innings, person) reuse the one shuffle by match.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.requireAllClusterKeysForCoPartition": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        # Typed state of streams, with timers, is kept in RocksDB.
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        # Recording a Python call site for every column costs more than planning.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder the cluster names for checkpoints, if it names one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    return current.get() if current.isDefined() else None


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage of ``df`` with a table written to the shared folder.

    Written tables survive the loss of an executor. Without a shared folder
    the rows are cached instead, which Spark recomputes if a block is lost.
    """
    spark = df.sparkSession
    folder = checkpoint_dir(spark)
    if folder is None:
        return df.persist()
    path = f"{folder.rstrip('/')}/overstats-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def materialise_by(df: DataFrame, label: str, key: str) -> DataFrame:
    """:func:`materialise` in buckets of ``key``: what groups by it, and by more, reads the table without a shuffle.

    The table is named while it is written and read back; then the name goes and the files stay.
    """
    spark = df.sparkSession
    folder = checkpoint_dir(spark)
    if folder is None:
        return df.persist()
    own = uuid.uuid4().hex
    name = f"spark_catalog.default.overstats_{label}_{own}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").bucketBy(buckets, key).option(
        "path", f"{folder.rstrip('/')}/overstats-{label}-{own}").saveAsTable(name)
    rows = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return rows


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of ``path``, and the path as it takes it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder that all executors share; a temporary one only for a local master without a shared folder."""
    folder = checkpoint_dir(spark)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="overstats-")
    return f"{folder.rstrip('/')}/overstats-{label}-{uuid.uuid4().hex}"
