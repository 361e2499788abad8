"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app: str = "caseledger",
                  shuffle_partitions: int | None = None) -> SparkSession:
    """Create (or reuse) a session with AQE on, UTC session time and no UI.

    On a cluster the master, partition counts and ``spark.checkpoint.dir`` come
    from the submit configuration; these defaults only apply when unset.
    """
    master = master or os.environ.get("CASELEDGER_MASTER") or "local[*]"
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if master.startswith("local"):
        # local mode: the driver JVM is the only executor, size its heap
        builder = builder.config("spark.driver.memory",
                                 os.environ.get("CASELEDGER_DRIVER_MEMORY", "8g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder for written intermediate tables and stream checkpoints.

    Uses the cluster's ``spark.checkpoint.dir``. Only in local mode, where all
    executors share the machine, a fresh scratch folder stands in when it is
    unset; elsewhere that is an error.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    # Spark takes the setting at its start only; the context keeps the folder
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="caseledger-ckpt-"))
    return spark.sparkContext.getCheckpointDir()


def materialize(df, compression=None):
    """Compute ``df`` once and cut its lineage by writing it as a Parquet
    table under the cluster's shared ``spark.checkpoint.dir`` and reading it
    back (survives executor loss, unlike a local checkpoint; later scans get
    column pruning and filter pushdown). Use for an intermediate that a plan
    reads several times. ``compression`` is a Parquet codec, by default the session's."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path, compression=compression)
    _STORED.append(path)
    return spark.read.parquet(path)


#: Tables stored by ``materialize`` and not yet dropped.
_STORED: list[str] = []


@contextmanager
def stored_tables(spark: SparkSession):
    """Drops, at its end, the tables that ``materialize`` stored inside: use it
    around building and consuming a result."""
    first = len(_STORED)
    try:
        yield
    finally:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        while len(_STORED) > first:
            path = jvm.org.apache.hadoop.fs.Path(_STORED.pop())
            path.getFileSystem(conf).delete(path, True)
