"""Session set-up and the shared scratch area."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("likeness")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Read from the session, then from the context. A folder of our own is made
    only on one machine (local master); elsewhere a missing setting is an error,
    for files in a local folder are seen by one executor alone.
    """
    context = spark.sparkContext
    base = spark.conf.get(CHECKPOINT_CONF, None) or context.getCheckpointDir()
    if base:
        return base
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that the driver and all executors share")
    base = tempfile.mkdtemp(prefix="likeness-")
    atexit.register(shutil.rmtree, base, ignore_errors=True)
    spark.conf.set(CHECKPOINT_CONF, base)
    return base


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, for a table one query writes."""
    return os.path.join(shared_dir(spark), "likeness", f"{name}-{uuid.uuid4().hex}")


#: Whether an execution's shuffle files go when it ends, and not when the driver happens to collect its plan.
CLEAN_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The files outlive the executors that wrote them, so a lost executor costs
    a re-read and never a recomputation of the steps before. What was shuffled
    for them is read by nothing else and is deleted once they are written.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEAN_CONF, None)
    spark.conf.set(CLEAN_CONF, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEAN_CONF) if before is None else spark.conf.set(CLEAN_CONF, before)
    return spark.read.parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more, on whatever store holds it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
