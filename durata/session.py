"""Session helpers.

The library never creates cluster-wide settings behind the caller's back:
``get_session`` is for tests, the bench and local runs.  ``checkpoint_dir``
reads ``spark.checkpoint.dir`` from the running session and only falls back
to a scratch folder when the setting is absent (local runs and tests).
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int = 8,
                app: str = "durata", extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", os.environ.get("DURATA_DRIVER_MEMORY", "16g"))
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and staged tables.

    On a cluster ``spark.checkpoint.dir`` names a shared file system folder;
    it is used as is.  Only a local session without one (tests, local runs)
    gets a scratch folder; on a cluster a missing setting is an error, since
    executors do not share their temporary folders.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    master = spark.sparkContext.master
    if not d and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not d:
        d = tempfile.mkdtemp(prefix="durata-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


def staging_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written tables."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/staging/{name}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on any file system Spark reads."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def delete_path(spark: SparkSession, path: str) -> bool:
    """Deletes a file or folder on any file system Spark writes."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True))


def move_path(spark: SparkSession, old: str, new: str) -> None:
    """Moves a folder; the folders above its new name are made."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    source, target = path(old), path(new)
    fs = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(target.getParent())
    if not fs.rename(source, target):
        raise OSError(f"{old} cannot be moved to {new}")


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, a query's shuffle files go when the query has ended.  Spark
    keeps them until the driver's garbage collector finds its plan, so that
    those of all steps of a job lie on disk at a time.  For queries that run
    once."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def workers_find_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it
    (local sessions and clusters on a shared file system)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))


def cut_lineage(df: DataFrame, name: str = "cut") -> DataFrame:
    """``df`` written once to the shared folder and read back: a lost executor
    costs a re-read, and later steps read only the columns they need."""
    path = staging_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
