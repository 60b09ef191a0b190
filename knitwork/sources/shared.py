"""The folder that the driver and all executors share, for checkpoints and tables in between."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_SCRATCH: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a local session gets a temporary one; a cluster raises."""
    context = spark.sparkContext
    root = context.getConf().get(SETTING) or spark.conf.get(SETTING, None)
    if not root:
        if not context.master.startswith("local"):
            raise ValueError(f"set {SETTING} to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="knitwork-")
        spark.conf.set(SETTING, root)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of any file system that Spark reaches."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def scratch(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder, deleted by ``release`` or at exit."""
    path = f"{shared_root(spark)}/knitwork-{label}/{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: without lineage, and there when executors are lost."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete what ``scratch`` and ``written`` made so far, once it has been used."""
    while _SCRATCH:
        delete(spark, _SCRATCH.pop())


@atexit.register
def _release_at_exit() -> None:
    with contextlib.suppress(Exception):
        if spark := SparkSession.getActiveSession():
            release(spark)
