"""User-given placements: a folder of ``partition-<n>`` or ``partition-<n>.txt`` with one id per line.

Each is a file, or a folder of text files as Spark writes them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NAME = r"partition-([0-9]+)(?:\.txt)?(?:/[^/]*)?$"


def read_placement(spark: SparkSession, folder: str) -> DataFrame:
    """(id, part)."""
    rows = spark.read.text(f"{folder}/partition-*").select("value", F.col("_metadata.file_path").alias("file"))
    return rows.select(F.trim("value").cast("long").alias("id"), F.regexp_extract("file", _NAME, 1).cast("short").alias("part"))


def write_placement(placement: DataFrame, folder: str) -> None:
    """One folder ``partition-<n>`` per partition, in text, for ``read_placement`` and other tools."""
    placement.select(F.col("id").cast("string").alias("value"), "part").write.mode("overwrite").partitionBy("part").text(folder)
    context = placement.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path
    system = path(folder).getFileSystem(context._jsc.hadoopConfiguration())
    for status in system.listStatus(path(folder)):
        name = status.getPath().getName()
        if name.startswith("part="):
            system.rename(status.getPath(), path(folder, f"partition-{name.removeprefix('part=')}"))
