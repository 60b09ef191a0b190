"""Incidences that arrive over time: Parquet folders read as a stream, and degrees kept up to date.

Message passing itself is a batch computation over a snapshot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def incidence_stream(spark: SparkSession, folder: str, schema: StructType | str, edge: str, vertex: str, files_per_batch: int = 100) -> DataFrame:
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return rows.select(F.col(vertex).cast("long").alias("v"), F.col(edge).cast("long").alias("e")).filter("v IS NOT NULL AND e IS NOT NULL")


def degrees(stream: DataFrame, side: str = "v") -> DataFrame:
    """Running degree of each element, for ``outputMode("complete")`` or ``"update"``."""
    return stream.groupBy(F.col(side).alias("id")).agg(F.count("*").alias("degree"))
