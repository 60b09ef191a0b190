"""Shared pieces of the corpus operators: inputs, scratch tables, UTF-8 columns."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knitwork.sources.shared import delete, shared_root

_WRITTEN: list[str] = []
#: Rows and bytes that go to a Python worker at a time, but for a single longer row: texts can be long.
ROWS_PER_BATCH, BYTES_PER_BATCH = 1000, 4_000_000
_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": ROWS_PER_BATCH, "spark.sql.execution.arrow.maxBytesPerBatch": BYTES_PER_BATCH}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the input; Arrow batches of the session are bounded from then on."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; on a cluster that does not name one, this raises."""
    return shared_root(spark)


def _number(value: str) -> int:
    return int(value.rstrip("b"))


def bounded_batches(spark: SparkSession) -> dict[str, str]:
    """From now on in this session, a batch for a Python worker is no larger than the limits; returns the settings before."""
    before = {key: spark.conf.get(key) for key in _LIMITS}
    for key, most in _LIMITS.items():
        if not 0 < _number(before[key]) <= most:
            spark.conf.set(key, str(most))
    return before


def trim() -> None:
    """Give freed memory of this worker process back, since workers stay alive between stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def give_back(spark: SparkSession) -> None:
    """Have executors collect garbage and give free heap back: a heap that one step filled otherwise stays as large beside the Python workers of the next."""
    tasks = 2 * spark.sparkContext.defaultParallelism  # an executor that gets none keeps its heap, nothing else depends on it
    spark.range(0, tasks, 1, tasks).select(F.call_function("java_method", F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to a Parquet table in the shared folder and read back: no lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/knitwork/{label}-{uuid.uuid4().hex}"
    before = bounded_batches(spark)
    try:
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the scratch tables written so far; call it once their results have been consumed."""
    while _WRITTEN:
        delete(spark, _WRITTEN.pop())


@atexit.register
def _release_at_exit() -> None:
    with contextlib.suppress(Exception):
        if spark := SparkSession.getActiveSession():
            release(spark)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A string column as Python strings, null as the empty string."""
    return ["" if x is None else x for x in batch.column(name).to_pylist()]


def utf8(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A string column as UTF-8 bytes, null as the empty string."""
    return [b"" if x is None else x for x in batch.column(name).cast(pa.large_binary()).to_pylist()]


def pieces_of(batches: Iterator[pa.RecordBatch], most: int, name: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most`` text bytes, or of one longer row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False)
        begin, held = 0, 0
        for k, size in enumerate(sizes):
            if held and held + size > most:
                yield batch.slice(begin, k - begin)
                begin, held = k, 0
            held += int(size)
        if batch.num_rows > begin:
            yield batch.slice(begin)


def fold(column: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus
