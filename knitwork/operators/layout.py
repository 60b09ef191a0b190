"""Vertex-cut layouts: the rows that each partition of a partitioned run holds, written, read back and turned into a hypergraph.

Uniques live in one partition, replicas in every partition that holds one of
their out-neighbours. A replica gets a new id whose remainder by the number of
partitions is its master; uniques name their out-neighbours by new ids, replicas
by the ids of uniques. Lists of neighbours are cut into chunks of about ``CHUNK``
by hash, so that no row grows with the degree of an element.

Older layouts, folders ``partition-<i>`` of binary files, are read as well; such
a file has to fit in one row, which Spark bounds by 2 GB.
"""

from __future__ import annotations

import csv
import io
import json
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from knitwork.operators import placement
from knitwork.plans.supersteps import EDGE, VERTEX
from knitwork.sources.adjacency_text import read_adjacency
from knitwork.sources.hypergraph import Hypergraph, frequent
from knitwork.sources.placement_files import read_placement
from knitwork.sources.shared import written

#: Neighbours in one row, about.
CHUNK = 65_536
#: Partition numbers fit in a byte.
MOST_PARTS = 255

_TABLES = {
    "replicas": "old_id long, new_id long, total_degree long, weight string, chunk int, neighbours array<long>, part short",
    "uniques": "id long, weight string, chunk int, neighbours array<long>, part short",
    "masters": "new_id long, servant_parts array<short>, part short",
}


@dataclass(frozen=True)
class Layout:
    """``replicas`` (part, old_id, new_id, total_degree, weight, chunk, neighbours), ``uniques`` (part, id, weight, chunk, neighbours),
    ``masters`` (part, new_id, servant_parts) of replicas with more than one copy, and what is the same for all partitions. ``dealt`` says that
    the rows of replicas and uniques come from as many tasks as there are, by id, and need not be dealt again to be written."""

    replicas: DataFrame
    uniques: DataFrame
    masters: DataFrame
    meta: dict[str, bool | int]
    dealt: bool = False


def _lists(rows: DataFrame, sizes: DataFrame, keys: list[str], chunk: int) -> DataFrame:
    """Sorted ``neighbours`` (from ``to``) of each key, in chunks. ``sizes`` has the number ``n`` of rows of the keys, of which those with more
    than a chunk are few, at most a row for each chunk."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    large = sizes.filter(F.col("n") > chunk).select(*keys, F.ceil(F.col("n") / F.lit(chunk)).alias("chunks_"))
    dealt = rows.join(F.broadcast(large), keys, "left").withColumn("chunk", F.coalesce(F.pmod(F.xxhash64("to"), F.col("chunks_")), F.lit(0)).cast("int"))
    # dealt before they are collected, so that lists are made once, each by one task
    return dealt.select(*keys, "chunk", "to").repartition(parts, *keys, "chunk").groupBy(*keys, "chunk").agg(F.sort_array(F.collect_list("to")).alias("neighbours"))


def _filled(rows: DataFrame, lists: DataFrame, keys: list[str]) -> DataFrame:
    empty = F.array().cast("array<long>")
    return rows.join(lists, keys, "left").withColumns({"chunk": F.coalesce("chunk", F.lit(0)), "neighbours": F.coalesce("neighbours", empty)})


def build(graph: Hypergraph, parts: int, unique_side: str = EDGE, placed: DataFrame | None = None, chunk: int = CHUNK) -> Layout:
    """The layout over ``parts`` partitions; uniques are placed by modulo, or as ``placed`` (id, part) says."""
    if unique_side not in (VERTEX, EDGE):
        raise ValueError(f"unique_side must be {VERTEX!r} or {EDGE!r}")
    if not 0 < parts <= MOST_PARTS:
        raise ValueError(f"between 1 and {MOST_PARTS} partitions")
    v2e, e2v = graph.v2e.select(F.col("v").alias("src"), F.col("e").alias("dst")), graph.e2v.select(F.col("e").alias("src"), F.col("v").alias("dst"))
    replicas, uniques, there, back = (graph.vertices, graph.hyperedges, v2e, e2v) if unique_side == EDGE else (graph.hyperedges, graph.vertices, e2v, v2e)
    if placed is None and graph.mirrored and set(graph.ends) == {"v", "e"}:
        return _of_ends(uniques, there, back, parts, unique_side, chunk)
    # what several tables are made from is written once, so that it is not put together again from the source for each of them
    counts = {"total_replica_elements": (replicas := written(replicas.select("id", "weight"), "layout-replicas")).count(), "total_unique_elements": (uniques := written(uniques.select("id", "weight"), "layout-uniques")).count()}
    where = placement.by_modulo(uniques, parts) if placed is None else placement.by_table(uniques, placed)
    local = written(placement.local(there, where), "layout-local")
    held = written(placement.copies_of(replicas, there, local, parts), "layout-copies")
    ids = written(placement.new_ids(held, parts), "layout-ids")
    degrees = held.groupBy("id").agg(F.sum("n_local").alias("total_degree"))
    rows = _filled(held.drop("n_local"), _lists(local, held.withColumnRenamed("n_local", "n"), ["id", "part"], chunk), ["id", "part"])
    rows = rows.join(ids.join(degrees, "id").join(replicas, "id"), "id")
    short = F.col("part").cast("short").alias("part")

    moved = _moved(back, ids)
    sizes = back.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))
    own = _filled(uniques.join(where, "id"), _lists(moved, sizes, ["id"], chunk), ["id"])

    return Layout(
        rows.select(short, F.col("id").alias("old_id"), "new_id", "total_degree", "weight", "chunk", "neighbours"),
        own.select(short, "id", "weight", "chunk", "neighbours"),
        _masters(held, ids, parts),
        {"uniques_as_hyperedges": unique_side == EDGE, **counts, "partitions": parts},
    )


def _of_ends(uniques: DataFrame, there: DataFrame, back: DataFrame, parts: int, unique_side: str, chunk: int) -> Layout:
    """The layout by modulo of a hypergraph whose elements are the ends of its incidences. The partition of a unique follows from its id and
    every element has neighbours, so lists are not joined with uniques or copies, and no element is looked for besides those in lists."""
    home = lambda c: F.pmod(c, F.lit(parts)).cast("long")
    none, short = F.lit(None).cast("string").alias("weight"), F.col("part").cast("short").alias("part")
    local = there.select(F.col("src").alias("id"), home("dst").alias("part"), F.col("dst").alias("to"))
    held = written(local.groupBy("id", "part").agg(F.count("*").alias("n_local")), "layout-copies")
    ids = written(placement.new_ids(held, parts), "layout-ids")
    about = ids.join(held.groupBy("id").agg(F.sum("n_local").alias("total_degree")), "id")
    rows = _lists(local, held.withColumnRenamed("n_local", "n"), ["id", "part"], chunk).join(about, "id")
    moved, sizes = _moved(back, ids), frequent(back.select(F.col("src").alias("id")), ["id"], chunk)
    own = _lists(moved, sizes, ["id"], chunk).withColumn("part", home("id"))
    return Layout(
        rows.select(short, F.col("id").alias("old_id"), "new_id", "total_degree", none, "chunk", "neighbours"),
        own.select(short, "id", none, "chunk", "neighbours"),
        _masters(held, ids, parts),
        {"uniques_as_hyperedges": unique_side == EDGE, "total_replica_elements": ids.count(), "total_unique_elements": uniques.count(), "partitions": parts},
        dealt=True,
    )


def _moved(back: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, to): every out-neighbour of a unique by its new id."""
    unknown = F.raise_error(F.concat(F.lit("no replica "), F.col("dst").cast("string"))).cast("long")
    return back.join(ids.withColumnRenamed("id", "dst"), "dst", "left").select(F.col("src").alias("id"), F.coalesce("new_id", unknown).alias("to"))


def _masters(held: DataFrame, ids: DataFrame, parts: int) -> DataFrame:
    servants = placement.servants(held).join(ids, "id").groupBy("new_id").agg(F.sort_array(F.collect_list(F.col("part").cast("short"))).alias("servant_parts"))
    return servants.select(F.pmod("new_id", F.lit(parts)).cast("short").alias("part"), "new_id", "servant_parts")


def write(layout: Layout, path: str, mode: str = "errorifexists") -> None:
    """Parquet by partition, in several files each where there are fewer partitions than tasks, and one row of metadata."""
    shares = -(-4 * int(layout.replicas.sparkSession.conf.get("spark.sql.shuffle.partitions")) // layout.meta["partitions"])  # some for each task
    for name, key in (("replicas", "new_id"), ("uniques", "id"), ("masters", "new_id")):
        share = F.pmod(F.xxhash64(key), F.lit(shares))
        table = getattr(layout, name)
        table = table if layout.dealt and name != "masters" else table.repartition("part", share)
        table.write.mode(mode).partitionBy("part").parquet(f"{path}/{name}")
    spark = layout.replicas.sparkSession
    spark.createDataFrame([(json.dumps(layout.meta),)], "value string").coalesce(1).write.mode(mode).text(f"{path}/meta")


def write_weights(layout: Layout, path: str, mode: str = "errorifexists") -> None:
    """Weights as text for other tools, ``id, weight`` per line: replicas by new id, in every partition with a copy."""
    for name, table, key in (("replica_weights", layout.replicas, "new_id"), ("unique_weights", layout.uniques, "id")):
        lines = table.filter("weight IS NOT NULL").select("part", F.concat_ws(", ", F.col(key).cast("string"), "weight").alias("value")).distinct()
        lines.write.mode(mode).partitionBy("part").text(f"{path}/{name}")


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """(part, id, weight) of a folder written by ``write_weights``; both fields are trimmed, the weight stays text."""
    rows = spark.read.text(path)
    return rows.select(F.col("part").cast("short").alias("part"), F.trim(F.split_part("value", F.lit(","), F.lit(1))).cast("long").alias("id"), F.trim(F.substring_index("value", ",", -1)).alias("weight"))


def read(spark: SparkSession, path: str) -> Layout:
    return Layout(*(spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in _TABLES.items()), json.loads(spark.read.text(f"{path}/meta").head()[0]))


def to_hypergraph(layout: Layout, mirrored: bool = False) -> Hypergraph:
    """The hypergraph of a layout, with its old ids; ``mirrored`` if the one that was laid out is."""
    kind = layout.meta["uniques_as_hyperedges"]
    replicas = layout.replicas.groupBy(F.col("old_id").alias("id")).agg(F.any_value("weight").alias("weight"))
    uniques = layout.uniques.groupBy("id").agg(F.any_value("weight").alias("weight"))
    own, other = ("v", "e") if kind else ("e", "v")
    there = layout.replicas.select(F.col("old_id").alias(own), F.explode("neighbours").alias(other))
    olds = layout.replicas.select("new_id", "old_id").distinct()
    back = layout.uniques.select(F.col("id").alias(other), F.explode("neighbours").alias("new_id")).join(olds, "new_id").select(other, F.col("old_id").alias(own))
    return Hypergraph(replicas, uniques, there, back, mirrored=mirrored) if kind else Hypergraph(uniques, replicas, back, there, mirrored=mirrored)


def partition(spark: SparkSession, source: str, parts: int, out: str, unique_side: str = EDGE, placement_folder: str | None = None, strict: bool = True, mode: str = "errorifexists") -> Layout:
    """Read a text hypergraph, lay it out, write that, and return what was written."""
    placed = None if placement_folder is None else read_placement(spark, placement_folder)
    write(build(read_adjacency(spark, source, strict), parts, unique_side, placed), out, mode)
    return read(spark, out)


# Binary folders. Numbers are unsigned, big-endian, 32 bits wide, partition numbers one byte.


def _numbers(data: bytes) -> list[int]:
    if len(data) % 4:
        raise ValueError("a binary file ends within a number")
    return list(struct.unpack(f">{len(data) // 4}I", data))


def replica_records(data: bytes) -> Iterator[tuple[int, int, int, list[int]]]:
    """old_id, new_id, total_degree and local neighbours."""
    words, at = _numbers(data), 0
    while at < len(words):
        old, new, degree, n = words[at : at + 4]
        if len(words) < at + 4 + n:
            raise ValueError("a binary file ends within a record")
        yield old, new, degree, words[at + 4 : at + 4 + n]
        at += 4 + n


def unique_records(data: bytes) -> Iterator[tuple[int, list[int]]]:
    """id and neighbours by new id."""
    words, at = _numbers(data), 0
    while at < len(words):
        key, n = words[at : at + 2]
        if len(words) < at + 2 + n:
            raise ValueError("a binary file ends within a record")
        yield key, words[at + 2 : at + 2 + n]
        at += 2 + n


def master_records(data: bytes) -> Iterator[tuple[int, list[int]]]:
    """new_id and the partitions of its other copies."""
    at = 0
    while at < len(data):
        if len(data) < at + 5 or len(data) < at + 5 + data[at + 4]:
            raise ValueError("a binary file ends within a record")
        yield int.from_bytes(data[at : at + 4], "big"), list(data[at + 5 : at + 5 + data[at + 4]])
        at += 5 + data[at + 4]


def weight_records(data: bytes) -> Iterator[tuple[int, str]]:
    for row in csv.reader(io.StringIO(data.decode())):
        if row:
            yield int(row[0].strip()), row[1].strip()


#: Records of a file turned into Arrow at a time.
_ROWS = 10_000


def _binary(spark: SparkSession, folder: str, name: str, records: Callable[[bytes], Iterator[tuple]], schema: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", name).option("recursiveFileLookup", "true").load(folder)
    part = F.regexp_extract("path", r"partition-([0-9]+)/[^/]*$", 1).cast("short").alias("part")

    kinds = to_arrow_schema(StructType.fromDDL(f"part short, {schema}"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in zip(batch.column("part").to_pylist(), batch.column("content").to_pylist(), strict=True):
                held = []
                for record in records(data):
                    held.append((number, *record))
                    if len(held) == _ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds.types, strict=True)], schema=kinds)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds.types, strict=True)], schema=kinds)

    return files.select(part, "content").mapInArrow(parse, f"part short, {schema}")


def read_meta(spark: SparkSession, folder: str) -> dict[str, bool | int]:
    """The three keys of a ``meta.yaml``, which is the same in every partition."""
    out: dict[str, bool | int] = {}
    rows = spark.read.option("pathGlobFilter", "meta.yaml").option("recursiveFileLookup", "true").text(folder).filter(F.trim("value") != "").distinct().collect()
    for row in rows:
        key, _, value = row["value"].partition(":")
        key, value = key.strip(), value.strip()
        if key not in ("uniques_as_hyperedges", "total_replica_elements", "total_unique_elements"):
            raise ValueError(f"unknown key {key!r} in meta.yaml")
        out[key] = value == "true" if key == "uniques_as_hyperedges" else int(value)
    return out


def read_binary(spark: SparkSession, folder: str) -> Layout:
    """Folders ``partition-<i>`` of binary files, with weights where there are any."""
    replicas = _binary(spark, folder, "replicas.bin", replica_records, "old_id long, new_id long, total_degree long, neighbours array<long>")
    uniques = _binary(spark, folder, "uniques.bin", unique_records, "id long, neighbours array<long>")
    masters = _binary(spark, folder, "master_partitions.bin", master_records, "new_id long, servant_parts array<short>")
    on_new = _binary(spark, folder, "replica_weighs.csv", weight_records, "new_id long, weight string")
    on_id = _binary(spark, folder, "unique_weighs.csv", weight_records, "id long, weight string")
    return Layout(
        replicas.join(on_new, ["part", "new_id"], "left").select("part", "old_id", "new_id", "total_degree", "weight", F.lit(0).alias("chunk"), "neighbours"),
        uniques.join(on_id, ["part", "id"], "left").select("part", "id", "weight", F.lit(0).alias("chunk"), "neighbours"),
        masters,
        read_meta(spark, folder),
    )
