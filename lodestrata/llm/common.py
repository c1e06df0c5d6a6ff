"""Helpers shared by the corpus operators: input shape, durable intermediates, Arrow batch bounds."""

from __future__ import annotations

import ctypes
import gc
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.durable import durable, shared_base  # noqa: F401
from ..shipping import ship

#: Bytes of one Arrow batch handed to Python; a few long texts stay a small batch.
BATCH_BYTES = 2 << 20
#: The white space that separates words.
SPACE = r"[\x20\x09-\x0D]+"


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, so that a Python worker's memory doesn't follow the longest texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with null texts as empty; other columns go, so their names can't clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below it."""
    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that ``shared_folder`` named."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_remainder(doc_id: int | None, modulus: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % modulus


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus)


def give_back() -> None:
    """Returns freed memory to the system: a worker is used again, and what one task needed is no other's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    library = ctypes.CDLL(None)
    if hasattr(library, "malloc_trim"):  # as in glibc
        library.malloc_trim(0)


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow with bounded batches; workers hand their memory back at the end of each task."""

    def bounded(batches):
        try:
            yield from function(batches)
        finally:
            give_back()

    bound_batches(df.sparkSession)
    ship(df.sparkSession)
    return df.mapInArrow(bounded, schema)


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
