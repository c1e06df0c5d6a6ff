"""Exact deduplication by content sort, in DataFrame operations alone.

Texts are normalised (each run of white space is one space), then range-partitioned by sampled splitters and sorted;
equal texts come to stand side by side and are told apart by comparing each whole text with its neighbour.
A splitter is the first 64 characters, a 64-bit hash of the whole text (which orders texts that begin alike) and a salt
of the id, so what the driver samples has a fixed size, and a text with very many copies is spread over as many ranges as
there are. A row is told from the one before it alone, so no run is held. The sub-runs of a salted group are joined by
the text's digest afterwards, without the texts.

Defined results: a null text is empty; rows with a null doc_id are kept as rows of their group and only keep it if all
its ids are null; of repeated rows with the id that stays, each is marked kept by the report, and one stays in the table;
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .common import SPACE, durable, id_and_text, shuffle_partitions
from .rows import one_of_each, parted

#: Salts for each range: a text that is most of the table is spread over all of them.
SALTS_PER_RANGE = 2
HEAD = 64


def content_sort(docs: DataFrame) -> DataFrame:
    """doc_id, digest (binary) and salt of each row, and whether it is the first of its sub-run: its smallest id."""
    spark = docs.sparkSession
    ranges = shuffle_partitions(spark)
    sorted_by = ["head", "hash", "salt"]
    texts = id_and_text(docs).select("doc_id", F.regexp_replace("text", SPACE, " ").alias("norm"))
    texts = texts.select("doc_id", "norm", F.substring("norm", 1, HEAD).alias("head"), F.xxhash64("norm").alias("hash"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS_PER_RANGE * ranges)).cast("int").alias("salt"))
    ranged = texts.repartitionByRange(ranges, *sorted_by)
    # Range partitioning by (head, hash, salt) already holds the rows of a sub-run together: only a sort is added, and each
    # row is compared with its neighbour by the whole text.
    before = F.lag("norm").over(W.partitionBy(*sorted_by).orderBy("norm", F.col("doc_id").asc_nulls_last()))
    return ranged.select("doc_id", "salt", F.unhex(F.sha2("norm", 256)).alias("digest"), (~F.col("norm").eqNullSafe(before)).alias("first"))


def _grouped(docs: DataFrame) -> DataFrame:
    """doc_id, digest, keep_id, group_size of each row; small rows, read twice, while the texts are sorted once."""
    rows = durable(content_sort(docs))
    runs = rows.groupBy("digest", "salt").agg(F.min(F.when(F.col("first"), F.col("doc_id"))).alias("run_keep"), F.count(F.lit(1)).alias("run_size"))
    group = W.partitionBy("digest")
    groups = runs.select(F.col("digest").alias("d"), F.col("salt").alias("s"), F.min("run_keep").over(group).alias("keep_id"), F.sum("run_size").over(group).alias("group_size"))
    return rows.join(groups, (F.col("digest") == F.col("d")) & (F.col("salt") == F.col("s"))).select("doc_id", "digest", "keep_id", "group_size")


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    return _grouped(docs).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts, with all its columns: one with the smallest doc_id (null if all are).

    What goes is told by id and text together, so a row with another text under the same id stays. Only rows whose id
    loses a row are looked at again; the others aren't shuffled.
    """
    shared = durable(_grouped(docs).where("group_size > 1").groupBy("doc_id", "digest").agg(F.first(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), F.count(F.lit(1)).alias("n")))
    seen = docs.withColumn("__id", F.col("doc_id").cast("long"))
    maybe, others = parted(seen, "__id", shared.where("NOT kept OR n > 1").select(F.col("doc_id").alias("__id")))
    named = maybe.withColumn("__digest", F.unhex(F.sha2(F.regexp_replace(F.coalesce("text", F.lit("")), SPACE, " "), 256)))
    gone = shared.where("NOT kept").select(F.col("doc_id").alias("__gone"), F.col("digest").alias("__of"))
    kept = one_of_each(named, ["__id", "__digest"]).join(gone, F.col("__id").eqNullSafe(F.col("__gone")) & (F.col("__digest") == F.col("__of")), "left_anti")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return kept.select(*columns).unionAll(others.select(*columns))
