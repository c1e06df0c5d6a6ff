"""Global row numbers without a single task: range partitions are counted, then numbered from where they start."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.durable import durable


def with_places(df: DataFrame, order: Sequence[Column], name: str, first: int = 0) -> DataFrame:
    """``df`` with each row's place in ``order``. Only one number for each partition reaches the driver."""
    ranged = durable(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id()))
    sizes = sorted((r["__part"], r["n"]) for r in ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect())
    starts, at = [], first
    for part, n in sizes:
        starts.append((part, at))
        at += n
    begins = F.broadcast(df.sparkSession.createDataFrame(starts, "__part int, __begin long"))  # a row for each partition
    own = F.row_number().over(Window.partitionBy("__part").orderBy("__row")) - 1
    numbered = ranged.withColumn("__own", own).join(begins, "__part")
    return numbered.withColumn(name, (F.col("__begin") + F.col("__own")).cast("long")).drop("__part", "__row", "__own", "__begin")
