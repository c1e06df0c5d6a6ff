"""Cutting lineage so that a lost executor can't undo it: checkpoints in the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F


def shared_base(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of this machine only where none is set and all run in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return base or tempfile.gettempdir() + "/lodestrata-checkpoints"


def durable(df: DataFrame) -> DataFrame:
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_base(df.sparkSession))
    return df.checkpoint()


#: Rows up to which a counted frame goes on in one partition, so that small rounds of a loop don't pay for many tasks.
FEW_ROWS = 20_000


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """A durable frame and its number of rows, by one job."""
    seen = Observation()
    out = durable(df.observe(seen, F.count(F.lit(1)).alias("n")))
    n = seen.get["n"]
    return (out.coalesce(1) if n <= FEW_ROWS and out._jdf.queryExecution().toRdd().getNumPartitions() > 1 else out), n
