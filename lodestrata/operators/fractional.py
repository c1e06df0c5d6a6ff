"""Fractional indexes: decimal digits behind a point that sort as text like the rows they belong to.

A row keeps its index for as long as it stays: a new row gets one strictly between those of its neighbours, with as many
more digits as that takes, and no other row's index changes. Rows that come together into one gap divide it evenly.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StringType

from ..plans.durable import durable
from ..shipping import ship
from .ordering import with_places
from .zset import MULT, ZSet

#: Digits beyond the number of rows that divide a gap.
SPARE_DIGITS = 1


def between(low: str | None, high: str | None, place: int, of: int) -> str:
    """The index of the place-th of ``of`` rows (from 0) that lie between two indexes; None is an open end."""
    digits = max(len(low or ""), len(high or "")) + len(str(of + 1)) + SPARE_DIGITS
    a = int((low or "").ljust(digits, "0"))
    b = int(high.ljust(digits, "0")) if high is not None else 10**digits
    return str(a + (b - a) * (place + 1) // (of + 1)).rjust(digits, "0").rstrip("0")


def evenly(place: Column, of: Column) -> Column:
    """The indexes of all rows of a new order, by their places from 0 and their number; as ``between`` without ends."""
    digits = F.length((of + 1).cast("string")) + F.lit(SPARE_DIGITS)
    scale = F.rpad(F.lit("1"), digits + 1, F.lit("0")).cast("decimal(19,0)")
    value = F.call_function("div", (place + 1).cast("decimal(19,0)") * scale, (of + 1).cast("decimal(19,0)"))
    return F.rtrim(F.lpad(value.cast("string"), digits, F.lit("0")), F.lit("0"))


class FractionalOrder:
    """Rows in an order (of each key, or of all), with indexes that stay. ``rows``: columns, multiplicity and ``index``."""

    def __init__(self, rows: ZSet, order: Sequence[Column], keys: Sequence[str] = ()):
        self.order, self.keys, self.columns = list(order), list(keys), rows.columns
        placed = self._placed(rows.consolidate().df.where(F.col(MULT) > 0))
        self.rows = durable(placed.select(*self.columns, MULT, evenly(F.col("__place"), F.col("__of")).alias("index")))

    def _by(self, columns: Sequence[str] = ()) -> list[Column]:
        return [*self.order, *(F.col(c) for c in columns or self.columns)]

    def _placed(self, rows: DataFrame) -> DataFrame:
        """``__place`` from 0 and ``__of``, the number of rows, of each key or of all."""
        if self.keys:
            whole = Window.partitionBy(*self.keys)
            return rows.withColumn("__place", F.row_number().over(whole.orderBy(*self._by())).cast("long") - 1).withColumn("__of", F.count(F.lit(1)).over(whole))
        out = durable(with_places(rows, self._by(), "__place"))
        return out.withColumn("__of", F.lit(out.count()))

    def update(self, change: ZSet) -> ZSet:
        """Applies a change; returns the rows, with their indexes, that came (+1) and went (-1)."""
        net = ZSet(change.df.select(*self.columns, MULT)).consolidate().df.withColumnRenamed(MULT, "__by")
        same = [F.col(f"s.{c}").eqNullSafe(F.col(f"n.{c}")) for c in self.columns]
        met = durable(net.alias("n").join(self.rows.alias("s"), reduce(lambda x, y: x & y, same), "left").select(*(F.col(f"n.{c}").alias(c) for c in self.columns), F.coalesce(f"s.{MULT}", F.lit(0)).alias("__had"), "__by", "index"))
        now = (F.col("__had") + F.col("__by")).alias(MULT)
        came = durable(self._between(met.where("__had = 0 AND __by > 0")).select(*self.columns, "__by", "index"))
        gone = met.where("__had > 0 AND __had + __by <= 0")
        changed = met.where("__had > 0 AND __had + __by > 0").select(*self.columns, now, "index").unionByName(came.withColumnRenamed("__by", MULT))
        touched = met.where("__had > 0").select(*self.columns)
        left = self.rows.alias("s").join(touched.alias("n"), reduce(lambda x, y: x & y, same), "left_anti")
        self.rows = durable(left.select(*self.columns, MULT, "index").unionByName(changed.select(*self.columns, MULT, "index")))
        one = lambda rows, sign: rows.select(*self.columns, "index", F.lit(sign).cast("long").alias(MULT))
        return ZSet(one(came, 1).unionByName(one(gone, -1)))

    def _between(self, new: DataFrame) -> DataFrame:
        """The new rows with an index between their neighbours' among the old ones."""
        old = self.rows.select(*self.columns, "index")
        if self.keys:  # the rows of other keys aren't looked at
            old = old.join(new.select(*self.keys).distinct(), self.keys, "left_semi")
        mixed = old.unionByName(new.select(*self.columns, F.lit(None).cast("string").alias("index")))
        if self.keys:
            part, carried = self.keys, mixed
        else:  # neighbours within a range of the order; the ranges' ends are a row for each partition
            part = ["__part"]
            carried = durable(mixed.repartitionByRange(*self._by()).withColumn("__part", F.spark_partition_id()))
        whole = Window.partitionBy(*part)
        following = F.lead("index").over(whole.orderBy(F.col("index").asc_nulls_last()))  # indexes are in the rows' order
        known = carried.withColumn("__next", following).withColumn("__least", F.min("index").over(whole))
        pair = F.last(F.when(F.col("index").isNotNull(), F.struct("index", "__next")), ignorenulls=True).over(whole.orderBy(*self._by()))
        seen = known.withColumn("__pair", pair).where("index IS NULL").withColumn("__low", F.col("__pair.index")).withColumn("__high", F.when(F.col("__pair").isNull(), F.col("__least")).otherwise(F.col("__pair.__next"))).drop("index", "__pair", "__next", "__least")
        if not self.keys:
            ends = sorted((r["__part"], r["lo"], r["hi"]) for r in carried.groupBy("__part").agg(F.min("index").alias("lo"), F.max("index").alias("hi")).collect() if r["lo"] is not None)
            parts = sorted({r["__part"] for r in carried.select("__part").distinct().collect()})
            reach = [(p, max((h for q, _, h in ends if q < p), default=None), min((lo for q, lo, _ in ends if q > p), default=None)) for p in parts]
            seen = seen.join(F.broadcast(old.sparkSession.createDataFrame(reach, "__part int, __before string, __behind string")), "__part")  # a row for each partition
            seen = seen.withColumn("__low", F.coalesce("__low", "__before")).withColumn("__high", F.coalesce("__high", "__behind")).drop("__part", "__before", "__behind")
        gap = [*self.keys, "__low", "__high"]
        placed = FractionalOrder._placed(self, seen) if not self.keys else seen.withColumn("__place", F.row_number().over(Window.partitionBy(*gap).orderBy(*self._by())).cast("long") - 1)
        sizes = placed.groupBy(*gap).agg(F.min("__place").alias("__from"), F.count(F.lit(1)).alias("__n"))
        joined = placed.drop("__of").alias("p").join(sizes.alias("z"), reduce(lambda x, y: x & y, [F.col(f"p.{c}").eqNullSafe(F.col(f"z.{c}")) for c in gap]))
        ship(old.sparkSession)
        index = F.pandas_udf(_indexes, StringType())(F.col("p.__low"), F.col("p.__high"), F.col("__place") - F.col("__from"), F.col("__n"))
        found = joined.select(*(F.col(f"p.{c}").alias(c) for c in self.columns), index.alias("index"))
        same = [F.col(f"f.{c}").eqNullSafe(F.col(f"n.{c}")) for c in self.columns]
        return new.drop("index").alias("n").join(found.alias("f"), reduce(lambda x, y: x & y, same)).select("n.*", "f.index")


def _indexes(low: pd.Series, high: pd.Series, place: pd.Series, of: pd.Series) -> pd.Series:
    return pd.Series([between(a, b, int(p), int(n)) for a, b, p, n in zip(low, high, place, of, strict=True)], dtype=object)
