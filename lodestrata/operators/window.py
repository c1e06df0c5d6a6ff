"""A top-k window that can be moved: an order with stable indexes is kept, moves read it again and report what enters and leaves."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .fractional import FractionalOrder
from .zset import MULT, ZSet


class MovableWindow:
    def __init__(self, rows: ZSet, keys: Sequence[str], order: Sequence[Column], limit: int, offset: int = 0, on_size: Callable[[Callable[[], int]], None] | None = None):
        self.keys, self.limit, self.offset = list(keys), limit, offset
        self.ordered = FractionalOrder(rows, order, keys)
        if on_size:  # as in a subscription: the caller may ask for the size whenever it likes
            on_size(self.size)

    def _slice(self, touched: DataFrame | None = None) -> ZSet:
        """The rows at ``offset`` and on, ``limit`` at most, of each key (of the touched ones) or of all."""
        rows = self.ordered.rows.drop(MULT)
        if not self.keys:
            out = rows.orderBy("index")
            out = (out.offset(self.offset) if self.offset else out).limit(self.limit)
        else:
            rows = rows if touched is None else rows.join(touched, self.keys, "left_semi")
            place = F.row_number().over(Window.partitionBy(*self.keys).orderBy("index"))
            out = rows.withColumn("__place", place).where((F.col("__place") > self.offset) & (F.col("__place") <= self.offset + self.limit)).drop("__place")
        return ZSet(out.withColumn(MULT, F.lit(1).cast("long")))

    def size(self) -> int:
        return self.ordered.rows.count()

    def rows(self) -> DataFrame:
        return self._slice().df.drop(MULT)

    def move(self, offset: int | None = None, limit: int | None = None) -> ZSet:
        """The change of the window's rows."""
        before = self._slice()
        self.offset, self.limit = self.offset if offset is None else offset, self.limit if limit is None else limit
        return before.diff(self._slice())

    def update(self, change: ZSet) -> ZSet:
        """Applies a change to the rows; returns the change of the window's rows. No row's index moves."""
        touched = change.df.select(*self.keys).distinct() if self.keys else None
        before = self._slice(touched)
        self.ordered.update(change)
        return before.diff(self._slice(touched))
