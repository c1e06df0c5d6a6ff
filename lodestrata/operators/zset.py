"""Multisets of rows with signed multiplicities, as DataFrames with one more column.

``ZSet`` is the stand-alone operator library: every method returns a new lazy ZSet. A change is a ZSet whose
multiplicities may be negative; a state is one whose rows are all positive. Opaque Python functions are taken by the
methods ending in ``_rows`` (Arrow batches); everything else is Column expressions.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

MULT = "__mult"


def _columns(names: str | Sequence[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


class ZSet:
    def __init__(self, df: DataFrame):
        """``df`` without a multiplicity column has each row once for each time it stands there."""
        self.df = df if MULT in df.columns else df.withColumn(MULT, F.lit(1).cast("long"))

    @classmethod
    def of(cls, spark: SparkSession, rows: Iterable[tuple], schema: str) -> ZSet:
        """``rows`` are (row tuple, multiplicity) pairs."""
        return cls(spark.createDataFrame([(*r, int(m)) for r, m in rows], f"{schema}, {MULT} long"))

    @classmethod
    def from_json(cls, spark: SparkSession, texts: Iterable[str], schema: str) -> ZSet:
        names = spark.createDataFrame([], schema).columns
        return cls.of(spark, ((tuple(json.loads(t)[0].get(n) for n in names), json.loads(t)[1]) for t in texts), schema)

    def to_json(self) -> DataFrame:
        """One [row, multiplicity] text for each entry."""
        return self.df.select(F.concat(F.lit("["), F.to_json(F.struct(*self.columns)), F.lit(","), F.col(MULT).cast("string"), F.lit("]")).alias("value"))

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c != MULT]

    # rows

    def map(self, *columns: Column | str) -> ZSet:
        return ZSet(self.df.select(*columns, MULT))

    def map_rows(self, function: Callable, schema: str) -> ZSet:
        """``function`` takes an iterator of pandas frames (with the multiplicity column, which it keeps)."""
        return ZSet(self.df.mapInPandas(function, f"{schema}, {MULT} long"))

    def filter(self, condition: Column | str) -> ZSet:
        return ZSet(self.df.where(condition))

    def key_by(self, key: Column, name: str = "key") -> ZSet:
        return ZSet(self.df.withColumn(name, key))

    def unkey(self, name: str = "key") -> ZSet:
        return ZSet(self.df.drop(name))

    def rekey(self, key: Column, name: str = "key") -> ZSet:
        return self.unkey(name).key_by(key, name)

    def pipe(self, *steps: Callable[[ZSet], ZSet]) -> ZSet:
        return reduce(lambda z, f: f(z), steps, self)

    def tap(self, function: Callable[[DataFrame], None]) -> ZSet:
        """Passes on unchanged; the function sees the DataFrame."""
        function(self.df)
        return self

    def observe(self, name: str) -> ZSet:
        """Counts entries and net rows while the plan runs (see DataFrame.observe)."""
        return ZSet(self.df.observe(name, F.count(F.lit(1)).alias("entries"), F.sum(MULT).alias("net")))

    def debug(self, name: str, indent: bool = False, show: Callable[[str], None] = print) -> ZSet:
        for line in self.to_json().toLocalIterator():
            show(f"{name}: {json.dumps(json.loads(line.value), indent=2) if indent else line.value}")
        return self

    def output(self, function: Callable[[dict, int], None]) -> ZSet:
        """Calls back for every entry of the consolidated set, in the driver."""
        for row in self.consolidate().df.toLocalIterator():
            values = row.asDict()
            function({k: v for k, v in values.items() if k != MULT}, values[MULT])
        return self

    # multiplicities

    def concat(self, *others: ZSet) -> ZSet:
        return ZSet(reduce(DataFrame.unionByName, (o.df for o in others), self.df))

    def negate(self) -> ZSet:
        return ZSet(self.df.withColumn(MULT, -F.col(MULT)))

    def consolidate(self) -> ZSet:
        """Each row once, with its net multiplicity; rows that cancel out are gone."""
        return ZSet(self.df.groupBy(*self.columns).agg(F.sum(MULT).alias(MULT)).where(F.col(MULT) != 0))

    def distinct(self, by: str | Sequence[str] | None = None) -> ZSet:
        """Rows with a positive net multiplicity, once each; ``by``: the smallest such row of each key."""
        rows = self.consolidate().df.where(F.col(MULT) > 0).withColumn(MULT, F.lit(1).cast("long"))
        if by is None:
            return ZSet(rows)
        key = _columns(by)
        rest = [c for c in self.columns if c not in key]
        if not rest:
            return ZSet(rows)
        least = rows.groupBy(*key).agg(F.min(F.struct(*rest)).alias("least"))
        return ZSet(least.select(*(F.col(c) if c in key else F.col(f"least.{c}") for c in self.columns)))

    threshold = distinct

    def subtract(self, other: ZSet) -> ZSet:
        """What is left of each row after the other's are taken away, once each."""
        return self.concat(other.negate()).distinct()

    def intersect(self, other: ZSet) -> ZSet:
        return ZSet(self.distinct().df.drop(MULT).join(other.distinct().df.drop(MULT), self.columns, "left_semi"))

    def rows(self) -> DataFrame:
        """Plain rows: each as often as its net multiplicity says."""
        return self.consolidate().df.where(F.col(MULT) > 0).withColumn(MULT, F.explode(F.sequence(F.lit(1).cast("long"), F.col(MULT)))).drop(MULT)

    def size(self) -> int:
        return self.df.agg(F.coalesce(F.sum(MULT), F.lit(0)).alias("n")).first()["n"]

    def diff(self, newer: ZSet) -> ZSet:
        """The change that leads from this set to ``newer``."""
        return newer.concat(self.negate()).consolidate()

    def index(self, keys: str | Sequence[str]) -> Index:
        return Index(self, _columns(keys))

    # joins

    def join(self, other: ZSet, on: str | Sequence[str], how: str = "inner") -> ZSet:
        """inner, left, right, full or anti. A row that has no partner keeps its multiplicity, with nulls."""
        keys = _columns(on)
        if how == "anti":
            return self.anti_join(other, on)
        right = other.df.withColumnRenamed(MULT, "__other")
        both = self.df.join(right, keys, how)
        net = F.coalesce(MULT, F.lit(1)) * F.coalesce("__other", F.lit(1))
        return ZSet(both.withColumn(MULT, net.cast("long")).drop("__other"))

    def inner_join(self, other: ZSet, on: str | Sequence[str]) -> ZSet:
        return self.join(other, on, "inner")

    def left_join(self, other: ZSet, on: str | Sequence[str]) -> ZSet:
        return self.join(other.consolidate(), on, "left")

    def right_join(self, other: ZSet, on: str | Sequence[str]) -> ZSet:
        return self.consolidate().join(other, on, "right")

    def full_join(self, other: ZSet, on: str | Sequence[str]) -> ZSet:
        return self.consolidate().join(other.consolidate(), on, "full")

    def anti_join(self, other: ZSet, on: str | Sequence[str]) -> ZSet:
        """Rows whose key has no net mass on the other side."""
        keys = _columns(on)
        mass = other.df.groupBy(*keys).agg(F.sum(MULT).alias("__mass")).where("__mass != 0").select(*keys)
        return ZSet(self.df.join(mass, keys, "left_anti"))

    def filter_by(self, other: ZSet, on: str | Sequence[str]) -> ZSet:
        """Rows whose key the other side has, times its multiplicity."""
        keys = _columns(on)
        mass = other.df.groupBy(*keys).agg(F.sum(MULT).alias("__mass"))
        return ZSet(self.df.join(mass, keys).withColumn(MULT, F.col(MULT) * F.col("__mass")).drop("__mass")).consolidate()

    @staticmethod
    def join_delta(left: ZSet, left_change: ZSet, right: ZSet, right_change: ZSet, on: str | Sequence[str]) -> ZSet:
        """How the inner join of (left, right) changes: dA*B + A*dB + dA*dB."""
        return left_change.inner_join(right, on).concat(left.inner_join(right_change, on), left_change.inner_join(right_change, on)).consolidate()

    # aggregates

    def group_by(self, keys: str | Sequence[str], **aggregates: Aggregate) -> ZSet:
        """One row for each key with a positive net multiplicity: key columns and the named aggregates."""
        keys, rows = _columns(keys), self.df
        if any(a.per_row for a in aggregates.values()):
            rows = self.consolidate().df.where(F.col(MULT) > 0)
        grouped = rows.groupBy(*keys).agg(F.sum(MULT).alias("__net"), *(a.build(F.col(MULT)).alias(n) for n, a in aggregates.items() if not a.exploded))
        grouped = grouped.where("__net > 0").drop("__net")
        for name, a in aggregates.items():
            if a.exploded:  # exact order statistics weigh a value by its net multiplicity
                grouped = _left(grouped, a.exploded(self, keys, name), keys)
        return ZSet(grouped.select(*keys, *aggregates))

    def count(self, keys: str | Sequence[str]) -> ZSet:
        return self.group_by(keys, count=rows_count())

    def reduce(self, keys: str | Sequence[str], function: Callable, schema: str) -> ZSet:
        """An opaque function of each key's pandas frame of values and multiplicities; prefer group_by."""
        return ZSet(self.consolidate().df.groupBy(*_columns(keys)).applyInPandas(function, f"{schema}, {MULT} long"))

    def min_by_key(self, keys: str | Sequence[str], value: str) -> ZSet:
        return self.group_by(keys, **{value: minimum(value)})

    # order

    def top_k(self, keys: str | Sequence[str], order: Sequence[Column], limit: int | None = None, offset: int = 0, index: str | None = None) -> ZSet:
        """The rows at ``offset`` and on of each key; a row takes one place whatever its multiplicity. ``index``: also its place."""
        ranked = self.ranked(keys, order)
        kept = F.col("__place") >= offset
        if limit is not None:
            kept = kept & (F.col("__place") < offset + limit)
        out = ranked.where(kept)
        return ZSet(out.withColumnRenamed("__place", index) if index else out.drop("__place"))

    def ranked(self, keys: str | Sequence[str], order: Sequence[Column]) -> DataFrame:
        """Positive rows with their place (from 0) in their key's order; ties by all columns."""
        rows = self.consolidate().df.where(F.col(MULT) > 0)
        window = Window.partitionBy(*_columns(keys)).orderBy(*order, *(F.col(c) for c in self.columns))
        return rows.withColumn("__place", F.row_number().over(window).cast("long") - 1)

    def order_by(self, order: Sequence[Column], limit: int | None = None, offset: int = 0) -> ZSet:
        """A global order with limit and offset; nothing is ranked beyond them."""
        rows = self.consolidate().df.where(F.col(MULT) > 0).orderBy(*order, *(F.col(c) for c in self.columns))
        rows = rows.offset(offset) if offset else rows
        return ZSet(rows.limit(limit) if limit is not None else rows)

    def order_by_with_index(self, order: Sequence[Column], limit: int | None = None, offset: int = 0, index: str = "index") -> ZSet:
        """``order_by`` with each row's place. Places count over range partitions, so no task sees all rows."""
        from .ordering import with_places

        rows = self.order_by(order, limit, offset)
        return ZSet(with_places(rows.df, [*order, *(F.col(c) for c in self.columns)], index, offset))

    def order_by_with_fractional_index(self, order: Sequence[Column], limit: int | None = None, offset: int = 0, index: str = "index") -> ZSet:
        """An index whose text order is the rows' order; see ``fractional.FractionalOrder`` for one that outlives changes."""
        from .fractional import FractionalOrder

        return ZSet(FractionalOrder(self.order_by(order, limit, offset), order).rows.withColumnRenamed("index", index))

    def grouped_order_by_with_fractional_index(self, keys: str | Sequence[str], order: Sequence[Column], limit: int | None = None, offset: int = 0, index: str = "index") -> ZSet:
        from .fractional import FractionalOrder

        return ZSet(FractionalOrder(self.top_k(keys, order, limit, offset), order, _columns(keys)).rows.withColumnRenamed("index", index))


class Index:
    """A multiset by key: rows under keys, net masses, changes, and joins with another by the same key."""

    def __init__(self, rows: ZSet, keys: list[str]):
        self.rows, self.keys = rows.consolidate(), keys

    def get(self, keys: DataFrame) -> ZSet:
        """The entries under the given keys."""
        return ZSet(self.rows.df.join(keys.select(*self.keys).distinct(), self.keys, "left_semi"))

    def has(self, keys: DataFrame) -> DataFrame:
        """The given keys that have entries."""
        return keys.join(self.rows.df.select(*self.keys), self.keys, "left_semi")

    def masses(self) -> ZSet:
        """Each key's net number of rows (``mass``) and number of entries."""
        return ZSet(self.rows.df.groupBy(*self.keys).agg(F.sum(MULT).alias("mass"), F.count(F.lit(1)).alias("entries")))

    def append(self, change: ZSet) -> Index:
        return Index(self.rows.concat(change), self.keys)

    def join(self, other: Index) -> ZSet:
        return self.rows.inner_join(other.rows, self.keys)


def _left(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right, keys, "left") if keys else left.join(right, F.lit(True), "left")


class Aggregate:
    """How a column of ``group_by`` comes about; ``build`` gets the multiplicity."""

    def __init__(self, build: Callable[[Column], Column] | None = None, per_row: bool = False, exploded: Callable | None = None):
        self.build, self.per_row, self.exploded = build, per_row, exploded


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def total(value: Column | str) -> Aggregate:
    return Aggregate(lambda m: F.sum(_column(value) * m))


def rows_count() -> Aggregate:
    return Aggregate(lambda m: F.sum(m))


def count(value: Column | str) -> Aggregate:
    """Values that aren't null."""
    return Aggregate(lambda m: F.coalesce(F.sum(F.when(_column(value).isNotNull(), m)), F.lit(0)).cast("long"))


def average(value: Column | str) -> Aggregate:
    return Aggregate(lambda m: F.sum(_column(value) * m) / F.sum(F.when(_column(value).isNotNull(), m)))


def minimum(value: Column | str) -> Aggregate:
    return Aggregate(lambda m: F.min(_column(value)), per_row=True)


def maximum(value: Column | str) -> Aggregate:
    return Aggregate(lambda m: F.max(_column(value)), per_row=True)


def _weighted(z: ZSet, keys: list[str], value: Column | str) -> DataFrame:
    return z.df.select(*keys, _column(value).alias("__value"), MULT).where("__value IS NOT NULL").groupBy(*keys, "__value").agg(F.sum(MULT).alias("__n")).where("__n > 0")


def median(value: Column | str) -> Aggregate:
    """Exact; the mean of the two middle values where their number is even; 0 without values."""

    def build(z: ZSet, keys: list[str], name: str) -> DataFrame:
        weighted = _weighted(z, keys, value)
        # the exact percentile takes frequencies, so no row is repeated
        return weighted.groupBy(*keys).agg(F.coalesce(F.percentile(F.col("__value").cast("double"), F.lit(0.5), F.col("__n")), F.lit(0.0)).alias(name))

    return Aggregate(exploded=build)


def mode(value: Column | str) -> Aggregate:
    """The most frequent value; of several, the smallest."""

    def build(z: ZSet, keys: list[str], name: str) -> DataFrame:
        counted = _weighted(z, keys, value)
        most = counted.groupBy(*keys).agg(F.max("__n").alias("__most"))
        top = counted.join(most, keys) if keys else counted.join(most, F.lit(True))
        return top.where("__n = __most").groupBy(*keys).agg(F.min("__value").alias(name))

    return Aggregate(exploded=build)


def custom(build: Callable[[Column], Column]) -> Aggregate:
    """Any aggregate expression of the multiplicity and the columns, a grouped pandas_udf included."""
    return Aggregate(build)
