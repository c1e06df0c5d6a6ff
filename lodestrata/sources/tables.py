"""Binding host tables to relations: columns by position, in the relation's types."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def bind(table: DataFrame, *columns: str | Column) -> DataFrame:
    """The columns that a relation wants, in its order; names may repeat or clash."""
    return table.select(*(c if isinstance(c, Column) else F.expr(c) for c in columns)).toDF(*(f"c{k}" for k in range(len(columns))))


def warehouse(spark: SparkSession, folder: str) -> Mapping[str, DataFrame]:
    """The relations that the bundled queries read, over the star schema in ``folder``. Whole numbers are long, money
    is in cents."""
    t = lambda name: parquet(spark, folder, name)
    return {
        "Region": bind(t("region"), "cast(r_regionkey as long)", "r_name"),
        "Nation": bind(t("nation"), "cast(n_nationkey as long)", "n_name", "cast(n_regionkey as long)"),
        "Customer": bind(t("customer"), "c_custkey", "cast(c_nationkey as long)", "c_mktsegment"),
        "Supplier": bind(t("supplier"), "s_suppkey", "cast(s_nationkey as long)"),
        "Part": bind(t("part"), "p_partkey", "p_brand", "p_type", "cast(p_size as long)"),
        "Orders": bind(t("orders"), "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"),
        "Lineitem": bind(t("lineitem"), "l_orderkey", "l_partkey", "l_suppkey", "cast(l_quantity as long)", "cast(round(l_extendedprice * 100) as long)"),
        "Events": bind(t("events"), "event_id", "user_id", "event_type", "cast(round(value * 100) as long)"),
        "Conv": bind(t("conversations"), "conv_id", "turn", "role"),
    }
