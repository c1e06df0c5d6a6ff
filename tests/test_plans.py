"""What reaches the scan and the shuffle."""

import re

import pytest
from pyspark.sql import functions as F, types as T

from lodestrata.functions.types import ColumnType, register_type
from lodestrata.plans.executor import Engine
from lodestrata.plans.parser import parse_program, parse_rule
from lodestrata.plans.planner import core_atoms, join_order
from lodestrata.plans.strata import stratify, waves
from lodestrata.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(QUERIES["proj_filter_const"](spark, SF))
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in text
    assert re.search(r"ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>", text)


def test_sets_use_semi_joins_and_negation_anti_joins(spark):
    assert "LeftSemi" in plan(QUERIES["semi_noncore"](spark, SF))
    assert "LeftAnti" in plan(QUERIES["anti_single"](spark, SF))
    assert "Cartesian" not in plan(QUERIES["join_inner_4way"](spark, SF))


def test_top_k_has_no_single_partition(spark):
    assert "SinglePartition" not in plan(QUERIES["topk_per_key"](spark, SF))


def test_join_order():
    rule = parse_rule("R(a, d) :- A(a, b), C(c, d), B(b, c).")
    assert join_order(rule, False) == [0, 2, 1]
    assert join_order(parse_rule("R(a, d) :- A(a, b), B(b, c), C(c, d, 5)."), True) == [2, 1, 0]
    star = parse_rule("R(a, d) :- Big(a, b), Small(b, c), Middle(b, d).")
    assert join_order(star, True, {"Big": 10**9, "Small": 10**3, "Middle": 10**6}) == [1, 2, 0]
    assert join_order(star, True, {"Big": 10, "Small": 10, "Middle": 10}) == [0, 1, 2]
    assert [str(a) for a in core_atoms(parse_rule("R(y) :- Reach(x), Arc(x, y), Arc(x, y)."))] == ["Arc(x, y)"]


def test_strata_and_waves():
    program = parse_program(".in .decl E(x: number, y: number) .out .decl D(x: number) .rule A(x) :- E(x, _). B(x) :- E(_, x). C(x) :- A(x), !B(x). D(x) :- C(x). D(y) :- D(x), E(x, y).")
    strata = stratify(program)
    place = {h: i for i, s in enumerate(strata) for h in s.heads}
    assert place["A"] < place["C"] > place["B"] and place["D"] > place["C"]
    assert [s.recursive for s in strata if s.heads == ("D",)] == [True]
    assert [sorted(strata[i].heads[0] for i in wave) for wave in waves(strata, program)] == [["A", "B"], ["C"], ["D"]]


def test_more_column_types(spark):
    register_type(ColumnType("day", T.DateType(), str))
    days = spark.createDataFrame([(1, "2024-02-03")], "k long, d string").select("k", F.to_date("d"))
    out = Engine(spark).run(".in .decl A(k: number, d: day) .out .decl R(d: day) .rule R(d) :- A(_, d).", {"A": days})["R"]
    assert out.schema[0].dataType == T.DateType() and out.count() == 1


@pytest.mark.parametrize("name", ["tc_nonlinear", "sssp_min"])
def test_recursion_at_another_size(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
