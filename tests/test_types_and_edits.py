"""Types, flow facts and edits on small scripts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quarry.operators import code, edits, types
from quarry.plans.code_queries import sample_project


@pytest.fixture(scope="module")
def p(spark):
    return sample_project(spark)


def test_literal_types(spark):
    want = {"1": "int", "- 0x1F": "int", "1.5": "float", ".5": "float", '"a"': "String", '&"a"': "StringName", "true": "bool", "null": "null", "[ 1 ]": "Array", "{ }": "Dictionary", "Vector2 ( 1 , 2 )": "Vector2", "Node . new ( )": "Node", "a > b": "bool", "a if b > 1 else c": None, "x": None, "$Sprite": "Node"}
    rows = spark.createDataFrame([(k,) for k in want], "v string").select("v", types.literal_type(F.col("v")).alias("t")).collect()
    assert {r.v: r.t for r in rows} == want


def test_return_types(p):
    got = {(r.path, r.method): r.types for r in types.return_types(p.nodes).collect()}
    assert got["core/base.gd", "pick"] == ["String", "null"] and got["core/base.gd", "_ready"] == ["null"] and got["core/risky.gd", "measure"] == ["int"]


def test_parameters_agree(p):
    got = {(r.path, r.method): (r.types, r.agreed) for r in types.parameter_types(p.nodes, p.uses).collect()}
    assert got["core/risky.gd", "greet"] == (["String"], "String")


def test_conflicts_and_nulls(p):
    assert [(r.path, r.line, r.want, r.got) for r in types.type_conflicts(p.nodes).collect()] == [("core/risky.gd", 22, "int", "String")]
    narrowed = {(r.name, r.type, r.from_line, r.to_line) for r in types.narrowings(p.nodes).where("path = 'core/risky.gd'").collect()}
    assert narrowed == {("target", "not null", 11, 11), ("thing", "Node", 28, 28), ("thing", "has:step", 28, 28)}


def test_duck_types(p):
    got = {(r.path, r.name): (r.needs, r.fits) for r in types.duck_types(p.nodes, p.uses).collect()}
    assert got["core/risky.gd", "thing"][0] == ["has_method", "pick", "step"]


def test_unsafe_calls_and_connections(p):
    assert {(r.path, r.code) for r in code.unsafe_calls(p.uses).collect()} == {("core/risky.gd", "SEC010"), ("core/risky.gd", "SEC020")}
    assert [(r.signal, r.callback) for r in code.signal_connections(p.nodes, p.uses).collect()] == [("ready", "on_ready")]


def test_rename_plan(p):
    rows = edits.rename_plan(p.nodes, p.uses, "twice", "double").collect()
    assert {(r.path, r.line, r.confidence) for r in rows} == {("util/helper.gd", 5, "Strict"), ("core/child.gd", 11, "Strict")}


def test_changes_apply(spark):
    rows = [("abc", "abxc"), ("", "new"), ("same", "same"), ("aaa", "aa"), ("gone", ""), ("éa", "éb")]
    df = spark.createDataFrame(rows, "a string, b string").withColumn("c", edits.text_change(F.col("a"), F.col("b")))
    assert all(r.b == r.done for r in df.withColumn("done", edits.apply_change(F.col("a"), F.col("c"))).collect())


def test_formatting_is_stable(spark):
    text = "func f(a,b):  \n    var x = [1,2]\n\n\n\n\n\treturn x\n\n\n"
    once = spark.createDataFrame([(text,)], "t string").select(edits.formatted(F.col("t")).alias("t"))
    first = once.first().t
    assert first == "func f(a, b):\n\tvar x = [1, 2]\n\n\n\treturn x\n"
    assert once.select(edits.formatted(F.col("t")).alias("t")).first().t == first


def test_symbol_at(spark, p):
    points = spark.createDataFrame([("core/base.gd", 17), ("core/base.gd", 33)], "path string, line int")
    assert {(r.line, r.kind, r.name) for r in edits.symbol_at(p.nodes, points).collect()} == {(17, "assign", "count"), (33, "pass", None)}
