"""Ancestors by pointer jumping against plain walks, and on a very deep chain."""

import random

import pytest
from pyspark.sql import functions as F

from namemine.operators import ancestry, graphs, usages


def made_forest(seed, n=120, roots=3, deep=0.5):
    draw = random.Random(seed)
    parent = {}
    for i in range(n):
        parent[i] = None if i < roots else i - 1 if draw.random() < deep and i > roots else draw.randrange(i)
    return parent


def above(parent, v):
    out = []
    while v is not None:
        out.append(v)
        v = parent[v]
    return out


def table(spark, parent):
    return spark.createDataFrame(list(parent.items()), "node_id long, parent_id long").repartition(4)


def ids(spark, nodes):
    return spark.createDataFrame([(v,) for v in nodes], "node_id long")


@pytest.mark.parametrize("seed", [1, 2])
def test_nearest_and_enclosing(spark, seed):
    parent = made_forest(seed, deep=0.3 * seed)
    draw = random.Random(seed)
    marked, wanted = set(draw.sample(range(120), 25)), draw.sample(range(120), 60)
    ast = table(spark, parent)
    near = {r.node_id: r.anc for r in ancestry.nearest_marked(ast, ids(spark, [*marked, *marked])).collect()}
    assert near == {v: next((a for a in above(parent, v) if a in marked), None) for v in parent}
    pairs = [(r.anc, r.node_id) for r in ancestry.enclosing(ast, ids(spark, marked), ids(spark, [*wanted, *wanted])).collect()]
    assert sorted(pairs) == sorted((a, v) for v in wanted for a in above(parent, v) if a in marked)
    assert ancestry.enclosing(ast, ids(spark, []), ids(spark, wanted)).count() == 0


@pytest.mark.parametrize("seed", [3, 4])
def test_common_ancestors(spark, seed):
    parent = made_forest(seed, roots=2, deep=0.2 * seed)
    draw = random.Random(seed)
    groups = {f"g{i}": {draw.randrange(120) for _ in range(draw.choice([1, 2, 2, 3, 9]))} for i in range(60)}
    groups["root"] = {0, 5}
    rows = [(g, v) for g, members in groups.items() for v in members] * 2
    got = {r.decl_id: r.anc for r in ancestry.common_ancestors(table(spark, parent), spark.createDataFrame(rows, "decl_id string, node_id long")).collect()}
    want = {}
    for g, members in groups.items():
        common = set.intersection(*[set(above(parent, v)[1:]) for v in members])
        if common:
            want[g] = max(common, key=lambda a: len(above(parent, a)))
    assert got == want and "root" not in got


def test_a_very_deep_chain(spark):
    n = 100_000
    ast = spark.range(n).select(F.col("id").alias("node_id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"))
    levels, depth = ancestry.jumps(ast)
    assert len(levels) == 17 and depth.where("depth != node_id").isEmpty()
    uses = spark.createDataFrame([("a", n - 1), ("a", 70_001), ("b", 5), ("c", 0), ("c", 9)], "decl_id string, node_id long")
    assert {(r.decl_id, r.scope_root) for r in usages.scope_root(uses, ast).collect()} == {("a", 70_000), ("b", 4)}
    typed = ast.withColumn("raw_type", F.when(F.col("node_id") == 3, "MethodDeclaration").otherwise("Block"))
    ends = spark.createDataFrame([(0, n - 1), (0, 2)], "graph_id long, node_id long")
    assert [(r.src, r.dst) for r in graphs.returns_to(ends, typed).collect()] == [(n - 1, 3)]
    inside = ancestry.enclosing(ast, ids(spark, [10, 60_000]), ids(spark, [5, 50_000, n - 1]))
    assert {(r.anc, r.node_id) for r in inside.collect()} == {(10, 50_000), (10, n - 1), (60_000, n - 1)}


def test_odd_trees(spark):
    empty = spark.createDataFrame([], "node_id long, parent_id long")
    assert ancestry.nearest_marked(empty, ids(spark, [1])).count() == 0
    assert ancestry.common_ancestors(empty, spark.createDataFrame([("a", 1)], "decl_id string, node_id long")).count() == 0
    lost = spark.createDataFrame([(1, 99), (2, 1)], "node_id long, parent_id long")  # a parent that isn't in the table
    assert {r.node_id: r.anc for r in ancestry.nearest_marked(lost, ids(spark, [])).collect()} == {1: None, 2: None}
