"""Levels of calls against plain Python, for chains, trees, joints and cycles."""

import random

from pyspark.sql import functions as F

from siteline.llm import toolcalls


def brute(nodes, edges):
    """Longest path from a call without dependencies; None in or behind a cycle."""
    needs = {x: {b for a, b in edges if a == x and b in nodes} for x in nodes}
    level = {}
    for _ in nodes:
        for x in nodes:
            if x not in level and needs[x] <= level.keys():
                level[x] = max((level[y] + 1 for y in needs[x]), default=0)
    return {x: level.get(x) for x in nodes}


def check(spark, nodes, edges):
    calls = spark.createDataFrame([(x,) for x in nodes], "call_id string")
    own = spark.createDataFrame(edges, "call_id string, needs string")
    got = {r["call_id"]: r["level"] for r in toolcalls.levels(calls, own).collect()}
    assert got == brute(nodes, edges)


def test_levels_of_chains_and_joints(spark):
    r = random.Random(3)
    nodes = [f"c{k}" for k in range(120)]
    chain = [(f"c{k}", f"c{k - 1}") for k in range(1, 60)]
    tree = [(f"c{k}", f"c{r.randrange(60, k)}") for k in range(61, 90)]
    joint = [(f"c{k}", f"c{r.randrange(0, k)}") for k in range(90, 116) for _ in range(2)]
    cycle = [("c116", "c117"), ("c117", "c116"), ("c118", "c116"), ("c119", "c118"), ("c119", "c5"), ("c119", "nowhere"), ("c7", None)]
    check(spark, nodes, chain + tree + joint + cycle)


def test_levels_of_cycles_through_joints(spark):
    nodes = list("abcdefg")
    check(spark, nodes, [("a", "b"), ("a", "c"), ("b", "a"), ("b", "c"), ("d", "a"), ("e", "c"), ("e", "f"), ("g", "g")])


def test_rounds_grow_with_the_logarithm(spark):
    n = 700
    single = spark.range(1, n).select(F.concat(F.lit("c"), F.col("id")).alias("call_id"), F.concat(F.lit("c"), F.col("id") - 1).alias("needs"))
    got = {r["call_id"]: (r["ptr"], r["dist"]) for r in toolcalls.chains(single).collect()}
    assert got == {f"c{k}": ("c0", k) for k in range(1, n)}


def test_empty_and_null(spark):
    calls = spark.createDataFrame([], "conv_id long, turn long, call_id string, name string, arguments string, level int")
    results = spark.createDataFrame([], "conv_id long, turn long, call_id string, content string")
    edges = spark.createDataFrame([], "call_id string, needs string")
    schemas = spark.createDataFrame([], "name string, parameter string, type string, required boolean")
    assert toolcalls.link(calls, results, edges, schemas).count() == 0
    some = spark.createDataFrame([(None, None, "a", None, None, 1), (None, 1, None, "f", "{}", 1), (None, None, "b", None, "{}", 1), (2, 1, "c", "f", "", 1)], calls.schema)
    out = {r["call_id"]: r for r in toolcalls.link(some, results, edges, schemas).collect()}
    assert set(out) == {"a", "b", "c"} and {out[x]["place"] for x in "ab"} == {1, 2} and out["c"]["errors"] == "not an object"
