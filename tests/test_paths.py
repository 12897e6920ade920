"""Shapes of paths are counted without the paths: against all paths of a plain walk, with loops and repeats, and at a hub."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import clausemine as cm
from clausemine.operators import paths
from clausemine.operators.generalize import distinct_rules, rules_of_shapes, shaped

AA, AB, BA, BB = ("a", "aa", "a"), ("a", "ab", "b"), ("b", "ba", "a"), ("b", "bb", "b")
TRIPLE = "draw_id long, head_id long, tail_id long, head_type string, tail_type string, relation string"


@pytest.fixture(scope="module")
def graph(spark):
    rng = random.Random(4)
    return cm.KnowledgeGraph.from_lists(spark, {"a": 1, "b": 1}, {t: [(rng.randrange(4), rng.randrange(4)) for _ in range(11)] for t in (AA, AB, BA, BB)})


@pytest.mark.parametrize("wide", [False, True])
def test_shapes_are_those_of_all_paths(spark, graph, monkeypatch, wide):
    if wide:  # lists of ids meet first, in several slices
        monkeypatch.setattr(paths, "WIDE", 0)
        monkeypatch.setattr(paths, "SLICE", 0.3)
    triples = spark.createDataFrame([(i, h, t, "a", "a", "likes") for i, (h, t) in enumerate([(0, 1), (2, 2), (3, 0)])], TRIPLE)
    every = cm.enumerate_paths(graph, triples, 1, 3).join(triples, "draw_id")
    want = Counter((r.head_id, r.tail_id, str(r.shape)) for r in shaped(every).collect())
    counts, shapes = paths.path_shapes(graph, triples, 1, 3)
    found = counts.join(shapes, "shape_no").collect()
    assert {(r.head_id, r.tail_id, str(r.shape)): r.times for r in found} == want and len(found) == len(want) > 12
    key = lambda r: (str(r.head), str(r.body), r.rule_type)
    rules = {key(r): (r.ord.head_id, r.ord.tail_id) for r in rules_of_shapes(counts, shapes, "likes").collect()}
    assert rules == {key(r): (r.ord.head_id, r.ord.tail_id) for r in distinct_rules(every, ["head_id", "tail_id", "variant"]).collect()}


def test_a_hub_costs_its_neighbours(spark, monkeypatch):
    """4,000 nodes at one hub: 16 million walks of two hops between them, which no table holds and no half makes."""
    n, made = 4_000, []
    spread = spark.range(n).select(F.col("id").alias("src"), F.lit(0).cast("long").alias("dst"))
    graph = cm.KnowledgeGraph.from_parts({"a": spark.range(n), "b": spark.range(1)}, {AB: spread, BA: spread.select("dst", "src"), AA: spark.range(n).select("id", F.col("id").alias("to"))})
    plain = paths.stored
    monkeypatch.setattr(paths, "stored", lambda df, name: (t := plain(df, name), made.append(t.count()))[0])
    halves = paths.counted_half
    monkeypatch.setattr(paths, "counted_half", lambda *a: (h := halves(*a), made.append(h[0].count() if h[0] else 0))[0])
    triples = spark.range(n).select(F.col("id").alias("draw_id"), F.col("id").alias("head_id"), ((F.col("id") + 1) % n).alias("tail_id"), F.lit("a").alias("head_type"), F.lit("a").alias("tail_type"), F.lit("r").alias("relation"))
    counts, shapes = paths.path_shapes(graph, triples, 3, 3)
    assert counts.agg(F.sum("times")).first()[0] == 2 * n and max(made) <= 4 * n  # aa ab ba and ab ba aa
