"""Reach in words against sets, its store, hubs divided among tasks, and paths that meet in the middle against a plain walk."""

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

import clausemine as cm
from clausemine.operators import reach as reaching
from clausemine.operators.generalize import distinct_rules, generalize
from clausemine.operators.metrics import counted, flagged_reach

AB, BA, BC, AC = ("a", "ab", "b"), ("b", "ba", "a"), ("b", "bc", "c"), ("a", "ac", "c")
CHAINS = [(AB,), (AB, BC), (AB, BA, AC), (AB, BA, AB, BC), (AB, BA), (AC,)]


@pytest.fixture(scope="module")
def edges():
    rng = random.Random(3)
    draw = lambda n, a, b: [(rng.randrange(-a, a), rng.randrange(-b, b)) for _ in range(n)]
    return {AB: draw(60, 20, 90), BA: draw(40, 90, 20), BC: draw(70, 90, 200), AC: draw(50, 20, 200)}


@pytest.fixture(scope="module")
def graph(spark, edges):
    return cm.KnowledgeGraph.from_lists(spark, {"a": 1, "b": 1, "c": 1}, edges)


def pairs_of(edges, chain):
    pairs = set(edges[chain[0]])
    for t in chain[1:]:
        pairs = {(s, d) for s, m in pairs for n, d in edges[t] if n == m}
    return pairs


def test_reach_equals_sets(graph, edges):
    got = [tuple(r) for r in reaching.reach(graph, CHAINS).select("chain", "src", "dst").collect()]
    assert len(set(got)) == len(got)
    assert set(got) == {(i, *p) for i, c in enumerate(CHAINS) for p in pairs_of(edges, c)}


@pytest.mark.parametrize("by", [None, "src", "dst"])
def test_counts_equal_sets(graph, edges, by):
    wanted = [(c, AC) for c in CHAINS[1:3]] + [(CHAINS[1], AB)]
    got = {tuple(r) for r in counted(flagged_reach(graph, wanted), by).collect()}
    want = set()
    for i, (c, head) in enumerate(wanted):
        pairs, known = pairs_of(edges, c), set(edges[head])
        for key in {None} if by is None else {p[by == "dst"] for p in pairs}:
            some = {p for p in pairs if key is None or p[by == "dst"] == key}
            want.add((i, *([] if by is None else [key]), len(some), len(some & known)))
    assert got == want


def test_each_chain_is_computed_once(graph, edges, monkeypatch):
    asked, plain = [], reaching.words
    monkeypatch.setattr(reaching, "words", lambda g, chains: asked.extend(chains) or plain(g, chains))
    store = cm.ReachStore(graph)
    for some in (CHAINS[:2], CHAINS[1:4], CHAINS[::-1]):
        got = {tuple(r) for r in reaching.unpacked(store.words(some)).select("chain", "src", "dst").collect()}
        assert got == {(i, *p) for i, c in enumerate(some) for p in pairs_of(edges, c)}
    assert sorted(asked) == sorted(CHAINS)


def test_batches_share_reach(spark, graph, monkeypatch):
    asked, plain = [], reaching.words
    monkeypatch.setattr(reaching, "words", lambda g, chains: asked.extend(chains) or plain(g, chains))
    x, y = cm.Term.variable("X", "a"), cm.Term.variable("Y", "c")
    z = [cm.Term.variable(f"Z{i}", t) for i, t in enumerate("ba")]
    bodies = [(cm.Atom("ab", x, z[0]), cm.Atom("bc", z[0], y)), (cm.Atom("ab", x, z[0]), cm.Atom("ba", z[0], z[1]), cm.Atom("ac", z[1], y))]
    rules = [cm.Rule(cm.Atom("ac", x, y), b) for b in bodies] + [cm.Rule(cm.Atom("ac", cm.Term.constant(i, "a"), y), bodies[i % 2]) for i in range(6)]
    frame, config = cm.rules_frame(spark, rules), cm.RuleConfig(1, 0.0, 0.0)
    every = cm.evaluate_batch(graph, frame, config).orderBy("ord").collect()
    asked.clear()
    few = cm.evaluate_batch(graph, frame, config, max_results=len(every), batch=2).collect()
    assert [r.ord for r in few] == [r.ord for r in every] and sorted(asked) == sorted([(AB, BC), (AB, BA, AC)])


def test_a_trie_of_many_chains_is_made_in_one_pass():
    rng = random.Random(2)
    types = [(f"t{i}", "r", f"t{j}") for i in range(10) for j in range(10)]
    chains = list({tuple(rng.choice(types) for _ in range(rng.randint(1, 4))) for _ in range(10_500)})[:10_000]
    began = time.process_time()
    trie = reaching.Trie(chains)
    assert time.process_time() - began < 1
    assert sum(len(v) for ends in trie.ends for v in ends.values()) == len(chains)


def test_a_hub_is_divided_among_tasks(spark):
    """One node has half of all edges and half of all pairs stand at it: no task of the join makes over five times the median's rows."""
    n = 40_000
    edges = spark.range(2 * n).select(F.when(F.col("id") < n, 0).otherwise(F.col("id")).alias("from"), F.col("id").alias("to"))
    state = spark.range(200).select(F.when(F.col("id") < 100, 0).otherwise(F.col("id") + n).alias("at"), F.col("id").alias("start"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = reaching.met(state, edges)
        rows = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(rows) == 100 * n + 100 and got.distinct().count() == sum(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(rows) == 8 and max(rows) <= 5 * sorted(rows)[len(rows) // 2]


def plain_paths(edges, head, tail, low, high):
    out, walkers = Counter(), [((head, "a"), ())]
    for hop in range(1, high + 1):
        moved = []
        for (node, kind), path in walkers:
            for t, links in edges.items():
                if t[0] == kind:
                    for s, d in set(links):
                        if s == node:
                            whole = (*path, (node, kind, t[1]))
                            if (d, t[2]) == (tail, "a") and hop >= low:
                                out[(*whole, (d, "a", ""))] += 1
                            else:
                                moved.append(((d, t[2]), whole))
        walkers = moved
    return out


def test_paths_that_meet_in_the_middle_equal_a_plain_walk(spark, edges, graph):
    ends = [(0, 1, 1), (1, 1, 1), (2, 3, -4), (3, 3, -4), (4, 7, 7), (5, -2, 5)]  # repeated ends and loops
    triples = spark.createDataFrame([(i, h, t, "a", "a", "r") for i, h, t in ends], "draw_id long, head_id long, tail_id long, head_type string, tail_type string, relation string")
    for low, high in ((1, 4), (2, 4), (3, 3)):
        got = Counter((r.draw_id, tuple((s.entity_id, s.node_type, s.relation) for s in r.path)) for r in cm.enumerate_paths(graph, triples, low, high).collect())
        assert got == Counter({(i, p): n for i, h, t in ends for p, n in plain_paths(edges, h, t, low, high).items()})


def test_distinct_rules_are_the_rules_of_all_paths(spark, edges, graph):
    triples = spark.createDataFrame([(i, i % 5, i % 7, "a", "a", "likes") for i in range(30)], "draw_id long, head_id long, tail_id long, head_type string, tail_type string, relation string")
    paths = cm.enumerate_paths(graph, triples, 2, 4).join(triples.select("draw_id", "relation", "head_type", "tail_type"), "draw_id")
    for drop in (True, False):
        every = generalize(paths, drop).select("head", "body", "rule_type", "draw_id").collect()
        firsts: dict = {}
        for r in every:
            key = str((r.head, r.body, r.rule_type))
            firsts[key] = min(firsts.get(key, r.draw_id), r.draw_id)
        got = distinct_rules(paths, ["draw_id", "variant"], drop).collect()
        assert len(got) == len(firsts) and {str((r.head, r.body, r.rule_type)): r.ord.draw_id for r in got} == firsts
