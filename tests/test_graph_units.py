"""Operators on small graphs whose results are known by hand."""

import pytest
from pyspark.sql import functions as F

import clausemine as cm
from clausemine.functions import rule_columns as R
from clausemine.operators.predict import known_pairs, ordered

LIVES, KNOWS, NEAR, BORN = ("person", "lives_in", "city"), ("person", "knows", "person"), ("city", "near", "city"), ("person", "born_in", "city")
X, Y, Z = cm.Term.variable("X", "person"), cm.Term.variable("Y", "city"), cm.Term.variable("Z0", "city")
BODY = (cm.Atom("born_in", X, Z), cm.Atom("near", Z, Y))
HEAD = cm.Atom("lives_in", X, Y)
CYCLIC = cm.Rule(HEAD, BODY)
AC2 = cm.Rule(HEAD, BODY[:1])


def subject(i):
    return cm.Rule(cm.Atom("lives_in", cm.Term.constant(i, "person"), Y), BODY)


def object_(i):
    return cm.Rule(cm.Atom("lives_in", X, cm.Term.constant(i, "city")), BODY)


@pytest.fixture(scope="module")
def simple(spark):
    """Five people and three cities."""
    return cm.KnowledgeGraph.from_lists(spark, {"person": 5, "city": 3}, {LIVES: [(0, 0), (0, 1), (1, 1), (2, 2), (3, 0), (4, 2)], KNOWS: [(0, 1), (1, 2), (2, 3), (3, 4), (4, 0)], NEAR: [(0, 1), (1, 2), (2, 0)]})


@pytest.fixture(scope="module")
def judged(spark):
    return cm.KnowledgeGraph.from_lists(spark, {"person": 4, "city": 3}, {LIVES: [(0, 0), (1, 1), (2, 2), (3, 0)], BORN: [(0, 0), (1, 1), (2, 0), (3, 2)], NEAR: [(0, 1), (1, 2), (2, 0)]})


@pytest.fixture(scope="module")
def perfect(spark):
    return cm.KnowledgeGraph.from_lists(spark, {"person": 3, "city": 3}, {LIVES: [(0, 1), (1, 2), (2, 0)], BORN: [(0, 0), (1, 1), (2, 2)], NEAR: [(0, 1), (1, 2), (2, 0)]})


def with_confidence(spark, *rules):
    """Rules as results of the given confidence."""
    frame = cm.rules_frame(spark, [r for r, _ in rules])
    table = spark.createDataFrame([(i, c) for i, (_, c) in enumerate(rules)], "ord long, confidence double")
    return frame.join(table, "ord")


def pairs_of(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_catalog_and_counts(simple):
    assert (simple.node_count("person"), simple.node_count("city")) == (5, 3)
    assert [simple.edge_count(t) for t in (LIVES, KNOWS, NEAR)] == [6, 5, 3]
    assert simple.total_edges().first()[0] == 14
    assert simple.node_types == ("person", "city") and simple.edge_types == (LIVES, KNOWS, NEAR)
    assert simple.outgoing_edge_types("person") == [LIVES, KNOWS] and simple.outgoing_edge_types("city") == [NEAR]
    assert [r.dst for r in simple.neighbors(0, LIVES).collect()] == [0, 1]
    assert simple.dangling().count() == 0


def test_unknown_and_empty_types(spark, simple):
    for call in (lambda: simple.edge_count(("a", "b", "c")), lambda: simple.node_count("x"), lambda: simple.neighbors(0, ("a", "b", "c")), lambda: simple.outgoing_edge_types("x"), lambda: simple.bag(("a", "b", "c"))):
        with pytest.raises(ValueError, match="unknown"):
            call()
    with pytest.raises(ValueError, match="at least one"):
        cm.KnowledgeGraph({}, {})
    with pytest.raises(ValueError, match="empty"):
        cm.KnowledgeGraph.from_lists(spark, {"a": 1}, {("a", "r", "a"): []})
    some = cm.KnowledgeGraph.from_lists(spark, {"a": 2}, {("a", "r", "a"): [(0, 1), (0, 1)], ("a", "s", "a"): []})
    assert some.edge_count(("a", "s", "a")) == 0 and some.edge_count(("a", "r", "a")) == 2
    assert some.adjacency(("a", "r", "a")).count() == 1
    assert some.outgoing_edge_types("a") == [("a", "r", "a")]
    for call in (lambda: some.adjacency(("a", "s", "a")), lambda: some.neighbors(0, ("a", "s", "a"))):
        with pytest.raises(ValueError, match="has no edges"):
            call()


def test_settings_are_checked():
    for bad in (
        lambda: cm.SamplerConfig(sample_size=0), lambda: cm.SamplerConfig(target_edge_type=("a", "b")), lambda: cm.SamplerConfig(target_edge_type=("a", 1, "b")),
        lambda: cm.SamplerConfig(strategy="uniform"), lambda: cm.WalkConfig(max_length=0), lambda: cm.WalkConfig(min_length=3, max_length=2), lambda: cm.WalkConfig(max_attempts=0),
        lambda: cm.RuleConfig(min_support=0), lambda: cm.RuleConfig(min_confidence=1.1), lambda: cm.RuleConfig(min_head_coverage=-0.1), lambda: cm.EvaluationConfig(k_values=(0,)), lambda: cm.MinerConfig(walk_strategy="x"),
    ):
        with pytest.raises(ValueError):
            bad()
    assert cm.MinerConfig().seed == cm.SamplerConfig().seed == cm.WalkConfig().seed == 42
    assert cm.MinerConfig().walker == cm.WalkConfig(4, 2, 700)


def test_unknown_strategies(simple):
    with pytest.raises(ValueError, match="unknown sampling"):
        cm.sample_triples(simple, cm.SamplerConfig(strategy=cm.WalkStrategy.RELATION_WEIGHTED))
    with pytest.raises(ValueError, match="unknown walk"):
        cm.random_walks(simple, cm.sample_triples(simple, cm.SamplerConfig(3)), cm.WalkConfig(strategy=cm.SamplingStrategy.RELATION_INVERSE))


@pytest.mark.parametrize("strategy", list(cm.SamplingStrategy))
def test_samples_are_edges_and_repeatable(simple, strategy):
    config = cm.SamplerConfig(100, strategy, 7)
    one, two = (sorted(map(tuple, cm.sample_triples(simple, config).collect())) for _ in range(2))
    assert one == two and len(one) == 14
    assert {(h, t, (a, r, b)) for _, h, t, a, b, r in one} <= {(r.src, r.dst, (r.src_type, r.relation, r.dst_type)) for r in simple.edges.collect()}


def test_sampling_a_target_type(simple):
    got = cm.sample_triples(simple, cm.SamplerConfig(100, cm.SamplingStrategy.RELATION_INVERSE, 1, NEAR)).collect()
    assert len(got) == 3 and {r.relation for r in got} == {"near"}


def walk_graph(spark, nodes, edges):
    return cm.KnowledgeGraph.from_lists(spark, nodes, edges)


def triple(spark, head, tail, head_type, tail_type, relation):
    return spark.createDataFrame([(0, head, tail, head_type, tail_type, relation)], "draw_id long, head_id long, tail_id long, head_type string, tail_type string, relation string")


def shape(row):
    return [(s.entity_id, s.node_type, s.relation) for s in row.path]


def test_walks_on_a_line_and_at_a_dead_end(spark):
    line = walk_graph(spark, {"A": 2, "B": 1}, {("A", "r1", "B"): [(0, 0)], ("B", "r2", "A"): [(0, 1)]})
    start = triple(spark, 0, 1, "A", "A", "x")
    got = cm.random_walks(line, start, cm.WalkConfig(4, 2, 5)).collect()
    assert [shape(r) for r in got] == [[(0, "A", "r1"), (0, "B", "r2"), (1, "A", "")]]
    assert cm.random_walks(line, start, cm.WalkConfig(4, 3, 5)).count() == 0
    end = walk_graph(spark, {"X": 2}, {("X", "rel", "X"): [(0, 1)]})
    assert cm.random_walks(end, triple(spark, 0, 0, "X", "X", "rel"), cm.WalkConfig(4, 2, 5)).count() == 0


@pytest.mark.parametrize(("head", "tail", "low", "high", "n"), [((0, "person"), (2, "person"), 2, 5, 1), ((0, "person"), (0, "city"), 2, 4, 5), ((0, "person"), (0, "person"), 2, 5, 1), ((0, "person"), (2, "city"), 2, 4, 4)])
def test_all_paths_and_that_walks_are_among_them(spark, simple, head, tail, low, high, n):
    start = triple(spark, head[0], tail[0], head[1], tail[1], "x")
    every = {tuple(shape(r)) for r in cm.enumerate_paths(simple, start, low, high).collect()}
    assert len(every) == n
    for strategy in cm.WalkStrategy:
        assert {tuple(shape(r)) for r in cm.random_walks(simple, start, cm.WalkConfig(high, low, 40, strategy)).collect()} <= every


PATH = "array<struct<entity_id: bigint, node_type: string, relation: string>>"


def generalized(spark, *steps, head="person", tail="city"):
    paths = spark.createDataFrame([(list(steps), "lives_in", head, tail)], f"path {PATH}, relation string, head_type string, tail_type string")
    return cm.generalize(paths)


def test_generalization(spark):
    rules = [cm.rule_of(r) for r in generalized(spark, (0, "person", "born_in"), (1, "city", "near"), (2, "city", "")).collect()]
    assert sorted(r.rule_type for r in rules) == ["ac1", "ac1", "cyclic"]
    assert str(next(r for r in rules if r.rule_type == "cyclic")) == "person_lives_in_city(X, Y) :- person_born_in_city(X, Z0), city_near_city(Z0, Y)"
    direct = generalized(spark, (0, "person", "lives_in"), (1, "city", "")).collect()
    assert [r.rule_type for r in direct] == ["ac1", "ac1"]  # the tautology is dropped, rules with a constant are not
    loop = generalized(spark, (0, "person", "knows"), (1, "person", "knows"), (0, "person", ""), tail="person").collect()
    assert {r.rule_type for r in loop} == {"ac2", "ac1"}
    with pytest.raises(Exception, match="at least one step"):
        generalized(spark).collect()


def test_rules_as_values_equal_rules_as_columns(spark):
    rules = [CYCLIC, AC2, subject(3), object_(1), cm.Rule(HEAD, (HEAD,))]
    rows = cm.rules_frame(spark, rules).select("*", R.shown_rule(F.col("head"), F.col("body")).alias("s"), R.tautological(F.col("head"), F.col("body")).alias("t"), R.variables(F.col("head"), F.col("body")).alias("v"), R.constants(F.col("head"), F.col("body")).alias("c"), R.rule_type(F.col("head"), F.col("body")).alias("kind")).orderBy("ord").collect()
    for rule, row in zip(rules, rows, strict=True):
        assert cm.rule_of(row) == rule and row.s == str(rule) and row.t == rule.is_tautological and row.kind == rule.rule_type
        assert set(row.v) == rule.variables and set(row.c) == {f"{t}:{i}" for i, t in rule.constants}
        assert cm.classify_rule(rule.head, rule.body) is rule.rule_type
    assert CYCLIC.length == 2 and HEAD.edge_signature == LIVES and str(cm.Term.constant(3, "city")) == "city:3"
    for bad in (lambda: cm.Term(cm.TermKind.VARIABLE, "a"), lambda: cm.Term(cm.TermKind.CONSTANT, "a"), lambda: cm.Term(cm.TermKind.VARIABLE, "a", "X", 1), lambda: cm.Term(cm.TermKind.CONSTANT, "a", "X", 1)):
        with pytest.raises(ValueError):
            bad()


JUDGED = [(CYCLIC, 1, 4, 0.25, 0.25), (subject(0), 0, 1, 0.0, 0.0), (subject(3), 1, 1, 1.0, 0.25), (object_(0), 1, 1, 1.0, 0.25), (object_(1), 0, 2, 0.0, 0.0), (object_(2), 0, 1, 0.0, 0.0), (AC2, 4, 12, 1 / 3, 1.0)]


def test_metrics_of_all_kinds_at_once(spark, judged, perfect):
    got = cm.evaluate(judged, cm.rules_frame(spark, [r for r, *_ in JUDGED])).orderBy("ord").collect()
    for row, (_, support, n, confidence, coverage) in zip(got, JUDGED, strict=True):
        assert (row.support, row.num_predictions) == (support, n)
        assert row.confidence == pytest.approx(confidence) and row.head_coverage == pytest.approx(coverage)
    got = cm.evaluate(perfect, cm.rules_frame(spark, [CYCLIC, AC2])).orderBy("ord").collect()
    assert [(r.support, r.num_predictions, r.head_coverage) for r in got] == [(3, 3, 1.0), (3, 9, 1.0)]


def test_bag_and_set_in_metrics(spark):
    """Repeated edges count for the head and for AC2, not for pairs."""
    graph = cm.KnowledgeGraph.from_lists(spark, {"person": 2, "city": 2}, {LIVES: [(0, 0), (0, 0), (1, 1)], BORN: [(0, 0), (0, 0)], NEAR: [(0, 0), (0, 1)]})
    cyclic, ac2 = cm.evaluate(graph, cm.rules_frame(spark, [CYCLIC, AC2])).orderBy("ord").collect()
    assert (cyclic.support, cyclic.num_predictions, cyclic.head_coverage) == (1, 2, pytest.approx(1 / 3))
    assert (ac2.support, ac2.num_predictions, ac2.head_coverage) == (2, 2, pytest.approx(2 / 3))


def test_batches_thresholds_and_trivial_rules(spark, judged):
    rules = cm.rules_frame(spark, [r for r, *_ in JUDGED])
    config = cm.RuleConfig(1, 0.2, 0.2)
    assert [r.ord for r in cm.evaluate_batch(judged, rules, config).orderBy("ord").collect()] == [0, 2, 3, 6]
    for batch in (1, 2, 100):
        assert [r.ord for r in cm.evaluate_batch(judged, rules, config, 2, batch).collect()] == [0, 2]
    nowhere = cm.Rule(HEAD, (cm.Atom("near", Z, Y), cm.Atom("near", Y, Z)))
    row = cm.evaluate(judged, cm.rules_frame(spark, [nowhere])).withColumn("trivial", cm.is_trivial(F.col("num_predictions"))).first()
    assert row.rule_type == "ac2" and not row.trivial
    with pytest.raises(ValueError, match="unknown edge type"):
        cm.evaluate(judged, cm.rules_frame(spark, [cm.Rule(HEAD, (cm.Atom("eats", X, Y),))]))
    assert cm.evaluate(judged, rules.filter("false")).count() == 0


def test_predictions(spark, judged):
    both = with_confidence(spark, (CYCLIC, 0.25), (object_(0), 0.5))
    got = {(r.head_id, r.tail_id): r.score for r in cm.predict(judged, both).collect()}
    assert got == {(0, 1): 0.25, (1, 2): 0.25, (2, 1): 0.25, (3, 0): pytest.approx(0.625)}
    assert pairs_of(cm.predict(judged, both, filter_known=True), "head_id", "tail_id") == {(0, 1), (1, 2), (2, 1)}
    assert pairs_of(cm.predict(judged, both, min_score=0.25), "head_id", "tail_id") == {(3, 0)}
    assert [(r.head_id, r.tail_id) for r in ordered(cm.predict(judged, both)).collect()] == [(3, 0), (0, 1), (1, 2), (2, 1)]
    mine = with_confidence(spark, (CYCLIC, 0.25), (subject(0), 0.5), (AC2, 0.9))
    tails = {r.tail_id: r.score for r in cm.score_tails(judged, mine, 0).collect()}
    assert tails == {0: 0.0, 1: pytest.approx(0.625), 2: 0.0}
    heads = {r.head_id: r.score for r in cm.score_heads(judged, mine, 1).collect()}
    assert heads == {0: pytest.approx(0.625), 1: 0.0, 2: 0.25, 3: 0.0}
    assert known_pairs(judged, LIVES).count() == 4


def test_predictor_guards(spark, judged):
    with pytest.raises(ValueError, match="no rules"):
        cm.predict(judged, with_confidence(spark, (CYCLIC, 0.5)).filter("false"))
    other = cm.Rule(cm.Atom("near", Z, Y), (cm.Atom("near", Z, Y),))
    with pytest.raises(ValueError, match="share one head"):
        cm.predict(judged, with_confidence(spark, (CYCLIC, 0.5), (other, 0.5)))


def ranked(spark, graph, filtered, results):
    tests = cm.KnowledgeGraph.linked(graph, LIVES).toDF("head_id", "tail_id").withColumn("test_id", F.col("head_id") * 10 + F.col("tail_id"))
    return cm.ranks(graph, cm.scores(graph, results), tests, LIVES, filtered)


def test_ranks_and_their_means(spark, judged, perfect):
    rule = with_confidence(spark, (CYCLIC, 0.25))
    want = {True: [(0, 2, 1), (1, 2, 3), (2, 2, 2), (3, 1, 1)], False: [(0, 2, 2), (1, 2, 3), (2, 2, 2), (3, 1, 1)]}
    means = {True: (0.666667, 0.375, 1.0), False: (0.604167, 0.25, 1.0)}
    for filtered in (True, False):
        rows = ranked(spark, judged, filtered, rule)
        got = {(r.head_id, r.side): r.rank for r in rows.collect()}
        assert got == {(h, s): r for h, t, a in want[filtered] for s, r in (("tail", t), ("head", a))}
        metrics = {r.k: r for r in cm.link_metrics(rows, cm.EvaluationConfig((1, 3), filtered)).collect()}
        assert (round(metrics[1].mrr, 6), metrics[1].hits, metrics[3].hits, metrics[1].num_queries) == (*means[filtered], 8)
        assert {r.rank for r in ranked(spark, perfect, filtered, with_confidence(spark, (CYCLIC, 1.0))).collect()} == {1}


def test_the_whole_miner(spark, perfect):
    miner = cm.RuleMiner(cm.MinerConfig(sample_size=10, target_edge_type=LIVES, max_length=3, max_attempts=30, min_support=1))
    for call in (lambda: miner.predict(), lambda: miner.evaluate_predictions(perfect.linked(LIVES))):
        with pytest.raises(RuntimeError, match="fit"):
            call()
    miner.fit(perfect)
    assert {r.stage for r in miner.counts().collect()} == {"edges", "triples", "paths", "rules", "results"}
    assert CYCLIC in {cm.rule_of(r) for r in miner.results.collect()}
    tests = perfect.linked(LIVES).toDF("head_id", "tail_id")
    assert {(r.mrr, r.hits) for r in miner.evaluate_predictions(tests).collect()} == {(1.0, 1.0)}
    assert {(r.mrr, r.hits, r.num_queries) for r in miner.evaluate_predictions(tests.filter("false")).collect()} == {(0.0, 0.0, 0)}
    assert pairs_of(miner.predict(filter_known=True), "head_id", "tail_id").isdisjoint(pairs_of(tests, "head_id", "tail_id"))
    miner.report(3)
    none = cm.RuleMiner(cm.MinerConfig(sample_size=5, target_edge_type=LIVES, max_length=2, max_attempts=2, min_support=1000)).fit(perfect)
    with pytest.raises(RuntimeError, match="no rules"):
        none.predict()


def test_names_become_ids(spark):
    rows = [("n", "b", "in", "r", "x"), ("n", "a", "in", "r", "x"), ("n", "a", "in", "r", "x"), ("s", "q", "at", "n", "b")]
    graph = cm.KnowledgeGraph.from_named_edges(spark.createDataFrame(rows, "src_type string, src_name string, relation string, dst_type string, dst_name string"))
    assert {tuple(r) for r in graph.edges.collect()} == {("n", "in", "r", 1, 0), ("n", "in", "r", 0, 0), ("s", "at", "n", 0, 1)}
