"""Sources and destinations that share a node cost that node and not their pairs; results are those of the pairs."""

import pytest
from pyspark.sql import functions as F

import clausemine as cm
from clausemine.operators import metrics, predict, ranking, reach
from clausemine.operators.predict import class_scores
from clausemine.operators.ranking import class_ranks, ranks

IN, HAS, BUYS = ("c", "in", "n"), ("n", "has", "s"), ("c", "buys", "s")
X, Y, Z = cm.Term.variable("X", "c"), cm.Term.variable("Y", "s"), cm.Term.variable("Z0", "n")
HEAD = cm.Atom("buys", X, Y)
NATION = cm.Rule(HEAD, (cm.Atom("in", X, Z), cm.Atom("has", Z, Y)))
PEER = cm.Rule(HEAD, (cm.Atom("in", X, Z), cm.Atom("peer", Z, cm.Term.variable("Z1", "c")), cm.Atom("buys", cm.Term.variable("Z1", "c"), Y)))
CUSTOMERS, SUPPLIERS, NATIONS = 600, 60, 3


def made(spark, stray=()):
    """Nations share customers and suppliers; ``stray`` are more links of customers to nations."""
    home = [(i, i % NATIONS) for i in range(CUSTOMERS)]
    pairs = {IN: home + list(stray), HAS: [(i % NATIONS, i) for i in range(SUPPLIERS)], ("n", "peer", "c"): [(n, c) for c, n in home], BUYS: [(i, (i * 7 + k) % SUPPLIERS) for i in range(CUSTOMERS) for k in (0, 3, 4)]}
    return cm.KnowledgeGraph.from_lists(spark, {"c": CUSTOMERS, "s": SUPPLIERS, "n": NATIONS}, pairs), {t: set(p) for t, p in pairs.items()}


def reached(pairs, body):
    out = {(c, c) for c in range(CUSTOMERS)}
    for atom in body:
        step: dict = {}
        for a, b in pairs[atom.edge_signature]:
            step.setdefault(a, set()).add(b)
        out = {(c, b) for c, a in out for b in step.get(a, ())}
    return out


def rules_of(spark):
    constant = [cm.Rule(cm.Atom("buys", X, cm.Term.constant(i, "s")), NATION.body) for i in (0, 7)] + [cm.Rule(cm.Atom("buys", cm.Term.constant(i, "c"), Y), PEER.body) for i in (1, 2)]
    return [NATION, PEER, *constant]


@pytest.mark.parametrize("stray", [(), ((5, 0),)])
def test_metrics_are_those_of_the_pairs(spark, monkeypatch, stray):
    graph, pairs = made(spark, stray)
    asked, plain = [], metrics.words
    monkeypatch.setattr(metrics, "words", lambda g, chains: asked.extend(chains) or plain(g, chains))
    rules = rules_of(spark)
    for rule, row in zip(rules, cm.evaluate(graph, cm.rules_frame(spark, rules)).orderBy("ord").collect(), strict=True):
        pred = {p for p in reached(pairs, rule.body) if rule.head.subject.entity_id in (None, p[0]) and rule.head.object.entity_id in (None, p[1])}
        assert (row.num_predictions, row.support) == (len(pred), len(pred & pairs[BUYS]))
    assert (IN, ("n", "peer", "c"), BUYS) not in asked or stray  # no pair of a folded chain is made


@pytest.mark.parametrize("filtered", [True, False])
def test_predictions_and_ranks_by_class(spark, monkeypatch, filtered):
    graph, _ = made(spark)
    results = cm.evaluate(graph, cm.rules_frame(spark, rules_of(spark)[:4]))
    largest = []
    for module in (predict, ranking, reach):
        plain = module.stored
        monkeypatch.setattr(module, "stored", lambda df, name, plain=plain: (t := plain(df, name), largest.append(t.count()))[0])
    by_class = class_scores(graph, results)
    rows = lambda df, *c: sorted((*r[:-1], round(r[-1], 9)) for r in df.select(*c).collect())
    pairs = cm.predict(graph, results, filter_known=filtered)
    assert max(largest) == CUSTOMERS < pairs.count()  # the table of classes: no table holds a row for each pair
    monkeypatch.setattr(predict, "class_scores", lambda *_: None)
    assert rows(pairs, "head_id", "tail_id", "score") == rows(cm.predict(graph, results, filter_known=filtered), "head_id", "tail_id", "score")
    tests = spark.createDataFrame([(i, i % 50, i * 11 % SUPPLIERS) for i in range(80)] + [(99, 10_000, 3)], "test_id long, head_id long, tail_id long")
    scores = by_class.pairs().withColumn("score", F.round("score", 9))
    by_class = predict.ClassScores(by_class.heads, by_class.scores.withColumn("score", F.round("score", 9)))
    want, got = ranks(graph, scores, tests, BUYS, filtered), class_ranks(graph, by_class, tests, BUYS, filtered)
    assert rows(got, "test_id", "side", "rank") == rows(want, "test_id", "side", "rank") and got.count() == 162


def test_pairs_of_folded_chains(spark):
    graph, pairs = made(spark)
    for chain in ((IN, HAS), (IN, ("n", "peer", "c"), BUYS), (IN, ("n", "peer", "c")), (BUYS, BUYS)):
        fold = reach.Folds(graph).of(chain)
        if chain[0] == BUYS:
            assert fold is None
            continue
        got = [tuple(r) for r in fold.pairs().collect()]
        step = [cm.Atom(t[1], cm.Term.variable("A", t[0]), cm.Term.variable("B", t[2])) for t in chain]
        assert len(got) == len(set(got)) and set(got) == reached(pairs, step)
    rows = fold_parts(reach.Folds(graph).of((IN, HAS)).pairs())
    assert len(rows) == 8 and max(rows) < 2 * min(rows)  # three nations, yet all tasks make pairs


def fold_parts(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
