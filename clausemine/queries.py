"""Registered graph queries over the order tables; their SQL is in ``oracle``.

Held-out links for ranking are a hash split of all pairs: one in twenty is a test link.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import EvaluationConfig, MinerConfig, RuleConfig, SamplerConfig, SamplingStrategy, WalkConfig, WalkStrategy
from .functions import rule_columns as R
from .functions.portable_random import draw
from .operators.generalize import rules_of_links, rules_of_shapes
from .operators.metrics import METRICS, evaluate, evaluate_batch, top_rules
from .operators.paths import listed_ways, path_shapes
from .operators.predict import ClassScores, chain_groups, class_scores, ordered, predict, score_heads, score_tails, scores
from .operators.ranking import class_ranks, link_metrics, ranks
from .operators.reach import Folds, ReachStore, chains_of, reach
from .operators.sampling import sample_triples
from .operators.walks import random_walks
from .oracle import ATTEMPTS, HOPS, MINER_ATTEMPTS, SQL
from .plans.rule_miner import RuleMiner
from .rules import Atom, Rule, RuleType, Term, rules_frame
from .sources import knowledge_graph as kg
from .sources.edge_index import EdgeIndex
from .sources.storage import stored

X, Y = Term.variable("X", "customer"), Term.variable("Y", "supplier")
HEAD = Atom("bought_from", X, Y)


def over(*edge_types: kg.EdgeType, last: Term = Y) -> tuple[Atom, ...]:
    """A body along edge types from X to the last term."""
    inner = [Term.variable(f"Z{i}", t[2]) for i, t in enumerate(edge_types[:-1])]
    ends = [X, *inner, last]
    return tuple(Atom(t[1], a, b) for t, a, b in zip(edge_types, ends, ends[1:], strict=False))


NATION_RULE = Rule(HEAD, over(kg.CUSTOMER_NATION, kg.NATION_SUPPLIER))
PART_RULE = Rule(HEAD, over(kg.BOUGHT, kg.SUPPLIED))
PEER_RULE = Rule(HEAD, over(kg.CUSTOMER_NATION, kg.NATION_CUSTOMER, kg.BOUGHT_FROM))
AC2_SUBJECT = Rule(HEAD, over(kg.CUSTOMER_NATION, last=Term.variable("Z0", "nation")))
AC2_OBJECT = Rule(HEAD, (Atom("supplied_by", Term.variable("Z0", "part"), Y),))
BATCH = [NATION_RULE, PART_RULE, AC2_SUBJECT, AC2_OBJECT, PEER_RULE]


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in columns})


def measured(df: DataFrame, *more: str) -> DataFrame:
    return rounded(df, "confidence", "head_coverage").select(*more, *METRICS)


def of_rules(*rules: Rule):
    return lambda spark, d: measured(evaluate(kg.trade_graph(spark, d), rules_frame(spark, list(rules))))


def grounded(graph: kg.KnowledgeGraph, rule: Rule, side: str) -> DataFrame:
    """The rule with each node of the head's subject or object type as its constant."""
    one = rules_frame(graph.spark, [rule]).select("head", "body")
    node_type = (rule.head.subject if side == "subject" else rule.head.object).node_type
    constant = R.constant(F.col("id"), F.lit(node_type))
    head = R.atom(F.col("head.relation"), constant if side == "subject" else F.col("head.subject"), F.col("head.object") if side == "subject" else constant)
    nodes = graph.ids[node_type]
    rows = nodes.join(F.broadcast(one)).select(F.col("id").alias("ord"), F.lit(str(RuleType.AC1)).alias("rule_type"), head.alias("head"), "body")
    return R.with_keys(rows)


def metrics_ac1(side: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        graph = kg.trade_graph(spark, d)
        return measured(evaluate(graph, grounded(graph, NATION_RULE, side)).withColumn("entity_id", F.col("ord")), "entity_id")

    return query


def batch(graph: kg.KnowledgeGraph, config: RuleConfig, most: int | None = None) -> DataFrame:
    return measured(evaluate_batch(graph, rules_frame(graph.spark, BATCH), config, most), "ord")


def learned(graph: kg.KnowledgeGraph, store: ReachStore | None = None) -> DataFrame:
    """The nation rule whole and with each supplier as its constant, with metrics."""
    rules = rules_frame(graph.spark, [NATION_RULE])
    return stored(evaluate(graph, rules.unionByName(grounded(graph, NATION_RULE, "object")), store), "learned")


def split(spark: SparkSession, d: str) -> tuple[kg.KnowledgeGraph, DataFrame]:
    """(the graph without the test links, the test links)."""
    graph = kg.trade_graph(spark, d)
    is_test = (F.col("src") * 31 + F.col("dst")) % 20 == 0
    tests = graph.linked(kg.BOUGHT_FROM).filter(is_test).toDF("head_id", "tail_id").withColumn("test_id", F.struct("head_id", "tail_id"))
    return kg.KnowledgeGraph(graph.ids, {**graph.pairs, kg.BOUGHT_FROM: graph.bag(kg.BOUGHT_FROM).filter(~is_test)}), tests


def all_ranks(spark: SparkSession, d: str, filtered: bool) -> DataFrame:
    graph, tests = split(spark, d)
    store = ReachStore(graph)
    rules = learned(graph, store)
    if by_class := class_scores(graph, rules):
        by_class = ClassScores(by_class.heads, rounded(by_class.scores, "score"))  # equal scores stay ties however they were multiplied
        return class_ranks(graph, by_class, tests, kg.BOUGHT_FROM, filtered).drop("test_id")
    scored = rounded(scores(graph, rules, store=store), "score")
    return ranks(graph, scored, tests, kg.BOUGHT_FROM, filtered).drop("test_id")


def mrr_hits(filtered: bool):
    return lambda spark, d: rounded(link_metrics(all_ranks(spark, d, filtered), EvaluationConfig(filter_known=filtered)), "mrr", "hits")


def scored(spark: SparkSession, d: str, **options) -> DataFrame:
    graph = kg.trade_graph(spark, d)
    store = ReachStore(graph)
    return rounded(predict(graph, learned(graph, store), store=store, **options), "score")


def filtered_predictions(spark: SparkSession, d: str) -> DataFrame:
    graph, _ = split(spark, d)
    store = ReachStore(graph)
    return rounded(predict(graph, learned(graph, store), filter_known=True, store=store), "score").select("head_id", "tail_id", "score")


def sampled(strategy: SamplingStrategy, target=None):
    return lambda spark, d: sample_triples(kg.trade_graph(spark, d), SamplerConfig(1000, strategy, 3, target))


def shown_step(entity_id: Column, node_type: Column, relation: Column) -> Column:
    return F.concat_ws(":", node_type, entity_id.cast("string"), relation)


def shown_path() -> Column:
    return F.concat_ws(" ", F.transform("path", lambda s: shown_step(s["entity_id"], s["node_type"], s["relation"]))).alias("path")


def every_link(graph: kg.KnowledgeGraph) -> DataFrame:
    ends = {"head_type": F.lit("customer"), "tail_type": F.lit("supplier"), "relation": F.lit("bought_from")}
    return graph.linked(kg.BOUGHT_FROM).toDF("head_id", "tail_id").withColumns(ends)


def shapes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Shapes of all paths of up to HOPS steps between the ends of every link, and how many there are."""
    graph = kg.trade_graph(spark, d)
    return path_shapes(graph, every_link(graph), 1, HOPS)


def enumerated(spark: SparkSession, d: str) -> DataFrame:
    """All paths of up to HOPS steps between the ends of every link, as text, counted and summed."""
    graph = kg.trade_graph(spark, d)
    # summed for each sequence of node types, so that what one shuffles is gone before the next
    sums = [stored(df.groupBy("head_id", "tail_id").agg(*summed(F.col("path"))), "path-sums") for df in listed_ways(graph, every_link(graph), 1, HOPS, shown_step, shown=True)]
    both = reduce(DataFrame.unionByName, sums).groupBy("head_id", "tail_id").agg(*(F.sum(c).alias(c) for c in ("n", "high", "low")))
    whole = F.col("high").cast("decimal(38,0)") * F.lit(HALF).cast("decimal(8,0)") + F.col("low").cast("decimal(38,0)")
    return both.select("head_id", "tail_id", "n", whole.cast("decimal(38,0)").cast("string").alias("checksum"))


#: Drawn numbers are summed in halves: whole numbers, not decimals, for every text.
HALF = 1 << 24


def summed(text: Column) -> list[Column]:
    """How many texts there are and sums of both halves of numbers drawn from them, which tell one bag of texts from another in any order."""
    drawn = draw(text)
    return [F.count("*").alias("n"), F.sum(F.shiftright(drawn, 24)).alias("high"), F.sum(drawn.bitwiseAND(HALF - 1)).alias("low")]


def walked(strategy: WalkStrategy):
    def query(spark: SparkSession, d: str) -> DataFrame:
        graph = kg.trade_graph(spark, d)
        index = EdgeIndex(graph)
        triples = stored(sample_triples(graph, SamplerConfig(1000, SamplingStrategy.UNIFORM, 5, kg.BOUGHT_FROM), index), "triples")
        return random_walks(graph, triples, WalkConfig(HOPS, 2, ATTEMPTS, strategy, 5), index).select("draw_id", "attempt", shown_path())

    return query


def shown(*columns):
    """Distinct rules of all paths, tautologies too, with columns made of head and body."""
    rule = R.shown_rule(F.col("head"), F.col("body")).alias("rule")
    return lambda spark, d: rules_of_shapes(*shapes(spark, d), "bought_from", drop_tautologies=False).select(rule, *columns)


def dedup(spark: SparkSession, d: str) -> DataFrame:
    rules = rules_of_shapes(*shapes(spark, d), "bought_from")
    return rules.select(R.shown_rule(F.col("head"), F.col("body")).alias("rule"), F.col("ord.head_id").alias("first_head"), F.col("ord.tail_id").alias("first_tail"))


def generalized(spark: SparkSession, d: str) -> DataFrame:
    """Rules of each link's paths, counted and summed."""
    rules = rules_of_links(*shapes(spark, d), "bought_from", draw)
    return rules.select("head_id", "tail_id", "variant", "n", F.col("total").cast("string").alias("checksum"))


def named_graph(spark: SparkSession, d: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    nations = read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    lies = nations.select(F.lit("nation").alias("src_type"), F.col("n_name").alias("src_name"), F.lit("in_region").alias("relation"), F.lit("region").alias("dst_type"), F.col("r_name").alias("dst_name"))
    sells = read("supplier").join(read("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.lit("supplier").alias("src_type"), F.col("s_name").alias("src_name"), F.lit("in_nation").alias("relation"), F.lit("nation").alias("dst_type"), F.col("n_name").alias("dst_name"))
    return kg.KnowledgeGraph.from_named_edges(lies.unionByName(sells)).edges


MINER = MinerConfig(target_edge_type=kg.BOUGHT_FROM, max_attempts=MINER_ATTEMPTS)  # everything else as a miner has it by default


def pipeline_fit(spark: SparkSession, d: str) -> DataFrame:
    results = RuleMiner(MINER).fit(kg.trade_graph(spark, d).written()).results
    return measured(results.withColumn("rule", R.shown_rule(F.col("head"), F.col("body"))), "rule", "rule_type")


def pipeline_predict(spark: SparkSession, d: str) -> DataFrame:
    return rounded(RuleMiner(MINER).fit(kg.trade_graph(spark, d).written()).predict(filter_known=True), "score").select("head_id", "tail_id", "score")


def pipeline_evaluate(spark: SparkSession, d: str) -> DataFrame:
    graph, tests = split(spark, d)
    miner = RuleMiner(MINER).fit(graph.written())
    return rounded(miner.evaluate_predictions(tests.select("head_id", "tail_id")), "mrr", "hits")


def peers_reach(graph: kg.KnowledgeGraph) -> DataFrame:
    """What the chain of peers reaches; every customer lies in one nation, so its pairs are those of nations."""
    chains = list(chains_of(rules_frame(graph.spark, [PEER_RULE])).values())
    fold = Folds(graph).of(chains[0])
    return fold.pairs() if fold else reach(graph, chains).drop("chain")


def graph_query(f):
    return lambda spark, d: f(kg.trade_graph(spark, d))


QUERIES = {
    "kg_node_counts": graph_query(lambda g: g.node_counts()),
    "kg_edge_counts": graph_query(lambda g: g.edge_counts().drop("ordinal")),
    "kg_total_edges": graph_query(lambda g: g.total_edges()),
    "kg_catalog": graph_query(lambda g: g.edge_counts().withColumn("empty", F.col("edge_count") == 0).drop("edge_count")),
    "kg_outgoing_types": graph_query(lambda g: g.outgoing_types().drop("ordinal", "edge_count")),
    "kg_neighbors": graph_query(lambda g: g.neighbors(7, kg.NATION_CUSTOMER)),
    "kg_edge_bag": graph_query(lambda g: g.bag(kg.BOUGHT_FROM).groupBy("src", "dst").agg(F.count("*").alias("copies"))),
    "kg_adjacency_distinct": graph_query(lambda g: g.adjacency(kg.BOUGHT_FROM)),
    "kg_dangling": graph_query(lambda g: g.dangling()),
    "kg_named_ids": named_graph,
    "kg_activity_edges": lambda spark, d: kg.activity_graph(spark, d).edges.groupBy("relation").agg(F.count("*").alias("edge_count"), F.count_distinct("src", "dst").alias("pairs")),
    "kg_synthetic": lambda spark, d: kg.synthetic_graph(spark, nodes_per_type=spark.read.parquet(f"{d}/customer.parquet").count()).edges.groupBy("relation").agg(F.count("*").alias("n"), F.sum("src").alias("src_sum"), F.sum("dst").alias("dst_sum"), F.count_distinct("src", "dst").alias("pairs")),
    "chain_reach_2hop": graph_query(lambda g: reach(g, list(chains_of(rules_frame(g.spark, [PART_RULE])).values())).drop("chain")),
    "chain_reach_3hop": graph_query(peers_reach),
    "metrics_cyclic": of_rules(NATION_RULE),
    "metrics_cyclic_parts": of_rules(PART_RULE),
    "metrics_ac1_subject": metrics_ac1("subject"),
    "metrics_ac1_object": metrics_ac1("object"),
    "metrics_ac2_subject": of_rules(AC2_SUBJECT),
    "metrics_ac2_object": of_rules(AC2_OBJECT),
    "metrics_batch_thresholds": graph_query(lambda g: batch(g, RuleConfig(2, 0.3255, 0.03))),
    "metrics_batch_max_results": graph_query(lambda g: batch(g, RuleConfig(2, 0.01, 0.01), 3)),
    "top_rules": graph_query(lambda g: measured(top_rules(evaluate(g, rules_frame(g.spark, BATCH)), 3), "ord")),
    "noisy_or_confidence": lambda spark, d: rounded(spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_suppkey").cast("long").alias("l_suppkey")).agg(R.noisy_or(F.col("l_discount").cast("double") / 10).alias("score")), "score"),
    "chain_groups": graph_query(lambda g: rounded(chain_groups(learned(g)), "confidence").drop("chain_key")),
    "predict_all": scored,
    "predict_filter_known": filtered_predictions,
    "predict_min_score": lambda spark, d: scored(spark, d, min_score=0.55).select("head_id", "tail_id", "score"),
    "top_predictions": lambda spark, d: ordered(scored(spark, d)).select("head_id", "tail_id", "score").limit(20),
    "score_tails_dense": graph_query(lambda g: rounded(score_tails(g, learned(g), 1), "score")),
    "score_heads_dense": graph_query(lambda g: rounded(score_heads(g, learned(g), 1), "score")),
    "tail_ranks_filtered": lambda spark, d: all_ranks(spark, d, True).filter("side = 'tail'"),
    "head_ranks_filtered": lambda spark, d: all_ranks(spark, d, True).filter("side = 'head'"),
    "ranks_raw": lambda spark, d: all_ranks(spark, d, False),
    "mrr_hits_filtered": mrr_hits(True),
    "mrr_hits_raw": mrr_hits(False),
    "sample_uniform": sampled(SamplingStrategy.UNIFORM),
    "sample_relation_proportional": sampled(SamplingStrategy.RELATION_PROPORTIONAL),
    "sample_relation_inverse": sampled(SamplingStrategy.RELATION_INVERSE),
    "sample_target_type": sampled(SamplingStrategy.UNIFORM, kg.BOUGHT_FROM),
    "walk_enumerate_paths": enumerated,
    "walk_uniform": walked(WalkStrategy.UNIFORM),
    "walk_relation_weighted": walked(WalkStrategy.RELATION_WEIGHTED),
    "generalize_rules": generalized,
    "classify_rules": lambda spark, d: shown("rule_type")(spark, d),
    "tautology_filter": lambda spark, d: shown(R.tautological(F.col("head"), F.col("body")).alias("tautological"))(spark, d),
    "rule_strings": lambda spark, d: shown(F.size("body").alias("length"))(spark, d),
    "rule_variables": lambda spark, d: shown(F.concat_ws(",", R.variables(F.col("head"), F.col("body"))).alias("variables"))(spark, d),
    "rule_constants": lambda spark, d: shown(F.concat_ws(",", R.constants(F.col("head"), F.col("body"))).alias("constants"))(spark, d),
    "dedup_rules": dedup,
    "pipeline_fit": pipeline_fit,
    "pipeline_predict": pipeline_predict,
    "pipeline_evaluate": pipeline_evaluate,
}

__all__ = ["QUERIES", "SQL"]
