"""Rule mining, link prediction and corpus preparation on Spark."""

from .config import EvaluationConfig, MinerConfig, RuleConfig, SamplerConfig, SamplingStrategy, WalkConfig, WalkStrategy
from .operators.generalize import distinct_rules, generalize
from .operators.metrics import evaluate, evaluate_batch, is_trivial, passing, top_rules
from .operators.predict import chain_groups, predict, score_heads, score_tails, scores
from .operators.ranking import link_metrics, ranks
from .operators.reach import ReachStore, connected, reach
from .operators.sampling import sample_triples
from .operators.walks import enumerate_paths, random_walks
from .plans.rule_miner import RuleMiner
from .rules import Atom, Rule, RuleType, Term, TermKind, classify_rule, rule_of, rules_frame
from .sources.knowledge_graph import EdgeType, KnowledgeGraph
from .sources.runs import Run

__all__ = [
    "Atom", "EdgeType", "EvaluationConfig", "KnowledgeGraph", "MinerConfig", "ReachStore", "Rule", "RuleConfig", "RuleMiner", "RuleType",
    "Run", "SamplerConfig", "SamplingStrategy", "Term", "TermKind", "WalkConfig", "WalkStrategy", "chain_groups", "classify_rule",
    "connected", "distinct_rules", "enumerate_paths", "evaluate", "evaluate_batch", "generalize", "is_trivial", "link_metrics",
    "passing", "predict", "random_walks", "ranks", "reach", "rule_of", "rules_frame", "sample_triples", "score_heads",
    "score_tails", "scores", "top_rules",
]
