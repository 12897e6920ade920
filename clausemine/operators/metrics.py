"""Support, confidence, head coverage and number of predictions of many rules at once.

All rules with one body and head relation are aggregates of one relation, the body's reach with the known
links marked among its bits: the whole of it for cyclic rules, a group per source or destination for
rules with a constant. Rules with one connected variable (AC2) count its bindings times all nodes of the
other type without making the pairs. So do rules of a chain that can be folded (see ``Folds``). Reach and known pairs are sets; head coverage and the support of
AC2 rules count raw edges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RuleConfig
from ..functions.rule_columns import chain, signature
from ..sources.knowledge_graph import EdgeType, KnowledgeGraph
from ..sources.storage import ranked, stored
from .reach import Chain, Fold, Folds, ReachStore, check_types, connected, packed, unpacked, words

METRICS = ["support", "confidence", "head_coverage", "num_predictions"]


def flagged_reach(graph: KnowledgeGraph, wanted: list[tuple[Chain, EdgeType]], store: ReachStore | None = None) -> DataFrame:
    """``pair, src, word, bits, known``: the reach of each (chain, head type) in words, and the bits of the links that the head has."""
    chains, heads = {}, {}
    for c, h in wanted:
        chains.setdefault(c, len(chains))
        heads.setdefault(h, len(heads))
    reached = store.words(list(chains)) if store else words(graph, list(chains))
    known = [packed(graph.bag(h), "src", "dst").select(F.lit(i).alias("head"), F.col("from").alias("src"), "word", F.col("bits").alias("links")) for h, i in heads.items()]
    if len(heads) == 1:  # pairs are chains then, in the same order
        joined = reached.withColumnRenamed("chain", "pair").join(known[0].drop("head"), ["src", "word"], "left")
    else:
        table = graph.spark.createDataFrame([(chains[c], heads[h], i) for i, (c, h) in enumerate(wanted)], "chain int, head int, pair int")
        joined = reached.join(F.broadcast(table), "chain").join(reduce(DataFrame.unionByName, known), ["head", "src", "word"], "left")
    return joined.select("pair", "src", "word", "bits", F.col("bits").bitwiseAND(F.coalesce("links", F.lit(0))).alias("known"))


def counted(flagged: DataFrame, by: str | None) -> DataFrame:
    """``pair, preds, hits``, with ``by`` a row for each source or destination (``entity``)."""
    if by == "dst":
        ends = unpacked(flagged.select("pair", "word", "known", "bits"), "bits", "entity")
        return ends.groupBy("pair", "entity").agg(F.count("*").alias("preds"), F.sum(F.call_function("getbit", F.col("known"), F.col("entity").bitwiseAND(63).cast("int"))).alias("hits"))
    group = ["pair"] if by is None else ["pair", F.col("src").alias("entity")]
    return flagged.groupBy(*group).agg(F.sum(F.bit_count("bits")).alias("preds"), F.sum(F.bit_count("known")).alias("hits"))


def folded_counts(fold: Fold, hits: DataFrame, by: str | None) -> DataFrame:
    """As ``counted`` of one chain, without the pairs: ``hits`` are the links that it reaches."""
    preds = fold.predictions(by)
    if by is None:
        return preds.join(F.broadcast(hits.agg(F.count("*").alias("hits"))))
    return preds.join(hits.groupBy(F.col(by).alias("entity")).agg(F.count("*").alias("hits")), "entity", "left")


def connected_side(head: Column, body: Column) -> Column:
    """For AC2: 'src' or 'dst', the head variable that the body binds; null if both or neither."""
    used = lambda t: F.coalesce(F.exists(body, lambda a: (a["subject"]["name"] == t["name"]) | (a["object"]["name"] == t["name"])), F.lit(False))
    s, o = used(head["subject"]), used(head["object"])
    return F.when(s & ~o, "src").when(o & ~s, "dst")


def evaluate(graph: KnowledgeGraph, rules: DataFrame, store: ReachStore | None = None) -> DataFrame:
    """The rules with their metrics, a row each. Unknown edge types in a body or head raise ValueError. Reach is taken from ``store`` if there is one.

    The distinct (chain, head type) pairs come to the driver; they are as few as chains are.
    """
    rules = stored(rules, "rules")  # each part below reads the rules again
    head = signature(F.col("head"))
    side = F.when(F.col("rule_type") == "ac2", connected_side(F.col("head"), F.col("body")))
    rows = rules.select("rule_type", "chain_key", chain(F.col("body")).alias("hops"), head.alias("h"), side.alias("side")).distinct().collect()
    hops = {r["chain_key"]: tuple(map(tuple, r["hops"])) for r in rows}
    check_types(graph, [*hops.values(), *((tuple(r["h"]),) for r in rows)])
    kinds = {r["rule_type"] for r in rows}
    table = list(dict.fromkeys((r["chain_key"], tuple(r["h"])) for r in rows))
    number = {t: i for i, t in enumerate(table)}
    named = graph.spark.createDataFrame([(k, h, i) for (k, h), i in number.items()], "chain_key string, h struct<src_type: string, relation: string, dst_type: string>, pair int")
    keyed = rules.withColumns({"h": head, "side": side}).join(F.broadcast(named), ["chain_key", "h"])
    columns = [*rules.columns, "h", "preds", "hits"]
    parts = [keyed.filter("rule_type = 'ac2'").join(F.broadcast(ac2_counts(graph, rows, hops, number)), ["pair", "side"], "left").select(*columns)] if "ac2" in kinds or not kinds else []
    if kinds - {"ac2"}:
        wanted = list(dict.fromkeys((r["chain_key"], tuple(r["h"])) for r in rows if r["rule_type"] != "ac2"))
        folds, folded = Folds(graph), {}
        for w in wanted:
            if fold := folds.of(hops[w[0]]):
                folded[w] = fold
        plain = [w for w in wanted if w not in folded]
        flagged = flagged_reach(graph, [(hops[k], h) for k, h in plain], store) if plain else None
        renumber = graph.spark.createDataFrame([(i, number[w]) for i, w in enumerate(plain)], "pair int, to int")
    subject, obj = F.col("head.subject.entity_id"), F.col("head.object.entity_id")
    ways = [("cyclic", F.lit(True), None, None), ("ac1", subject.isNotNull(), subject, "src"), ("ac1", subject.isNull(), obj, "dst")]
    sides = {r[0] for r in rules.filter("rule_type = 'ac1'").select(F.when(subject.isNotNull(), "src").otherwise("dst")).distinct().collect()} if "ac1" in kinds else set()
    ways = [w for w in ways if w[0] in kinds and w[3] in {None, *sides}]
    if ways:
        flagged = stored(flagged, "flagged-reach") if flagged and len(ways) > 1 else flagged
        hits = {w: fold.among(graph.bag(w[1])) for w, fold in folded.items()}
        hits = {w: stored(df, "links-reached") if len(ways) > 1 else df for w, df in hits.items()}
    for kind, which, entity, by in ways:
        group = ["pair"] if by is None else ["pair", "entity"]
        some = [folded_counts(fold, hits[w], by).withColumn("pair", F.lit(number[w])).select(*group, "preds", "hits") for w, fold in folded.items()]
        if flagged:
            some.append(counted(flagged, by).join(F.broadcast(renumber), "pair").withColumn("pair", F.col("to")).select(*group, "preds", "hits"))
        counts = reduce(DataFrame.unionByName, some)
        some = keyed.filter((F.col("rule_type") == kind) & which)
        parts.append((some if by is None else some.withColumn("entity", entity)).join(counts, group, "left").select(*columns))
    counts = reduce(DataFrame.unionByName, parts)
    used = [h for h in dict.fromkeys(h for _, h in table)] or list(graph.edge_types[:1])
    heads = graph.edges_of(tuple(used)).groupBy(F.struct("src_type", "relation", "dst_type").alias("h")).agg(F.count("*").alias("edge_count"))
    preds, hits = F.coalesce("preds", F.lit(0)), F.when(F.coalesce("preds", F.lit(0)) > 0, F.coalesce("hits", F.lit(0))).otherwise(0)
    return counts.join(F.broadcast(heads), "h", "left").select(
        *rules.columns,
        hits.cast("long").alias("support"),
        F.when(preds > 0, hits / preds).otherwise(0.0).alias("confidence"),
        F.when(F.col("edge_count") > 0, hits / F.col("edge_count")).otherwise(0.0).alias("head_coverage"),
        preds.cast("long").alias("num_predictions"),
    )


def ac2_counts(graph: KnowledgeGraph, rows: list, hops: dict[str, Chain], number: dict) -> DataFrame:
    """``pair, side, preds, hits`` of AC2 rules, a row for each chain, head type and side; none where the head is connected on both sides or on none."""
    out = graph.spark.createDataFrame([], "pair int, side string, preds long, hits long")
    for side, other in (("src", 2), ("dst", 0)):
        wanted = list(dict.fromkeys((r["chain_key"], tuple(r["h"])) for r in rows if r["rule_type"] == "ac2" and r["side"] == side))
        if not wanted:
            continue
        keys = {k: i for i, k in enumerate(dict.fromkeys(k for k, _ in wanted))}
        bound = stored(connected(graph, [hops[k] for k in keys], side), "bound")  # read for its size and for each head type
        sizes = bound.groupBy("chain").agg(F.count("*").alias("bound"))
        for head in dict.fromkeys(h for _, h in wanted):
            mine = graph.spark.createDataFrame([(keys[k], number[k, h]) for k, h in wanted if h == head], "chain int, pair int")
            degree = graph.bag(head).groupBy(F.col(side).alias("id")).agg(F.count("*").alias("n"))
            hits = bound.join(degree, "id").groupBy("chain").agg(F.sum("n").alias("hits"))
            free = graph.ids[head[other]].agg(F.count("*").alias("free")) if head[other] in graph.ids else graph.spark.range(1).select(F.lit(0).alias("free"))
            part = mine.join(sizes, "chain", "left").join(hits, "chain", "left").join(F.broadcast(free))
            out = out.unionByName(part.select("pair", F.lit(side).alias("side"), (F.col("bound") * F.col("free")).alias("preds"), "hits"))
    return out


def is_trivial(num_predictions: Column) -> Column:
    """Whether a rule predicts nothing."""
    return num_predictions == 0


def passing(metrics: DataFrame, config: RuleConfig) -> DataFrame:
    """Rules at or above all three thresholds."""
    return metrics.filter((F.col("support") >= config.min_support) & (F.col("confidence") >= config.min_confidence) & (F.col("head_coverage") >= config.min_head_coverage))


def evaluate_batch(graph: KnowledgeGraph, rules: DataFrame, config: RuleConfig, max_results: int | None = None, batch: int = 500, store: ReachStore | None = None) -> DataFrame:
    """The rules that pass, in their order; the first ``max_results`` if that is given.

    Then rules are evaluated in batches in that order, and no more once enough have passed; no chain's reach is computed twice, as
    batches share a store.
    """
    if max_results is None:
        return passing(evaluate(graph, rules, store), config)
    store, found = store or ReachStore(graph), None
    numbered, total = ranked(rules, ["ord"], "numbered-rules", "place")
    for first in range(0, max(total, 1), batch):
        some = numbered.filter((F.col("place") >= first) & (F.col("place") < first + batch)).drop("place")
        part = stored(passing(evaluate(graph, some, store), config), "passing")
        found = part if found is None else found.unionByName(part)
        if found.count() >= max_results:
            break
    return found.orderBy("ord").limit(max_results)


def top_rules(metrics: DataFrame, k: int = 20) -> DataFrame:
    """By confidence, then support; ties keep the order of the rules."""
    return metrics.orderBy(F.desc("confidence"), F.desc("support"), "ord").limit(k)
