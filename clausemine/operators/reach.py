"""What body chains reach: the distinct (src, dst) pairs of a chain of edge types, for many chains at once.

Different chains are few (types to the power of the longest rule at most), so they come to the driver and
become a trie. Hop by hop, the pairs of all chains meet the edges of one type, once for each type that any
chain takes there: a plan has a join for each type and hop, however many chains there are. Pairs carry the
number of their place in the trie and are made distinct after every hop, so a hub costs its pairs, not its paths.

A chain's last hop makes no pairs. Ends are kept as words: 64 ids that differ in their last six bits share
a row ``src, word`` whose ``bits`` say which of them are reached. Neighbours are packed in words before the join,
words of one source are united by a bitwise or, and they are counted without being unpacked. A word never takes
more rows than its pairs would; where ends lie close it takes up to 64 times fewer, in the join, the shuffle and the table.

Nodes with very many neighbours would put all of their edges into one task of a sort-merge join. Where the edges
of a type are too many to be broadcast, such nodes' edges are divided among slices and the pairs that stand there are sent to each.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.knowledge_graph import EdgeType, KnowledgeGraph
from ..sources.storage import stored

Chain = tuple[EdgeType, ...]
WORD = ["chain", "src", "word", "bits"]
#: A hub has at least this share of a type's edges, so there are at most this many of them.
HUBS = 64


def chains_of(rules: DataFrame) -> dict[str, Chain]:
    """The distinct chains of rules by ``chain_key``."""
    from ..functions.rule_columns import chain

    rows = rules.select("chain_key", chain(F.col("body")).alias("hops")).dropDuplicates(["chain_key"]).collect()  # one row for each chain
    return {r["chain_key"]: tuple(tuple(h) for h in r["hops"]) for r in rows}


def check_types(graph: KnowledgeGraph, chains) -> None:
    """ValueError if a chain names an edge type that the graph does not have."""
    for hops in chains:
        for edge_type in hops:
            graph.require(edge_type)


class Trie:
    """Places of chains, made in one pass over them.

    ``moves[n][edge type]`` lists the (place before, place after) of hop n + 1, ``ends[n]`` gives the numbers of the chains that end
    at a place after that hop, ``inner`` are the places from which some chain goes on.
    """

    def __init__(self, chains: list[Chain]):
        places: dict[tuple[int, EdgeType], int] = {}
        self.moves: list[dict[EdgeType, list[tuple[int, int]]]] = []
        self.ends: list[dict[int, list[int]]] = []
        self.inner: set[int] = {0}
        for number, hops in enumerate(chains):
            here = 0
            for n, edge_type in enumerate(hops):
                if n == len(self.moves):
                    self.moves.append(defaultdict(list))
                    self.ends.append(defaultdict(list))
                self.inner.add(here)
                if (here, edge_type) not in places:
                    places[here, edge_type] = len(places) + 1
                    self.moves[n][edge_type].append((here, places[here, edge_type]))
                here = places[here, edge_type]
            self.ends[len(hops) - 1][here].append(number)


def moved(state: DataFrame, moves: list[tuple[int, int]]) -> DataFrame:
    """The rows that make one of these moves, at their new place."""
    if len(moves) == 1:
        return state.filter(F.col("place") == moves[0][0]).withColumn("place", F.lit(moves[0][1]))
    table = F.broadcast(state.sparkSession.createDataFrame(moves, "place int, after int"))  # at most a row for each chain
    return state.join(table, "place").withColumn("place", F.col("after")).drop("after")


def ended(state: DataFrame, ends: dict[int, list[int]]) -> DataFrame:
    """The rows at the ends of chains, a row for each of these chains."""
    return moved(state, [(place, number) for place, numbers in ends.items() for number in numbers]).withColumnRenamed("place", "chain")


def broadcastable(df: DataFrame) -> bool:
    """Whether Spark's own estimate of the size lets it broadcast this."""
    spark = df.sparkSession
    limit = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= limit


def met(state: DataFrame, edges: DataFrame) -> DataFrame:
    """``state`` joined with ``edges(from, ...)`` on at = from; hubs are divided among slices unless the edges are small."""
    if broadcastable(edges):
        return state.join(edges, F.col("at") == F.col("from"))
    degrees = edges.groupBy("from").agg(F.count("*").alias("degree"))
    degrees = degrees.join(F.broadcast(edges.agg((F.count("*") / HUBS).alias("share"))), F.col("degree") > F.col("share"))  # fewer than HUBS rows
    hubs = F.broadcast(degrees.select(F.col("from").alias("hub"), F.ceil(F.col("degree") / F.col("share")).cast("int").alias("slices")))
    far = [c for c in edges.columns if c != "from"]
    divided = edges.join(hubs, F.col("from") == F.col("hub"), "left").withColumn("slice", F.when(F.col("hub").isNull(), 0).otherwise(F.pmod(F.xxhash64(*far), F.col("slices"))).cast("int")).drop("hub", "slices")
    spread = state.join(hubs, F.col("at") == F.col("hub"), "left").withColumn("to_slice", F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1))).drop("hub", "slices")
    return spread.join(divided, (F.col("at") == F.col("from")) & (F.col("to_slice") == F.col("slice"))).drop("slice", "to_slice")


def bit(node: str) -> Column:
    return F.expr(f"shiftleft(1L, cast({node} & 63 as int))")


def packed(edges: DataFrame, near: str, far: str) -> DataFrame:
    """``from, word, bits``: the neighbours of each node in words."""
    return edges.groupBy(F.col(near).alias("from"), F.shiftright(far, 6).alias("word")).agg(F.bit_or(bit(far)).alias("bits"))


def unpacked(words: DataFrame, bits: str = "bits", to: str = "dst") -> DataFrame:
    """The words' other columns with a row for each id that is in ``bits``."""
    ids = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("getbit", F.col(bits), i.cast("int")) == 1)
    return words.withColumn(to, F.explode(F.transform(ids, lambda i: F.shiftleft("word", 6) + i))).drop("word", bits)


def hop(graph: KnowledgeGraph, edge_type: EdgeType, near: str, far: str) -> DataFrame:
    return graph.linked(edge_type).select(F.col(near).alias("from"), F.col(far).alias("to"))


def steps(graph: KnowledgeGraph, trie: Trie, n: int, state: DataFrame | None, near: str, far: str, columns: list[str], seed: int | None, wanted: set[int]) -> DataFrame | None:
    """The distinct rows after hop n + 1 at the places in ``wanted``."""
    parts = []
    for edge_type, moves in trie.moves[n].items():
        moves = [m for m in moves if m[1] in wanted]
        if not moves:
            continue
        edges = hop(graph, edge_type, near, far)
        if n == 0:
            some = edges if seed is None else edges.filter(F.col("from") == seed)
            parts.append(some.select(F.lit(moves[0][1]).alias("place"), F.col("to").alias("at"), F.col("from").alias("start")).select(*columns))
        else:
            parts.append(met(moved(state, moves), edges).withColumn("at", F.col("to")).select(*columns))
    return reduce(DataFrame.unionByName, parts).distinct() if parts else None


def followed(graph: KnowledgeGraph, chains: list[Chain], carry: bool, back: bool = False, seed: int | None = None) -> DataFrame:
    """``chain, at`` and, with ``carry``, ``start``: nodes at the ends of chains and where they came from.

    ``back`` walks edges from dst to src. ``seed`` starts from one node. Without ``carry`` a hop is a semi-join in
    effect: only the set of nodes goes on.
    """
    near, far = ("dst", "src") if back else ("src", "dst")
    trie, columns = Trie(chains), ["place", "at", *(["start"] if carry else [])]
    state, found = None, []
    for n, ends in enumerate(trie.ends):
        state = steps(graph, trie, n, state, near, far, columns, seed, trie.inner | set(ends))
        if ends:
            found.append(ended(state, ends))
    return reduce(DataFrame.unionByName, found)


def words(graph: KnowledgeGraph, chains: list[Chain]) -> DataFrame:
    """``chain, src, word, bits``: what each chain reaches, a row for each source and word; ``chain`` is the place in the list."""
    check_types(graph, chains)
    if not chains:
        return graph.spark.createDataFrame([], "chain int, src long, word long, bits long")
    trie, state, found = Trie(chains), None, []
    for n, ends in enumerate(trie.ends):
        parts = []
        for edge_type, moves in trie.moves[n].items():
            moves = [m for m in moves if m[1] in ends]
            if moves:
                near = packed(graph.bag(edge_type), "src", "dst")
                if n == 0:
                    parts.append(near.select(F.lit(moves[0][1]).alias("place"), F.col("from").alias("start"), "word", "bits"))
                else:
                    parts.append(met(moved(state, moves), near).select("place", "start", "word", "bits"))
        if parts:
            united = reduce(DataFrame.unionByName, parts)
            if n:
                united = united.groupBy("place", "start", "word").agg(F.bit_or("bits").alias("bits"))
            found.append(ended(united, ends))
        state = steps(graph, trie, n, state, "src", "dst", ["place", "at", "start"], None, trie.inner)
    return reduce(DataFrame.unionByName, found).withColumnRenamed("start", "src").select(*WORD)


def reach(graph: KnowledgeGraph, chains: list[Chain], src: int | None = None, dst: int | None = None) -> DataFrame:
    """``chain, src, dst``, distinct; ``chain`` is the place in the list. From one ``src`` or to one ``dst`` alone if asked."""
    if src is None and dst is None or not chains:
        return unpacked(words(graph, chains)).select("chain", "src", "dst")
    check_types(graph, chains)
    back = dst is not None
    pairs = followed(graph, [c[::-1] for c in chains] if back else chains, True, back, dst if back else src)
    a, b = ("at", "start") if back else ("start", "at")
    pairs = pairs.select("chain", F.col(a).alias("src"), F.col(b).alias("dst"))
    return pairs.filter(F.col("src") == src) if back and src is not None else pairs


def connected(graph: KnowledgeGraph, chains: list[Chain], side: str = "src") -> DataFrame:
    """``chain, id``: nodes at which a chain can start (``src``) or end (``dst``); no pair is made on the way."""
    check_types(graph, chains)
    if not chains:
        return graph.spark.createDataFrame([], "chain int, id long")
    back = side == "src"
    return followed(graph, [c[::-1] for c in chains] if back else chains, False, back).select("chain", F.col("at").alias("id"))


class ReachStore:
    """The reach of a graph's chains, each computed once and written, for all that asks for it later."""

    def __init__(self, graph: KnowledgeGraph):
        self.graph = graph
        self.table_of: dict[Chain, tuple[int, int]] = {}  # (table, number in it)
        self.tables: list[DataFrame] = []

    def words(self, chains: list[Chain]) -> DataFrame:
        """As ``words`` of these chains, which must differ; those not asked for before are computed together."""
        new = [c for c in chains if c not in self.table_of]
        if new:
            self.table_of |= {c: (len(self.tables), i) for i, c in enumerate(new)}
            self.tables.append(stored(words(self.graph, new), "reach"))
        asked: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, c in enumerate(chains):
            table, number = self.table_of[c]
            asked[table].append((number, i))
        if not asked:
            return words(self.graph, [])
        parts = [moved(self.tables[t].withColumnRenamed("chain", "place"), moves).withColumnRenamed("place", "chain").select(*WORD) for t, moves in asked.items()]
        return reduce(DataFrame.unionByName, parts)


def single(graph: KnowledgeGraph, edge_type: EdgeType, back: bool = False) -> bool:
    """Whether no node has two different neighbours over this type."""
    near, far = ("dst", "src") if back else ("src", "dst")
    return graph.bag(edge_type).dropna().groupBy(near).agg(F.min(far).alias("least"), F.max(far).alias("most")).filter("least <> most").isEmpty()


class Folds:
    """Chains whose first hop gives each source one node, or whose last hop gives each destination one: what they reach follows from what
    these nodes reach, ``x`` for a source and ``y`` for a destination, however many sources and destinations share them."""

    def __init__(self, graph: KnowledgeGraph):
        self.graph, self.known = graph, {}

    def single(self, edge_type: EdgeType, back: bool = False) -> bool:
        key = edge_type, back
        if key not in self.known:
            self.known[key] = single(self.graph, *key)
        return self.known[key]

    def of(self, chain: Chain) -> Fold | None:
        front, rear = len(chain) > 1 and self.single(chain[0]), len(chain) > 1 and self.single(chain[-1], back=True)
        return Fold(self.graph, chain, front, rear) if front or rear else None


@dataclass(frozen=True)
class Fold:
    graph: KnowledgeGraph
    chain: Chain
    front: bool
    rear: bool

    @cached_property
    def ends(self) -> tuple[DataFrame | None, DataFrame | None]:
        """``src, x`` and ``dst, y``, each source and destination once; none where these are the nodes themselves."""
        of = lambda t, *names: self.graph.linked(t).dropna().toDF(*names)
        return (of(self.chain[0], "src", "x") if self.front else None, of(self.chain[-1], "y", "dst") if self.rear else None)

    @cached_property
    def core(self) -> DataFrame | None:
        """``x, y``, distinct and written: what the hops between reach; none if there are no such hops, so that x is y."""
        hops = self.chain[self.front : len(self.chain) - self.rear]
        return stored(reach(self.graph, [hops]).select(F.col("src").alias("x"), F.col("dst").alias("y")), "core") if hops else None

    def predictions(self, by: str | None) -> DataFrame:
        """``preds``, with ``by`` for each source or destination (``entity``): how many pairs the chain reaches."""
        (src, dst), back = self.ends, by == "dst"
        mine, other = ((dst, "dst", "y"), (src, "src", "x")) if back else ((src, "src", "x"), (dst, "dst", "y"))
        core = self.core
        if other[0] is None:
            weights = core.groupBy(mine[2]).agg(F.count("*").alias("preds"))
        else:
            sizes = other[0].groupBy(other[2]).agg(F.count("*").alias("preds"))
            weights = sizes.withColumnRenamed(other[2], mine[2]) if core is None else core.join(sizes, other[2]).groupBy(mine[2]).agg(F.sum("preds").alias("preds"))
        if by is None and mine[0] is not None:
            weights = weights.join(mine[0].groupBy(mine[2]).agg(F.count("*").alias("many")), mine[2]).withColumn("preds", F.col("preds") * F.col("many"))
        if by is None:
            return weights.agg(F.sum("preds").alias("preds"))
        return weights.withColumnRenamed(mine[2], "entity") if mine[0] is None else mine[0].join(weights, mine[2]).select(F.col(mine[1]).alias("entity"), "preds")

    def among(self, pairs: DataFrame) -> DataFrame:
        """The different ones of these ``src, dst`` that the chain reaches."""
        (src, dst), rows = self.ends, pairs.select("src", "dst")
        rows = rows.withColumn("x", F.col("src")) if src is None else rows.join(src, "src")
        rows = rows.withColumn("y", F.col("dst")) if dst is None else rows.join(dst, "dst")
        rows = rows.filter(F.col("x") == F.col("y")) if self.core is None else rows.join(self.core, ["x", "y"], "left_semi")
        return rows.select("src", "dst").distinct()

    def pairs(self) -> DataFrame:
        """``src, dst``, distinct: what the chain reaches. Sources are dealt among tasks and meet what their ``x`` reaches, so no pair is moved."""
        (src, dst), core = self.ends, self.core
        far = core if dst is None else dst.withColumnRenamed("y", "x") if core is None else core.join(dst, "y").select("x", "dst")
        far = far.withColumnRenamed("y", "dst") if dst is None else far
        if src is None:
            return far.withColumnRenamed("x", "src").select("src", "dst")
        return crossed(src, stored(far, "far")).select("src", "dst")


#: Rows that are sent to every executor, of two or three numbers each.
MOST_BROADCAST = 500_000


def crossed(near: DataFrame, far: DataFrame) -> DataFrame:
    """Both joined on ``x``; few values of it may stand for nearly all rows of both, so ``near`` is dealt evenly where ``far`` is small."""
    if far.count() > MOST_BROADCAST:
        return near.join(far, "x")
    parts = int(near.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return near.repartition(parts).join(F.broadcast(far), "x")
