"""A typed knowledge graph: a DataFrame of ids for each node type and one of pairs for each edge type.

``nodes(node_type, id)`` lists every node, isolated ones too. ``edges(src_type, relation, dst_type, src,
dst)`` is a bag. Both are unions made on demand; operators read the types that they need alone. The catalog
(edge types in declared order, empty ones included) is as small as a schema and lives on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import stored

EdgeType = tuple[str, str, str]
TYPE = ["src_type", "relation", "dst_type"]
EDGE_SCHEMA = "src_type string, relation string, dst_type string, src long, dst long"


@dataclass(frozen=True)
class KnowledgeGraph:
    ids: dict[str, DataFrame]
    pairs: dict[EdgeType, DataFrame]

    def __post_init__(self) -> None:
        if not self.pairs:
            raise ValueError("a graph needs at least one edge type")

    @classmethod
    def from_parts(cls, nodes: dict[str, DataFrame], edges: dict[EdgeType, DataFrame]) -> KnowledgeGraph:
        """From a one-column DataFrame of ids per node type and a two-column DataFrame per edge type."""
        long = lambda df, *names: df.toDF(*names).select(*(F.col(n).cast("long").alias(n) for n in names))
        return cls({t: long(df, "id") for t, df in nodes.items()}, {tuple(t): long(df, "src", "dst") for t, df in edges.items()})

    @classmethod
    def from_lists(cls, spark: SparkSession, nodes: dict[str, int], edges: dict[EdgeType, list[tuple[int, int]]]) -> KnowledgeGraph:
        """A small graph from node counts (ids 0..n-1) and lists of pairs; ValueError if no type has any."""
        if edges and not any(edges.values()):
            raise ValueError("all edge types are empty")
        return cls.from_parts({t: spark.range(n) for t, n in nodes.items()}, {t: spark.createDataFrame(list(pairs), "src long, dst long") for t, pairs in edges.items()})

    @classmethod
    def from_named_edges(cls, named: DataFrame) -> KnowledgeGraph:
        """From ``src_type, src_name, relation, dst_type, dst_name``: repeated edges become one, and
        names become ids 0..n-1 per type in order of name.

        Ids are given by range-partitioned rank: sorted slices number their rows and the slices' sizes
        offset them, so no node type is gathered in one task.
        """
        ends = named.select(F.col("src_type").alias("node_type"), F.col("src_name").alias("name")).unionByName(named.select(F.col("dst_type").alias("node_type"), F.col("dst_name").alias("name"))).distinct()
        dealt = ends.repartitionByRange("node_type", "name").sortWithinPartitions("node_type", "name").withColumn("m", F.monotonically_increasing_id())
        slices = dealt.groupBy("node_type", F.shiftright("m", 33).alias("slice")).agg(F.count("*").alias("n"), F.min("m").alias("first"))
        ahead = Window.partitionBy("node_type").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        offset = slices.select("node_type", "slice", "first", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
        ids = dealt.withColumn("slice", F.shiftright("m", 33)).join(offset, ["node_type", "slice"]).select("node_type", "name", (F.col("before") + F.col("m") - F.col("first")).alias("id"))
        src, dst = ids.toDF("src_type", "src_name", "src"), ids.toDF("dst_type", "dst_name", "dst")
        edges = named.select("src_type", "src_name", "relation", "dst_type", "dst_name").distinct().join(src, ["src_type", "src_name"]).join(dst, ["dst_type", "dst_name"]).select(*TYPE, "src", "dst")
        ids, edges = stored(ids.select("node_type", "id"), "named-nodes", ["node_type"]), stored(edges, "named-edges", TYPE)
        types = [tuple(r) for r in edges.select(*TYPE).distinct().orderBy(*TYPE).collect()]
        node_types = [r[0] for r in ids.select("node_type").distinct().orderBy("node_type").collect()]
        return cls({t: ids.filter(F.col("node_type") == t).select("id") for t in node_types}, {t: edges.filter(is_type(t)).select("src", "dst") for t in types})

    @property
    def spark(self) -> SparkSession:
        return next(iter(self.pairs.values())).sparkSession

    @property
    def edge_types(self) -> tuple[EdgeType, ...]:
        return tuple(self.pairs)

    @property
    def nodes(self) -> DataFrame:
        return reduce(DataFrame.unionByName, (df.select(F.lit(t).alias("node_type"), "id") for t, df in self.ids.items()))

    @property
    def edges(self) -> DataFrame:
        return self.edges_of(self.edge_types)

    def edges_of(self, types: tuple[EdgeType, ...]) -> DataFrame:
        """The bag of these types."""
        return reduce(DataFrame.unionByName, (self.pairs[t].select(*(F.lit(v).alias(k) for k, v in zip(TYPE, t, strict=True)), "src", "dst") for t in types))

    @property
    def catalog(self) -> DataFrame:
        """Edge types with their declared order."""
        return self.spark.createDataFrame([(*t, i) for i, t in enumerate(self.edge_types)], "src_type string, relation string, dst_type string, ordinal int")

    @property
    def node_types(self) -> tuple[str, ...]:
        return tuple(self.ids)

    @property
    def distinct_edges(self) -> DataFrame:
        return self.edges.distinct()

    def require(self, edge_type: EdgeType, with_edges: bool = False) -> EdgeType:
        """The type itself; ValueError if it is unknown, or has no edges though some are needed."""
        if tuple(edge_type) not in self.pairs:
            raise ValueError(f"unknown edge type {edge_type}")
        if with_edges and self.bag(edge_type).isEmpty():
            raise ValueError(f"edge type {edge_type} exists but has no edges")
        return tuple(edge_type)

    def require_node_type(self, node_type: str) -> str:
        if node_type not in self.ids:
            raise ValueError(f"unknown node type {node_type}")
        return node_type

    def bag(self, edge_type: EdgeType) -> DataFrame:
        """Raw ``src, dst`` of one type, repeats included."""
        return self.pairs[self.require(edge_type)]

    def linked(self, edge_type: EdgeType) -> DataFrame:
        """Distinct ``src, dst`` of one type; none for a type without edges."""
        return self.bag(edge_type).distinct()

    def adjacency(self, edge_type: EdgeType) -> DataFrame:
        """Distinct ``src, dst`` of one type, which must have edges."""
        return self.linked(self.require(edge_type, with_edges=True))

    def neighbors(self, node_id: int, edge_type: EdgeType) -> DataFrame:
        """Distinct ``dst`` of one node, sorted."""
        return self.bag(self.require(edge_type, with_edges=True)).filter(F.col("src") == node_id).select("dst").distinct().orderBy("dst")

    def node_counts(self) -> DataFrame:
        return self.nodes.groupBy("node_type").agg(F.count("*").alias("node_count"))

    def node_count(self, node_type: str) -> int:
        return self.ids[self.require_node_type(node_type)].count()

    def edge_counts(self) -> DataFrame:
        """Raw count per declared edge type, zeros included."""
        counted = self.edges.groupBy(*TYPE).agg(F.count("*").alias("edge_count"))
        return self.catalog.join(counted, TYPE, "left").select(*TYPE, "ordinal", F.coalesce("edge_count", F.lit(0)).alias("edge_count"))

    def edge_count(self, edge_type: EdgeType) -> int:
        return self.bag(edge_type).count()

    def total_edges(self) -> DataFrame:
        return self.edges.agg(F.count("*").alias("total_edges"))

    def outgoing_types(self) -> DataFrame:
        """Non-empty edge types per source type, numbered from 0 in declared order, with their number."""
        w = Window.partitionBy("src_type")  # as many rows as the schema has edge types
        some = self.edge_counts().filter("edge_count > 0")
        return some.select(*TYPE, "ordinal", "edge_count", (F.row_number().over(w.orderBy("ordinal")) - 1).alias("type_idx"), F.count("*").over(w).alias("n_types"))

    def outgoing_edge_types(self, node_type: str) -> list[EdgeType]:
        self.require_node_type(node_type)
        rows = self.outgoing_types().filter(F.col("src_type") == node_type).orderBy("ordinal").collect()
        return [tuple(r[k] for k in TYPE) for r in rows]

    def dangling(self) -> DataFrame:
        """Edges whose source or destination is not among the nodes."""
        src, dst = self.nodes.toDF("src_type", "src"), self.nodes.toDF("dst_type", "dst")
        return self.edges.join(src, ["src_type", "src"], "left_anti").select(*EDGE_COLUMNS).unionByName(self.edges.join(dst, ["dst_type", "dst"], "left_anti").select(*EDGE_COLUMNS))

    def written(self) -> KnowledgeGraph:
        """The same graph on a written table for each type, for operators that read edges again and again."""
        return KnowledgeGraph({t: stored(df, "nodes") for t, df in self.ids.items()}, {t: stored(df, "edges") for t, df in self.pairs.items()})

    def without(self, edge_type: EdgeType, held: DataFrame) -> KnowledgeGraph:
        """The graph without these ``src, dst`` edges of one type."""
        left = self.bag(edge_type).join(held, ["src", "dst"], "left_anti").select("src", "dst")
        return KnowledgeGraph(self.ids, {**self.pairs, tuple(edge_type): left})


def is_type(edge_type: EdgeType):
    return reduce(lambda a, b: a & b, (F.col(k) == v for k, v in zip(TYPE, edge_type, strict=True)))


EDGE_COLUMNS = [*TYPE, "src", "dst"]

CUSTOMER_NATION = ("customer", "in_nation", "nation")
SUPPLIER_NATION = ("supplier", "in_nation", "nation")
NATION_SUPPLIER = ("nation", "rev_in_nation", "supplier")
NATION_CUSTOMER = ("nation", "rev_in_nation", "customer")
NATION_REGION = ("nation", "in_region", "region")
BOUGHT = ("customer", "bought", "part")
SUPPLIED = ("part", "supplied_by", "supplier")
BOUGHT_FROM = ("customer", "bought_from", "supplier")


TRADE_KEYS = {
    "customer": "c_custkey long, c_nationkey long",
    "supplier": "s_suppkey long, s_nationkey long",
    "nation": "n_nationkey long, n_regionkey long",
    "region": "r_regionkey long",
    "part": "p_partkey long",
    "orders": "o_orderkey long, o_custkey long",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long",
}


def trade_graph(spark: SparkSession, sf_dir: str) -> KnowledgeGraph:
    """The order tables as a graph; the keys of the tables are the ids."""
    # keys are whole numbers of any width; a stated schema spares a look into each file
    read = lambda t, *cols: spark.read.schema(TRADE_KEYS[t]).parquet(f"{sf_dir}/{t}.parquet").select(*cols)
    orders = read("orders", F.col("o_orderkey").alias("k"), "o_custkey")
    lines = read("lineitem", F.col("l_orderkey").alias("k"), "l_partkey", "l_suppkey")
    sold = orders.join(lines, "k")
    nodes = {"customer": read("customer", "c_custkey"), "supplier": read("supplier", "s_suppkey"), "nation": read("nation", "n_nationkey"), "region": read("region", "r_regionkey"), "part": read("part", "p_partkey")}
    edges = {
        CUSTOMER_NATION: read("customer", "c_custkey", "c_nationkey"),
        SUPPLIER_NATION: read("supplier", "s_suppkey", "s_nationkey"),
        NATION_SUPPLIER: read("supplier", "s_nationkey", "s_suppkey"),
        NATION_CUSTOMER: read("customer", "c_nationkey", "c_custkey"),
        NATION_REGION: read("nation", "n_nationkey", "n_regionkey"),
        BOUGHT: sold.select("o_custkey", "l_partkey"),
        SUPPLIED: read("lineitem", "l_partkey", "l_suppkey"),
        BOUGHT_FROM: sold.select("o_custkey", "l_suppkey"),
    }
    return KnowledgeGraph.from_parts(nodes, edges)


def activity_graph(spark: SparkSession, sf_dir: str) -> KnowledgeGraph:
    """A second graph: users by kind of event and hour of day."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type", F.hour("ts").alias("hour"))
    kinds = [r["event_type"] for r in events.select("event_type").distinct().orderBy("event_type").collect()]
    edges = {("user", f"did_{k}", "hour"): events.filter(F.col("event_type") == k).select("user_id", "hour") for k in kinds}
    return KnowledgeGraph.from_parts({"user": events.select("user_id").distinct(), "hour": events.select("hour").distinct()}, edges)


def synthetic_graph(spark: SparkSession, nodes_per_type: int, degree: int = 10, seed: int = 0) -> KnowledgeGraph:
    """Three node types and four edge types with ``degree * nodes_per_type`` evenly drawn edges each.

    The edge types and their order are fixed values: rules of the benchmark name them.
    """
    from ..functions.portable_random import below

    types = [("A", "r_ab", "B"), ("B", "r_bc", "C"), ("B", "r_ba", "A"), ("A", "r_ac", "C")]
    pairs = {t: spark.range(nodes_per_type * degree).select(below(F.lit(nodes_per_type), seed, t[1], "src", F.col("id")).alias("src"), below(F.lit(nodes_per_type), seed, t[1], "dst", F.col("id")).alias("dst")) for t in types}
    return KnowledgeGraph.from_parts({t: spark.range(nodes_per_type) for t in "ABC"}, pairs)
