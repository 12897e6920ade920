"""Paths of given lengths between the ends of links, met in the middle, and how many of each shape there are.

Paths are taken by the node types of their places. A path is two halves: one from its head forwards, one from its tail
backwards. They meet at the place that makes the fewest rows by the sizes of the edge types; links join the half first that has fewer
walks to an end. Where ends have many walks to the middle on both sides, links and halves are first met as lists of ids (``meeting``), which
leaves the (head, middle, tail) that do meet, and halves join these.

A shape says which places of a path hold one entity. It needs no path: ``path_shapes`` counts the ways of a link on which
given places hold one entity, others free, carrying the entities of these places alone, and takes from each count those of
its special cases (Moebius inversion over the partitions of places). So a hub costs its neighbours and not the paths through it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.knowledge_graph import EdgeType, KnowledgeGraph
from ..sources.storage import stored

#: Rows of candidates, as a multiple of those of links and halves: beyond it lists of ids meet first, and it is what one slice of heads may make there.
WIDE, SLICE = 4, 4
#: So many ids of a list cost as much as a row.
LISTED = 4
#: Paths that a task lists.
PATHS_A_TASK = 2_000_000
SHAPE = "array<struct<name: string, node_type: string, relation: string>>"


def routes(graph: KnowledgeGraph, head_type: str, tail_type: str, length: int) -> list[tuple[str, ...]]:
    """The sequences of node types that edges of this length can have between these types."""
    after: dict[str, set[str]] = {}
    for t in graph.edge_types:
        after.setdefault(t[0], set()).add(t[2])
    behind = [{tail_type}]
    for _ in range(length):
        behind.append({a for a, ends in after.items() if ends & behind[-1]})
    found = [(head_type,)] if head_type in behind[length] else []
    for left in range(length - 1, -1, -1):
        found = [(*r, t) for r in found for t in sorted(after.get(r[-1], set()) & behind[left])]
    return found


@dataclass(frozen=True)
class Way:
    """Node types of a path's places and the edge types of its hops; the halves meet after ``half`` hops. ``tail_first`` if links join the tails' half
    first, ``wide`` if lists of ids meet before, in ``slices`` of heads."""

    nodes: tuple[str, ...]
    hops: list[list[EdgeType]]
    half: int
    tail_first: bool
    wide: bool
    slices: int
    paths: float  # about how many paths lie between links

    @property
    def length(self) -> int:
        return len(self.hops)

    @property
    def chains(self) -> list[tuple[EdgeType, ...]]:
        return list(product(*self.hops))

    def side(self, back: bool) -> list[list[EdgeType]]:
        """The hops of a half as it is walked."""
        return self.hops[self.half :][::-1] if back else self.hops[: self.half]


class Links:
    """The distinct edges of the types on the way, each type written once, and how large they are."""

    def __init__(self, graph: KnowledgeGraph, types: list[EdgeType]):
        self.graph, self.types = graph, types
        self.number = {t: i for i, t in enumerate(types)}
        self.tables = {t: stored(graph.linked(t).dropna(), "links") for t in types}
        sizes = (df.agg(F.lit(i).alias("t"), F.count("*").alias("n"), F.approx_count_distinct("src").alias("s"), F.approx_count_distinct("dst").alias("d")) for i, df in enumerate(self.tables.values()))
        rows = {r["t"]: (r["n"], max(r["s"], 1), max(r["d"], 1)) for r in reduce(DataFrame.unionByName, sizes).collect()} if types else {}  # a row for each type
        self.sizes = {t: rows[i] for t, i in self.number.items()}

    def hop(self, types: list[EdgeType], back: bool) -> DataFrame:
        """``from, to, type_no, relation``: edges of these types as they are walked."""
        near, far = ("dst", "src") if back else ("src", "dst")
        return reduce(DataFrame.unionByName, (self.tables[t].select(F.col(near).alias("from"), F.col(far).alias("to"), F.lit(self.number[t]).cast("long").alias("type_no"), F.lit(t[1]).alias("relation")) for t in types))

    def spread(self, types: list[EdgeType], back: bool) -> float:
        """About how many edges of these types a node has."""
        return sum(self.sizes[t][0] / self.sizes[t][2 if back else 1] for t in types)

    def way(self, nodes: tuple[str, ...], n_pairs: int, n_heads: int, n_tails: int) -> Way:
        """The paths along these node types, cut where the fewest rows are made."""
        hops, best = [[t for t in self.types if (t[0], t[2]) == ends] for ends in zip(nodes, nodes[1:], strict=False)], None
        for half in range(len(hops) + 1):
            of_head = math.prod(self.spread(h, False) for h in hops[:half])
            of_tail = math.prod(self.spread(h, True) for h in hops[half:])
            a, b = n_heads * of_head if half else 0, n_tails * of_tail if half < len(hops) else 0
            rows, n_mid = n_pairs * min(of_head, of_tail), max((self.sizes[t][2] for t in hops[half - 1]), default=1) if half else n_heads
            wide = 0 < half < len(hops) and rows > WIDE * (n_pairs + a + b)
            crossed = n_heads * of_head * n_tails * of_tail / n_mid
            cost = a + b + (crossed / LISTED if wide else rows)
            if best is None or cost < best[0]:
                best = cost, Way(nodes, hops, half, of_tail < of_head, wide, max(1, math.ceil(crossed / (SLICE * (n_pairs + a + b + 1)))), crossed * n_pairs / (n_heads * n_tails))
        return best[1]

    def first_hop(self, ends: DataFrame, n_ends: int, types: list[EdgeType], back: bool) -> DataFrame:
        """Edges that leave these ends; all edges where most of their nodes are ends, as others meet no link later."""
        edges = self.hop(types, back)
        if 2 * n_ends > max(self.sizes[t][2 if back else 1] for t in types):
            return edges
        return edges.join(ends.select(F.col("tail_id" if back else "head_id").alias("from")).distinct(), "from", "left_semi")

    def step(self, state: DataFrame | None, asked: Asked, types: list[EdgeType], back: bool) -> DataFrame:
        """The state's walkers with each edge at their node; without a state, walkers that start."""
        if state is None:
            return self.first_hop(asked.pairs, asked.n_tails if back else asked.n_heads, types, back).withColumn("start", F.col("from"))
        return state.join(self.hop(types, back), F.col("at") == F.col("from"))


@dataclass(frozen=True)
class Asked:
    """Links of one head and tail type, and how many links, heads and tails there are."""

    pairs: DataFrame
    n_pairs: int
    n_heads: int
    n_tails: int


def meeting(way: Way, links: Links, asked: Asked) -> DataFrame:
    """``head_id, mid, tail_id``: middles at which a link's halves meet. Lists of tails go to the heads, where those asked for are kept."""
    ahead, back = walked(way, links, asked, False).toDF("head_id", "mid"), walked(way, links, asked, True).toDF("tail_id", "mid")
    tails, parts = back.groupBy("mid").agg(F.collect_list("tail_id").alias("tails")), []
    for i in range(way.slices):
        mine = F.pmod(F.xxhash64("head_id"), F.lit(way.slices)) == i
        wanted = asked.pairs.filter(mine).groupBy("head_id").agg(F.collect_list("tail_id").alias("wanted"))
        met = ahead.filter(mine).join(tails, "mid").select("head_id", "mid", "tails").join(wanted, "head_id")
        parts.append(stored(met.select("head_id", "mid", F.explode(F.array_intersect("tails", "wanted")).alias("tail_id")), "meeting"))
    return reduce(DataFrame.unionByName, parts)


def walked(way: Way, links: Links, asked: Asked, back: bool) -> DataFrame:
    """``start, at``, distinct: the middles that each start reaches."""
    state = None
    for types in way.side(back):
        first = state is None
        state = links.step(state, asked, types, back).select("start", F.col("to").alias("at"))
        state = state if first and len(types) == 1 else state.distinct()
    return state


def joined(way: Way, links: Links, asked: Asked, ahead: DataFrame | None, back: DataFrame | None, conditions: list[Column], parts: int | None = None) -> DataFrame:
    """Links with halves ``a_start, a_at, ...`` and ``b_start, b_at, ...`` that meet; a half without hops is its link's end. ``parts``: among how many tasks the last join is dealt."""
    pairs = meeting(way, links, asked) if way.wide else asked.pairs
    every = lambda *cs: reduce(lambda a, b: a & b, cs)
    of_head, of_tail = F.col("head_id") == F.col("a_start"), F.col("tail_id") == F.col("b_start")
    if back is None:
        return pairs.join(ahead, every(of_head, F.col("tail_id") == F.col("a_at"), *conditions))
    if ahead is None:
        return pairs.join(back, every(of_tail, F.col("head_id") == F.col("b_at"), *conditions))
    meet = [F.col("a_at") == F.col("b_at"), *conditions]
    if way.wide:
        of_head, of_tail = of_head & (F.col("mid") == F.col("a_at")), of_tail & (F.col("mid") == F.col("b_at"))
    (first, on), (second, then) = ((back, of_tail), (ahead, of_head)) if way.tail_first else ((ahead, of_head), (back, of_tail))
    some = pairs.join(first, on)
    some = some.repartition(parts, *(("head_id", "b_at") if way.tail_first else ("tail_id", "a_at"))) if parts else some
    return some.join(second, every(then, *meet))


def all_ways(graph: KnowledgeGraph, triples: DataFrame, low: int, high: int):
    """(links, what is asked, the way) for every sequence of node types. The different ends of triples are written."""
    pairs = stored(triples.select("head_id", "head_type", "tail_id", "tail_type").dropna().distinct(), "ends")
    sizes = pairs.groupBy("head_type", "tail_type").agg(F.count("*").alias("n"), F.approx_count_distinct("head_id").alias("heads"), F.approx_count_distinct("tail_id").alias("tails"))
    known = sizes.collect()  # as few as pairs of node types
    found = [(r, nodes) for r in known for length in range(low, high + 1) for nodes in routes(graph, r["head_type"], r["tail_type"], length)]
    used = {ends for _, nodes in found for ends in zip(nodes, nodes[1:], strict=False)}
    links = Links(graph, [t for t in graph.edge_types if (t[0], t[2]) in used])
    for r, nodes in found:
        mine = pairs.filter((F.col("head_type") == r["head_type"]) & (F.col("tail_type") == r["tail_type"])).select("head_id", "tail_id")
        asked = Asked(mine, r["n"], r["heads"], r["tails"])
        yield links, asked, links.way(nodes, r["n"], r["heads"], r["tails"])


def one(step: Column, shown: bool) -> Column:
    return step if shown else F.array(step)


def glued(first: Column, second: Column, shown: bool) -> Column:
    """Steps one after the other: texts with a blank between, or arrays."""
    return F.concat_ws(" ", first, second) if shown else F.concat(first, second)


def listed_half(way: Way, links: Links, asked: Asked, back: bool, low: int, step, shown: bool) -> DataFrame | None:
    """``start, at, steps`` and, forwards, ``seen``: every walk of a half. ``seen`` are the ids, from place ``low`` on, of nodes of the tail's type; backwards walks that come by the tail there are left out."""
    state, tail_type = None, way.nodes[-1]
    for n, types in enumerate(way.side(back), 1):
        place, first = way.length - n if back else n, state is None
        taken = links.step(state, asked, types, back)
        this = one(step(F.col("to" if back else "from"), F.lit(way.nodes[place if back else n - 1]), F.col("relation")), shown)
        before = one(step(F.col("start"), F.lit(tail_type), F.lit("")), shown) if first else F.col("steps")
        steps = glued(this, before, shown) if back else this if first else glued(before, this, shown)
        counts = low <= place < way.length and way.nodes[place] == tail_type
        taken = taken.filter(F.col("to") != F.col("start")) if back and counts else taken
        seen = F.array().cast("array<long>") if first else F.col("seen")
        seen = F.concat(seen, F.array("to")) if counts else seen
        state = taken.select("start", F.col("to").alias("at"), steps.alias("steps"), seen.alias("seen"))
    return state


def listed_ways(graph: KnowledgeGraph, triples: DataFrame, low: int, high: int, step, shown: bool = False):
    """``head_id, head_type, tail_id, tail_type, path`` for each sequence of node types: every path, as an array of what ``step(entity, node type, relation)`` makes of its places, or as one text if these are ``shown``, which halves carry ready made."""
    for links, asked, way in all_ways(graph, triples, low, high):
        ahead, back = (listed_half(way, links, asked, back, low, step, shown) for back in (False, True))
        ahead = ahead and ahead.select(F.col("start").alias("a_start"), F.col("at").alias("a_at"), F.col("steps").alias("a_steps"), "seen")
        back = back and back.select(F.col("start").alias("b_start"), F.col("at").alias("b_at"), F.col("steps").alias("b_steps"))
        parts = max(int(graph.spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(way.paths / PATHS_A_TASK))  # by what the join makes, not by what it reads
        met, head_type, tail_type = joined(way, links, asked, ahead, back, [], parts), way.nodes[0], way.nodes[-1]
        if tail_type in way.nodes[low : min(way.half, way.length - 1) + 1]:
            met = met.filter(~F.array_contains("seen", F.col("tail_id")))
        rest = F.col("b_steps") if back else one(step(F.col("tail_id"), F.lit(tail_type), F.lit("")), shown)
        path = glued(F.col("a_steps"), rest, shown) if ahead else rest
        yield met.select("head_id", F.lit(head_type).alias("head_type"), "tail_id", F.lit(tail_type).alias("tail_type"), path.alias("path"))


def listed_paths(graph: KnowledgeGraph, triples: DataFrame, low: int, high: int, step) -> DataFrame:
    """``head_id, head_type, tail_id, tail_type, path``: every path, as an array of what ``step`` makes of its places."""
    found = list(listed_ways(graph, triples, low, high, step))
    if not found:
        return triples.limit(0).select("head_id", "head_type", "tail_id", "tail_type", one(step(F.col("head_id"), F.col("head_type"), F.lit("")), False).alias("path"))
    return reduce(DataFrame.unionByName, found)


def partitions(places: list[int], alike) -> list[tuple[tuple[int, ...], ...]]:
    """The ways to put these places into blocks of which each two may hold one entity."""
    if not places:
        return [()]
    first, found = places[0], []
    for rest in partitions(places[1:], alike):
        found.append(((first,), *rest))
        found += [(*rest[:i], (first, *b), *rest[i + 1 :]) for i, b in enumerate(rest) if all(alike(first, p) for p in b)]
    return [tuple(sorted(p)) for p in found]


def finer(whole: tuple[tuple[int, ...], ...]) -> list[tuple[tuple[tuple[int, ...], ...], int]]:
    """(partition, sign): the partitions that divide blocks of this one, and how often its count goes into theirs."""
    found = []
    for parts in product(*(partitions(list(b), lambda *_: True) for b in whole)):
        found.append((tuple(sorted(b for p in parts for b in p)), math.prod((-1) ** (len(p) - 1) * math.factorial(len(p) - 1) for p in parts)))
    return found


def counted_half(way: Way, links: Links, asked: Asked, back: bool, blocks: dict[int, tuple[int, ...]]) -> tuple[DataFrame | None, dict]:
    """(``start, at, sig, n`` and columns of entities that the other half must hold too, these columns by block): counts of walks, places of one block at one entity.

    ``sig`` are the numbers of the edge types taken, as digits.
    """
    prefix, start, base = ("b", way.length, len(links.types)) if back else ("a", 0, len(links.types))
    ahead_of = (lambda p, here: way.half <= p < here) if back else (lambda p, here: here < p <= way.half)
    crosses = lambda b: way.half not in b and min(b) < way.half < max(b)
    state, held = None, ({blocks[start]: "start"} if start in blocks else {})
    for n, types in enumerate(way.side(back), 1):
        place, left = (way.length - n, way.length - n + 1) if back else (n, n - 1)
        first = state is None
        state = links.step(state, asked, types, back)
        before = F.lit(0).cast("long") if first else F.col("sig")
        sig = before + F.col("type_no") * base ** (n - 1) if back else before * base + F.col("type_no")
        kept = [c for c in held.values() if c != "start"]
        state = state.select("start", F.col("to").alias("at"), sig.alias("sig"), (F.lit(1).cast("long") if first else F.col("n")).alias("n"), *kept)
        lost = n > 1 and blocks.get(left) not in held  # the node left behind is held no more, so walks are alike that differ in it
        block = blocks.get(place)
        if block in held:
            state = state.filter(F.col("at") == F.col(held[block]))
        elif block is not None and place != way.half:
            held = {**held, block: f"{prefix}_k{min(block)}"}
            state = state.withColumn(held[block], F.col("at"))
        held = {b: c for b, c in held.items() if c == "start" or crosses(b) or any(ahead_of(p, place) for p in b)}
        keep = ["start", "at", "sig", *(c for c in held.values() if c != "start")]
        state = state.groupBy(*keep).agg(F.sum("n").alias("n")) if lost else state.select(*keep, "n")
    columns = {b: c for b, c in held.items() if crosses(b)}
    if state is None:
        return None, {b: "tail_id" if back else "head_id" for b in columns}
    state = state.select(*(F.col(c).alias(f"{prefix}_{c}") for c in ("start", "at", "sig", "n")), *(c for c in columns.values() if c != "start"))
    return state, {b: f"{prefix}_start" if c == "start" else c for b, c in columns.items()}


def shape_of(chain: tuple[EdgeType, ...], partition: tuple[tuple[int, ...], ...]) -> list[tuple[str, str, str]]:
    """Names, types and relations of a path's places: X at its head's entity, Y at its tail's, Z0, Z1 ... by first sight."""
    types, names, n = [chain[0][0], *(t[2] for t in chain)], {}, 0
    for place in range(len(types)):
        block = next(b for b in partition if place in b)
        if block not in names:
            names[block] = "X" if 0 in block else "Y" if len(chain) in block else f"Z{n}"
            n += names[block][0] == "Z"
    named = [next(names[b] for b in partition if p in b) for p in range(len(types))]
    return [(name, t, chain[i][1] if i < len(chain) else "") for i, (name, t) in enumerate(zip(named, types, strict=True))]


def path_shapes(graph: KnowledgeGraph, triples: DataFrame, min_length: int = 2, max_length: int = 4) -> tuple[DataFrame, DataFrame]:
    """(``head_id, tail_id, shape_no, times``, ``shape_no, head_type, tail_type, shape``): how many paths of each shape lie between the ends of triples, as ``enumerate_paths`` finds them, and the shapes, which are few."""
    spark, found, shapes = graph.spark, [], []
    for links, asked, way in all_ways(graph, triples, min_length, max_length):
        length, base, rows, lookup = way.length, len(links.types), [], []
        if base**length >= 1 << 62:
            raise ValueError("too many edge types for paths of this length")
        number: dict = {}
        for i, whole in enumerate(partitions(list(range(length + 1)), lambda p, q: way.nodes[p] == way.nodes[q])):  # noqa: B023
            for chain in way.chains:
                named = []
                for part, sign in finer(whole):
                    if any(length in b and any(min_length <= p < length for p in b) for b in part):
                        continue  # a walk stops when it first comes to its tail
                    if (chain, part) not in number:
                        number[chain, part] = len(shapes)
                        shapes.append((len(shapes), way.nodes[0], way.nodes[-1], shape_of(chain, part)))
                    named.append((number[chain, part], sign))
                lookup.append((i, sum(links.number[t] * base ** (length - 1 - n) for n, t in enumerate(chain)), named))
            blocks = {p: b for b in whole if len(b) > 1 for p in b}
            (ahead, of_a), (back, of_b) = counted_half(way, links, asked, False, blocks), counted_half(way, links, asked, True, blocks)
            same = [F.col(of_a[b]) == F.col(of_b[b]) for b in of_a]
            if {0, length} <= set(blocks) and blocks[0] == blocks[length] and way.half in (0, length):
                same.append(F.col("head_id") == F.col("tail_id"))
            both = joined(way, links, asked, ahead, back, same)
            sig = (F.col("a_sig") if ahead else F.lit(0)) * base ** (length - way.half) + (F.col("b_sig") if back else F.lit(0))
            n = (F.col("a_n") if ahead else F.lit(1)) * (F.col("b_n") if back else F.lit(1))
            rows.append(both.select("head_id", "tail_id", sig.cast("long").alias("sig"), F.lit(i).alias("part"), n.cast("long").alias("n")))
        names = F.broadcast(spark.createDataFrame(lookup, "part int, sig long, counts array<struct<shape_no: int, sign: int>>"))  # a row for each chain and partition
        signed = reduce(DataFrame.unionByName, rows).join(names, ["part", "sig"]).select("head_id", "tail_id", "n", F.explode("counts").alias("c")).select("head_id", "tail_id", "c.shape_no", (F.col("n") * F.col("c.sign")).alias("n"))
        once = len(rows) == 1 and way.half in (0, length)  # a half that ends at the other end is counted by these
        counts = signed.withColumnRenamed("n", "times") if once else signed.groupBy("head_id", "tail_id", "shape_no").agg(F.sum("n").alias("times")).filter("times > 0")
        found.append(stored(counts, "path-shapes"))
    table = spark.createDataFrame(shapes, f"shape_no int, head_type string, tail_type string, shape {SHAPE}")
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "head_id long, tail_id long, shape_no int, times long"), table
