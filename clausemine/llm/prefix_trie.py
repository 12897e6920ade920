"""Prefix trie of conversations as succinct level-order tries (LOUDS), with rollups.

Turns are sorted by range of (conv_id, turn), so a conversation may span tasks. Each gets a key: the chain of its own
and all earlier turns' digests, a polynomial modulo 2^127 - 1. Such chains can be joined, so a conversation's
pieces are chained apart and then shifted by what stands before them, and rebuilding a conversation from another's
first turns only shifts keys once more. Equal (depth, key) is one node, and nodes are counted by grouping.

Nodes of one conversation alone are its tail: all their figures are known at once and no trie holds
them. Nodes that conversations share are dealt to shards by their prefix. A node is heavy if more than
``shard_rows`` turns stand below it; the root and heavy nodes are the upper levels, and each of their light
children's subtrees goes to one shard. Every shard becomes a LOUDS bitvector with its labels in level order, and one
pass from the last level to the first adds each node to its parent. The upper levels, at most (turns / ``shard_rows``) nodes
at each depth, are one more such trie over what the shards' tops add up to. By default ``shard_rows`` is the
larger of 1,000 and 16 times the square root of all turns, so neither side outgrows the other.

The hash of a node's conversations is fed from texts of up to ``CHUNK`` ids each, made range by range, so a node at
which very many conversations end is read as few rows, and never held.

Defined results: turns of one conversation are ordered by turn (null first), those with the same turn by role, then by a digest of
role and text; null role or text is empty; rows without conv_id belong to no conversation and are left out; repeated rows
are turns each; remainders of negative conv_ids are negative, as in SQL; an empty table gives no rows, not even a root; other columns are ignored;
long chains that many conversations share are upper levels and held by one task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize, table

FAMILY, CYCLE, CHUNK = 5, 9, 10_000
PRIME = (1 << 127) - 1
BASE = int.from_bytes(hashlib.sha256(b"conversation prefix").digest()[:15], "big")
NO_TURN = bytes(16)
NO_ENDS = hashlib.sha256(b"").hexdigest()


class Louds:
    """A forest under a super-root in level order: for each node a one for every child, then a zero.

    Node i (from 1; 0 is the super-root) is the i-th one. ``labels`` are its nodes' keys, in the same order.
    """

    def __init__(self, degrees: np.ndarray, labels: list[bytes]):
        self.n, self.labels = len(labels), labels
        bits = np.ones(int(degrees.sum()) + len(degrees), np.uint8)
        bits[np.cumsum(degrees) + np.arange(len(degrees))] = 0
        self.bits = np.packbits(bits, bitorder="little")

    def unpacked(self) -> np.ndarray:
        return np.unpackbits(self.bits, bitorder="little")[: 2 * self.n + 1]

    def parents(self) -> np.ndarray:
        """For nodes 1 .. n their parent: the number of zeros before their one."""
        bits = self.unpacked()
        return np.cumsum(1 - bits, dtype=np.int64)[np.flatnonzero(bits)]

    def levels(self) -> list[tuple[int, int]]:
        """Ranges of nodes (first, after the last) by level, the super-root's children first."""
        zeros, out, first = np.flatnonzero(self.unpacked() == 0), [], 1
        after = int(zeros[0]) + 1
        while first < after:
            out.append((first, after))
            first, after = after, int(zeros[after - 1]) - (after - 1) + 1
        return out

    def rolled_up(self, *values: np.ndarray) -> list[np.ndarray]:
        """Sums over subtrees of values of nodes 1 .. n, level by level from the last."""
        parents, sums = np.concatenate([[0], self.parents()]), [np.concatenate([[0], v]) for v in values]
        for a, b in reversed(self.levels()):
            for s in sums:
                np.add.at(s, parents[a:b], s[a:b])
        return [s[1:] for s in sums]


def parents_among(depth: np.ndarray, key: list[bytes], parent: list[bytes]) -> np.ndarray:
    """For each row the row of its parent, -1 if that is not among them."""
    own = np.array([b"%08x" % d + k.hex().encode() for d, k in zip(depth.tolist(), key, strict=True)], "S40")
    above = np.array([b"%08x" % max(d - 1, 0) + p.hex().encode() if d else b"none" for d, p in zip(depth.tolist(), parent, strict=True)], "S40")
    order = np.argsort(own)
    at = np.minimum(np.searchsorted(own[order], above), len(own) - 1)
    return np.where(own[order][at] == above, order[at], -1)


def level_order(above: np.ndarray) -> np.ndarray:
    """Rows breadth first; children in the order of their parents."""
    by_parent = np.argsort(above, kind="stable")
    ends = np.cumsum(np.bincount(above + 1, minlength=len(above) + 1))
    frontier, out = by_parent[: ends[0]], []
    while len(frontier):
        out.append(frontier)
        first, count = ends[frontier], ends[frontier + 1] - ends[frontier]
        frontier = by_parent[np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def tries(nodes: DataFrame, shard: Column) -> DataFrame:
    """A row for each shard: ``shard, n, louds, labels, nodes``.

    ``nodes`` have ``depth, key, parent, conv_id, n_convs, bytes`` and what hangs below them outside the shard:
    ``outside`` (children), ``outside_leaves``, ``outside_saved``. Those of the result are in level order, with their rollups; the parent's conv_id is
    null for tops.
    """

    def build(rows: pa.Table) -> pa.Table:
        depth, key, parent = rows["depth"].to_numpy(), rows["key"].to_pylist(), rows["parent"].to_pylist()
        above = parents_among(depth, key, parent)
        order = level_order(above)
        place = np.empty(len(order) + 1, np.int64)
        place[order], place[-1] = np.arange(1, len(order) + 1), 0
        degrees = np.bincount(place[above], minlength=len(order) + 1)
        louds = Louds(degrees, [key[i] for i in order.tolist()])
        column = {n: rows[n].to_numpy()[order] for n in ("depth", "conv_id", "n_convs", "bytes", "outside", "outside_leaves", "outside_saved")}
        children = column["outside"] + degrees[1:]
        leaves, saved = louds.rolled_up(column["outside_leaves"] + (children == 0), column["outside_saved"] + (column["n_convs"] - 1) * column["bytes"])
        up = louds.parents()
        conv = np.concatenate([[0], column["conv_id"]])
        fields = {
            "depth": pa.array(column["depth"], pa.int32()),
            "key": pa.array(louds.labels, pa.binary()),
            "parent": pa.array([parent[i] for i in order.tolist()], pa.binary()),
            "conv_id": pa.array(column["conv_id"]),
            "parent_conv_id": pa.array(conv[up], mask=up == 0),
            "n_convs": pa.array(column["n_convs"]),
            "n_children": pa.array(children),
            "n_leaves": pa.array(leaves),
            "saved_tokens": pa.array(saved),
        }
        listed = pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), pa.StructArray.from_arrays(list(fields.values()), list(fields)))
        return pa.table({"shard": rows["shard"][:1], "n": [len(order)], "louds": pa.array([louds.bits.tobytes()], pa.binary()), "labels": pa.array([b"".join(louds.labels)], pa.binary()), "nodes": listed})

    node = "depth int, key binary, parent binary, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
    return nodes.withColumn("shard", shard.cast("long")).groupBy("shard").applyInArrow(build, f"shard long, n long, louds binary, labels binary, nodes array<struct<{', '.join(f.replace(' ', ': ', 1) for f in node.split(', '))}>>")


def number(raw: bytes) -> int:
    return int.from_bytes(raw, "big")


def chained(batches: Iterator[pa.RecordBatch]):
    """``conv_id, slice, place, key, before, bytes``: turns of a sorted task with the chain of this task's turns of the conversation, with and without the turn itself."""
    part, last, chain, place = TaskContext.get().partitionId(), None, 0, 0
    for b in batches:
        keys, befores, places = [], [], []
        for conv, digest in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if conv != last:
                last, chain, place = conv, 0, 0
            befores.append(chain.to_bytes(16, "big"))
            chain = (chain * BASE + number(digest) + 1) % PRIME
            keys.append(chain.to_bytes(16, "big"))
            places.append(place)
            place += 1
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(keys), part, np.int32)), pa.array(places, pa.int64()), pa.array(keys, pa.binary()), pa.array(befores, pa.binary()), b.column(2)], ["conv_id", "slice", "place", "key", "before", "bytes"])


def carried(batches: Iterator[pa.RecordBatch]):
    """``conv_id, slice, turns_before, chain_before`` from ``conv_id, slice, n, chain`` in order."""
    last, chain, turns = None, 0, 0
    for b in batches:
        chains, befores = [], []
        for conv, n, own in zip(*(b.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
            if conv != last:
                last, chain, turns = conv, 0, 0
            chains.append(chain.to_bytes(16, "big"))
            befores.append(turns)
            chain, turns = (chain * pow(BASE, n, PRIME) + number(own)) % PRIME, turns + n
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(befores, pa.int64()), pa.array(chains, pa.binary())], ["conv_id", "slice", "turns_before", "chain_before"])


def own_turns(turns: DataFrame) -> DataFrame:
    """Turns with their chains within their task, written."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = turns.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"), F.unhex(F.substring(digest, 1, 30)).alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "digest"]
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(sorted_rows.select("conv_id", "digest", "bytes").mapInArrow(chained, "conv_id long, slice int, place long, key binary, before binary, bytes long"), "turns")


def rebuilt(turns: DataFrame, family: int = FAMILY, cycle: int = CYCLE) -> DataFrame:
    """``conv_id, depth, key, parent, bytes, length``: the prefixes of every rebuilt conversation, the empty one too, written.

    A conversation c starts with the first h turns of c - c % family, h = crc32(c) % cycle, and goes on with its own after their first h.
    """
    own = own_turns(turns)
    parts = own.groupBy("conv_id", "slice").agg(F.count("*").alias("n"), F.max_by("key", "place").alias("chain"))
    parts = materialize(parts, "conversation-parts")
    carry = parts.repartition("conv_id").sortWithinPartitions("conv_id", "slice").mapInArrow(carried, "conv_id long, slice int, turns_before long, chain_before binary")
    carry = materialize(carry, "carry")
    most = cycle - 1

    def shifted(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            place, key, before, chain = (b.column(i).to_pylist() for i in (1, 2, 4, 5))
            keys = [k if not t else ((number(c) * pow(BASE, p + 1, PRIME) + number(k)) % PRIME).to_bytes(16, "big") for p, k, t, c in zip(place, key, before, chain, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([p + t for p, t in zip(place, before, strict=True)], pa.int64()), pa.array(keys, pa.binary()), b.column(3)], ["conv_id", "place", "key", "bytes"])

    starts = own.filter(F.col("place") < most).join(carry.filter(F.col("turns_before") < most), ["conv_id", "slice"]).select("conv_id", "place", "key", "bytes", "turns_before", "chain_before")
    starts = starts.mapInArrow(shifted, "conv_id long, place long, key binary, bytes long").filter(F.col("place") < most)
    heads = starts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "key", "bytes"))).alias("head"))  # at most cycle - 1 entries
    heads = materialize(heads, "heads")
    convs = parts.groupBy("conv_id").agg(F.sum("n").alias("turns"))
    convs = convs.withColumns({"base": F.col("conv_id") - F.col("conv_id") % family, "h": (F.crc32(F.col("conv_id").cast("string")) % cycle).cast("int")})
    told = convs.join(heads, "conv_id").join(heads.select(F.col("conv_id").alias("base"), F.col("head").alias("first")), "base", "left")
    taken = F.least("h", F.coalesce(F.size("first"), F.lit(0)))
    told = told.withColumn("taken", F.when(F.col("first").isNull(), 0).otherwise(taken))
    no_turn, at = F.lit(bytearray(NO_TURN)), lambda keys, n: F.when(F.col(n) > 0, F.try_element_at(keys, F.col(n))["key"])
    told = told.select("conv_id", "h", "taken", F.slice(F.coalesce("first", F.array().cast("array<struct<place:bigint,key:binary,bytes:bigint>>")), F.lit(1), F.col("taken")).alias("first"), F.when(F.col("h") == 0, no_turn).otherwise(at(F.col("head"), "h")).alias("left_out"), (F.col("taken") + F.greatest(F.col("turns") - F.col("h"), F.lit(0))).alias("length"))
    told = materialize(told.withColumn("entry", F.coalesce(at(F.col("first"), "taken"), no_turn)), "rebuilt-heads")
    root = told.select("conv_id", F.lit(0).alias("depth"), no_turn.alias("key"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("bytes"), "length")
    copied = told.select("conv_id", "length", "first", F.posexplode("first").alias("i", "turn"))
    before = F.when(F.col("i") == 0, no_turn).otherwise(F.try_element_at("first", F.greatest("i", F.lit(1)))["key"])
    copied = copied.select("conv_id", (F.col("i") + 1).alias("depth"), "turn.key", before.alias("parent"), "turn.bytes", "length")
    names = ["conv_id", "depth", "key", "parent", "bytes", "length"]

    def moved(batches: Iterator[pa.RecordBatch]):
        powers = [1]
        for b in batches:
            conv, size, length = b.column(0), b.column(4), b.column(11)
            rows = []
            for i, (place, key, prior, turns_before, chain, h, taken, out, entry) in enumerate(zip(*(b.column(k).to_pylist() for k in (1, 2, 3, 5, 6, 7, 8, 9, 10)), strict=True)):
                over = turns_before + place - h
                if over < 0:
                    continue
                while len(powers) <= min(max(over, place) + 1, 4096):
                    powers.append(powers[-1] * BASE % PRIME)
                power = lambda k: powers[k] if k < len(powers) else pow(BASE, k, PRIME)
                c, delta = number(chain), number(entry) - number(out)
                now = (c * power(place + 1) + number(key) + delta * power(over + 1)) % PRIME
                then = (c * power(place) + number(prior) + delta * power(over)) % PRIME
                rows.append((i, taken + over + 1, now.to_bytes(16, "big"), then.to_bytes(16, "big")))
            at, depth, keys, parents = zip(*rows, strict=True) if rows else ((), (), (), ())
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([conv.take(at), pa.array(depth, pa.int32()), pa.array(keys, pa.binary()), pa.array(parents, pa.binary()), size.take(at), length.take(at)], names)

    shift = carry.join(told.select("conv_id", "h", "taken", "left_out", "entry", "length"), "conv_id")
    kept = own.join(shift, ["conv_id", "slice"]).filter(F.col("turns_before") + F.col("place") >= F.col("h"))
    kept = kept.select("conv_id", "place", "key", "before", "bytes", "turns_before", "chain_before", "h", "taken", "left_out", "entry", "length")
    kept = kept.mapInArrow(moved, "conv_id long, depth int, key binary, parent binary, bytes long, length long")
    return materialize(root.unionByName(copied).unionByName(kept), "prefixes")


def end_hashes(prefixes: DataFrame) -> DataFrame:
    """``depth, key, ends_sha256`` of nodes at which conversations end: ids in ascending order, fed to the hash text by text."""

    def chunks(batches: Iterator[pa.RecordBatch]):
        last, ids = None, []

        def row():
            return pa.RecordBatch.from_arrays([pa.array([last[0]], pa.int32()), pa.array([last[1]], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], ["depth", "key", "first", "ids"])

        rows = []
        for b in batches:
            for depth, key, conv in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if ids and ((depth, key) != last or len(ids) >= CHUNK):
                    rows.append(row())
                    ids = []
                last = depth, key
                ids.append(conv)
            if rows:
                yield pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
                rows = []
        if ids:
            yield row()

    def digests(batches: Iterator[pa.RecordBatch]):
        last, state, out = None, None, []
        for b in batches:
            for depth, key, ids in zip(*(b.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                if (depth, key) != last:
                    if state:
                        out.append((*last, state.hexdigest()))
                    last, state = (depth, key), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            yield of(out)
            out = []
        if state:
            yield of([(*last, state.hexdigest())])

    def of(rows):
        d, k, h = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(d, pa.int32()), pa.array(k, pa.binary()), pa.array(h, pa.string())], ["depth", "key", "ends_sha256"])

    order = ["depth", "key", "conv_id"]
    ends = prefixes.filter("depth = length").select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    texts = ends.mapInArrow(chunks, "depth int, key binary, first long, ids string")
    return texts.repartition("depth", "key").sortWithinPartitions("depth", "key", "first").mapInArrow(digests, "depth int, key binary, ends_sha256 string")


def conversation_trie(turns: DataFrame, family: int = FAMILY, cycle: int = CYCLE, shard_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(the nodes, the shards' tries).

    Nodes: ``conv_id, depth, key, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``. Tries: ``shard, n, louds,
    labels, nodes``, shard -1 holding the upper levels.
    """
    prefixes = rebuilt(turns, family, cycle)
    here = ["depth", "key"]
    nodes = prefixes.groupBy(*here).agg(F.first("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"), F.sum((F.col("depth") == F.col("length")).cast("long")).alias("n_ends"), F.sum(F.col("length") - F.col("depth") + 1).alias("weight"))
    nodes = materialize(nodes, "nodes")
    total = prefixes.count()
    limit = shard_rows or max(1000, 16 * math.isqrt(total))
    is_upper = (F.col("depth") == 0) | ((F.col("weight") > limit) & (F.col("n_convs") > 1))
    upper = materialize(nodes.filter(is_upper), "upper-nodes")  # at most total / limit nodes at each depth
    above = lambda df, name: F.broadcast(df.select((F.col("depth") + 1).alias("depth"), F.col("key").alias("parent"), F.col("conv_id").alias(name)))
    tops = prefixes.join(above(upper, "over"), ["depth", "parent"], "left_semi").join(F.broadcast(upper.select(*here)), here, "left_anti").select("conv_id", F.col("key").alias("top"))
    light = nodes.filter((F.col("n_convs") > 1) & ~is_upper).join(tops, "conv_id")
    light = materialize(light, "light-nodes")
    found = nodes.filter((F.col("n_convs") == 1) & ~is_upper).join(above(upper, "over"), ["depth", "parent"], "left")
    shared = light.select((F.col("depth") + 1).alias("depth"), F.col("key").alias("parent"), F.col("conv_id").alias("beside"))
    found = found.join(shared, ["depth", "parent"], "left")
    single = materialize(found.select("conv_id", *here, "parent", "n_ends", F.coalesce("over", "beside").alias("left")), "single-nodes")
    tails = single.filter(F.col("left").isNotNull()).groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("key")).agg(F.count("*").alias("tails"))
    zero, columns = F.lit(0).cast("long"), ["depth", "key", "parent", "conv_id", "n_convs", "bytes"]
    hung = F.coalesce("tails", zero)
    inner = light.join(tails, here, "left").select(*columns, "top", hung.alias("outside"), hung.alias("outside_leaves"), zero.alias("outside_saved"))
    shards = max(1, -(-total // limit))
    light_tries = materialize(tries(inner, F.pmod(F.xxhash64("top"), F.lit(shards))), "tries")
    rolled = light_tries.select(F.inline("nodes"))
    below = rolled.filter(F.col("parent_conv_id").isNull()).groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("key")).agg(F.count("*").alias("tops"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    outside = upper.join(tails, here, "left").join(below, here, "left").select(*columns, (hung + F.coalesce("tops", zero)).alias("outside"), (hung + F.coalesce("leaves", zero)).alias("outside_leaves"), F.coalesce("saved", zero).alias("outside_saved"))
    upper_trie = materialize(tries(outside, F.lit(-1)), "upper-trie")
    figures = ["conv_id", *here, "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    rolled = rolled.join(above(upper, "over"), ["depth", "parent"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "over"))
    many = upper_trie.select(F.inline("nodes")).select(*figures).unionByName(rolled.select(*figures))
    many = many.join(end_hashes(prefixes), here, "left").select(*figures, F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))
    one = F.lit(1).cast("long")
    alone = single.select("conv_id", *here, F.coalesce("left", "conv_id").alias("parent_conv_id"), one.alias("n_convs"), (1 - F.col("n_ends")).alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"), F.when(F.col("n_ends") > 0, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(NO_ENDS).alias("ends_sha256"))
    return many.unionByName(alone), light_tries.unionByName(upper_trie)


def op11_prefix_trie(spark, sf_dir):
    nodes, _ = conversation_trie(table(spark, sf_dir, "conversations"))
    return nodes.withColumn("depth", F.col("depth").cast("long")).drop("key")


CRC_STEPS = ", ".join(f"crc{i + 1} AS (SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END AS v FROM crc{i})" for i in range(8))
OP11_SQL = f"""WITH crc0 AS (SELECT range AS i, range AS v FROM range(256)), {CRC_STEPS}, crc AS (SELECT list(v ORDER BY i) AS t FROM crc8),
turns AS (SELECT conv_id AS c, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p FROM conversations WHERE conv_id IS NOT NULL),
own AS MATERIALIZED (SELECT c, list(turn ORDER BY p) AS s FROM turns GROUP BY c),
marked AS (SELECT c, s, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295) % {CYCLE} AS h FROM own, crc),
rebuilt AS (SELECT m.c, list_concat(coalesce(o.s[1:h], []), m.s[h + 1:]) AS s FROM marked m LEFT JOIN own o ON o.c = m.c - m.c % {FAMILY}),
prefixes AS (SELECT c, s, unnest(range(len(s) + 1)) AS d FROM rebuilt),
nodes AS MATERIALIZED (SELECT d, s[1:d] AS k, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len(s) = d), '')) AS ends_sha256 FROM prefixes GROUP BY d, s[1:d]),
children AS (SELECT d - 1 AS d, k[1:d - 1] AS k, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
full_nodes AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.d = n.d AND c.k = n.k),
above AS (SELECT unnest(range(d + 1)) AS d, k, (n_children = 0)::BIGINT AS leaf, (n_convs - 1) * coalesce(strlen(k[-1].text), 0) AS saved FROM full_nodes),
rolled AS (SELECT d, k[1:d] AS k, sum(leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM above GROUP BY d, k[1:d])
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, r.n_leaves, r.saved_tokens, n.ends_sha256
FROM full_nodes n JOIN rolled r ON r.d = n.d AND r.k = n.k LEFT JOIN nodes p ON p.d = n.d - 1 AND p.k = n.k[1:n.d - 1]"""
