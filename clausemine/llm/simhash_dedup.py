"""SimHash near-dedup by anchor-point covering.

A fingerprint's 64 bits are cut into blocks so that two fingerprints within the threshold differ by
at most ``threshold // blocks`` bits in one block. In each block the anchors are the words of a
covering code: a Hamming code on 2^m - 1 bits (covering radius 1) times all values of the bits that
are left. A fingerprint is at home at its nearest anchor and is replicated to every anchor within
covering radius plus the block's threshold; so a linked pair meets at the home of either, and only
fingerprints of one anchor are compared, exactly and over all 64 bits.

Equal fingerprints are one. Per anchor only a spanning forest of the links leaves the task, so
groups of near copies cost no quadratic output; crowded anchors are cut into pairs of parts, each
compared by a task of its own. Anchors get finer with the number of distinct fingerprints; the layout
changes cost, never results.

Defined results: null and empty texts, and texts of white space alone, have fingerprint zero and are
linked like any other; component_id is the smallest doc_id reachable (null doc_ids are ignored for
it unless a component has no other); repeated rows are a row each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, materialize, table, texts

THRESHOLD, SHINGLE, SEED = 4, 4, 42
#: Blocks as (first bit, check bits of the Hamming code, other bits): three of 21 or 22 bits, or two of 32.
LAYOUTS = (((0, 4, 6), (21, 4, 6), (42, 4, 7)), ((0, 5, 1), (32, 5, 1)))
PART = 4096
SPACE = bytes(range(9, 14))
SPACES = bytes.maketrans(SPACE, b" " * len(SPACE))
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """The unsigned SimHash over word shingles, repeats included."""
    words = text.encode().translate(SPACES).translate(LOWER).split(b" ")
    words = [w for w in words if w]
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    last = ends[min(size, len(words)) - 1 :]
    first = np.concatenate([[0], ends + 1])[: len(last)]
    hash_of = xxhash.xxh64_intdigest
    h = np.array([hash_of(line[a:b], SEED) for a, b in zip(first.tolist(), last.tolist(), strict=True)], "<u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[k : k + (1 << 16), None].view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE, row: str | None = None) -> DataFrame:
    """``doc_id, fp`` with the fingerprint as a signed long, and ``row``, if a column of unique longs is named."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            fp = np.array([fingerprint(t, size) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), *b.columns[2:]], ["doc_id", "fp", *b.schema.names[2:]])

    if row is None:
        return texts(docs).mapInArrow(run, "doc_id long, fp long")
    return texts(docs, F.col(row).alias("row")).mapInArrow(run, "doc_id long, fp long, row long")


class Covering:
    """Anchors of one block: a Hamming code with ``check`` check bits times ``free`` free bits."""

    def __init__(self, first: int, check: int, free: int, within: int):
        self.first, self.bits, self.coded = np.uint64(first), (1 << check) - 1 + free, (1 << check) - 1
        self.check = check
        by_syndrome: list[list[int]] = [[] for _ in range(1 << check)]
        for weight in range(within + 2):  # covering radius 1, plus what a pair may differ by in this block
            for error in combinations(range(self.bits), weight):
                s = 0
                for bit in error:
                    s ^= bit + 1 if bit < self.coded else 0
                by_syndrome[s].append(sum(1 << bit for bit in error))
        self.errors = [np.array(e, np.uint64) for e in by_syndrome]

    def anchors(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index into fp, anchor, whether it is the home) of every anchor within reach."""
        word = fp >> self.first & np.uint64((1 << self.bits) - 1)
        syndrome = np.zeros(len(fp), np.int64)
        for bit in range(self.coded):
            syndrome ^= np.where(word >> np.uint64(bit) & np.uint64(1), bit + 1, 0)
        found = []
        for s, errors in enumerate(self.errors):
            at = np.flatnonzero(syndrome == s)
            home = np.uint64(1 << (s - 1) if s else 0)
            found.append((np.repeat(at, len(errors)), (word[at, None] ^ errors).ravel(), np.tile(errors == home, len(at))))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def layout_for(n: int) -> int:
    """The layout with the least work for n distinct fingerprints: rows sent, and comparisons at an even spread."""
    cost = []
    for blocks in LAYOUTS:
        sent, pairs = 0.0, 0.0
        for first, check, free in blocks:
            code = Covering(first, check, free, THRESHOLD // len(blocks))
            reach = np.mean([len(e) for e in code.errors])
            sent += n * reach
            pairs += n * n * reach / 2.0 ** (code.bits - check)
        cost.append(sent + pairs / 50)
    return int(np.argmin(cost))


def replicas(unique: DataFrame, layout: int, threshold: int = THRESHOLD) -> DataFrame:
    """``block, anchor, fp, home`` for each anchor that a fingerprint goes to."""
    blocks = LAYOUTS[layout]
    codes = [Covering(*b, threshold // len(blocks)) for b in blocks]

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for k in range(0, b.num_rows, 2000):
                fp = b.column(0).slice(k, 2000).to_numpy().view(np.uint64)
                for i, code in enumerate(codes):
                    at, anchor, home = code.anchors(fp)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, np.int32)), pa.array(anchor.view(np.int64)), pa.array(fp[at].view(np.int64)), pa.array(home)], ["block", "anchor", "fp", "home"])

    return unique.select("fp").mapInArrow(run, "block int, anchor long, fp long, home boolean")


def forest(homes: np.ndarray, others: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Edges that join the same fingerprints as all links between homes and others do."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p] if p in parent else p
        return x

    edges = []
    for k in range(0, len(homes), 256):
        block = homes[k : k + 256]
        for j in range(0, len(others), 4096):
            x, y = np.nonzero(np.bitwise_count(block[:, None] ^ others[None, j : j + 4096]) <= threshold)
            for a, b in zip(block[x].tolist(), others[j : j + 4096][y].tolist(), strict=True):
                if a != b and (ra := root(a)) != (rb := root(b)):
                    parent[max(ra, rb)] = min(ra, rb)
                    edges.append((a, b))
    return edges


def links(unique: DataFrame, layout: int, threshold: int = THRESHOLD, part: int = PART) -> DataFrame:
    """Edges ``u, v`` between fingerprints whose components are those of all links within the threshold."""
    rows = materialize(replicas(unique, layout, threshold), "anchors")
    crowded = rows.groupBy("block", "anchor").agg(F.count("*").alias("n")).filter(F.col("n") > part)
    parts = rows.join(crowded.withColumn("parts", F.ceil(F.col("n") / part).cast("int")), ["block", "anchor"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own, every = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"), F.sequence(F.lit(0), F.col("parts") - 1)
    as_home = parts.filter("home").select("block", "anchor", own.alias("i"), F.explode(every).alias("j"), "fp", F.lit(True).alias("home"))
    as_other = parts.select("block", "anchor", F.explode(every).alias("i"), own.alias("j"), "fp", F.lit(False).alias("home"))
    cells = as_home.unionByName(as_other).select(F.xxhash64("block", "anchor", "i", "j").alias("cell"), "block", "anchor", "i", "j", "fp", "home")
    dealt = cells.repartition("cell").sortWithinPartitions("cell", "block", "anchor", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]):
        held: list[tuple] = []

        def compared(key, fp, home):
            cut = np.flatnonzero(np.any(key[1:] != key[:-1], axis=1)) + 1
            edges = []
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(fp)], strict=True):
                if b - a > 2:  # a home alone meets only itself
                    h = home[a:b]
                    edges += forest(fp[a:b][h], fp[a:b][~h], threshold) if h.any() else []
            e = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["u", "v"])

        for b in batches:
            key = np.stack([c.to_numpy().astype(np.int64) for c in b.columns[:5]], axis=1)
            fp, home = b.column(5).to_numpy().view(np.uint64), b.column(6).to_numpy(zero_copy_only=False)
            if not len(key):
                continue
            ahead = np.flatnonzero(np.any(key != key[-1], axis=1))
            cut = int(ahead[-1]) + 1 if len(ahead) else 0
            # rows of the last cell wait for the next batch; a cell has at most twice `part` rows or so
            if cut:
                held.append((key[:cut], fp[:cut], home[:cut]))
                yield compared(*(np.concatenate(c) for c in zip(*held, strict=True)))
                held = []
            elif held and not np.array_equal(held[-1][0][-1], key[0]):
                yield compared(*(np.concatenate(c) for c in zip(*held, strict=True)))
                held = []
            held.append((key[cut:], fp[cut:], home[cut:]))
        if held:
            yield compared(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return dealt.mapInArrow(run, "u long, v long")


def simhash_dedup(docs: DataFrame, threshold: int = THRESHOLD, size: int = SHINGLE, layout: int | None = None, part: int = PART, row: str | None = None) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    If a column of unique longs is named as ``row``, it and ``component`` (a fingerprint, one per component) follow.
    """
    rows = materialize(fingerprints(docs, size, row), "fingerprints")
    unique = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    layout = layout_for(unique.count()) if layout is None else layout
    found = components(links(unique, layout, threshold, part))
    joined = unique.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    joined = materialize(joined, "fp-components")
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = joined.join(least, "component").select("fp", "component", "component_id")
    more = [] if row is None else [F.col("row").alias(row), "component"]
    return rows.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", *more)


def op6_simhash_dedup(spark, sf_dir):
    return simhash_dedup(table(spark, sf_dir, "documents"))
