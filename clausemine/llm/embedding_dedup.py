"""Embedding near-dedup by collision-counting projections.

Every vector, scaled to length one and less the mean of all, is projected on many random directions; each direction is one sorted line of values. A
vector is a member of the lines on which it lies farthest out, where lines are sparse, and queries
the few farthest of these: a window centred at its value collides with the members inside. Lines are
cut into cells as wide as the half-window, so a window meets three cells and the collisions are an
equi-join on (line, cell) that adaptive execution may split. Collisions are counted per pair; pairs
whose count reaches a bound go on to verification by the exact cosine in double precision.

Lines follow the number of vectors, so that a window meets as many unlike vectors at every size: about ``ENDS`` line ends for each vector of a
length. A direction is the sum of one direction out of each of two families (three for many vectors), so projecting on the families' few directions places a vector on
all the lines: the farthest sums come from the farthest terms.

Each length of vector has its own number of lines, members and queries, and its own bound: the highest that keeps the recall asked for on
pairs at exactly the threshold. Every vector of the table takes part in one such pair (in more where a length has less than ``PAIRS`` vectors), its partner
is made from one of ``PARTNERS`` random directions that a hash of the vector picks, and what the pairs meet is counted in tasks; nothing is sampled. Where recall
is too low for one collision, more members are taken, then fewer lines, each in another pass over the vectors of such lengths; a length for which no number of lines keeps it raises ValueError.
The mean keeps a direction that all vectors share from drawing all of them to the same lines. It is taken for the ``MEANS`` most frequent
lengths that keep the recall with it; the others use zero. Pairs are verified on the vectors as they are, each divided by its largest component first, so that
no square overflows or vanishes.

Equal vectors are one while candidates are searched, and count as often as they occur in n_links.
Work grows with N times the members of a window, and with the pairs that are alike. Projecting costs a vector about
4 * sqrt(N) directions up to a million vectors, then 2 * cbrt(N) and more, fewer where recall asks for it.

Defined results: vectors that are null, empty, zero or hold null or non-finite components have no
links, not even to copies of themselves, and are kept; vectors of different lengths never link;
rows are told apart by place, so repeated vec_ids are rows each; component_id ignores null vec_ids where it can;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, materialize, table

THRESHOLD, HALF_WINDOW, RECALL, SEED = 0.95, 0.5, 0.98, 7
ENDS, FAMILY = 64, 4096  # line ends for each vector; the most directions in a family of two
REACHES = ((48, 8), (96, 12))  # members and queries of a vector: the first that keeps the recall
PAIRS, PARTNERS, MEANS = 1500, 1024, 64  # the least pairs that a bound rests on; directions that make partners
Means = dict[int, np.ndarray]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one, whatever their magnitude."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    return np.array(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def family_sizes(n: int) -> tuple[int, int]:
    """(families, directions in each) whose sums have about ENDS line ends for each of n vectors."""
    two = math.ceil(math.sqrt(ENDS * n) / 2)
    return (2, two) if two <= FAMILY else (3, math.ceil(math.cbrt(ENDS * n) / 2))


def directions(dim: int, families: int, lines: int, seed: int) -> list[np.ndarray]:
    found = (np.random.default_rng([seed, dim, k]).standard_normal((dim, lines)) for k in range(families))
    return [a / np.linalg.norm(a, axis=0) * np.sqrt(dim / families) for a in found]


def farthest(line: np.ndarray, value: np.ndarray, members: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the lines with the greatest values, greatest first."""
    members = min(members, value.shape[1])
    at = np.argpartition(-value, members - 1, axis=1)[:, :members]
    at = np.take_along_axis(at, np.argsort(-np.take_along_axis(value, at, 1), axis=1, kind="stable"), 1)
    return np.take_along_axis(line, at, 1), np.take_along_axis(value, at, 1)


def tails(centred: np.ndarray, families: list[np.ndarray], members: int) -> tuple[np.ndarray, np.ndarray]:
    """Per vector the numbers and values of its farthest lines, a line's two ends count as two; the farthest sums are sums of the farthest terms."""
    line, value = np.zeros((len(centred), 1), np.int64), np.zeros((len(centred), 1))
    for family in families:
        z = centred @ family
        ends, far = farthest(2 * np.arange(z.shape[1]) + (z < 0), np.abs(z), members)
        i, j = np.divmod(np.arange(value.shape[1] * far.shape[1]), far.shape[1])
        some = (i + 1) * (j + 1) <= members  # both are sorted: before any other sum there are (i + 1) * (j + 1) - 1 that are no less
        line, value = farthest(line[:, i[some]] * (2 * z.shape[1]) + ends[:, j[some]], value[:, i[some]] + far[:, j[some]], members)
    return line, value


def pairs_each(n: int) -> int:
    """Of n vectors of a length, how many pairs each is given."""
    return -(-PAIRS // n)


def collisions(x: np.ndarray, prints: np.ndarray, each: int, mean: np.ndarray, families: list[np.ndarray], queries: int, members: int, half: float, threshold: float, seed: int) -> np.ndarray:
    """How often each unit vector meets ``each`` partners at the threshold, pair by pair; its print picks the partners, wherever the vector stands."""
    some = np.random.default_rng([seed, x.shape[1], len(families)]).standard_normal((PARTNERS, x.shape[1]))
    counts = np.zeros((len(x), each), np.int64)
    for k in range(0, len(x), 250):  # bounded memory
        s = slice(k, k + 250)
        lx, vx = tails(x[s] - mean, families, members)
        for j in range(each):
            y = some[(prints[s] + j) % PARTNERS]
            y = y - (y * x[s]).sum(1, keepdims=True) * x[s]
            y = unit(threshold * x[s] + np.sqrt(1 - threshold**2) * y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12))
            ly, vy = tails(y - mean, families, members)
            meet = (lx[:, :, None] == ly[:, None, :]) & (np.abs(vx[:, :, None] - vy[:, None, :]) <= half)
            counts[s, j] = meet[:, :queries, :].sum((1, 2)) + meet[:, :, :queries].sum((1, 2))
    return counts.ravel()


def bound_of(met: np.ndarray, pairs: np.ndarray, recall: float) -> tuple[int, float]:
    """The highest count that keeps ``recall`` of the pairs, 1 if none does, and the share it keeps; ``pairs[i]`` of them met ``met[i]`` times."""
    whole, bound = pairs.sum(), 1
    while pairs[met >= bound + 1].sum() / whole >= recall:
        bound += 1
    return bound, float(pairs[met >= bound].sum() / whole)


def choice(dim: int, n: int, step: int) -> dict:
    """The step-th settings for n vectors of a length: with the mean or without, more members, then half the lines."""
    families, lines = family_sizes(n)
    lines >>= step // (2 * len(REACHES))
    if not lines:
        raise ValueError(f"no number of lines keeps the recall for vectors of length {dim}")
    members, queries = REACHES[step % len(REACHES)]
    return {"families": families, "lines": lines, "members": members, "queries": queries, "centred": step // len(REACHES) % 2 == 0}


def calibrated(x: np.ndarray, mean: np.ndarray, n: int, half: float, threshold: float, recall: float, seed: int) -> dict:
    """``settings_of`` for unit vectors in memory, all of one length, with as many lines as n of them get."""
    for step in itertools.count():
        found = choice(x.shape[1], n, step)
        of = directions(x.shape[1], found["families"], found["lines"], seed)
        counts = collisions(x, np.arange(len(x)), pairs_each(len(x)), mean * found["centred"], of, found["queries"], found["members"], half, threshold, seed)
        bound, share = bound_of(*np.unique(counts, return_counts=True), recall)
        if share >= recall:
            return found | {"bound": bound, "recall": share}


def means_of(classes: DataFrame, sizes: DataFrame) -> Means:
    """The mean unit vector of each of the most frequent lengths."""

    def run(batches: Iterator[pa.RecordBatch]):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            count = np.diff(b.column(0).offsets.to_numpy())
            for dim in np.unique(count).tolist():
                x = unit(matrix(b.column(0).filter(pa.array(count == dim)), dim))
                sums[dim] = sums.get(dim, 0) + x.sum(0)
        for dim, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(dim, dim, np.int32)), pa.array(np.arange(dim, dtype=np.int32)), pa.array(total)], ["dim", "at", "part"])

    often = sizes.orderBy(F.desc("n"), "dim").limit(MEANS)
    some = classes.select("embedding", F.size("embedding").alias("dim")).join(F.broadcast(often), "dim", "left_semi").select("embedding")
    sums = some.mapInArrow(run, "dim int, at int, part double").groupBy("dim", "at").agg(F.sum("part").alias("total")).join(F.broadcast(often), "dim")
    found = sums.groupBy("dim").agg(F.sort_array(F.collect_list(F.struct("at", (F.col("total") / F.col("n")).alias("mean")))).alias("mean")).collect()  # MEANS rows at most
    return {r["dim"]: np.array([m["mean"] for m in r["mean"]]) for r in found}


SETTINGS = "dim int, n long, families int, lines int, members int, queries int, centred boolean, bound int, recall double, pairs long"
PLACING = ["families", "lines", "members", "queries", "centred"]


def tried(classes: DataFrame, sizes: DataFrame, step: int, means: Means, half: float, threshold: float, recall: float, seed: int) -> DataFrame:
    """``SETTINGS`` of this step for the lengths in ``sizes``: every vector of theirs meets its partners."""

    def meet(batches: Iterator[pa.RecordBatch]):
        known: dict[int, list[np.ndarray]] = {}
        for b in batches:
            dims, ns = b.column(0).to_numpy(), b.column(1).to_numpy()
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                n = int(ns[at[0]])
                found = choice(dim, n, step)
                if dim not in known:
                    known[dim] = directions(dim, found["families"], found["lines"], seed)
                x, prints = unit(matrix(b.column(2).take(pa.array(at)), dim)), b.column(3).to_numpy()[at]
                counts = collisions(x, prints, pairs_each(n), means.get(dim, np.zeros(dim)) * found["centred"], known[dim], found["queries"], found["members"], half, threshold, seed)
                met, pairs = np.unique(counts, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(met), dim, np.int32)), pa.array(np.full(len(met), n)), pa.array(met), pa.array(pairs)], ["dim", "n", "met", "pairs"])

    def bound(rows: pa.Table) -> pa.Table:
        dim, n, pairs = rows["dim"][0].as_py(), rows["n"][0].as_py(), rows["pairs"].to_numpy()
        of, share = bound_of(rows["met"].to_numpy(), pairs, recall)
        row = {"dim": dim, "n": n, **choice(dim, n, step), "bound": of, "recall": share, "pairs": int(pairs.sum())}
        kinds = {"n": pa.int64(), "pairs": pa.int64(), "recall": pa.float64(), "centred": pa.bool_()}
        return pa.table({k: pa.array([v], kinds.get(k, pa.int32())) for k, v in row.items()})

    prints = F.pmod(F.xxhash64("embedding"), F.lit(PARTNERS))
    sized = classes.select(F.size("embedding").alias("dim"), "embedding", prints.alias("print")).join(F.broadcast(sizes), "dim").select("dim", "n", "embedding", "print")
    counts = sized.mapInArrow(meet, "dim int, n long, met long, pairs long").groupBy("dim", "n", "met").agg(F.sum("pairs").alias("pairs"))
    return materialize(counts.groupBy("dim").applyInArrow(bound, SETTINGS), "settings")


def settings_of(classes: DataFrame, sizes: DataFrame, means: Means, half: float, threshold: float, recall: float, seed: int) -> DataFrame:
    """``SETTINGS`` for every length of vector: the first that keep the recall over all vectors of the length."""
    found = None
    for step in itertools.count():
        now = tried(classes, sizes, step, means, half, threshold, recall, seed)
        done = now.filter(F.col("recall") >= recall)
        found = found.unionByName(done) if found else done
        sizes = now.filter(F.col("recall") < recall).select("dim", "n")
        if sizes.isEmpty():
            return found


def lines_of(classes: DataFrame, means: Means, half: float, seed: int) -> DataFrame:
    """``dim, line, cell, value, cls, query`` rows from ``cls, embedding`` and ``PLACING``; a query's rows lie in its cell and both neighbours."""

    def run(batches: Iterator[pa.RecordBatch]):
        known: dict[int, list[np.ndarray]] = {}
        for b in batches:
            cls, vectors = b.column(0).to_numpy(), b.column(1)
            sizes = np.diff(vectors.offsets.to_numpy())
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                families, lines, members, queries, centred = (b.column(k)[int(at[0])].as_py() for k in range(2, 7))
                if dim not in known:
                    known[dim] = directions(dim, families, lines, seed)
                for k in range(0, len(at), 250):
                    some = at[k : k + 250]
                    x = unit(matrix(vectors.take(pa.array(some)), dim))
                    line, value = tails(x - (means.get(dim, 0.0) if centred else 0.0), known[dim], members)
                    who, cell = np.repeat(cls[some], line.shape[1]), np.floor(value / half).astype(np.int64)
                    rows = [(line.ravel(), cell.ravel(), value.ravel(), who, False)]
                    q = (line[:, :queries].ravel(), value[:, :queries].ravel(), np.repeat(cls[some], min(queries, line.shape[1])))
                    rows += [(q[0], cell[:, :queries].ravel() + d, q[1], q[2], True) for d in (-1, 0, 1)]
                    for ln, ce, va, wh, query in rows:
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ln), dim, np.int32)), pa.array(ln), pa.array(ce), pa.array(va), pa.array(wh), pa.array(np.full(len(ln), query))], ["dim", "line", "cell", "value", "cls", "query"])

    return classes.select("cls", "embedding", *PLACING).mapInArrow(run, "dim int, line long, cell long, value double, cls long, query boolean")


def cosine_pairs(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """``u, v`` of the pairs whose cosine in double precision reaches the threshold."""
    x = classes.select(F.col("cls").alias("u"), F.col("embedding").alias("x"))
    y = classes.select(F.col("cls").alias("v"), F.col("embedding").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            u, v = b.column(0), b.column(1)
            sizes = np.diff(b.column(2).offsets.to_numpy())
            keep = np.zeros(b.num_rows, bool)
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                p, q = (matrix(b.column(c).take(pa.array(at)), dim) for c in (2, 3))
                p, q = (v / np.abs(v).max(axis=1, keepdims=True) for v in (p, q))
                keep[at] = (p * q).sum(1) / (np.linalg.norm(p, axis=1) * np.linalg.norm(q, axis=1)) >= threshold
            yield pa.RecordBatch.from_arrays([u.filter(pa.array(keep)), v.filter(pa.array(keep))], ["u", "v"])

    return pairs.join(x, "u").join(y, "v").select("u", "v", "x", "y").mapInArrow(run, "u long, v long")


def embedding_dedup(vectors: DataFrame, threshold: float = THRESHOLD, half: float = HALF_WINDOW, recall: float = RECALL, seed: int = SEED) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept."""
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    numbers = F.col("embedding") if single else F.col("embedding").cast("array<double>")
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), numbers.alias("embedding"))
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists("embedding", lambda c: c != 0)
    usable = F.coalesce(finite, F.lit(False))
    good = plain.filter(usable)
    classes = good.groupBy("embedding").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    classes = materialize(classes.withColumn("cls", F.monotonically_increasing_id()), "vectors")
    sizes = materialize(classes.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")), "sizes")  # a row for each length of vector
    means = means_of(classes, sizes)
    settings = settings_of(classes, sizes, means, half, threshold, recall, seed)
    sized = classes.join(F.broadcast(settings.select("dim", *PLACING)), F.size("embedding") == F.col("dim"))
    placed = materialize(lines_of(sized, means, half, seed), "lines")
    line = ["dim", "line", "cell"]
    q = placed.filter("query").select(*line, F.col("value").alias("at"), F.col("cls").alias("c"))
    m = placed.filter("not query").select(*line, "value", "cls")
    met = q.join(m, line).filter((F.abs(F.col("at") - F.col("value")) <= half) & (F.col("c") != F.col("cls")))
    counted = met.select("dim", F.least("c", "cls").alias("u"), F.greatest("c", "cls").alias("v")).groupBy("dim", "u", "v").count()
    pairs = counted.join(F.broadcast(settings.select("dim", "bound")), "dim").filter(F.col("count") >= F.col("bound")).select("u", "v")
    found = materialize(cosine_pairs(pairs, classes, threshold), "links")
    both = found.unionByName(found.select(F.col("v").alias("u"), F.col("u").alias("v")))
    linked = both.join(classes.select(F.col("cls").alias("v"), "copies"), "v").groupBy("u").agg(F.sum("copies").alias("links")).withColumnRenamed("u", "cls")
    joined = classes.join(linked, "cls", "left").join(components(found).withColumnRenamed("node", "cls"), "cls", "left")
    joined = materialize(joined.select("cls", "embedding", "copies", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "cls").alias("component")), "classes")
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    known = joined.join(least, "component").select("embedding", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id")
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))
    out = good.join(known, "embedding").select("vec_id", "n_links", "component_id", kept.alias("kept"))
    alone = plain.filter(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(alone)


def op3_embedding_dedup(spark, sf_dir):
    return embedding_dedup(table(spark, sf_dir, "embeddings"))
