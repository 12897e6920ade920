"""Best-fit packing by a configuration linear program.

Only the histogram of piece lengths (at most ``size`` numbers) reaches the driver. A configuration
says how many pieces of each length share one sequence. The program "as few sequences as possible, every
length covered" is solved by multiplicative weights: the weight of a length is its tokens times the
exponential of how far it is behind in coverage, and its price a piece is weight over need. A round finds what every room can
earn by knapsack dynamic programming, and gives shares to configurations within ``SLACK`` of the most
valuable one, each as far as no length gets more than the round's part. Prices over the best value
are a dual solution, so every round also gives a lower bound, and so does the price of one over how many such pieces a sequence
holds, which is exact where all are long (``relax`` returns the best).

Shares are rounded: largest first, down, but at least one sequence, as long as the pieces last. What is left is
a smaller program and is solved again until ``BY_PROGRAM`` of the tokens are placed. The rest, still a mix
of all lengths, is packed best fit: the longest piece, then always the longest that leaves a room which others fill.

The plan gives, for every length, ranges of ranks and the place each range takes. Pieces are ranked
within their length without gathering a length in one task: each task numbers its own, and the
counts by task and length give the offsets.

Defined results: null or empty text is one piece holding the end id; a document longer than ``size``
is cut into pieces of ``size`` ids, its first piece taking the remainder; repeated rows are packed
each; among equally good configurations the longest lengths come first; null doc_ids are packed like any other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, table, texts
from .tokens import encoder, in_slices

SIZE, END_ID, ROUNDS, SHARP, SLACK, BY_PROGRAM = 2048, 0, 8, 5.0, 0.1, 0.92


def pieces(docs: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and ``task, place``: the running number of this length in its task."""

    def run(batches: Iterator[pa.RecordBatch]):
        enc, end = encoder(path), end_id.to_bytes(4, "little")
        task, seen = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            words = batch.column(1).to_pylist()
            for a, b in in_slices(words):
                rows = []
                for doc_id, raw in zip(batch.column(0).slice(a, b - a).to_pylist(), enc.encode(words[a:b]), strict=True):
                    raw += end
                    n = len(raw) // 4
                    first = n if n <= size else (n % size or size)
                    starts = [0, *range(first, n, size)]
                    for k, (x, y) in enumerate(zip(starts, [*starts[1:], n], strict=True)):
                        rows.append((doc_id, k, x, y - x, zlib.crc32(raw[4 * x : 4 * y]), task, seen[y - x]))
                        seen[y - x] += 1
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "place"])

    return texts(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, place long")


def knapsack(price: np.ndarray, offered: np.ndarray, size: int) -> np.ndarray:
    """What every room up to ``size`` can earn; ``offered`` are the lengths, longest first."""
    worth, best, m = price[offered], np.zeros(size + 1), len(offered)
    first = np.searchsorted(-offered, -np.arange(size + 1)).tolist()
    for room in range(1, size + 1):
        best[room] = best[room - 1]
        if first[room] < m:
            k = first[room]
            best[room] = max(best[room], (worth[k:] + best[room - offered[k:]]).max())
    return best


def configuration(n: int, slack: float, price: np.ndarray, best: np.ndarray, offered: np.ndarray, room_for: np.ndarray, need: np.ndarray) -> Counter | None:
    """A full configuration around a piece of length n that earns at most ``slack`` less than the best around it, of lengths with room; None if there is none."""
    room, found = len(best) - 1 - n, Counter({n: 1})
    while room:
        can = offered[np.searchsorted(-offered, -room) :]
        loss = best[room] - price[can] - best[room - can]
        good = np.flatnonzero((loss <= slack + 1e-12) & (room_for[can] > 1e-9))
        k = next((k for k in good.tolist() if found[int(can[k])] < need[can[k]]), None)
        if k is None:
            return None
        slack -= float(loss[k])
        found[int(can[k])] += 1
        room -= int(can[k])
    return found


def dual(need: np.ndarray, offered: np.ndarray, price: np.ndarray) -> float:
    """The lower bound that prices give: what all pieces cost over the most that one sequence can hold."""
    return float(need @ price) / knapsack(price, offered, len(need) - 1)[-1] if len(offered) else 0.0


def relax(need: np.ndarray, rounds: int = ROUNDS, sharp: float = SHARP, slack: float = SLACK) -> tuple[dict[tuple, float], float]:
    """(share of each configuration, lower bound on the number of sequences) of the linear program."""
    size, load, shares = len(need) - 1, np.zeros(len(need)), {}
    offered = np.flatnonzero(need)[::-1].copy()
    bound = dual(need, offered, np.where(need > 0, 1.0 / (size // np.maximum(np.arange(size + 1), 1)), 0.0))
    for r in range(1, rounds + 1):
        price = np.where(need > 0, np.arange(size + 1) * np.exp(sharp * ((r - 1) / rounds - load)), 0.0)  # weight over need
        best = knapsack(price, offered, size)
        bound = max(bound, float(need @ price) / best[size])
        room_for, spare = need * (r / rounds - load), price[offered] + best[size - offered] - (1 - slack) * best[size]
        for i in np.argsort(-spare, kind="stable").tolist():
            n = int(offered[i])
            if spare[i] < 0:
                break
            config = configuration(n, float(spare[i]), price, best, offered, room_for, need) if room_for[n] > 1e-9 else None
            step = min(room_for[k] / c for k, c in config.items()) if config else 0.0
            if step > 1e-9:
                for k, c in config.items():
                    room_for[k] -= step * c
                    load[k] += step * c / need[k]
                key = tuple(sorted(config.items(), reverse=True))
                shares[key] = shares.get(key, 0.0) + step
    return shares, bound


def reachable(lengths: np.ndarray, size: int) -> np.ndarray:
    """Which rooms the lengths can fill exactly, copies not counted."""
    up, fits = np.sort(lengths), np.zeros(size + 1, bool)
    fits[0] = True
    below = np.searchsorted(up, np.arange(size + 1), "right").tolist()
    for r in range(1, size + 1):
        fits[r] = bool(fits[r - up[: below[r]]].any())
    return fits


def fullest(left: np.ndarray, reach: np.ndarray) -> tuple[Counter, int]:
    """(the longest remaining length and what best fits beside it, the room that stays empty)."""
    down = np.flatnonzero(left)[::-1]
    found, room = Counter({int(down[0]): 1}), len(left) - 1 - int(down[0])
    while room:
        can = down[down <= room]
        can = can[left[can] > np.array([found[int(n)] for n in can], np.int64)]
        if not len(can):
            break
        good = can[reach[room - can]]
        pick = int(good[0] if len(good) else can[0])
        found[pick] += 1
        room -= pick
    return found, room


Plan = list[tuple[dict[int, int], int]]


def solve(histogram: dict[int, int], size: int = SIZE, rounds: int = ROUNDS, by_program: float = BY_PROGRAM) -> tuple[Plan, int]:
    """(configurations with the number of sequences that each fills, how many of these entries come from the program); every piece is placed exactly once.

    Rounding may cost a program more than it gains on lengths of which few share a sequence: if best fit alone needs fewer sequences, its plan is taken.
    """
    plans = [rounded(histogram, size, rounds, share) for share in dict.fromkeys((by_program, 0.0))]
    return min(plans, key=lambda p: sum(c for _, c in p[0]))


def rounded(histogram: dict[int, int], size: int, rounds: int, by_program: float) -> tuple[Plan, int]:
    """As ``solve``, with this share of the tokens placed by the program."""
    left, lengths, plan = np.zeros(size + 1, np.int64), np.arange(size + 1), []
    for n, c in histogram.items():
        left[n] = c

    def place(config, count: int) -> None:
        plan.append((dict(config), count))
        for n, c in config:
            left[n] -= c * count

    stop, again = (1 - by_program) * float(left @ lengths), rounds
    while left @ lengths > stop and again:
        shares, _ = relax(left, again)
        before, again = len(plan), 2
        for config, x in sorted(shares.items(), key=lambda s: (-int(s[1]), -s[0][0][0])):
            count = min(max(1, int(x + 1e-6)), *(int(left[n]) // c for n, c in config))
            if count > 0 and left @ lengths > stop:
                place(config, count)
        if len(plan) == before:
            break
    solved, reach, fresh = len(plan), None, False
    while left.any():
        if reach is None:
            reach, fresh = reachable(np.flatnonzero(left), size), True
        config, gap = fullest(left, reach)
        if gap and not fresh:  # some length has run out since
            reach = None
            continue
        place(config.items(), min(int(left[n]) // c for n, c in config.items()))
        fresh = False
    return plan, solved


def places(plan: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, copies in a sequence, offset of the first), sorted by length and rank."""
    rows, taken, sequence = [], Counter(), 0
    for config, count in plan:
        offset = 0
        for n, c in sorted(config.items(), reverse=True):
            rows.append((n, taken[n], sequence, c, offset))
            taken[n] += c * count
            offset += n * c
        sequence += count
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID, rounds: int = ROUNDS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    rows = materialize(pieces(docs, path, size, end_id), "pieces")
    counts = rows.groupBy("length", "task").count()
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most `size` rows
    spots = places(solve(histogram, size, rounds)[0])
    ahead = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "task", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("base"))
    far = 1 << 44
    starts = spots[:, 0] * far + spots[:, 1]

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            n, first, sequence, copies, offset = spots[np.searchsorted(starts, length * far + rank, "right") - 1].T
            at, slot = np.divmod(rank - first, copies)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence + at), pa.array(offset + slot * n)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = rows.join(base, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("place")).alias("rank"))
    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op9_packing(spark, sf_dir):
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
