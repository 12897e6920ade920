"""Packing by minimum bin slack: whole documents first, cuts only where nothing else fills a sequence.

Only the histogram of piece lengths (at most ``size`` numbers) reaches the driver. Sequences are filled
one kind at a time. The longest remaining length opens a window; the sums that the remaining multiset can add
to it are a bitset, to which lengths are added longest first, each as often as it remains (by powers of two), until
the capacity itself is reached. The highest sum reached is the smallest slack, and the counts
that make it are traced back through the bitsets before each step. The window is then repeated as long as its lengths last,
so there are about as many windows as there are different lengths, whatever the number of documents.

Where no multiset fills a window, the gap is filled by the head of the longest piece that remains, whose
tail goes back among the remaining lengths: such a cut costs one piece more and no padding. When less than a sequence
is left, the capacity falls to the largest power of two that the rest fills, so nothing is padded at all.
Documents longer than ``size`` give whole sequences first and their last piece takes part as above.

The plan gives, for every length, ranges of ranks with the part of the piece and the place each takes. Pieces are
ranked within their length without gathering a length in one task: each task numbers its own, and the
counts by task and length give the offsets.

Defined results: null or empty text is the end id alone; repeated rows and null doc_ids are packed like any
other; which of several pieces of equal length is cut follows their order in the input; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter, deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, table, texts
from .tokens import encoder, in_slices

SIZE, END_ID, WIDTH = 4096, 2, 2


class Run(NamedTuple):
    """Pieces of one length with consecutive ranks, or the same part of each: from ``start``, the part is ``n`` long."""

    length: int
    rank: int
    count: int
    start: int


class Spot(NamedTuple):
    """Where a run goes: its i-th part is copy ``first + i`` of ``copies`` in each sequence from ``sequence`` on, the first at ``offset``."""

    length: int
    start: int
    rank: int
    count: int
    n: int
    sequence: int
    copies: int
    first: int
    offset: int


def closest(left: dict[int, int], lengths: list[int], capacity: int) -> Counter:
    """The multiset around the longest fitting length whose sum comes closest to the capacity; ``lengths`` descend."""
    fits = [n for n in lengths if n <= capacity]
    if not fits:
        return Counter()
    found, steps = Counter({fits[0]: 1}), []
    sums, mask, full = 1 << fits[0], (1 << (capacity + 1)) - 1, 1 << capacity
    for n in fits:
        copies = min(left[n] - found[n], (capacity - fits[0]) // n)
        k = 1
        while copies and not sums & full:
            k = min(k, copies)
            steps.append((n, k, sums))
            sums |= sums << (n * k) & mask
            copies, k = copies - k, 2 * k
        if sums & full:
            break
    total = sums.bit_length() - 1
    for n, k, before in reversed(steps):
        if not before >> total & 1:  # this sum needs these copies
            found[n] += k
            total -= n * k
    return found


def plan(histogram: dict[int, int], size: int = SIZE) -> tuple[list[Spot], int]:
    """(a spot for every run of parts, the number of sequences); sequences are full or as long as a power of two."""
    runs = {n: deque([Run(n, 0, c, 0)]) for n, c in histogram.items()}
    left = dict(histogram)
    total, spots, sequence = sum(n * c for n, c in left.items()), [], 0

    def taken(n: int, count: int) -> Iterator[Run]:
        """Runs of ``count`` parts that are n long."""
        left[n] -= count
        while count:
            run = runs[n].popleft()
            if run.count > count:
                runs[n].appendleft(run._replace(rank=run.rank + count, count=run.count - count))
                run = run._replace(count=count)
            count -= run.count
            yield run

    def put(run: Run, n: int, *where: int) -> None:
        spots.append(Spot(run.length, run.start, run.rank, run.count, n, *where))

    while total:
        capacity = size if total >= size else 1 << (total.bit_length() - 1)
        lengths = sorted((n for n, c in left.items() if c), reverse=True)
        config = closest(left, lengths, capacity)
        gap = capacity - sum(n * c for n, c in config.items())
        count = min((left[n] // c for n, c in config.items()), default=total // capacity)
        donor = next((n for n in lengths if n > gap and left[n] > config[n]), None) if gap else None
        if gap and donor is None:  # the gap is filled piece by piece: whole pieces are not enough for it, so some piece is longer
            raise AssertionError("a window that is not full has a longer piece beside it")
        if donor:
            count = min(count, left[donor] // (config[donor] + 1))
        count = min(count, total // capacity)
        offset = 0
        for n, c in sorted(config.items(), reverse=True):
            first = 0
            for run in taken(n, c * count):
                put(run, n, sequence, c, first, offset)
                first += run.count
            offset += n * c
        if donor:
            first = 0
            for run in list(taken(donor, count)):
                put(run, gap, sequence, 1, first, offset)
                first += run.count
                rest = donor - gap
                runs.setdefault(rest, deque()).append(run._replace(start=run.start + gap))
                left[rest] = left.get(rest, 0) + run.count
        sequence += count
        total -= count * capacity
    return spots, sequence


def pieces(docs: DataFrame, path: str, size: int, end_id: int, width: int) -> DataFrame:
    """``doc_id, start, doc_tokens, length, ids`` and ``task, place``, the running number of this length in its task; pieces are as long as a sequence or the last of their document."""

    def run(batches: Iterator[pa.RecordBatch]):
        enc, end = encoder(path, width), end_id.to_bytes(width, "little")
        task, seen = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            words = batch.column(1).to_pylist()
            for a, b in in_slices(words):
                rows = []
                for doc_id, raw in zip(batch.column(0).slice(a, b - a).to_pylist(), enc.encode(words[a:b]), strict=True):
                    raw += end
                    n = len(raw) // width
                    for x in range(0, n, size):
                        length = min(size, n - x)
                        rows.append((doc_id, x, n, length, raw[x * width : (x + length) * width], task, seen[length]))
                        seen[length] += 1
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.large_binary(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "start", "doc_tokens", "length", "ids", "task", "place"])

    return texts(docs).mapInArrow(run, "doc_id long, start long, doc_tokens long, length int, ids binary, task int, place long")


#: Bits of a place's key: start of the part, rank of the piece.
RANK_BITS, START_BITS = 37, 13


def located(spots: np.ndarray, length: np.ndarray, rank: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which pieces, the spot of their next part) until all parts of all pieces are named; ``spots`` are sorted by length, start and rank."""
    keys = (spots[:, 0] << START_BITS | spots[:, 1]) << RANK_BITS | spots[:, 2]
    some, at = np.arange(len(length)), np.zeros(len(length), np.int64)
    while len(some):
        spot = np.searchsorted(keys, (length[some] << START_BITS | at) << RANK_BITS | rank[some], "right") - 1
        yield some, spot
        at = spots[spot, 1] + spots[spot, 4]
        more = at < length[some]
        some, at = some[more], at[more]


def slack_pack(docs: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID, width: int = WIDTH, digest: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    ids are little-endian numbers of ``width`` bytes; with ``digest`` there is ``ids_crc32`` instead, the checksum
    of the ids as unsigned 32-bit numbers. ``size`` is at most 4096.
    """
    if not 0 < size < 1 << START_BITS:
        raise ValueError(f"size must lie between 1 and {(1 << START_BITS) - 1}")
    rows = materialize(pieces(docs, path, size, end_id, width), "pieces")
    counts = materialize(rows.groupBy("length", "task").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    spots = np.array(sorted(plan(histogram, size)[0]), np.int64).reshape(-1, 9)
    ahead = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "task", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    names = ["doc_id", "start", "length", "ids_crc32" if digest else "ids", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            length, rank, start = b.column(3).to_numpy().astype(np.int64), b.column(5).to_numpy(), b.column(1).to_numpy()
            ids = b.column(4).to_pylist()
            for some, spot in located(spots, length, rank):
                _, part, first_rank, _, n, sequence, copies, first, offset = spots[spot].T
                at, slot = np.divmod(first + rank[some] - first_rank, copies)
                cut = [ids[i][p * width : (p + k) * width] for i, p, k in zip(some.tolist(), part.tolist(), n.tolist(), strict=True)]
                if digest:
                    cut = pa.array([zlib.crc32(np.frombuffer(c, f"<u{width}").astype("<u4").tobytes()) for c in cut], pa.int64())
                else:
                    cut = pa.array(cut, pa.large_binary())
                take = pa.array(some)
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), pa.array(start[some] + part), pa.array(n), cut, b.column(2).take(take), pa.array(sequence + at), pa.array(offset + slot * n)], names)

    ranked = rows.join(base, ["length", "task"]).select("doc_id", "start", "doc_tokens", "length", "ids", (F.col("base") + F.col("place")).alias("rank"))
    return ranked.mapInArrow(run, f"doc_id long, start long, length long, {'ids_crc32 long' if digest else 'ids binary'}, doc_tokens long, sequence_id long, offset long")


def op13_slack_packing(spark, sf_dir):
    import public_tokenizers

    return slack_pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), digest=True)
