"""Token-id files with Elias-Fano encoded document boundaries.

A file set is a folder of blocks in a Parquet container, written and committed by Spark. A block
holds the concatenated ids of consecutive documents (little-endian, two bytes where the vocabulary
allows it) and the Elias-Fano code of the documents' end positions: low bits packed, high bits in
unary, and every 64th select position. A boundary costs about 2 + log2(mean length) bits. The doc_ids of
a block ascend and are kept in the same way, above the first of them. Blocks are numbered by shard (a range
of doc_ids) and by place in it; a document's place among all ids is its place in the block, which
select gives, plus the ids of the blocks before.

Texts are dealt by range of doc_id, so that one Python pass encodes a shard and writes it. Shards are
about ``shard_bytes`` of text each, by default a 2,048th of all text but at least 16 MB and at most 512 MB, so that 100 TB are
200,000 shards; a shard is streamed, so its size does not bound memory.

Defined results: null or empty text gives no ids but the end id; null doc_ids come first; rows with
equal doc_id follow each other, ordered by a hash of their texts, and may spread over shards, so that a
doc_id of very many rows is no single task; an empty table gives an empty file set; other
columns are ignored; very long texts are blocks of their own.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import shared_dir, table, texts
from .tokens import encoder, in_slices

SAMPLE = 64
BLOCK_IDS, SHARD_BYTES, SHARDS = 1 << 20, (16 << 20, 512 << 20), 2048
CODE = "low_bits int, low binary, high binary, selects binary"
BLOCK_SCHEMA = "shard int, ids_before long, n_docs int, n_ids long, ids binary, " + CODE + ", n_null int, first_doc long, doc_low_bits int, doc_low binary, doc_high binary, doc_selects binary"


class EliasFano:
    """A non-decreasing sequence in near-minimal space, with constant-time select by samples."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, selects: bytes):
        self.n, self.low_bits, self.low, self.high, self.selects = n, low_bits, low, high, selects

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        """From unsigned values."""
        values = values.astype(np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        low = (values[:, None] >> np.arange(bits, dtype=np.uint64) & np.uint64(1)).astype(np.uint8)
        return cls(n, bits, np.packbits(low, bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u4").tobytes())

    @property
    def fields(self) -> list:
        return [self.low_bits, self.low, self.high, self.selects]

    def select(self, i: int) -> int:
        """The i-th value, found from the sample before it."""
        at = int.from_bytes(self.selects[i // SAMPLE * 4 : i // SAMPLE * 4 + 4], "little")
        byte, left = at >> 3, i % SAMPLE
        word = self.high[byte] >> (at & 7) << (at & 7)
        while (count := word.bit_count()) <= left:
            left -= count
            byte += 1
            word = self.high[byte]
        for _ in range(left):
            word &= word - 1
        one = byte * 8 + (word & -word).bit_length() - 1
        return (one - i) << self.low_bits | self._low(i)

    def _low(self, i: int) -> int:
        first, last = i * self.low_bits, (i + 1) * self.low_bits
        word = int.from_bytes(self.low[first >> 3 : (last + 7) >> 3], "little")
        return word >> (first & 7) & ((1 << self.low_bits) - 1)


def sharded(docs: DataFrame, shard_bytes: int | None) -> DataFrame:
    """``doc_id, text`` dealt by range and sorted; a hash of the text and the row's number divide a doc_id of many rows."""
    rows = texts(docs).withColumns({"print": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shard_bytes = shard_bytes or min(max(size // SHARDS, SHARD_BYTES[0]), SHARD_BYTES[1])
    order = ["doc_id", "print", "row"]
    return rows.repartitionByRange(max(1, -(-size // shard_bytes)), *order).sortWithinPartitions(*order).select("doc_id", "text")


def _blocks(path: str, end_id: int, width: int, block_ids: int):
    """Encodes a shard's texts and yields its blocks."""

    def run(batches: Iterator[pa.RecordBatch]):
        enc, end, shard = encoder(path, width), end_id.to_bytes(width, "little"), TaskContext.get().partitionId()
        before, docs, parts, size = 0, [], [], 0

        def block():
            ends = np.cumsum([len(p) // width for p in parts])
            some = [d for d in docs if d is not None]
            first = some[0] if some else 0
            numbers = np.array(some, np.int64).astype(np.uint64) - np.array(first, np.int64).astype(np.uint64)
            row = [shard, before, len(docs), size, b"".join(parts), *EliasFano.encode(ends).fields, len(docs) - len(some), first, *EliasFano.encode(numbers).fields]
            kind = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
            fields = [f.split() for f in BLOCK_SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], kind[t]) for v, (_, t) in zip(row, fields, strict=True)], [n for n, _ in fields])

        for batch in batches:
            words = batch.column(1).to_pylist()
            for a, b in in_slices(words):
                for d, ids in zip(batch.column(0).slice(a, b - a).to_pylist(), enc.encode(words[a:b]), strict=True):
                    n = len(ids) // width + 1
                    if docs and size + n > block_ids:
                        yield block()
                        before, docs, parts, size = before + size, [], [], 0
                    docs.append(d)
                    parts.append(ids + end)
                    size += n
        if docs:
            yield block()

    return run


def write_token_files(docs: DataFrame, path: str, end_id: int, target: str, width: int = 2, block_ids: int = BLOCK_IDS, shard_bytes: int | None = None) -> None:
    """Encode all texts and write them in ascending doc_id order as a file set at ``target``."""
    sharded(docs, shard_bytes).mapInArrow(_blocks(path, end_id, width, block_ids), BLOCK_SCHEMA).write.parquet(target)


def bases(shards: DataFrame, group: int = 1024) -> DataFrame:
    """``shard, base`` from ``shard, n``: the ids before each shard, summed in groups of shards first, so that no window holds all of them."""
    grouped = shards.withColumn("group", F.floor(F.col("shard") / group))
    ahead = Window.partitionBy("group").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(F.floor(F.col("group") / group)).orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    whole = grouped.groupBy("group").agg(F.sum("n").alias("n"))
    before = whole.select("group", F.floor(F.col("group") / group).alias("top"), F.coalesce(F.sum("n").over(over), F.lit(0)).alias("in_top"))
    tops = whole.groupBy(F.floor(F.col("group") / group).alias("top")).agg(F.sum("n").alias("n"))
    first = tops.alias("a").join(F.broadcast(tops.alias("b")), F.col("b.top") < F.col("a.top"), "left").groupBy("a.top").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("of_top"))  # a row for each million shards
    placed = grouped.join(before.join(first, "top"), "group")
    return placed.select("shard", (F.col("of_top") + F.col("in_top") + F.coalesce(F.sum("n").over(ahead), F.lit(0))).alias("base"))


def read_token_files(spark: SparkSession, target: str, width: int = 2, digest: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` from a file set; ids are the document's bytes as stored.

    Each document's range comes from two selects. With ``digest`` the last column is ``ids_crc32`` instead, the
    checksum of the ids as unsigned 32-bit little-endian numbers.
    """
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(target)
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    shards = bases(shards)  # 12 bytes for each shard of text
    last = pa.int64() if digest else pa.binary()

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for b in batch.to_pylist():
                ends = EliasFano(b["n_docs"], b["low_bits"], b["low"], b["high"], b["selects"])
                ids = EliasFano(b["n_docs"] - b["n_null"], b["doc_low_bits"], b["doc_low"], b["doc_high"], b["doc_selects"])
                docs = [None] * b["n_null"] + [signed(b["first_doc"] + ids.select(i)) for i in range(ids.n)]
                at = [0, *map(ends.select, range(ends.n))]
                parts = [b["ids"][x * width : y * width] for x, y in zip(at, at[1:], strict=False)]
                if digest:
                    parts = [zlib.crc32(np.frombuffer(x, f"<u{width}").astype("<u4").tobytes()) for x in parts]
                at = np.array(at, np.int64)
                starts = at[:-1] + (b["base"] + b["ids_before"])
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts), pa.array(np.diff(at)), pa.array(parts, last)], ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    return blocks.join(F.broadcast(shards), "shard").drop("shard", "n_ids").mapInArrow(run, f"doc_id long, start long, n_tokens long, {'ids_crc32 long' if digest else 'ids binary'}")


def signed(x: int) -> int:
    """The 64-bit number of a sum that may have wrapped."""
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


def op7_token_files(spark, sf_dir):
    import public_tokenizers

    target = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2, target)
    return read_token_files(spark, target, digest=True)
