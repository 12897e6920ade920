"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the text's bytes cuts it where the hash of the last 32 bytes has ten zero bits,
so passages that documents share are cut alike wherever they stand. A chunk is encoded the first
time a task's worker meets it and found again after that. Chunks may begin and end inside a word,
so every join is repaired: the text around it is encoded anew, between places a few words into either chunk,
and the window widens until its outer ids agree with those of the chunks. What lies between two
windows is taken from the chunks as it is.

Reuse is held per Python worker in two generations of chunks of bounded size, not in a table of all chunks: that
would move every text through a shuffle to save less work than it costs (figures in the README).

Defined results: null or empty text gives no ids; a chunk without places where a word begins is part of the window
around it, so a text of one long word is encoded whole; the text of a special token divides a text; rows are independent, so repeated rows, null doc_ids and
empty tables need nothing special; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import table, texts
from .tokens import UNUSUAL_SPACE, WordEncoder, byte_of_char, encoder, in_slices

WINDOW, ZERO_BITS, SHORTEST, LONGEST = 32, 10, 256, 8192
ENDS = 4
KNOWN_BYTES = 48 << 20
BREAK = re.compile(rf"(?<=[^ \n\t\r{UNUSUAL_SPACE}])[ \n\t\r]")
#: One pseudo-random 32-bit number for each byte.
GEAR = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32)


def cut_points(data: bytes) -> list[int]:
    """Ends of the content-defined chunks, never inside a character; the last is the end of the data."""
    n = len(data)
    if n <= SHORTEST:
        return [n] if n else []
    raw = np.frombuffer(data, np.uint8)
    h = GEAR[raw]
    for s in (1, 2, 4, 8, 16):  # sums of 2, 4, ... 32 bytes, each shifted by its distance
        h[s:] += h[:-s] << np.uint32(s)
    ends, last = [], 0
    for at in np.flatnonzero(h >> np.uint32(32 - ZERO_BITS) == 0).tolist() + [n]:
        while at - last > LONGEST:
            last += LONGEST
            while raw[last] & 0xC0 == 0x80:
                last -= 1
            ends.append(last)
        while at < n and raw[at] & 0xC0 == 0x80:
            at += 1
        if at - last >= SHORTEST and at < n:
            ends.append(last := at)
    return [*ends, n]


class Chunk:
    """Ids of one chunk, with the first and last places where a word begins: (characters, ids before)."""

    __slots__ = ("first", "ids", "last", "text")

    def __init__(self, text: str, ids: np.ndarray, sizes: np.ndarray):
        self.text, self.ids = text, ids
        at = [m.start() for m in BREAK.finditer(text)]
        self.first = self.last = ()
        if len(at) >= 2 * ENDS:
            ends = np.cumsum(sizes[ids])
            pick = [*at[:ENDS], *at[-ENDS:]]
            offsets = pick if text.isascii() else [len(text[:p].encode()) for p in pick]
            before = (np.searchsorted(ends, offsets) + 1).tolist()
            self.first, self.last = tuple(zip(pick[:ENDS], before[:ENDS], strict=True)), tuple(zip(pick[ENDS:], before[ENDS:], strict=True))


class ChunkEncoder:
    """Encodes whole texts from chunks; see the module's text."""

    def __init__(self, words: WordEncoder):
        self.words = words
        vocab = words.tokenizer.get_vocab(with_added_tokens=True)
        back = byte_of_char()
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes[i] = token.encode() if token in words.special else bytes(back[c] for c in token)
        self.sizes = np.array([len(b) for b in self.bytes])
        self.decimal = [str(i) for i in range(len(self.bytes))]
        self.young: dict[str, Chunk] = {}
        self.old: dict[str, Chunk] = {}
        self.held = self.met = self.found = 0

    def _ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.words.encode([text])[0], self.words.dtype)

    def _chunks(self, batch: list[list[str]]) -> list[list[Chunk]]:
        """The chunks of each text; those that no text had before are encoded together."""
        wanted = {p for parts in batch for p in parts}
        self.met += sum(map(len, batch))
        if self.held > KNOWN_BYTES // 2:  # two generations, so what is still in use stays
            self.old, self.young, self.held = self.young, {}, 0
        new = []
        for p in wanted - self.young.keys():
            if p in self.old:
                self.young[p] = self.old[p]
            else:
                new.append(p)
            self.held += 3 * len(p) + 300
        self.found += len(new)
        for p, raw in zip(new, self.words.encode(new), strict=True):
            self.young[p] = Chunk(p, np.frombuffer(raw, self.words.dtype), self.sizes)
        return [[self.young[p] for p in parts] for parts in batch]

    def encode(self, batch: list[str]) -> list[np.ndarray]:
        """Ids of each text; the text of a special token divides a text and is its own id."""
        divided = [self.words.specials.split(t) if self.words.has_special(t) else [t] for t in batch]
        cut = []
        for t in (t for parts in divided for t in parts[::2]):
            data, last, parts = t.encode(), 0, []
            for end in cut_points(data):
                parts.append(data[last:end].decode())
                last = end
            cut.append(parts)
        joined = map(self._joined, self._chunks(cut))
        special = self.words.special
        one = lambda k, p: np.array([special[p]], self.words.dtype) if k % 2 else next(joined)
        out = [[one(k, p) for k, p in enumerate(parts)] for parts in divided]
        return [parts[0] if len(parts) == 1 else np.concatenate(parts) for parts in out]

    def _joined(self, chunks: list[Chunk]) -> np.ndarray:
        out, i = [], 0
        begun = 0  # ids of chunk i that the window before it has already given
        while i < len(chunks):
            left, j, between = chunks[i], i + 1, ""
            while j < len(chunks) and not chunks[j].first:  # no place to agree on: the window takes it whole
                between += chunks[j].text
                j += 1
            right = chunks[j] if j < len(chunks) else None
            if right is None and j == i + 1:
                out.append(left.ids[begun:])
                break
            repaired = self._repaired(left if left.first else None, left.text + between if not left.first else between, right)
            if repaired is None:
                return self._ids("".join(c.text for c in chunks))
            to, window, after = repaired
            out += [left.ids[begun:to], window] if left.first else [window]
            begun, i = after, j
        return np.concatenate(out) if out else np.zeros(0, self.words.dtype)

    def _repaired(self, left: Chunk | None, between: str, right: Chunk | None):
        """(ids of left to keep, ids of the window, ids of right that the window covers), or None if no window agrees."""
        for k in range(2, ENDS + 1):
            (a, a_ids), (a2, a2_ids) = (left.last[-k], left.last[1 - k]) if left else ((0, 0), (0, 0))
            (b2, b2_ids), (b, b_ids) = right.first[k - 2 : k] if right else ((0, 0), (0, 0))
            ids = self._ids((left.text[a:] if left else "") + between + (right.text[:b] if right else ""))
            head, tail = a2_ids - a_ids, b_ids - b2_ids
            if (not left or np.array_equal(ids[:head], left.ids[a_ids:a2_ids])) and (not right or np.array_equal(ids[len(ids) - tail :], right.ids[b2_ids:b_ids])):
                return a_ids, ids, b_ids
        return None

    def decode(self, ids: np.ndarray) -> str:
        """As the tokenizers library decodes with skip_special_tokens=False: the tokens' bytes in a row, as UTF-8."""
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


_chunkers: dict[str, ChunkEncoder] = {}


def chunk_encoder(path: str) -> ChunkEncoder:
    """The Python worker's encoder of this file."""
    if path not in _chunkers:
        _chunkers.clear()
        _chunkers[path] = ChunkEncoder(encoder(path))
    return _chunkers[path]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids`` (array of int) for each row."""

    def run(batches: Iterator[pa.RecordBatch]):
        enc = chunk_encoder(path)
        for b in batches:
            words = b.column(1).to_pylist()
            for x, y in in_slices(words):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(x, y - x), pa.array([i.astype(np.int32) for i in enc.encode(words[x:y])], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(coded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``."""

    def run(batches: Iterator[pa.RecordBatch]):
        enc = chunk_encoder(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([enc.decode(np.array(i or [], np.int64)) for i in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]):
        enc = chunk_encoder(path)
        for b in batches:
            words = b.column(1).to_pylist()
            for x, y in in_slices(words):
                ids = enc.encode(words[x:y])
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(x, y - x),
                        pa.array([len(i) for i in ids], pa.int64()),
                        pa.array([hashlib.sha256(",".join(map(enc.decimal.__getitem__, i.tolist())).encode()).hexdigest() for i in ids], pa.string()),
                        pa.array([hashlib.sha256(enc.decode(i).encode()).hexdigest() for i in ids], pa.string()),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_chunk_bpe(spark, sf_dir):
    import public_tokenizers

    return round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
