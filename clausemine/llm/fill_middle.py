"""Fill-in-the-middle rearrangement of texts held as ropes.

A rope is a balanced binary tree over a text. Its leaves hold up to ``LEAF`` units of text; every node
caches how many units and code points stand below it. A unit is whatever ``unit`` matches from left to
right (a code point by default; words or lines as well), what lies between matches belongs to the unit
before it. A text is cut by splitting its tree at two unit ranks, which makes no more than a path of new
nodes, and rearranged by concatenating the three subtrees with the sentinels. ``restored`` inverts this: it
builds the tree of the output and splits it where the sentinels stand.

The two ranks and the form come from a hash of seed and doc_id, made by Spark's functions, so a rerun makes the same cuts.

Defined results: null text is empty; empty texts and texts that hold a sentinel stay plain, as does
the share ``plain_percent`` of the others; a null doc_id hashes as an empty one; rows with equal doc_ids are
cut by the same hash, each for itself; an empty table gives no rows; other columns are ignored; a text of
any length is one tree, whose depth grows with the logarithm of its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import table, texts

LEAF, SEED, PLAIN_PERCENT, SPM_PERCENT = 2048, 1, 10, 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CODE_POINT = r"(?s:.)"
#: The sentinels of each form in the order in which they open its parts.
ORDERS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}


@dataclass(frozen=True, slots=True)
class Rope:
    """A leaf (``text`` and, where units are not code points, the code-point ranks ``starts`` of its units) or two subtrees."""

    units: int
    chars: int
    height: int
    text: str = ""
    starts: tuple[int, ...] | None = None
    left: Rope | None = None
    right: Rope | None = None

    def __iter__(self) -> Iterator[str]:
        """The leaves' texts in order."""
        todo = [self]
        while todo:
            node = todo.pop()
            if node.left is None:
                yield node.text
            else:
                todo += (node.right, node.left)

    def __str__(self) -> str:
        return "".join(self)


EMPTY = Rope(0, 0, 0)


def leaf(text: str, starts: tuple[int, ...] | None = None) -> Rope:
    return Rope(len(text) if starts is None else len(starts), len(text), 1, text, starts)


def node(left: Rope, right: Rope) -> Rope:
    return Rope(left.units + right.units, left.chars + right.chars, 1 + max(left.height, right.height), left=left, right=right)


def joined(a: Rope, b: Rope) -> Rope:
    """Both texts in a row; heights of siblings differ by at most one, as in the two trees themselves."""
    if not a.chars or not b.chars:
        return b if not a.chars else a
    if abs(a.height - b.height) <= 1:
        return node(a, b)
    if a.height > b.height:
        return balanced(a.left, joined(a.right, b))
    return balanced(joined(a, b.left), b.right)


def balanced(a: Rope, b: Rope) -> Rope:
    """A node over two subtrees whose heights differ by two at most, rotated where they do."""
    if a.height > b.height + 1:
        if a.left.height >= a.right.height:
            return node(a.left, node(a.right, b))
        return node(node(a.left, a.right.left), node(a.right.right, b))
    if b.height > a.height + 1:
        if b.right.height >= b.left.height:
            return node(node(a, b.left), b.right)
        return node(node(a, b.left.left), node(b.left.right, b.right))
    return node(a, b)


def split(rope: Rope, rank: int, by_chars: bool = False) -> tuple[Rope, Rope]:
    """(the first ``rank`` units, or code points, and the rest)."""
    size = rope.chars if by_chars else rope.units
    if rank <= 0 or rank >= size:
        return (EMPTY, rope) if rank <= 0 else (rope, EMPTY)
    if rope.left is None:
        at = rank if by_chars or rope.starts is None else rope.starts[rank]
        if rope.starts is None:
            return leaf(rope.text[:at]), leaf(rope.text[at:])
        before = tuple(s for s in rope.starts if s < at)
        return leaf(rope.text[:at], before), leaf(rope.text[at:], tuple(s - at for s in rope.starts[len(before) :]))
    here = rope.left.chars if by_chars else rope.left.units
    if rank <= here:
        a, b = split(rope.left, rank, by_chars)
        return a, joined(b, rope.right)
    a, b = split(rope.right, rank - here, by_chars)
    return joined(rope.left, a), b


def over(leaves: list[Rope]) -> Rope:
    """A tree over leaves, halved at each node."""
    half = len(leaves) // 2
    return node(over(leaves[:half]), over(leaves[half:])) if half else leaves[0]


def rope_of(text: str, unit: str = CODE_POINT, most: int = LEAF) -> Rope:
    """The tree of a text; what stands before the first unit belongs to it."""
    if unit == CODE_POINT:
        level = [leaf(text[i : i + most]) for i in range(0, len(text), most)]
    else:
        starts = [m.start() for m in re.finditer(unit, text) if m.end() > m.start()]
        cuts = [0, *starts[most::most], len(text)]
        level = [leaf(text[a:b], tuple(max(s, a) - a for s in starts[i * most : (i + 1) * most])) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))] if text else []
    return over(level) if level else EMPTY


def rearranged(rope: Rope, form: str, first: int, second: int) -> tuple[Rope, int, int]:
    """(the rope in its form, code points of prefix and middle), cut before two unit ranks."""
    prefix, rest = split(rope, first)
    middle, suffix = split(rest, second - first)
    parts = {PREFIX: prefix, SUFFIX: suffix, MIDDLE: middle}
    out = EMPTY
    for sentinel in ORDERS[form]:
        out = joined(joined(out, leaf(sentinel)), parts[sentinel])
    return out, prefix.chars, middle.chars


def put_back(rope: Rope, form: str) -> Rope:
    """The text before it was rearranged; a part never holds a sentinel, so the first of each kind opens its part."""
    text, parts, order = str(rope), {}, ORDERS[form]
    at = [text.index(s) for s in order]
    for sentinel, a in reversed(list(zip(order, at, strict=True))):
        rope, part = split(rope, a, by_chars=True)
        parts[sentinel] = split(part, len(sentinel), by_chars=True)[1]
    return joined(joined(parts[PREFIX], parts[MIDDLE]), parts[SUFFIX])


def draws(seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of a document: the first four groups of eight digits of a hash."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = SEED, plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT, unit: str = CODE_POINT) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output``: n units, the form and the rearranged text of each document."""
    drawn = texts(docs).select("doc_id", "text", *draws(seed))
    holds = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    plain = (F.col("text") == "") | holds | (F.col("h3") % 100 >= 100 - plain_percent)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm")

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            rows = []
            for doc_id, text, form, x, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rope = rope_of(text, unit)
                n = rope.units
                if form == "plain":
                    rows.append((doc_id, n, form, None, None, text))
                else:
                    out, p, m = rearranged(rope, form, *sorted((x % (n + 1), y % (n + 1))))
                    rows.append((doc_id, n, form, p, m, str(out)))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)

    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.large_string())])
    return drawn.select("doc_id", "text", form.alias("form"), "h1", "h2").mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(rearranged_docs: DataFrame) -> DataFrame:
    """The same rows with ``text``, rebuilt from ``output`` and ``form`` alone."""
    names = rearranged_docs.columns
    form, output = names.index("form"), names.index("output")

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            back = [o if f == "plain" else str(put_back(rope_of(o), f)) for f, o in zip(b.column(form).to_pylist(), b.column(output).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(back, pa.large_string())], [*names, "text"])

    return rearranged_docs.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rearranged_docs.schema) + ", text string")


def op12_fill_middle(spark, sf_dir):
    rows = restored(fill_in_middle(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("text", 256).alias("restored_sha256"))


OP12_SQL = f"""WITH hashed AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
drawn AS (SELECT doc_id, text, length(text) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM hashed),
cut AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= {100 - PLAIN_PERCENT} THEN 'plain' WHEN h4 % 100 < {SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT *, substr(text, 1, a) AS p, substr(text, a + 1, b - a) AS m, substr(text, b + 1) AS s FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM parts"""
