"""Column functions over texts and spans that stay linear in the text and in the number of spans.

Spark's higher-order functions evaluate an expression inside a lambda anew for each element, so what is used there is
bound once (``let``). Appending to an array copies it, so running totals are taken in blocks of ``BLOCK``; an array
of n numbers costs n * BLOCK / 2 + (n / BLOCK) ** 2 / 2 copies of a number. Overlaps are found by binary search.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK, CONTEXT = 128, 30
SPAN = "struct<start:int,end:int,match:string,left:string,after:string>"
PART_BITS = 10  # texts are cut in parts of 1,024 characters
PARTS = rf"(?s).{{1,{1 << PART_BITS}}}"


def let(value: Column, f) -> Column:
    """``f`` of the value, which is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def running(values: Column, op) -> Column:
    """The inclusive running ``op`` (of two ints) over an array of ints from 0 up, a bound one."""
    fold = lambda at: lambda acc, i: F.array_append(acc, op(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)), at(i)))
    none, n = F.expr("cast(array() as array<int>)"), F.size(values)
    block = lambda b: F.aggregate(F.sequence(b * BLOCK, F.least(n, (b + 1) * BLOCK) - 1), none, fold(lambda i: F.get(values, i)))

    def whole(parts):
        last = lambda j: F.get(F.get(parts, j), F.size(F.get(parts, j)) - 1)
        before = lambda sums: F.transform(parts, lambda p, j: F.transform(p, lambda v: op(v, F.coalesce(F.get(sums, j - 1), F.lit(0)))))
        sums = F.aggregate(F.sequence(F.lit(0), F.size(parts) - 1), none, fold(last))
        return F.flatten(let(sums, before))

    return F.when(n == 0, none).when(n <= BLOCK, block(F.lit(0))).otherwise(let(F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), block), whole))


def located(text: Column, pattern: str, when: Column | None = None) -> Column:
    """All leftmost matches with start and end in code points, the text between the match before and this one (its
    last characters) as ``left``, and the first character before the next match as ``after``."""

    def spans(p):
        gap, length = lambda i: F.get(p["gaps"], i), F.char_length
        place = lambda ends: F.transform(
            p["found"],
            lambda m, i: F.struct((F.get(ends, i) - length(m)).alias("start"), F.get(ends, i).alias("end"), m.alias("match"), F.substring(gap(i), -CONTEXT, CONTEXT).alias("left"), F.substring(gap(i + 1), 1, 1).alias("after")),
        )
        return let(F.transform(p["found"], lambda m, i: length(gap(i)) + length(m)), lambda moves: let(running(moves, lambda a, b: a + b), place))

    out = let(F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found")), spans)
    return out if when is None else F.when(when, out).otherwise(F.expr(f"cast(array() as array<{SPAN}>)"))


def overlaps(spans: Column, s: Column) -> Column:
    """Whether a span touches a character of any of these, which are bound, sorted and do not overlap each other."""
    n = F.size(spans)

    def halve(acc, _):
        mid = F.shiftright(acc["lo"] + acc["hi"], 1)
        left = F.get(spans, mid)["start"] < s["end"]
        open_ = acc["lo"] < acc["hi"]
        return F.struct(F.when(open_ & left, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(open_ & ~left, mid).otherwise(acc["hi"]).alias("hi"))

    steps = F.sequence(F.lit(1), F.ceil(F.log2(n.cast("double") + 1)).cast("int") + 1)
    first = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), n.alias("hi")), halve, lambda acc: acc["lo"])
    return F.when(n == 0, False).otherwise(let(first, lambda k: (k > 0) & F.coalesce(F.get(spans, k - 1)["end"] > s["start"], F.lit(False))))


def piece(parts: Column, start: Column, size: Column) -> Column:
    """``size`` characters from ``start`` of a text given as its parts (a bound array)."""
    some = F.transform(F.sequence(F.shiftright(start, PART_BITS), F.shiftright(start + size - 1, PART_BITS)), lambda k: F.get(parts, k))
    return F.when(size > 0, F.substring(F.array_join(some, ""), start.bitwiseAND((1 << PART_BITS) - 1) + 1, size)).otherwise("")
