"""Exact dedup by distributed MSD radix partitioning.

Documents are split by successive byte digits of their normalised text. Rows that share all digits
so far form a group; a group of one row is finished, and so is a group whose texts have ended. No
digest decides equality: two rows meet in a finished group only if every byte agreed. Digits widen
from round to round (64 bytes, then 16 times as many each), so a text of n bytes takes O(log n)
rounds, and only groups that are still open carry their remaining bytes on.

Skew: group sizes are counted by a map-side combined aggregate and joined back, one row per group on
one side of a sort-merge join at every input size, so adaptive execution splits the rows of a hot
group over tasks.

Defined results: null text counts as empty, all empty texts are equal; a null doc_id sorts last;
repeated rows count each and exactly one row of a group is kept; an empty table gives no rows;
columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, texts

WHITE = r"[\x20\x09-\x0D]+"
FIRST_DIGIT, WIDEN = 64, 16


def exact_dedup(docs: DataFrame, first_digit: int = FIRST_DIGIT, widen: int = WIDEN, row: str | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, and ``row``, if a column of unique longs is named."""
    norm = F.regexp_replace("text", WHITE, "")
    key = F.monotonically_increasing_id() if row is None else F.col(row)
    rows = texts(docs, key.alias("row")).select(
        "doc_id",
        "row",
        F.char_length("text").cast("long").alias("points"),
        F.sha2(norm.cast("binary"), 256).alias("sha"),
        F.lit(0).cast("long").alias("grp"),
        norm.cast("binary").alias("rest"),
    )
    width, done = first_digit, []
    while True:
        digit, ended = F.expr(f"substring(rest, 1, {width})"), F.octet_length("rest") <= width
        keyed = rows.withColumns({"digit": digit, "ended": ended})
        keys = ["grp", "digit", "ended"]
        sizes = keyed.groupBy(*keys).count().filter("count > 1").select(*keys, F.monotonically_increasing_id().alias("next"))
        sizes = materialize(sizes, "radix-groups")
        over = F.col("next").isNull() | F.col("ended")
        split = keyed.join(sizes.hint("merge"), keys, "left").select(
            "doc_id", "row", "points", "sha", F.col("next").alias("grp"),
            F.when(~over, F.expr(f"substring(rest, {width + 1})")).alias("rest"),
        )
        split = materialize(split, "radix-rows")
        done.append(split.filter("rest is null").select("doc_id", "row", "points", "sha", "grp", F.lit(len(done)).alias("round")))
        rows = split.filter("rest is not null")
        if rows.isEmpty():
            break
        width *= widen
    ended = reduce(DataFrame.unionByName, done)
    best = F.min_by(F.struct("doc_id", "row"), F.struct(-F.col("points"), F.col("doc_id").isNull(), "doc_id", "row"))
    groups = ended.filter("grp is not null").groupBy("round", "grp").agg(F.count("*").alias("size"), best.alias("best"))
    single = F.col("grp").isNull()
    return ended.join(groups, ["round", "grp"], "left").select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("row") == F.col("best.row"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
        *([] if row is None else [F.col("row").alias(row)]),
    )


def op4_exact_dedup(spark, sf_dir):
    from .shared import table

    return exact_dedup(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY points DESC, doc_id) = 1 AS kept,
       sha256(norm) AS text_sha256
FROM t
"""
