"""A corpus pipeline: toxicity, exact dedup, SimHash near-dedup, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a
DataFrame, which ``run`` writes as Parquet and reads again for the next stage. All but the last
return the columns of ``documents``; the last returns the packed pieces.

Defined results: rows are told apart by a number that a dedup stage gives each of its input rows,
so null or repeated doc_ids cost no text: of each group exactly one row stays, whatever its doc_id.
Null texts count as empty and stay null. SQL cannot express the toxicity classifier, so there is no ORACLE_SQL; tests hold
the classifier to held-out rows, and the README names the stages without a brute-force version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemine.llm.exact_dedup import exact_dedup
from clausemine.llm.packing import pack
from clausemine.llm.pii import redact
from clausemine.llm.shared import importable, materialize, table
from clausemine.llm.simhash_dedup import simhash_dedup
from clausemine.llm.toxicity import ACCEPT, score_column, train_toxicity


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    score = score_column(train_toxicity(docs, table(spark, sf_dir, "labels")))
    return docs.filter(score(F.coalesce("text", F.lit(""))) < ACCEPT)


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with a number for each row, written so that it stays the same, and the name of its column."""
    key = "row_key"
    while key in map(str.lower, docs.columns):
        key += "_"
    return materialize(docs.withColumn(key, F.monotonically_increasing_id()), "numbered"), key


def chosen(docs: DataFrame, key: str, rows: DataFrame) -> DataFrame:
    """The documents of these rows; texts move once, in the same way at every size."""
    return docs.join(rows.select(key).hint("merge"), key, "left_semi").drop(key)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one that exact dedup keeps stays."""
    docs, key = numbered(docs)
    return chosen(docs, key, exact_dedup(docs, row=key).filter("kept"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id stays; a null one is the largest, the first of equal ones stays."""
    docs, key = numbered(docs)
    first = F.min_by(key, F.struct(F.col("doc_id").isNull(), "doc_id", key)).alias(key)
    return chosen(docs, key, simhash_dedup(docs, row=key).groupBy("component").agg(first))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts as token pieces in sequences of 2048."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact dedup", exact_stage),
    ("simhash near-dedup", near_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
