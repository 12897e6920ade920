"""Helpers that several operators share: written tables, clean input columns, graph components."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import shared_dir, stored

TOP = Path(__file__).parents[2]
_shipped: set[str] = set()


def importable(spark: SparkSession) -> None:
    """Let Python workers import the library: from where the driver has it, or, on a cluster, from an archive that Spark hands out."""
    context = spark.sparkContext
    context.environment["PYTHONPATH"] = os.pathsep.join(dict.fromkeys([str(TOP), *filter(None, context.environment.get("PYTHONPATH", "").split(os.pathsep))]))
    if not context.master.startswith("local[") and context.applicationId not in _shipped:
        _shipped.add(context.applicationId)
        package = __package__.split(".")[0]
        context.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='package-')}/{package}", "zip", TOP, package))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder; this cuts the lineage, and a lost executor only costs the tasks it ran."""
    return stored(df, name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: Column) -> DataFrame:
    """``doc_id`` and ``text`` (null text: empty) and what is asked for, so that other columns of any name can't clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(u long, v long)`` as ``(node, component)``; component is the smallest node.

    Alternates large-star and small-star steps (each a grouped minimum and a join that adaptive
    execution may split) until the edge set stops changing; every node then points at its minimum.
    Each round is written to the shared folder. Self-loops and repeated edges are harmless, an
    empty input gives an empty result.
    """
    stars = materialize(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    before = None
    for _ in range(max_rounds):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(both.filter("v < u").join(low, "u").select("u", F.col("m").alias("v"))).filter("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        stars = materialize(small, "cc")
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
