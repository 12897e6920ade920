"""Tables written between stages: they cut plans and lineage, and a lost executor costs only its own tasks."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The folder of the run that tables are written for now, if any (see ``runs``).
folder: ContextVar[str | None] = ContextVar("folder", default=None)
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A local session that names none (tests, a laptop) gets a temporary folder; a cluster must name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """What queries shuffle meanwhile is removed when they end, not when the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, partitioned by columns if asked."""
    spark = df.sparkSession
    path = f"{folder.get() or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").partitionBy(*by or []).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def in_order(files) -> list[str]:
    """Files of a table by the tasks that wrote them."""
    return sorted(files, key=lambda f: [int(n) for n in re.search(r"part-(\d+)-.*-c(\d+)\.", f).groups()])


def ranked(df: DataFrame, order: list, name: str, rank: str) -> tuple[DataFrame, int]:
    """(the rows with their ``rank`` from 0 in this order, their number): dealt by range, sorted and written, numbered by file and row."""
    table = stored(df.repartitionByRange(*order).sortWithinPartitions(*order), name)
    rows = {r["file"]: r["n"] for r in table.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("n")).collect()}  # a row for each file
    files = in_order(rows)
    bases = list(zip(files, [0, *accumulate(rows[f] for f in files)], strict=False))
    bases = F.broadcast(df.sparkSession.createDataFrame(bases, "_file string, _base long"))
    placed = table.select(*df.columns, F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row")).join(bases, "_file")
    return placed.select(*df.columns, (F.col("_base") + F.col("_row")).alias(rank)), sum(rows.values())
