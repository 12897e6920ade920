"""Quality by hierarchical empirical Bayes over documents, paths and hosts.

A logistic classifier gives each document's own evidence from the shape of its text. Grouped aggregates
sum that evidence per path (a part of a host) and per host, over all documents. A host's rate of good documents is
shrunk toward the global rate, a path's toward its host's; how strongly follows from the data: the
spread between sites beyond what their sizes explain (method of moments). Sparse sites so stay near
the prior, large ones speak for themselves. A document's score multiplies its own odds by how its
path's odds differ from the global ones, with its own evidence taken out of the path first.

The classifier is fitted on at most ``TRAIN_ROWS`` labelled documents that are not held out, in hash
order; all statistics cover all documents.

Defined results: null or empty text has a shape like any other; a null host or path is a site of its
own; without labels of both classes a document's own evidence is the share of good labels (0.5 without
labels); repeated rows are a row each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize, table
from .toxicity import TRAIN_ROWS, held_out, logistic, sigmoid, training_rows

ACCEPT = 0.5
BLOCK = 400
ODD = re.compile(r"[^\w\s.,;:'\"?!-]")
RUNS = re.compile(r"([^\w\s])\1{1,}")


def repeats(words: list[str], block: int = BLOCK) -> float:
    """The share of words that stand before in their block, over consecutive blocks that cover the whole text."""
    return 1 - sum(len(set(words[k : k + block])) for k in range(0, len(words), block)) / len(words)


def shape(text: str) -> list[float]:
    """What the classifier sees of a text; every entry is bounded."""
    words = text.split()
    n, chars = len(words), max(len(text), 1)
    if not n:
        return [1.0, 1.0] + [0.0] * 9
    counts = Counter(words)
    repeated = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    lines = text.split("\n")
    return [
        1.0,
        0.0,
        min(1.0, len(ODD.findall(text)) / n),
        min(1.0, len(RUNS.findall(text)) / n),
        sum(map(str.isupper, words)) / n,
        repeated,
        (counts.most_common(1)[0][1] - 1) / n,
        repeats(words),
        min(1.0, len(text) / n / 20),
        1 - len(set(lines)) / len(lines),
        float(np.log1p(n) / 12),
    ]


def train_quality(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[float, np.ndarray | None]:
    """(share of good labels, weights or None)."""

    def shapes(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([shape(t) for t in b.column(0).to_pylist()], pa.list_(pa.float64()))], ["y", "x"])

    seen = training_rows(docs, labels, "quality", rows).select("text", "y").mapInArrow(shapes, "y int, x array<double>").collect()  # at most `rows`
    y = np.array([r["y"] for r in seen])
    if len(set(y.tolist())) < 2:
        return (float(y.mean()) if len(y) else 0.5), None
    x = np.array([r["x"] for r in seen])
    return float(y.mean()), logistic(x, y, ridge=0.05, steps=25)


def shrunk(good: Column, n: Column, prior: Column, strength: Column) -> Column:
    return (good + prior * strength) / (n + strength)


def strength(sites: DataFrame, prior: str) -> float:
    """Pseudo-documents that the prior is worth: large where sites differ no more than their sizes explain."""
    usable = sites.filter("n > 1")
    within = F.col("p") * (1 - F.col("p")) / F.col("n")
    found = usable.withColumn("p", F.col("good") / F.col("n")).agg(F.avg((F.col("p") - F.col(prior)) ** 2 - within).alias("between"), F.avg(F.col(prior) * (1 - F.col(prior))).alias("all")).first()
    if found["all"] is None:
        return 10.0
    return float(min(1e4, max(2.0, found["all"] / max(found["between"], 1e-6) - 1)))


def quality(docs: DataFrame, labels: DataFrame, host: Column, path: Column, rows: int = TRAIN_ROWS, accept: float = ACCEPT) -> DataFrame:
    """One row per input row: doc_id, host, path, held_out, evidence, host_rate, path_rate, score, predicted."""
    base, weight = train_quality(docs, labels, rows)

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            words = b.column(3).to_pylist()
            p = np.full(len(words), base) if weight is None else sigmoid(np.array([shape(t) for t in words]).reshape(-1, 11) @ weight)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(p)], ["doc_id", "host", "path", "evidence"])

    site = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    scored = materialize(site.mapInArrow(run, "doc_id long, host string, path string, evidence double"), "quality-evidence")
    paths = scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("evidence").alias("good"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    overall = min(0.999, max(0.001, (total["good"] or 0.0) / total["n"])) if total["n"] else 0.5
    hosts = hosts.withColumn("overall", F.lit(overall))
    of_host = strength(hosts, "overall")
    hosts = hosts.select("host", shrunk(F.col("good"), F.col("n"), F.lit(overall), F.lit(of_host)).alias("host_rate"))
    paths = paths.join(hosts, "host")
    of_path = strength(paths, "host_rate")
    rest = shrunk(F.col("good") - F.col("evidence"), F.col("n") - 1, F.col("host_rate"), F.lit(of_path))
    logit = lambda p: F.ln(F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6)) / (1 - F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))))
    joined = scored.join(paths, ["host", "path"])
    score = 1 / (1 + F.exp(-(logit(F.col("evidence")) + logit(rest) - logit(F.lit(overall)))))
    return joined.select(
        "doc_id", "host", "path", held_out(F.col("doc_id")).alias("held_out"), "evidence", "host_rate",
        shrunk(F.col("good"), F.col("n"), F.col("host_rate"), F.lit(of_path)).alias("path_rate"), score.alias("score"), (score >= accept).cast("int").alias("predicted"),
    )


def op10_quality(spark, sf_dir):
    """A document's host is its source; the path below it is the source's section in one language."""
    docs = table(spark, sf_dir, "documents")
    return quality(docs, table(spark, sf_dir, "labels"), F.col("source"), F.concat_ws("/", "source", "lang"))
