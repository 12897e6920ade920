"""Toxicity by weak supervision: voters, a generative label model, a linear classifier on its posteriors.

1. Voters are mined from labelled documents that are not held out: words, and stems with two or more
   endings, that stand in toxic documents in many different contexts and hardly ever in others.
   (Contexts, not documents: copies of one document share theirs and count once.) Pattern voters
   (shouting, exclamation runs, "you are a ...", a lexicon word that comes again) join them.
2. The label model takes the voters and the given label as independent given the true class, except
   for voters whose votes still correlate within a class: each of them weighs one over their number. Expectation-maximisation estimates each voter's rates and each document's posterior.
3. A logistic regression on the votes and on hit counts is fitted to the posteriors and scores all texts.

Documents used: at most ``TRAIN_ROWS`` labelled ones, in hash order, so what reaches the driver is bounded (each as a
short list of votes). Documents that nobody labelled can join the label model and the classifier (``unlabelled``);
by default none do, as on inner folds of the labelled rows they made both worse: independent voters are too sure of
what few votes mean. A voter must stand in a fixed share of contexts for each toxic document, so
what is a voter does not depend on how many labels there are, and voters need no cap. Equal rows count once, and each doc_id gives its first text before any
gives a second; scoring covers every row and whole texts.

Defined results: null or empty text is scored like any other (no votes); a null doc_id is not held
out and never labelled; labels without a value are ignored, of repeated labels the highest counts;
without labels of both classes every score is the share of toxic labels (0 without labels);
repeated rows are a row each; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, table, texts

TRAIN_ROWS = 20_000
DRAWN = 4
CONTEXTS_A_DOCUMENT, LEAST_SHARE = 0.025, 0.85
STEMS = (4, 5, 6)
ACCEPT = 0.7
WORD = re.compile(r"[^\W\d_]+")
PATTERNS = (re.compile(r"(?:\b[A-Z]{4,}\b\W+){3}"), re.compile(r"!{2,}"), re.compile(r"(?i)\byou(?:'re| are)?\s+(?:a|an|such|so)\b"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int = TRAIN_ROWS, unlabelled: int = 0) -> DataFrame:
    """``doc_id, text, y`` of at most ``rows`` labelled documents and ``unlabelled`` others (y null), none held out, in hash order, as a written table.

    Of a doc_id with several texts the first ones by hash, one of every doc_id before a second of any. One
    scan chooses among ids and hashes of texts, a second one fetches the texts chosen.
    """
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).dropna()
    named = named.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = F.broadcast(named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    known = texts(docs).withColumn("print", F.xxhash64("text"))
    if unlabelled:
        # a row is drawn with a chance that leaves more than enough; the number of rows comes from the files' footers
        chance = min(1.0, DRAWN * unlabelled / max(docs.count(), 1))
        drawn = F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & (F.pmod(draw(), F.lit(1 << 31)) < int(chance * (1 << 31)))
        met = known.join(chosen, "doc_id", "left").filter(F.col("y").isNotNull() | drawn)
    else:
        met = known.join(chosen, "doc_id")
    met = materialize(met.select("doc_id", "print", "y").distinct(), "training-ids")
    turn = F.row_number().over(Window.partitionBy("doc_id").orderBy("print"))
    few = met.filter("y is not null").withColumn("turn", turn).orderBy("turn", F.xxhash64("doc_id"), "doc_id").limit(rows).drop("turn")
    if unlabelled:
        others = met.filter("y is null")
        taken = named.select("doc_id").join(F.broadcast(others.select("doc_id").distinct()), "doc_id", "left_semi")
        few = few.unionByName(others.join(F.broadcast(taken), "doc_id", "left_anti").orderBy(draw(), "doc_id", "print").limit(unlabelled))
    found = known.join(F.broadcast(few), ["doc_id", "print"]).dropDuplicates(["doc_id", "print"])
    return materialize(found.select("doc_id", "text", "y"), "training")


def draw() -> Column:
    return F.xxhash64("doc_id", "print")


@dataclass
class Model:
    """What a task needs to score a text."""

    base: float = 0.0
    words: dict[str, int] = field(default_factory=dict)
    stems: dict[str, int] = field(default_factory=dict)
    weight: np.ndarray | None = None

    def votes(self, text: str) -> list[int]:
        all_words = WORD.findall(text.lower())
        found = set(all_words)
        lexical = found & self.words.keys()
        hits = {self.words[w] for w in lexical}
        if self.stems:
            for n in STEMS:
                hits.update(self.stems[s] for s in {w[:n] for w in found if len(w) > n} & self.stems.keys())
        first = len(self.words) + len(self.stems)
        hits.update(first + i for i, p in enumerate(PATTERNS) if p.search(text))
        if any(all_words.count(w) > 1 for w in lexical):
            hits.add(first + len(PATTERNS))  # a lexicon word comes again
        return sorted(hits)

    @property
    def voters(self) -> int:
        return len(self.words) + len(self.stems) + len(PATTERNS) + 1

    def counts(self, votes: list[list[int]]) -> np.ndarray:
        """What the classifier sees of a row besides its votes."""
        first = self.voters - len(PATTERNS) - 1
        lexical = np.array([sum(i < first for i in v) for v in votes], float)
        return np.column_stack([np.ones(len(votes)), np.log1p(lexical), np.minimum(lexical, 2)])

    def score(self, batch: list[str]) -> np.ndarray:
        if self.weight is None:
            return np.full(len(batch), self.base)
        votes = [self.votes(t) for t in batch]
        return sigmoid(np.array([self.weight[v].sum() for v in votes], float) + self.counts(votes) @ self.weight[self.voters :])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def mine(train: DataFrame) -> tuple[dict[str, int], dict[str, int]]:
    """Lexicon words and stems, numbered; the contexts are gone through once, stems add up what their words have."""
    least = max(2, round(CONTEXTS_A_DOCUMENT * train.filter("y = 1").count()))
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: w != "")
    pairs = train.select("y", F.explode(F.arrays_zip(F.concat(F.array(F.lit("")), words).alias("before"), words.alias("word"))).alias("p"))
    contexts = pairs.select("y", "p.before", "p.word").filter("word is not null").distinct()
    by_word = materialize(contexts.groupBy(F.col("word").alias("key")).agg(F.count_if(F.col("y") == 1).alias("n1"), F.count_if(F.col("y") == 0).alias("n0")), "lexicon")
    stems = F.explode(F.array(*(F.when(F.char_length("key") > n, F.substring("key", 1, n)) for n in STEMS)))
    by_stem = by_word.select("n1", "n0", stems.alias("key")).filter("key is not null").groupBy("key").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"), F.count("*").alias("kinds"))
    sure = (F.col("n1") >= least) & (F.col("n1") >= LEAST_SHARE * (F.col("n1") + F.col("n0")))
    best = lambda found: [r["key"] for r in found.filter(sure).orderBy(F.desc(F.col("n1") - 4 * F.col("n0")), "key").select("key").collect()]
    word_list, stem_list = best(by_word), best(by_stem.filter("kinds > 1"))
    return {w: i for i, w in enumerate(word_list)}, {s: len(word_list) + i for i, s in enumerate(stem_list)}


class VotePatterns:
    """The different (given label, votes) among documents, in order, and how many documents have each.

    Votes are (row, voter) pairs, so memory follows the votes cast and not documents times voters.
    """

    def __init__(self, votes: list[list[int]], given: list[int], voters: int):
        found = sorted(Counter(zip(given, map(tuple, votes), strict=True)).items())
        self.voters = voters
        self.votes = [list(v) for (_, v), _ in found]
        self.given = np.array([g for (g, _), _ in found], int)
        self.n = np.array([n for _, n in found], float)
        self.row = np.repeat(np.arange(len(found)), [len(v) for v in self.votes])
        self.voter = np.array([i for v in self.votes for i in v], int)

    def by_voter(self, weight: np.ndarray) -> np.ndarray:
        """Sum of a row's weight over the rows where each voter votes."""
        return np.bincount(self.voter, weight[self.row], self.voters)

    def by_row(self, value: np.ndarray) -> np.ndarray:
        """Sum of a voter's value over the votes of each row."""
        return np.bincount(self.row, value[self.voter], len(self.n))


def label_model(p: VotePatterns, rounds: int = 25, alike: float = 0.5) -> np.ndarray:
    """Posterior of the toxic class for each pattern, from its votes and the given label (-1: none), a voter among others.

    A voter whose votes correlate with those of others by more than ``alike`` within the classes weighs
    one over the number of these, itself included.
    """
    share = np.ones(p.voters)
    known, toxic = p.given >= 0, p.given == 1
    base = p.n[toxic].sum() / max(p.n[known].sum(), 1)
    post = np.where(known, np.where(toxic, 0.9, 0.1), base)
    for k in range(rounds):
        if k == rounds // 2:
            share = 1 / group_sizes(p, post, alike)
        q = np.stack([1 - post, post]) * p.n
        rate = np.array([(p.by_voter(w) + 0.5) / (w.sum() + 1) for w in q])
        right = np.array([(q[y][toxic].sum() + (1 if y == 0 else 99)) / (q[y][known].sum() + 100) for y in (0, 1)])
        prior = np.clip(q[1].sum() / p.n.sum(), 1e-3, 1 - 1e-3)
        yes, no = np.log(rate[1] / rate[0]) * share, np.log((1 - rate[1]) / (1 - rate[0])) * share
        odds = np.log(prior / (1 - prior)) + p.by_row(yes - no) + no.sum()
        odds = odds + np.where(known, np.where(toxic, np.log(right[1] / right[0]), np.log((1 - right[1]) / (1 - right[0]))), 0.0)
        post = sigmoid(odds)
    return post


def group_sizes(p: VotePatterns, post: np.ndarray, alike: float) -> np.ndarray:
    """How many voters, itself included, each voter correlates with inside the classes.

    Only voters that vote together somewhere can correlate so, hence a voter is compared with those that
    vote in its own rows: its votes less what its classes' means explain, against theirs.
    """
    q = np.stack([1 - post, post])
    total = np.maximum((q * p.n).sum(1), 1e-9)
    sums = np.array([p.by_voter(w * p.n) for w in q])
    mean = sums / total[:, None]
    both = (q * p.n) @ q.T  # how far the classes overlap
    rows = [[] for _ in range(p.voters)]
    for i, v in zip(p.row.tolist(), p.voter.tolist(), strict=True):
        rows[v].append(i)
    spread = np.sqrt(np.maximum(p.by_voter(p.n) - 2 * (sums * mean).sum(0) + (mean * (both @ mean)).sum(0), 0) / p.n.sum()) + 1e-6
    size = np.ones(p.voters)
    for a, mine in enumerate(rows):
        if mine:
            met = np.concatenate([p.votes[i] for i in mine])
            together = np.bincount(met, np.repeat(p.n[mine], [len(p.votes[i]) for i in mine]), p.voters)
            shared = together - sums[:, a] @ mean - mean[:, a] @ sums + mean[:, a] @ both @ mean
            close = shared / p.n.sum() / (spread[a] * spread) > alike
            close[a] = True
            size[a] = close.sum()
    return size


def sparse_logistic(p: VotePatterns, more: np.ndarray, post: np.ndarray, ridge: float = 0.1, steps: int = 30) -> np.ndarray:
    """Logistic regression on soft labels over votes and ``more`` columns, by Newton's method with conjugate gradients."""
    of_rows = lambda w: p.by_row(w[: p.voters]) + more @ w[p.voters :]
    of_columns = lambda r: np.concatenate([p.by_voter(r), r @ more])
    w = np.zeros(p.voters + more.shape[1])
    for _ in range(steps):
        s = sigmoid(of_rows(w))
        slope = of_columns(p.n * (s - post)) + ridge * w
        if np.abs(slope).max() < 1e-7:
            break
        curve = p.n * (s * (1 - s) + 1e-6)
        move, rest = np.zeros_like(w), slope.copy()
        ahead, size = rest.copy(), rest @ rest
        for _ in range(4 * len(w)):
            if size < 1e-16 * (slope @ slope):
                break
            bent = of_columns(curve * of_rows(ahead)) + ridge * ahead
            pace = size / (ahead @ bent)
            move += pace * ahead
            rest -= pace * bent
            ahead, size = rest + (rest @ rest / size) * ahead, rest @ rest
        w -= move
    return w


def logistic(x: np.ndarray, p: np.ndarray, ridge: float = 0.1, steps: int = 20) -> np.ndarray:
    """Newton's method for logistic regression on soft labels."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        s = sigmoid(x @ w)
        slope = x.T @ (s - p) + ridge * w
        w -= np.linalg.solve((x * (s * (1 - s) + 1e-6)[:, None]).T @ x + ridge * np.eye(len(w)), slope)
    return w


def train_toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, unlabelled: int = 0) -> Model:
    sample = training_rows(docs, labels, "toxic", rows, unlabelled)
    words, stems = mine(sample.filter("y is not null"))
    model = Model(words=words, stems=stems)

    def vote(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([model.votes(t) for t in b.column(0).to_pylist()], pa.list_(pa.int32()))], ["y", "votes"])

    seen = sample.select("text", "y").mapInArrow(vote, "y int, votes array<int>").collect()  # at most `rows` + `unlabelled` short lists
    given = [-1 if r["y"] is None else r["y"] for r in seen]
    labelled = [y for y in given if y >= 0]
    model.base = sum(labelled) / len(labelled) if labelled else 0.0
    if len(set(labelled)) == 2:
        patterns = VotePatterns([r["votes"] for r in seen], given, model.voters)
        model.weight = sparse_logistic(patterns, model.counts(patterns.votes), label_model(patterns))
    return model


def score_column(model: Model):
    """The score of a text column, for use beside any other columns."""
    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(model.score(text.fillna("").tolist()))

    return score


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, accept: float = ACCEPT) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted."""
    model = train_toxicity(docs, labels, rows)

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(b.column(1).to_pylist()))], ["doc_id", "score"])

    scored = texts(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"))


def op5_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
