"""The label model, its classifier and the shrinkage of quality rates against plain Python."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausemine.llm.quality import quality
from clausemine.llm.toxicity import VotePatterns, group_sizes, label_model, logistic, mine, sigmoid, sparse_logistic, training_rows

TEN = [
    ([0, 1], 1), ([0, 1, 3], 1), ([0, 1], -1), ([2], 1), ([2, 3], 0),
    ([], 0), ([], 0), ([3], 0), ([], -1), ([0, 1, 2], -1),
]


def correlated(votes, post, voters, alike):
    """For each voter, how many it correlates with inside the classes, from the dense table of what class means leave."""
    rest = [[float(v in row) for v in range(voters)] for row in votes]
    explained = [[0.0] * voters for _ in votes]
    for y in (0, 1):
        q = [p if y else 1 - p for p in post]
        for v in range(voters):
            mean = sum(a * float(v in row) for a, row in zip(q, votes)) / max(sum(q), 1e-9)
            for i, a in enumerate(q):
                explained[i][v] += a * mean
    rest = [[a - b for a, b in zip(r, e)] for r, e in zip(rest, explained)]
    dot = lambda a, b: sum(r[a] * r[b] for r in rest) / len(rest)
    spread = [math.sqrt(dot(v, v)) + 1e-6 for v in range(voters)]
    return [sum(a == b or dot(a, b) / (spread[a] * spread[b]) > alike for b in range(voters)) for a in range(voters)]


def plain_posteriors(rows, voters, rounds=25, alike=0.5):
    votes, given = [v for v, _ in rows], [g for _, g in rows]
    n_known = sum(g >= 0 for g in given)
    post = [0.9 if g == 1 else 0.1 if g == 0 else sum(g == 1 for g in given) / n_known for g in given]
    share = [1.0] * voters
    for k in range(rounds):
        if k == rounds // 2:
            share = [1 / n for n in correlated(votes, post, voters, alike)]
        rate, right = [], []
        for y in (0, 1):
            q = [p if y else 1 - p for p in post]
            rate.append([(sum(a for a, row in zip(q, votes) if v in row) + 0.5) / (sum(q) + 1) for v in range(voters)])
            said = sum(a for a, g in zip(q, given) if g == 1)
            right.append((said + (99 if y else 1)) / (sum(a for a, g in zip(q, given) if g >= 0) + 100))
        prior = min(max(sum(post) / len(post), 1e-3), 1 - 1e-3)
        new = []
        for row, g in zip(votes, given):
            odds = math.log(prior / (1 - prior))
            for v in range(voters):
                a, b = (rate[1][v], rate[0][v]) if v in row else (1 - rate[1][v], 1 - rate[0][v])
                odds += share[v] * math.log(a / b)
            if g >= 0:
                odds += math.log(right[1] / right[0]) if g else math.log((1 - right[1]) / (1 - right[0]))
            new.append(1 / (1 + math.exp(-min(max(odds, -30), 30))))
        post = new
    return post


def by_row(rows, patterns, values):
    place = {(g, tuple(v)): x for g, v, x in zip(patterns.given.tolist(), patterns.votes, values)}
    return [place[g, tuple(v)] for v, g in rows]


def some_rows(seed, n=300, voters=7):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        y = rng.random() < 0.3
        votes = {v for v in range(voters - 1) if rng.random() < (0.4 if y else 0.05)}
        if 0 in votes and rng.random() < 0.9:
            votes.add(voters - 1)  # says mostly what voter 0 says
        rows.append((sorted(votes), rng.choice([-1, int(y)])))
    return rows


@pytest.mark.parametrize("rows, voters", [(TEN, 4), (some_rows(1), 7), (some_rows(2, 60), 7)])
def test_label_model_is_that_of_plain_python(rows, voters):
    patterns = VotePatterns([v for v, _ in rows], [g for _, g in rows], voters)
    assert patterns.n.sum() == len(rows) and len(patterns.n) == len({(g, tuple(v)) for v, g in rows})
    assert by_row(rows, patterns, label_model(patterns)) == pytest.approx(plain_posteriors(rows, voters), abs=1e-9)


def test_label_model_follows_labels_and_voters():
    patterns = VotePatterns([v for v, _ in TEN], [g for _, g in TEN], 4)
    post = by_row(TEN, patterns, label_model(patterns))
    assert min(post[:2]) > 0.9 and max(post[5:8]) < 0.1  # labelled
    assert post[8] < 0.5 < min(post[2], post[9])  # by votes alone


def test_voters_that_say_the_same_share_their_weight():
    rows = some_rows(5, 500)
    patterns = VotePatterns([v for v, _ in rows], [g for _, g in rows], 7)
    post = label_model(patterns, rounds=3)
    sizes = group_sizes(patterns, post, 0.5)
    assert sizes.tolist() == correlated([v for v, _ in rows], by_row(rows, patterns, post), 7, 0.5)
    assert sizes[0] == sizes[6] == 2 and max(sizes[1:6]) == 1


def test_sparse_regression_reaches_the_dense_optimum():
    rows = some_rows(9, 400)
    patterns = VotePatterns([v for v, _ in rows], [g for _, g in rows], 7)
    post = label_model(patterns)
    more = lambda votes: np.column_stack([np.ones(len(votes)), np.log1p([len(v) for v in votes])])
    dense = np.array([[float(k in v) for k in range(7)] for v, _ in rows])
    want = logistic(np.hstack([dense, more([v for v, _ in rows])]), np.array(by_row(rows, patterns, post)), steps=60)
    got = sparse_logistic(patterns, more(patterns.votes), post)
    assert got == pytest.approx(want, abs=1e-4)
    assert sigmoid(np.array([50.0, -50.0])) == pytest.approx([1, 0], abs=1e-9)


def test_lexicon_counts_contexts_once(spark):
    """A word that copies of one document hold counts once for each context, a stem adds up the words it begins."""
    foul = [f"{w} snurfeling {w} snurfeled" for w in ("a", "b", "c", "d")]
    rows = [(i, t, 1) for i, t in enumerate(foul + foul[:1] * 50)] + [(100 + i, f"a b c d copied {i}", 0) for i in range(9)]
    words, stems = mine(spark.createDataFrame(rows, "doc_id long, text string, y int"))
    assert set(words) == {"snurfeling", "snurfeled"} and set(stems) == {"snur", "snurf", "snurfe"}
    assert sorted([*words.values(), *stems.values()]) == list(range(5))


def test_unlabelled_rows_are_bounded_and_neither_labelled_nor_held_out(spark, frame):
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 100, 2)] + [(1, None)], "doc_id long, toxic int")
    docs = frame([(i, f"text {i}") for i in range(300)] + [(7, "text 7")] * 30 + [(None, "none")])
    got = training_rows(docs, labels, "toxic", 20, 40).collect()
    named = [r for r in got if r.y is not None]
    assert len(named) == 20 and {r.doc_id for r in named} <= set(range(0, 100, 2))
    others = [r.doc_id for r in got if r.y is None]
    assert len(others) == 40 == len(set(others)) and not {*range(0, 100, 2), None} & set(others)
    assert not [r for r in got if r.doc_id is None or r.doc_id in held_out_ids()]
    every = training_rows(docs, labels, "toxic", 1000, 1000).collect()
    assert {r.doc_id for r in every} == set(range(300)) - held_out_ids() and len(every) == len({r.doc_id for r in every})


def held_out_ids():
    import zlib

    return {i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1}


def test_rates_of_hosts_of_one_two_and_a_thousand_rows(spark):
    """Shrinkage by the formulas, from each row's own evidence; sparse hosts stay near the prior, large ones do not."""
    rng = random.Random(4)
    good = lambda: " ".join(rng.choice("river stone lamp window garden paper letter morning".split()) + str(rng.randrange(99)) for _ in range(30))
    bad = lambda: " ".join(["### $$$ !!!"] * 10)
    sites = [("one", "one/a")] + [("two", "two/a"), ("two", "two/b")] + [("big", f"big/{i % 4}") for i in range(1000)] + [(f"h{i % 30}", f"h{i % 30}/x") for i in range(600)]
    rows, labels = [], []
    for i, (host, path) in enumerate(sites):
        y = int(host not in ("one", "two") and rng.random() < (0.2 if host == "big" else 0.2 + 0.02 * (i % 30)))
        rows.append((i, good() if y else bad(), host, path))
        labels.append((i, y))
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    got = quality(docs, spark.createDataFrame(labels, "doc_id long, quality int"), F.col("host"), F.col("path")).collect()
    assert len(got) == len(rows)

    of_path, of_host = defaultdict(list), defaultdict(list)
    for r in got:
        of_path[r.host, r.path].append(r.evidence)
        of_host[r.host].append(r.evidence)
    overall = sum(r.evidence for r in got) / len(got)

    def strength(groups):
        used = [(sum(v) / len(v), len(v), prior) for v, prior in groups if len(v) > 1]
        between = sum((p - prior) ** 2 - p * (1 - p) / n for p, n, prior in used) / len(used)
        return min(1e4, max(2.0, sum(prior * (1 - prior) for *_, prior in used) / len(used) / max(between, 1e-6) - 1))

    k = strength([(v, overall) for v in of_host.values()])
    host_rate = {h: (sum(v) + overall * k) / (len(v) + k) for h, v in of_host.items()}
    m = strength([(v, host_rate[h]) for (h, _), v in of_path.items()])
    logit = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    for r in got:
        v, prior = of_path[r.host, r.path], host_rate[r.host]
        assert r.host_rate == pytest.approx(prior, abs=1e-9)
        assert r.path_rate == pytest.approx((sum(v) + prior * m) / (len(v) + m), abs=1e-9)
        rest = (sum(v) - r.evidence + prior * m) / (len(v) - 1 + m)
        assert r.score == pytest.approx(sigmoid(logit(r.evidence) + logit(rest) - logit(overall)), abs=1e-9)
    raw = {h: sum(v) / len(v) for h, v in of_host.items()}
    moved = {h: abs(host_rate[h] - raw[h]) / abs(overall - raw[h]) for h in ("one", "two", "big")}
    assert moved["one"] > moved["two"] > 10 * moved["big"]
