"""Exact, SimHash and embedding dedup against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from clausemine.llm.embedding_dedup import embedding_dedup
from clausemine.llm.exact_dedup import exact_dedup
from clausemine.llm.shared import components
from clausemine.llm.simhash_dedup import simhash_dedup


def key(d):
    return (d is None, d or 0)


def exact_brute(pairs):
    groups = defaultdict(list)
    for d, t in pairs:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((d, t or ""))
    out = []
    for norm, rows in groups.items():
        best = min(rows, key=lambda r: (-len(r[1]), key(r[0])))
        left = 1
        for d, t in rows:
            kept = bool(left) and (d, len(t)) == (best[0], len(best[1]))
            left -= kept
            out.append((d, best[0], len(rows), kept, hashlib.sha256(norm.encode()).hexdigest()))
    return Counter(out)


def test_exact_dedup_agrees_with_a_dictionary(docs, rows):
    for first, widen in ((64, 16), (5, 40)):
        got = exact_dedup(docs, first, widen).collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == exact_brute(rows)


def test_exact_dedup_of_an_empty_table(frame):
    assert exact_dedup(frame([])).count() == 0


def simhash_brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def classes(nodes, linked):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        parent[root(a)] = root(b)
    out = defaultdict(list)
    for n in nodes:
        out[root(n)].append(n)
    return {n: group for group in out.values() for n in group}


def near_texts(seed, n=60):
    """Texts in families of near copies, so that fingerprints lie at all small distances."""
    rng = random.Random(seed)
    out, i = [], 1000
    for _ in range(n):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice([8, 60, 150]))]
        for _ in range(rng.choice([1, 2, 6])):
            copy = [w if rng.random() > 0.01 else "changed" for w in base]
            out.append((i, " ".join(copy)))
            i += 1
    return out


def test_simhash_agrees_with_brute_force(frame, rows):
    pairs = rows + near_texts(5)
    fp = [simhash_brute(t or "") for _, t in pairs]
    unique = sorted(set(fp))
    linked = [(a, b) for i, a in enumerate(unique) for b in unique[:i] if (a ^ b).bit_count() <= 4]
    group = classes(unique, linked)
    least = {}
    for (d, _), f in zip(pairs, fp, strict=True):
        for g in group[f]:
            least[g] = d if least.get(g) is None else least[g] if d is None else min(d, least[g])
    want = Counter((d, f"{f:016x}", least[f]) for (d, _), f in zip(pairs, fp, strict=True))
    assert any(0 < (a ^ b).bit_count() <= 4 for i, a in enumerate(unique) for b in unique[:i])
    for layout, part in ((0, 4), (1, 3)):
        got = simhash_dedup(frame(pairs), layout=layout, part=part).collect()
        assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want


def test_simhash_of_an_empty_table(frame):
    assert simhash_dedup(frame([])).count() == 0


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(100)] + [(500, 500 + i) for i in range(200)] + [(900, 900)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)]
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    group = classes(nodes, [e for e in edges if e[0] != e[1]])
    got = {r.node: r.component for r in components(spark.createDataFrame(edges + edges, "u long, v long")).collect()}
    assert got == {n: min(group[n]) for n in nodes}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int, cls int, line int, count int"


def vectors(seed, dim=64):
    rng = random.Random(seed)
    unit = lambda: [rng.gauss(0, 1) for _ in range(dim)]
    out, i = [], 0
    for _ in range(80):
        base = unit()
        for _ in range(rng.choice([1, 2, 5])):
            noise, eps = unit(), rng.choice([0.0, 0.1, 0.2, 0.3, 0.33])
            out.append((i, [b + eps * x for b, x in zip(base, noise, strict=True)]))
            i += 1
    odd = [(9000, None), (9001, []), (9002, [0.0] * dim), (9003, [None] * dim), (9004, [float("nan")] * dim), (9005, [float("inf")] * dim), (None, unit()), (3, out[3][1]), (9006, unit()[:5])]
    return out + odd + [(9100 + k, out[0][1]) for k in range(50)]


def cosine(a, b):
    return math.fsum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(math.fsum(x * x for x in a) * math.fsum(y * y for y in b))


def test_embedding_links_and_recall(spark):
    pairs = vectors(8)
    df = spark.createDataFrame([(i, v, i, 1, 1, 1) for i, v in pairs], VECTORS).repartition(6)
    stored = [(r.vec_id, r.embedding) for r in df.select("vec_id", "embedding").collect()]
    good = [(i, v) for i, v in stored if v and None not in v and all(map(math.isfinite, v)) and any(v)]
    links = [(a, b) for a in range(len(good)) for b in range(a) if len(good[a][1]) == len(good[b][1]) and cosine(good[a][1], good[b][1]) >= 0.95]
    n = Counter(x for e in links for x in e)
    got = embedding_dedup(df).collect()
    assert len(got) == len(pairs)
    odd = {r.vec_id: r for r in got if r.vec_id is not None and 9000 <= r.vec_id <= 9005}
    assert all(r.n_links == 0 and r.component_id == r.vec_id and r.kept for r in odd.values()) and len(odd) == 6
    found = sum(r.n_links for r in got)
    assert 0.9 * 2 * len(links) <= found <= 2 * len(links)
    want = Counter((good[k][0], n[k]) for k in range(len(good)))
    have = Counter((r.vec_id, r.n_links) for r in got if r.vec_id not in odd)
    assert sum((want & have).values()) >= 0.9 * len(good)
    group = classes(range(len(good)), links)
    least = {k: min((good[j][0] for j in group[k] if good[j][0] is not None), default=None) for k in group}
    assert sum(((Counter((good[k][0], least[k]) for k in group)) & Counter((r.vec_id, r.component_id) for r in got)).values()) >= 0.9 * len(good)


def test_embedding_dedup_of_an_empty_table(spark):
    assert embedding_dedup(spark.createDataFrame([], VECTORS)).count() == 0


DOUBLES = "vec_id long, embedding array<double>"


def recall_of(spark, rows):
    """(share of the links that are found, links that are none) by brute force over double vectors."""
    got = {r.vec_id: r.n_links for r in embedding_dedup(spark.createDataFrame(rows, DOUBLES).repartition(6)).collect()}
    x = np.array([v for _, v in rows])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = (x @ x.T >= 0.95).sum(1) - 1
    have = np.array([got[i] for i, _ in rows])
    return have.sum() / want.sum(), int((have > want).sum())


def planted(rng, n, dim, direction=0.0):
    """Half of the vectors have a partner at a cosine of about .95 to .99; ``direction`` is what all share."""
    shared = direction * rng.standard_normal(dim)
    base = shared + rng.standard_normal((n // 2, dim))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    noise = rng.standard_normal((n // 2, dim))
    noise -= (noise * base).sum(1, keepdims=True) * base
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    t = rng.uniform(0.951, 0.99, (n // 2, 1))
    return np.concatenate([base, t * base + np.sqrt(1 - t * t) * noise])


@pytest.mark.parametrize("scale", [1e200, 1e-200, 1e-300, 1.0])
def test_vectors_of_any_magnitude_link(spark, scale):
    x = planted(np.random.default_rng(4), 100, 64) * scale
    recall, wrong = recall_of(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    assert recall >= 0.98 and not wrong


@pytest.mark.parametrize(("dim", "direction"), [(64, 0.0), (64, 1.0), (2, 0.0), (3, 0.0), (16, 0.5)])
def test_recall_with_and_without_a_shared_direction(spark, dim, direction):
    x = planted(np.random.default_rng(dim), 600 if dim > 3 else 60, dim, direction)
    recall, wrong = recall_of(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    assert recall >= 0.97 and not wrong


def candidate_rows(x, mean, n):
    """Rows of the join on lines, of unit vectors with the settings that n of them get."""
    from clausemine.llm.embedding_dedup import HALF_WINDOW, RECALL, SEED, THRESHOLD, calibrated, directions, tails

    dim = x.shape[1]
    found = calibrated(x, mean, n, HALF_WINDOW, THRESHOLD, RECALL, SEED)
    line, value = tails(x - mean * found["centred"], directions(dim, found["families"], found["lines"], SEED), found["members"])
    by_line = defaultdict(list)
    for i in range(len(x)):
        for ln, v in zip(line[i].tolist(), value[i].tolist(), strict=True):
            by_line[ln].append((i, v))
    met = 0
    for i in range(len(x)):
        for ln, v in zip(line[i, : found["queries"]].tolist(), value[i, : found["queries"]].tolist(), strict=True):
            met += sum(abs(v - w) <= HALF_WINDOW and j != i for j, w in by_line[ln])
    return met


def test_a_shared_direction_does_not_draw_all_vectors_to_the_same_lines():
    """Candidate rows of the join on lines, of 1,000 vectors that share their mean: well below all pairs."""
    from clausemine.llm.embedding_dedup import unit

    x = unit(planted(np.random.default_rng(9), 1000, 64, 1.0))
    assert candidate_rows(x, x.mean(0), 1000) < 0.1 * len(x) ** 2


def test_candidate_rows_follow_the_vectors_and_not_their_square():
    """Vectors of which none are alike: four times as many meet about four times as many members, not sixteen."""
    from clausemine.llm.embedding_dedup import unit

    x = unit(np.random.default_rng(3).standard_normal((8000, 64)))
    few, many = (candidate_rows(x[:n], x[:n].mean(0), n) for n in (2000, 8000))
    assert many < 8 * few


def test_the_farthest_sums_are_found_among_the_farthest_terms():
    from clausemine.llm.embedding_dedup import directions, tails

    rng = np.random.default_rng(6)
    x, families = rng.standard_normal((20, 8)), directions(8, 3, 5, 7)
    line, value = tails(x, families, 12)
    assert all(len(set(row)) == 12 for row in line.tolist())
    near = [np.abs(x @ f) for f in families]
    sums = (near[0][:, :, None, None] + near[1][:, None, :, None] + near[2][:, None, None, :]).reshape(20, -1)
    assert np.allclose(value, np.sort(sums, axis=1)[:, ::-1][:, :12])


@pytest.mark.parametrize("n", [1, 1000, 10**6, 10**8, 10**10])
def test_lines_follow_the_number_of_vectors(n):
    from clausemine.llm.embedding_dedup import ENDS, family_sizes

    families, lines = family_sizes(n)
    assert ENDS * n <= (2 * lines) ** families * 1.01 and (2 * (lines - 1)) ** families < ENDS * n and families * lines <= 20_000


def test_vectors_that_a_hash_leaves_out_count_for_the_bound(spark):
    """Half of the vectors lie near the mean, where pairs meet less often; by their hashes a sample of 1,500 would hold none of these."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(11)
    near = rng.standard_normal((8000, 64)) / 8
    near[:, 0] += 2
    base = np.concatenate([rng.standard_normal((8000, 64)), near])
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    noise = rng.standard_normal(base.shape)
    noise -= (noise * base).sum(1, keepdims=True) * base
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    pairs = np.stack([base, 0.951 * base + np.sqrt(1 - 0.951**2) * noise], 1).reshape(-1, 64)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(pairs)], DOUBLES)
    low = {r.vec_id: r.low for r in frame.select("vec_id", (F.pmod(F.xxhash64("embedding"), F.lit(1 << 40)) < 1 << 39).alias("low")).collect()}
    far = [k for k in range(0, 16_000, 2) if low[k] and low[k + 1]][:750]
    close = [k for k in range(16_000, 32_000, 2) if not low[k] and not low[k + 1]][:750]
    assert len(far) == len(close) == 750
    recall, wrong = recall_of(spark, [(i, pairs[i].tolist()) for k in far + close for i in (k, k + 1)])
    assert recall >= 0.97 and not wrong


def test_settings_rest_on_every_vector(spark):
    """Each length has a pair for each of its vectors, and no less than PAIRS."""
    from clausemine.llm import embedding_dedup as op

    rng = np.random.default_rng(12)
    x = {dim: rng.standard_normal((n, dim)) for dim, n in ((16, 2500), (8, 40))}
    frame = spark.createDataFrame([(v.tolist(),) for rows in x.values() for v in rows], "embedding array<double>").repartition(5)
    sizes = spark.createDataFrame([(dim, len(rows)) for dim, rows in x.items()], "dim int, n long")
    got = {r.dim: r for r in op.settings_of(frame, sizes, {}, op.HALF_WINDOW, op.THRESHOLD, op.RECALL, op.SEED).collect()}
    assert {dim: r.pairs for dim, r in got.items()} == {16: 2500, 8: 40 * 38}
    assert all(r.recall >= op.RECALL for r in got.values())
