"""The classifiers' held-out accuracy and defined results, and the corpus pipeline against brute force stage by stage."""

import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from clausemine.llm.packing import SIZE
from clausemine.llm.pii import redact
from clausemine.llm.quality import quality, shape
from clausemine.llm.toxicity import ACCEPT, toxicity, training_rows
from test_dedup import classes, exact_brute, simhash_brute

DATA = "/root/testdata/sf0.001"
BYTE = public_tokenizers.path("byte_bpe_50k.json")
CLEAN, FOUL = "river stone lamp window garden paper letter morning".split(), "grobnak snurfel vexwit".split()


def judged(rng, n):
    """(doc_id, text, toxic): toxic texts hold foul words in many contexts."""
    out = []
    for i in range(n):
        words = [rng.choice(CLEAN) + rng.choice(["", "s", "ly"]) for _ in range(rng.randint(8, 40))]
        if toxic := i % 4 == 0:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(FOUL))
        out.append((i, " ".join(words), int(toxic)))
    return out


@pytest.fixture(scope="module")
def known():
    return judged(random.Random(17), 400)


@pytest.fixture(scope="module")
def labels(spark, known):
    named = [(d, y, y, "x") for d, _, y in known] + [(0, 1, 1, "again"), (1, None, None, "x"), (None, 1, 1, "x")]
    return spark.createDataFrame(named, "doc_id long, quality int, toxic int, text string")


def test_toxicity_on_held_out_rows(frame, labels, known):
    got = {r.doc_id: r for r in toxicity(frame([(d, t) for d, t, _ in known]), labels).collect()}
    assert len(got) == len(known)
    for d, _, y in known:
        assert got[d].held_out == (zlib.crc32(str(d).encode()) % 3 == 1)
        assert got[d].predicted == (got[d].score >= ACCEPT) and 0 <= got[d].score <= 1
    outside = [(got[d].predicted, y) for d, _, y in known if got[d].held_out]
    assert sum(p == y for p, y in outside) >= 0.98 * len(outside)


def test_toxicity_scores_every_row(docs, rows, labels):
    got = toxicity(docs, labels).collect()
    assert Counter((r.doc_id) for r in got) == Counter(d for d, _ in rows)
    assert all(0 <= r.score <= 1 for r in got)


def test_classifiers_without_labels_or_rows(frame, labels, known):
    docs, none = frame([(d, t) for d, t, _ in known[:20]]), labels.limit(0)
    assert {r.score for r in toxicity(docs, none).collect()} == {0.0}
    assert toxicity(frame([]), labels).count() == 0
    host, path = F.col("source"), F.col("lang")
    assert {r.evidence for r in quality(docs, none, host, path).collect()} == {0.5}
    assert quality(frame([]), labels, host, path).count() == 0


def test_quality_on_held_out_rows(spark):
    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")
    docs, named = read("documents"), {r.doc_id: r.quality for r in read("labels").collect()}
    got = quality(docs, read("labels"), F.col("source"), F.concat_ws("/", "source", "lang")).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in docs.select("doc_id").collect())
    outside = [(r.predicted, named[r.doc_id]) for r in got if r.held_out and named.get(r.doc_id) is not None]
    share = max(Counter(y for _, y in outside).values()) / len(outside)
    assert sum(p == y for p, y in outside) / len(outside) > share


def test_share_of_repeated_words_sees_every_word():
    """A text whose period divides a stride, and repeats that stand between chosen places, at any length."""
    index = 7
    varied = [f"w{i}" for i in range(20_000)]
    assert shape(" ".join(varied))[index] == 0
    lines = [w for i in range(2000) for w in (f"a{i}", "same", *(f"b{i}.{j}" for j in range(8)))]
    by_length = [shape(" ".join(lines[:n]))[index] for n in (400, 2000, 20_000)]
    assert by_length == pytest.approx([39 / 400] * 3)
    assert shape(" ".join(lines[1:]))[index] == pytest.approx(39 / 400, abs=1e-4)
    between = list(varied)
    between[1::50] = ["same"] * 400
    assert shape(" ".join(between))[index] == pytest.approx(7 / 400)


def test_training_rows_are_bounded_though_a_labelled_id_repeats(frame, labels, known):
    hot = next(d for d, _, _ in known if d > 1 and zlib.crc32(str(d).encode()) % 3 != 1)
    ids = {d for d, _, _ in known if zlib.crc32(str(d).encode()) % 3 != 1}
    docs = frame([(d, t) for d, t, _ in known] + [(hot, f"other text {i % 500}") for i in range(1500)])
    got = as_pairs(training_rows(docs, labels, "toxic", 300))
    assert len(got) == 300 and {d for d, _ in got} == ids if len(ids) <= 300 else len(got) == 300 == len({d for d, _ in got})
    every = as_pairs(training_rows(docs, labels, "toxic", 5000))
    assert len(every) == len(set(every)) == len(ids) + 500


def test_quality_of_odd_rows(docs, rows, labels):
    got = quality(docs, labels, F.lit(None), F.when(F.col("doc_id") % 2 == 0, F.col("lang"))).collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in rows)
    assert all(0 <= r.score <= 1 and 0 <= r.path_rate <= 1 for r in got)


def as_pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_exact_and_near_stage(spark, docs, rows):
    first = corpus_pipeline.exact_stage(spark, docs, DATA)
    assert first.columns == docs.columns
    kept = as_pairs(first)
    want = {d for d, _, _, stays, _ in exact_brute(rows) if stays}
    assert Counter(d for d, _ in kept) == Counter(want)
    near = corpus_pipeline.near_stage(spark, first, DATA)
    assert near.columns == docs.columns
    by_print = {d: simhash_brute(t or "") for d, t in kept}
    prints = sorted(set(by_print.values()))
    linked = [(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if (a ^ b).bit_count() <= 4]
    group = classes(prints, linked)
    least = {}
    for d, p in sorted(by_print.items(), key=lambda r: (r[0] is None, r[0] or 0)):
        least.setdefault(min(group[p]), d)
    assert Counter(d for d, _ in as_pairs(near)) == Counter(least.values())


def test_dedup_stages_keep_texts_of_null_and_repeated_ids(spark, frame):
    """One row per distinct text stays, with the doc_id that stands on it, though the ids are null or repeated."""
    rng = random.Random(23)
    a, b, c, d, e = (" ".join(f"{rng.randrange(10**9)}" for _ in range(30)) for _ in range(5))
    pairs = [(None, a), (None, b), (None, b), (5, c), (5, d), (4, d), (6, e), (6, e), (6, c + " ")]
    want = Counter([(None, a), (None, b), (4, d), (6, e), (6, c + " ")])
    docs = frame(pairs)
    first = corpus_pipeline.exact_stage(spark, docs, DATA)
    assert first.columns == docs.columns
    assert Counter(as_pairs(first)) == want
    near = corpus_pipeline.near_stage(spark, docs, DATA)
    assert near.columns == docs.columns
    assert Counter(as_pairs(near)) == Counter([(None, a), (None, b), (5, c), (4, d), (6, e)])


def test_pii_stage_redacts_and_keeps_rows(spark, docs, rows):
    out = corpus_pipeline.pii_stage(spark, docs, DATA)
    assert out.columns == docs.columns
    assert Counter(as_pairs(out)) == Counter(as_pairs(redact(docs)))
    got = as_pairs(out)
    assert Counter(d for d, _ in got) == Counter(d for d, _ in rows)
    assert sum(t is None for _, t in got) == sum(t is None for _, t in rows)
    assert not any(re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t or "") for _, t in got)


def test_whole_pipeline(spark):
    """What is packed are the pieces of the last stage's texts, and every stage keeps what it should."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, DATA).cache()
        assert docs.columns == before.columns
        if name == "toxicity":
            kept, clean = {d for d, _ in as_pairs(docs)}, {d for d, y in toxic.items() if y == 0}
            assert len(clean & kept) >= 0.98 * len(clean)  # it learns from six toxic documents here
    t = Tokenizer.from_file(BYTE)
    lengths = {d: len(t.encode(x or "", add_special_tokens=False).ids) + 1 for d, x in as_pairs(docs)}
    got = corpus_pipeline.run(spark, DATA).collect()
    by_doc, by_sequence = Counter(), Counter()
    for r in got:
        by_doc[r.doc_id] += r.length
        by_sequence[r.sequence_id] += r.length
    assert dict(by_doc) == lengths
    assert max(by_sequence.values()) <= SIZE


def test_empty_pipeline_stages(spark, frame):
    docs = frame([])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        assert docs.count() == 0
