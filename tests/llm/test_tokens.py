"""Token files, chunk BPE and packing against the tokenizers library itself."""

import hashlib
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from clausemine.llm.chunk_bpe import chunk_encoder, cut_points, decode_documents, encode_documents, round_trip_digests
from clausemine.llm.packing import pack, relax, solve
from clausemine.llm.token_files import EliasFano, bases, read_token_files, write_token_files
from clausemine.llm.tokens import WordEncoder

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LETTERS = "abAB z0'.,-\n\t\r    ́ß東😀İΣ<|endoftext|>é"


@pytest.fixture(scope="module")
def library():
    found = {p: Tokenizer.from_file(p) for p in (BYTE, WORD)}
    for t in found.values():
        t.no_truncation()
        t.no_padding()
    return found


def ids_of(t, text):
    return t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_word_encoder_equals_the_library(library, path):
    enc = WordEncoder(path, known=50)

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.one_of(st.text(alphabet=LETTERS, max_size=40), st.text(max_size=30)), max_size=8))
    def check(batch):
        batch = [t.encode("utf-8", "ignore").decode() for t in batch]
        got = [np.frombuffer(b, enc.dtype).tolist() for b in enc.encode(batch)]
        assert got == [ids_of(library[path], t) for t in batch]

    check()


@pytest.mark.parametrize("few", [0, 2000])
@pytest.mark.parametrize(("path", "words"), [(WORD, {"word"}), (BYTE, {" word", " Word", " WORD", "word"})])
def test_a_word_is_learnt_once_whatever_stands_around_it(library, path, words, few, monkeypatch):
    """Punctuation, lines and, for vocabularies that lower it, case make no new words to learn."""
    monkeypatch.setattr("clausemine.llm.tokens.FEW", few)
    enc = WordEncoder(path)
    probes = set(enc.young)
    text = "word Word WORD word, word. (word) Word!? WORD;\nword\nword: word"
    assert np.frombuffer(enc.encode([text])[0], enc.dtype).tolist() == ids_of(library[path], text)
    assert set(enc.young) - probes == (words | {"(word)"}) - probes


@pytest.mark.parametrize("few", [0, 2000])
@pytest.mark.parametrize("path", [BYTE, WORD])
def test_letters_of_any_case_and_memory(library, path, few, monkeypatch):
    """All Latin letters in words after a space, a line and nothing, with a memory of two words and of many, for few pieces and for many."""
    monkeypatch.setattr("clausemine.llm.tokens.FEW", few)
    letters = "".join(map(chr, [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x250)]))
    text = " ".join(f"{a}{b}{c}" for a, b, c in zip(letters, letters[7:], ["", ",", "\n" + letters[40], ".)"] * 200, strict=False))
    for known in (2, 1000):
        enc = WordEncoder(path, known=known)
        for _ in range(2):
            assert [np.frombuffer(b, enc.dtype).tolist() for b in enc.encode([text, text[::-1]])] == [ids_of(library[path], t) for t in (text, text[::-1])]


def test_chunks_equal_the_library(library):
    rng, enc = random.Random(9), chunk_encoder(BYTE)
    words = ["".join(rng.choice("abcdefghij'é東.,0") for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    passage = " ".join(rng.choice(words) for _ in range(900))
    texts = []
    for _ in range(60):
        parts = ["".join(rng.choice(words) + rng.choice([" ", " ", " ", "\n", "  ", "\n\n\n"]) for _ in range(rng.randrange(600))), passage[rng.randrange(300) :]]
        texts.append("".join(rng.sample(parts, 2)))
    texts += ["x" * 30_000, "a b" * 20_000, "é" * 9_000, " " * 20_000, passage, "", "\n"]
    for text, ids in zip(texts, enc.encode(texts), strict=True):
        assert ids.tolist() == ids_of(library[BYTE], text)
        assert enc.decode(ids) == library[BYTE].decode(ids.tolist(), skip_special_tokens=False)


def test_chunks_are_cut_alike_wherever_they_stand():
    rng = random.Random(10)
    passage = bytes(rng.randrange(97, 123) for _ in range(20_000))
    parts = lambda d: {d[a:b] for a, b in zip([0, *cut_points(d)], cut_points(d), strict=False)}
    assert len(parts(b"x" * 777 + passage) & parts(passage)) >= 5


def test_bpe_round_trip_on_spark(docs, rows, library):
    t = library[BYTE]
    want = Counter()
    for d, text in rows:
        ids = ids_of(t, text)
        want[d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(map(tuple, round_trip_digests(docs, BYTE).collect())) == want
    back = decode_documents(encode_documents(docs, BYTE), BYTE).collect()
    assert Counter(map(tuple, back)) == Counter((d, text or "") for d, text in rows)


def test_token_files_round_trip(docs, rows, library, spark, tmp_path):
    for width, block in ((2, 1 << 20), (4, 500)):
        target = f"file://{tmp_path}/{width}"
        write_token_files(docs, WORD, 2, target, width, block, shard_bytes=100_000)
        got = read_token_files(spark, target, width, digest=True).collect()
        raw = Counter((r.doc_id, r.start, zlib.crc32(np.frombuffer(r.ids, f"<u{width}").astype("<u4").tobytes())) for r in read_token_files(spark, target, width).collect())
        assert raw == Counter((r.doc_id, r.start, r.ids_crc32) for r in got)
        want = Counter()
        for d, text in rows:
            ids = [*ids_of(library[WORD], text), 2]
            want[d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
        assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
        at = 0
        for r in sorted(got, key=lambda r: r.start):
            assert r.start == at
            at += r.n_tokens
        order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
        assert order == sorted(order, key=lambda d: -1 if d is None else d)


def test_token_files_of_an_empty_table(frame, spark, tmp_path):
    write_token_files(frame([]), WORD, 2, f"file://{tmp_path}/none")
    assert read_token_files(spark, f"file://{tmp_path}/none").count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5000), min_size=1, max_size=300))
def test_elias_fano(steps):
    values = np.cumsum(steps)
    ef = EliasFano.encode(values)
    assert [ef.select(i) for i in range(len(values))] == values.tolist()


def test_elias_fano_of_far_values():
    values = [0, 0, 5, 1 << 40, (1 << 63) + 7, (1 << 64) - 1]
    ef = EliasFano.encode(np.array(values, np.uint64))
    assert [ef.select(i) for i in range(len(values))] == values


def test_reading_takes_offsets_from_select(spark, frame, tmp_path, monkeypatch):
    """A file whose select samples are damaged does not give the right offsets: there is no other way to them."""
    from pyspark.sql import functions as F

    target = f"file://{tmp_path}/t"
    write_token_files(frame([(i, "some words of text " * i) for i in range(300)]), WORD, 2, target)
    right = {tuple(r) for r in read_token_files(spark, target).select("doc_id", "start").collect()}
    blocks = spark.read.parquet(target).withColumn("selects", F.expr("cast(reverse(array_join(transform(sequence(1, octet_length(selects)), i -> chr(1)), '')) as binary)"))
    blocks.write.parquet(target + "-bad")
    with pytest.raises(Exception):  # noqa: B017, PT011
        wrong = {tuple(r) for r in read_token_files(spark, target + "-bad").select("doc_id", "start").collect()}
        assert wrong == right


def test_hot_and_extreme_doc_ids(spark, frame, library, tmp_path):
    rows = [(-(1 << 63), "low"), ((1 << 63) - 1, "high")] + [(None, f"text {i}") for i in range(400)] + [(7, "same")] * 400
    write_token_files(frame(rows), WORD, 2, f"file://{tmp_path}/x", shard_bytes=500)
    got = sorted(read_token_files(spark, f"file://{tmp_path}/x", digest=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None] * 400 + [-(1 << 63)] + [7] * 400 + [(1 << 63) - 1]
    want = Counter((d, zlib.crc32(np.array([*ids_of(library[WORD], t), 2], "<u4").tobytes())) for d, t in rows)
    assert Counter((r.doc_id, r.ids_crc32) for r in got) == want


def packed(got, rows, t, size, end):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= size
    want = defaultdict(list)
    for d, text in rows:
        ids = [*ids_of(t, text), end]
        n = len(ids)
        first = n if n <= size else n % size or size
        cuts = [0, *range(first, n + 1, size)]
        want[d] += [(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert {d: sorted(p) for d, p in by_doc.items()} == {d: sorted(p) for d, p in want.items()}
    return len(by_sequence)


def test_packing_holds_every_piece_once(docs, rows, library):
    for size in (2048, 64):
        got = pack(docs, BYTE, size=size).collect()
        used = packed(got, rows, library[BYTE], size, 0)
        total = sum(r.length for r in got)
        assert used <= -(-total // size) * 1.01 + 1


def test_packing_an_empty_table(frame):
    assert pack(frame([]), BYTE).count() == 0


def placed(plan, size):
    found = Counter()
    for config, count in plan:
        assert sum(k * c for k, c in config.items()) <= size
        for k, c in config.items():
            found[k] += c * count
    return found


def test_solver_is_near_the_bound_and_places_all():
    rng = random.Random(11)
    for size, n in ((512, 20_000), (100, 500), (10, 3)):
        need = Counter(min(size, max(1, int(rng.lognormvariate(4, 1)))) for _ in range(n))
        plan, _ = solve(dict(need), size)
        assert placed(plan, size) == need
        low = max(-(-sum(k * c for k, c in need.items()) // size), sum(c for k, c in need.items() if 2 * k > size))
        assert sum(c for _, c in plan) <= low * 1.001 + 1


@pytest.mark.parametrize("times", [1, 10, 100])
def test_the_program_places_most_and_beats_best_fit(library, spark, times):
    """On the lengths of the supplied documents: within 0.1 % of the dual bound, never more sequences than best fit alone."""
    from pyspark.sql import functions as F

    need = Counter()
    for (text,) in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.coalesce("text", F.lit(""))).collect():
        n = len(ids_of(library[BYTE], text)) + 1
        need.update([2048] * ((n - 1) // 2048) + [n % 2048 or 2048])
    need = {k: c * times for k, c in need.items()}
    began = time.process_time()
    plan, solved = solve(need)
    assert time.process_time() - began < 6  # about a second alone
    assert placed(plan, 2048) == need
    weight = np.zeros(2049, np.int64)
    for k, c in need.items():
        weight[k] = c
    bound = relax(weight)[1]
    used, alone = (sum(c for _, c in p) for p in (plan, solve(need, by_program=0)[0]))
    assert bound <= used <= min(alone, -(-bound * 1.001 // 1))
    by_program = sum(c * sum(k * v for k, v in config.items()) for config, c in plan[:solved])
    assert by_program >= 0.9 * sum(k * c for k, c in need.items())


def test_lengths_that_do_not_fill_a_sequence():
    plan, _ = solve({1500: 7, 700: 3}, 2048)
    assert placed(plan, 2048) == {1500: 7, 700: 3}
    assert sum(c for _, c in plan) == 7 + 2
    assert solve({}, 2048)[0] == []


@pytest.mark.parametrize(("low", "high", "per_sequence"), [(690, 1000, 2), (1025, 1500, 1), (500, 900, None)])
def test_lengths_of_which_few_fit_together(low, high, per_sequence):
    """The bound is what must be used where lengths alone decide, and the program never loses to best fit."""
    rng = random.Random(low)
    need = Counter(rng.randint(low, high) for _ in range(4000))
    plan, _ = solve(dict(need))
    assert placed(plan, 2048) == need
    used = sum(c for _, c in plan)
    assert used <= sum(c for _, c in solve(dict(need), by_program=0)[0])
    if per_sequence:
        weight = np.zeros(2049, np.int64)
        for k, c in need.items():
            weight[k] = c
        assert relax(weight)[1] == pytest.approx(4000 / per_sequence) and used == 4000 // per_sequence


@pytest.mark.parametrize("group", [1024, 7])
def test_bases_of_many_shards_need_no_window_over_all(spark, group):
    from pyspark.sql import functions as F

    shards = spark.range(10_000).select(F.col("id").cast("int").alias("shard"), (F.col("id") % 13).alias("n"))
    found = bases(shards.repartition(5), group)
    got = {r.shard: r.base for r in found.collect()}
    at = 0
    for i in range(10_000):
        assert got[i] == at
        at += i % 13
    plan = found._jdf.queryExecution().toString()
    assert "Window" in plan and "SinglePartition" not in plan.split("== Physical Plan ==")[1].split("Window")[0]
    assert bases(shards.limit(0)).count() == 0
