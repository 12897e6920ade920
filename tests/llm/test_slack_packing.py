"""Minimum bin slack against all subsets, plans against their histograms, and the pieces against the library."""

import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from clausemine.llm.slack_packing import closest, plan, slack_pack

WORD = public_tokenizers.path("word_bpe_49k.json")


def test_the_window_comes_as_close_as_any_subset():
    rng = random.Random(8)
    for _ in range(200):
        size = rng.randint(5, 60)
        pieces = [rng.randint(1, size + 5) for _ in range(rng.randint(1, 9))]
        left = Counter(pieces)
        got = closest(left, sorted(left, reverse=True), size)
        assert all(c <= left[n] for n, c in got.items())
        fits = [n for n in pieces if n <= size]
        if not fits:
            assert not got
            continue
        fits.remove(max(fits))
        longest = max(n for n in pieces if n <= size)
        best = max(longest + sum(s) for r in range(len(fits) + 1) for s in combinations(fits, r) if longest + sum(s) <= size)
        assert sum(n * c for n, c in got.items()) == best and got[longest] >= 1


def checked(histogram, size):
    """The number of sequences and of cuts of a plan, in which each token of each piece has exactly one place."""
    spots, sequences = plan(dict(histogram), size)
    filled, covered = defaultdict(list), defaultdict(list)
    for s in spots:
        for i in range(s.count):
            at, slot = divmod(s.first + i, s.copies)
            filled[s.sequence + at].append((s.offset + slot * s.n, s.n))
            covered[s.length, s.rank + i].append((s.start, s.n))
    assert len(filled) == sequences
    for parts in filled.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == size or at & (at - 1) == 0
    assert set(covered) == {(n, r) for n, c in histogram.items() for r in range(c)}
    for (n, _), parts in covered.items():
        at = 0
        for start, k in sorted(parts):
            assert start == at
            at += k
        assert at == n
    return sequences, sum(s.count for s in spots) - sum(histogram.values())


def test_plans_are_full_with_few_cuts():
    rng = random.Random(3)
    mixed = Counter(min(4096, max(1, int(rng.lognormvariate(6, 1)))) for _ in range(30_000))
    sequences, cuts = checked(mixed, 4096)
    assert sequences <= sum(n * c for n, c in mixed.items()) // 4096 + 12 and cuts < 30
    long = Counter(rng.randint(2500, 4000) for _ in range(3000))  # no two fit together
    sequences, _ = checked(long, 4096)
    assert sequences <= sum(n * c for n, c in long.items()) // 4096 + 12
    for histogram, size in (({}, 16), ({1: 5}, 16), ({16: 3}, 16), ({15: 7, 16: 1}, 16), ({11: 100}, 16), ({7: 3, 5: 2}, 10), ({n: 1 for n in range(1, 65)}, 64)):
        checked(Counter(histogram), size)
    for _ in range(60):
        size = rng.choice([8, 13, 64])
        checked(Counter(rng.randint(1, size) for _ in range(rng.randint(1, 200))), size)


def test_a_plan_does_not_grow_with_the_counts():
    few = Counter(random.Random(1).randint(1, 512) for _ in range(5000))
    many = {n: c * 10**9 for n, c in few.items()}
    spots, sequences = plan(many, 512)
    assert len(spots) < 6000 and sequences <= sum(n * c for n, c in many.items()) // 512 + 9


@pytest.mark.parametrize("size", [4096, 64])
def test_pieces_equal_the_library(docs, rows, size):
    library = Tokenizer.from_file(WORD)
    library.no_truncation()
    library.no_padding()
    want = Counter()
    for d, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        want[d, np.array(ids, "<u2").tobytes()] += 1
    got = slack_pack(docs, WORD, size).collect()
    digests = slack_pack(docs, WORD, size, digest=True).collect()
    filled, by_doc = defaultdict(list), defaultdict(list)
    for r in got:
        assert r.length * 2 == len(r.ids)
        filled[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for parts in filled.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == size or at & (at - 1) == 0 and at < size
    single = {d for d, c in Counter(d for d, _ in want.elements()).items() if c == 1}
    for d, ids in want:
        if d in single:
            mine = sorted(by_doc[d], key=lambda r: r.start)
            assert b"".join(bytes(r.ids) for r in mine) == ids
            assert [r.start for r in mine] == np.cumsum([0, *(r.length for r in mine)])[:-1].tolist()
            assert {r.doc_tokens for r in mine} == {len(ids) // 2}
    assert sum(r.length for r in got) == sum(len(ids) // 2 * c for (_, ids), c in want.items())
    # which of several equally long pieces is cut may differ from run to run; the pieces of documents left whole may not
    whole = Counter((r.doc_id, r.start, r.length, zlib.crc32(np.frombuffer(r.ids, "<u2").astype("<u4").tobytes())) for r in got if r.length == r.doc_tokens)
    again = Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in digests if r.length == r.doc_tokens)
    assert sum((whole & again).values()) >= 0.9 * sum(whole.values())


def test_packing_of_no_documents(frame):
    assert slack_pack(frame([]), WORD).count() == 0
    with pytest.raises(ValueError, match="size"):
        slack_pack(frame([]), WORD, size=1 << 14)
