"""Personal data and secrets against plain regular expressions."""

import hashlib
import itertools
import random
import re
import time
from collections import Counter

from clausemine.llm.pii import luhn, personal_data, redact
from clausemine.llm.secrets import codes, secret_scan, window_entropy
from clausemine.llm.spans import let, overlaps, running
from pyspark.sql import functions as F

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def check_digit(d):
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 * (int(c) > 4)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_pii(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [("email", m) for m in re.finditer(EMAIL, text)]
    out += [("ip", m) for m in re.finditer(IP, text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", m) for m in re.finditer(CARD, text) if 13 <= len(digits(m)) <= 19 and check_digit(digits(m))]
    out += [("phone", m) for m in re.finditer(PHONE, text) if 9 <= len(digits(m)) <= 15]
    return [(k, m.start(), m.end()) for k, m in out]


def base_secrets(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text, re.I | re.A) if len(m.group(2)) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return [(("assign", "access", "hex")[k], s, e) for s, k, e in sorted(out)]


def joined(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def noisy(seed, n=300):
    rng = random.Random(seed)
    parts = ["a@b.c", "x.y@z-w.co.uk", "@", ".", "..", "1", "42", "256", "255.1", "10.0.0.1", ".5", " ", "-", "+", "+1", "(555)", "4111111111111111", "5500 0000 0000 0004", "é", "東", "_", "%", "token", "Secret", "=", ": ", '"', "abcdef123456", "deadbeefdeadbeefdeadbeef", "AKIA", "ABCDEFGHIJ1234567890", "api_key", "\n", "😀", "name [at] host [dot] com", "555-123-4567"]
    return [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(25)))) for i in range(n)]


def test_personal_data_holds_all_base_spans(docs, rows, frame):
    pairs = rows + noisy(1)
    out = personal_data(frame(pairs)).collect()
    want = Counter((d, *(sum(k == kind for k, _, _ in b) for kind in ("email", "ip", "card", "phone")), hashlib.sha256(joined(b).encode()).hexdigest()) for d, t in pairs for b in [base_pii(t or "")])
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in out) == want


def test_classifier_adds_written_out_forms(frame):
    plain = [(i, f"contact user{i}@example.com or call +1 555 123 45{i:02d} or mail 10.1.2.{i}") for i in range(40)]
    loose = [(100, "please call 555-123-4567 today"), (101, "write to jane [at] example [dot] com soon"), (102, "order 555-123-4567")]
    out = {r.doc_id: r for r in personal_data(frame(plain + loose)).collect()}
    assert out[100].spans == "phone:12:24" and out[101].spans == "email:9:36"
    assert all(out[i].n_added == 0 for i in range(40))


def test_redact_removes_spans_and_keeps_rows(frame):
    pairs = [(1, "write to me@example.com or +1 555 123 4567 now"), (2, None), (3, ""), (4, "nothing here"), (4, "nothing here"), (None, "10.1.1.1")]
    out = redact(frame(pairs))
    assert out.columns == frame(pairs).columns
    got = Counter((r.doc_id, r.text, r.n_chars) for r in out.collect())
    clean = ["write to <EMAIL> or <PHONE> now", None, "", "nothing here", "nothing here", "<IP>"]
    assert got == Counter((d, t, None if t is None else len(t)) for (d, _), t in zip(pairs, clean, strict=True))


def test_scans_of_an_empty_table(frame):
    assert personal_data(frame([])).count() == 0
    assert secret_scan(frame([])).count() == 0
    assert redact(frame([])).count() == 0


def test_secrets_hold_all_base_spans(rows, frame):
    pairs = rows + noisy(2)
    out = secret_scan(frame(pairs)).collect()
    want = Counter((d, *(sum(k == kind for k, _, _ in b) for kind in ("assign", "access", "hex")), hashlib.sha256(joined(b).encode()).hexdigest()) for d, t in pairs for b in [base_secrets(t or "")])
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in out) == want


def test_entropy_finds_random_strings_and_spares_the_allow_list(frame):
    random_one = "Zq8rT2xLw9Vb4NcY7mKp3sHd"
    out = {r.doc_id: r for r in secret_scan(frame([(1, f"key {random_one} end"), (2, "id 123e4567-e89b-12d3-a456-426614174000 end"), (3, f"sha256: {random_one}"), (4, "a1a1a1a1a1a1a1a1a1a1a1a1a1"), (5, "path/to/some/very/long/name1/x")])).collect()}
    assert out[1].spans == f"entropy:4:{4 + len(random_one)}" and out[1].n_entropy == 1
    assert [out[i].n_entropy for i in (2, 3, 4, 5)] == [0, 0, 0, 0]


def test_allow_list_excuses_no_more_than_its_form(frame):
    token = "Zq8rT2xLw9Vb4NcY7mKp3sHd"
    secret = [f"https://hooks.example.com/services/T01ABCDEF/B01ABCDEF/{token}", "ab" * 5 + token, f"a/b/{token.lower()}/list", "one/" * 3000 + token]
    plain = ["ab" * 5 + "cd1" * 9, "a1/" * 4000, "ab_" * 8000 + "x1", "ab_1" * 1000, "docs/top-10-places-to-visit-2019/index", "v1/users/123e4567-e89b-12d3-a456-426614174000/posts"]
    got = {r.doc_id: r.n_entropy for r in secret_scan(frame(list(enumerate(secret + plain)))).collect()}
    assert [got[i] for i in range(len(got))] == [1] * len(secret) + [0] * len(plain)


def test_window_entropy_is_the_highest_of_all_windows(spark):
    import math

    def entropy(s):
        return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values())

    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefXYZ+/0123-_=") for _ in range(rng.choice([5, 20, 33]))) for _ in range(20)]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", let(codes(F.col("w")), lambda c: window_entropy(c)).alias("h")).collect()
    for r in got:
        assert abs(r.h - max(entropy(r.w[i : i + 20]) for i in range(max(1, len(r.w) - 19)))) < 1e-9


def test_luhn(spark):
    cards = ["4111111111111111", "4111111111111112", "378282246310005", "0"]
    got = {r.c: r.ok for r in spark.createDataFrame([(c,) for c in cards], "c string").select("c", luhn(F.col("c")).alias("ok")).collect()}
    assert got == {c: check_digit(c) for c in cards}


def seconds(df):
    began = time.time()
    out = df.collect()
    return time.time() - began, out


def test_a_long_base64_run_costs_in_proportion(frame):
    """A megabyte, one candidate: what it costs above a short text is near the cost of ten times a tenth."""
    rng = random.Random(5)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    run = lambda n: "".join(rng.choice(letters) for _ in range(n))
    none, _ = min(seconds(secret_scan(frame([(1, run(100))]))) for _ in range(2))
    tenth, _ = seconds(secret_scan(frame([(1, run(100_000))])))
    whole, out = seconds(secret_scan(frame([(1, run(1_000_000))])))
    assert (out[0].spans, out[0].n_entropy) == ("entropy:0:1000000", 1)
    assert whole - none < 20 * max(tenth - none, 1.0)


def test_a_text_of_very_many_spans_costs_in_proportion(frame):
    text = lambda n: " ".join(f"10.{i % 250}.{i % 199}.{i % 251}" for i in range(n))
    none, _ = min(seconds(personal_data(frame([(1, text(10))]))) for _ in range(2))
    tenth, _ = seconds(personal_data(frame([(1, text(10_000))])))
    whole, out = seconds(personal_data(frame([(1, text(100_000))])))
    assert out[0].n_ip == 100_000 and out[0].base_sha256 == hashlib.sha256(joined(base_pii(text(100_000))).encode()).hexdigest()
    assert whole - none < 20 * max(tenth - none, 1.0)
    assert redact(frame([(1, text(100_000))])).collect()[0].text == " ".join(["<IP>"] * 100_000)


def test_running_sums_and_maxima(spark):
    rng = random.Random(6)
    rows = [[rng.randrange(50) for _ in range(n)] for n in (0, 1, 127, 128, 129, 256, 5000)]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, v array<int>").select("i", running(F.col("v"), lambda a, b: a + b).alias("s"), running(F.col("v"), F.greatest).alias("m")).collect()
    for r in got:
        assert r.s == list(itertools.accumulate(rows[r.i])) and r.m == list(itertools.accumulate(rows[r.i], max))


def test_overlaps_by_binary_search(spark):
    rng = random.Random(7)
    rows = []
    for _ in range(60):
        at, spans = 0, []
        for _ in range(rng.randrange(12)):
            at += rng.randrange(4)
            spans.append((at, at := at + rng.randrange(1, 4)))
        a = rng.randrange(40)
        rows.append((spans, (a, a + rng.randrange(1, 6))))
    for r in spark.createDataFrame(rows, "spans array<struct<start:int,end:int>>, s struct<start:int,end:int>").select("*", overlaps(F.col("spans"), F.col("s")).alias("hit")).collect():
        assert r.hit == any(x < r.s.end and r.s.start < y for x, y in r.spans)


def test_a_match_that_fails_its_check_is_voted_against(frame):
    """The regex votes no on it, so no other labeler alone makes it personal data; base spans are never touched."""
    good = [(i, f"visa 4111 1111 1111 1111 paid, call +1 555 123 45{i:02d}") for i in range(40)]
    bad = [(100 + i, f"order no 4111 1111 1111 11{i:02d} shipped") for i in range(12, 40)]
    out = {r.doc_id: r for r in personal_data(frame(good + bad)).collect()}
    assert all(out[i].n_card == 1 for i in range(40))
    assert all(out[i].n_added == 0 for i in range(112, 140))


def test_redaction_against_plain_python(frame):
    """Spans as the scan gives them, cut out of each text by Python."""
    pairs = [(i, t) for i, (_, t) in enumerate(noisy(8))] + [(1000, "x" * 3000 + " me@example.com " + "é😀" * 900 + " 10.0.0.1"), (1001, None)]
    spans = {r.doc_id: r.spans for r in personal_data(frame(pairs)).collect()}
    kinds = ("email", "ip", "card", "phone")
    for r in redact(frame(pairs)).collect():
        text, out, at = dict(pairs)[r.doc_id], [], 0
        found = sorted((int(a), int(b), kinds.index(k)) for k, a, b in (s.split(":") for s in filter(None, spans[r.doc_id].split(","))))
        for a, b, k in found:
            if a >= at:
                out += [text[at:a], f"<{kinds[k].upper()}>"]
            at = max(at, b)
        assert r.text == (None if text is None else "".join(out) + text[at:])
