"""Ropes against plain strings, and the query against SQL and against a plain version."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clausemine.llm.fill_middle import OP12_SQL, CODE_POINT, fill_in_middle, joined, leaf, op12_fill_middle, put_back, rearranged, restored, rope_of, split

DATA = "/root/testdata/sf0.001"


def sound(rope):
    """The cached counts hold and no node leans by more than one."""
    if rope.left is None:
        assert rope.chars == len(rope.text) and rope.height == bool(rope.text)
        return
    sound(rope.left)
    sound(rope.right)
    assert abs(rope.left.height - rope.right.height) <= 1
    assert (rope.units, rope.chars, rope.height) == (rope.left.units + rope.right.units, rope.left.chars + rope.right.chars, 1 + max(rope.left.height, rope.right.height))


@pytest.mark.parametrize("unit", [CODE_POINT, r"\S+\s*", r"[^\n]*\n?"])
def test_ropes_split_and_join_like_strings(unit):
    rng = random.Random(4)
    for n in (0, 1, 7, 100, 3000):
        text = "".join(rng.choice("ab ü東\n🙂é") for _ in range(n))
        starts = [m.start() for m in re.finditer(unit, text) if m.end() > m.start()]
        rope = rope_of(text, unit, most=5)
        sound(rope)
        assert str(rope) == text and rope.units == len(starts)
        for _ in range(30):
            k = rng.randint(0, len(starts))
            at = len(text) if k == len(starts) else starts[k] if k else 0
            a, b = split(rope, k)
            assert (str(a), str(b)) == (text[:at], text[at:]) and (a.units, b.units) == (k, len(starts) - k)
            c = rng.randint(0, n)
            x, y = split(rope, c, by_chars=True)
            assert (str(x), str(y)) == (text[:c], text[c:])
            again = joined(joined(b, leaf("<S>")), a)
            for r in (a, b, x, y, again):
                sound(r)
            assert str(again) == text[at:] + "<S>" + text[:at]


def test_forms_are_undone():
    rng = random.Random(6)
    for _ in range(200):
        text = "".join(rng.choice("<>PSM x") for _ in range(rng.randint(1, 60)))
        if any(s in text for s in ("<P>", "<S>", "<M>")):
            continue
        first, second = sorted(rng.randint(0, len(text)) for _ in range(2))
        for form in ("psm", "spm"):
            out, p, m = rearranged(rope_of(text, most=4), form, first, second)
            parts = text[:first], text[first:second], text[second:]
            assert (p, m) == (first, second - first)
            assert str(out) == ("<P>{0}<S>{2}<M>{1}" if form == "psm" else "<S>{2}<P>{0}<M>{1}").format(*parts)
            assert str(put_back(rope_of(str(out), most=4), form)) == text


def plain(doc_id, text):
    text = text or ""
    digits = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digits[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text, text
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}" if form == "psm" else f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return doc_id, n, form, a, b - a, out, text


COLUMNS = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]


def test_documents_equal_a_plain_version(frame, rows):
    rows = [*rows, (500, "holds <M> itself"), (501, "<P"), (502, "é́🙂" * 5000)]
    got = restored(fill_in_middle(frame(rows))).select(*COLUMNS, "output", "text").collect()
    assert Counter(map(tuple, got)) == Counter(plain(*r) for r in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle(frame([])).count() == 0


def test_words_as_units(frame):
    rows = [(i, "one two  three\nfour five") for i in range(40)]
    got = restored(fill_in_middle(frame(rows), unit=r"\S+\s*", plain_percent=0)).collect()
    assert all(r.n == 5 and r.text == rows[0][1] and r.form != "plain" for r in got)
    assert {r.prefix_chars for r in got} <= {0, 4, 9, 15, 20, 24}


def test_query_and_sql(spark, frame, rows):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    columns = [*COLUMNS, "output_sha256", "restored_sha256"]
    want = Counter(con.sql(OP12_SQL).project(", ".join(columns)).fetchall())
    assert Counter(map(tuple, op12_fill_middle(spark, DATA).select(*columns).collect())) == want
    ids, texts = zip(*rows, strict=True)
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string())}))
    made = restored(fill_in_middle(frame(rows))).select(*COLUMNS, F.sha2("output", 256), F.sha2("text", 256)).collect()
    assert Counter(con.sql(OP12_SQL).project(", ".join(columns)).fetchall()) == Counter(map(tuple, made))
