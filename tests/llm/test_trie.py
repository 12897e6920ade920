"""The conversation trie against plain dictionaries, and its bitvectors against trees made by hand."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from clausemine.llm.prefix_trie import OP11_SQL, Louds, conversation_trie, level_order, op11_prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, key string, bytes int, top string, n_convs int, slice int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def frame_of(spark, rows):
    """A ``conversations`` table with extra columns whose names the operator uses inside."""
    return spark.createDataFrame([(*r, 1, "x", 2, "y", 3, 4) for r in rows], SCHEMA).repartition(4)


def expected(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        whole = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].add(c)
        ends[whole].append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
    return Counter(
        (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest())
        for k, m in members.items()
    )


def got(df):
    return Counter(tuple(r) for r in df.select(*COLUMNS).collect())


def awkward():
    rng = random.Random(5)
    rows = []
    for c in [*range(60), -3, -5, 10**15]:
        for t in range(rng.choice([1, 2, 5, 9, 14])):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["hi", "über", "", None, f"x{c}"])))
    rows += [(100 + i, t, "user", f"same {t}") for i in range(80) for t in range(6)]  # equal conversations
    rows += [(300, t, "user", f"long {t}") for t in range(400)] + [(305, t, "user", f"long {t}") for t in range(300)]
    rows += [(310, None, "system", "first"), (310, 3, "user", "a"), (310, 3, "user", "a"), (310, 3, None, None), (None, 0, "user", "nobody's"), (None, None, None, None)]
    rows += [(320, 0, "ab", "c"), (321, 0, "a", "bc"), (402, 0, "user", "few turns, no base")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard_rows", [None, 40])
def test_trie_equals_plain_dictionaries(spark, shard_rows):
    rows = awkward()
    nodes, shards = conversation_trie(frame_of(spark, rows), shard_rows=shard_rows)
    assert got(nodes) == expected(rows)
    kept = shards.collect()
    assert sum(r.shard == -1 for r in kept) == 1 and (shard_rows is None or len(kept) > 5)
    for r in kept:
        assert r.n == len(r.nodes) and r.labels == b"".join(n.key for n in r.nodes)
        degrees = np.array([0] * (r.n + 1))
        place = {(n.depth, bytes(n.key)): i + 1 for i, n in enumerate(r.nodes)}
        for n in r.nodes:
            degrees[place.get((n.depth - 1, bytes(n.parent) if n.parent else None), 0)] += 1
        assert Louds(degrees, [bytes(n.key) for n in r.nodes]).bits.tobytes() == r.louds


def test_trie_of_no_and_of_one_conversation(spark):
    assert conversation_trie(frame_of(spark, []))[0].count() == 0
    assert conversation_trie(frame_of(spark, [(None, 1, "user", "x")]))[0].count() == 0
    one = [(7, 0, "user", "x")]
    assert got(conversation_trie(frame_of(spark, one))[0]) == expected(one)


def test_trie_of_the_supplied_table_equals_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.001/conversations.parquet'")
    assert got(op11_prefix_trie(spark, "/root/testdata/sf0.001")) == Counter(con.sql(OP11_SQL).project(", ".join(COLUMNS)).fetchall())


def test_sql_equals_plain_dictionaries():
    rows = awkward()
    con = duckdb.connect()
    columns = zip(*rows, strict=True)
    con.register("conversations", pa.table({n: pa.array(c, t) for n, c, t in zip(("conv_id", "turn", "role", "text"), columns, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)}))
    ties = {c for c in (310,)}  # SQL orders equal turns by text, the operator by a digest
    mine = [r for r in rows if r[0] not in ties]
    con.register("conversations", con.sql(f"SELECT * FROM conversations WHERE conv_id NOT IN ({', '.join(map(str, ties))}) OR conv_id IS NULL").to_arrow_table())
    assert Counter(con.sql(OP11_SQL).project(", ".join(COLUMNS)).fetchall()) == expected(mine)


def test_level_order_and_louds():
    #      0        1 (a second top)
    #    2   3      4
    #    5
    above = np.array([-1, -1, 0, 0, 1, 2])
    assert level_order(above).tolist() == [0, 1, 2, 3, 4, 5]
    louds = Louds(np.array([2, 2, 1, 1, 0, 0, 0]), [b"%d" % i for i in range(6)])
    assert "".join(map(str, louds.unpacked())) == "110" + "110" + "10" + "10" + "0" + "0" + "0"
    assert louds.parents().tolist() == [0, 0, 1, 1, 2, 3]
    assert louds.levels() == [(1, 3), (3, 6), (6, 7)]
    (sums,) = louds.rolled_up(np.array([1, 10, 100, 1000, 10000, 100000]))
    assert sums.tolist() == [101101, 10010, 100100, 1000, 10000, 100000]


def test_random_louds_keep_their_tree():
    rng = random.Random(2)
    for n in (1, 2, 50, 400):
        above = np.array([rng.randrange(-1, i) if i else -1 for i in range(n)])
        order = level_order(above)
        place = np.empty(n + 1, int)
        place[order], place[-1] = np.arange(1, n + 1), 0
        louds = Louds(np.bincount(place[above], minlength=n + 1), [b""] * n)
        assert louds.parents().tolist() == place[above[order]].tolist()
        spans = louds.levels()
        assert spans[0][0] == 1 and spans[-1][1] == n + 1 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
        own = np.array([rng.randrange(9) for _ in range(n)])
        want = own.copy()
        for i in range(n - 1, -1, -1):
            if above[i] >= 0:
                want[above[i]] += want[i]
        assert louds.rolled_up(own[order])[0].tolist() == want[order].tolist()
