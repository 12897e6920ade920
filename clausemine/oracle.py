"""The SQL that DuckDB runs over the same tables, for each query that SQL can express."""

from __future__ import annotations

#: Edge types as (source type, relation, destination type, SQL of the pairs).
EDGES = [
    ("customer", "in_nation", "nation", "SELECT c_custkey, c_nationkey FROM customer"),
    ("supplier", "in_nation", "nation", "SELECT s_suppkey, s_nationkey FROM supplier"),
    ("nation", "rev_in_nation", "supplier", "SELECT s_nationkey, s_suppkey FROM supplier"),
    ("nation", "rev_in_nation", "customer", "SELECT c_nationkey, c_custkey FROM customer"),
    ("nation", "in_region", "region", "SELECT n_nationkey, n_regionkey FROM nation"),
    ("customer", "bought", "part", "SELECT o_custkey, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey"),
    ("part", "supplied_by", "supplier", "SELECT l_partkey, l_suppkey FROM lineitem"),
    ("customer", "bought_from", "supplier", "SELECT o_custkey, l_suppkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey"),
]
NODES = [("customer", "c_custkey"), ("supplier", "s_suppkey"), ("nation", "n_nationkey"), ("region", "r_regionkey"), ("part", "p_partkey")]

GRAPH = (
    "WITH nodes AS MATERIALIZED (\n"
    + "\nUNION ALL ".join(f"SELECT '{t}' AS node_type, {key}::BIGINT AS id FROM {t}" for t, key in NODES)
    + "),\nedges AS MATERIALIZED (\n"
    + "\nUNION ALL ".join(f"SELECT '{s}' AS src_type, '{r}' AS relation, '{d}' AS dst_type, e.a::BIGINT AS src, e.b::BIGINT AS dst, {i}::BIGINT AS ordinal FROM ({sql}) e(a, b)" for i, (s, r, d, sql) in enumerate(EDGES))
    + "),\nset_edges AS (SELECT DISTINCT src_type, relation, dst_type, src, dst FROM edges),\n"
    + "types AS (SELECT src_type, relation, dst_type, ordinal, count(*) AS edge_count FROM edges GROUP BY ALL)"
)
NATION, PART = (("customer", "in_nation", "nation"), ("nation", "rev_in_nation", "supplier")), (("customer", "bought", "part"), ("part", "supplied_by", "supplier"))
PEERS = (("customer", "in_nation", "nation"), ("nation", "rev_in_nation", "customer"), ("customer", "bought_from", "supplier"))
BOUGHT_FROM = ("customer", "bought_from", "supplier")


def of_type(edge_type, source: str = "edges") -> str:
    return f"(SELECT src, dst FROM {source} WHERE (src_type, relation, dst_type) = {tuple(edge_type)})"


def reach(chain, source: str = "edges") -> str:
    joins = " ".join(f"{'FROM' if i == 0 else 'JOIN'} {of_type(t, source)} e{i}" + (f" ON e{i - 1}.dst = e{i}.src" if i else "") for i, t in enumerate(chain))
    return f"(SELECT DISTINCT e0.src, e{len(chain) - 1}.dst {joins})"


def flagged(chain, source: str = "edges") -> str:
    return f"(SELECT r.src, r.dst, (k.src IS NOT NULL)::INT AS known FROM {reach(chain, source)} r LEFT JOIN (SELECT DISTINCT src, dst FROM {of_type(BOUGHT_FROM, source)}) k ON r.src = k.src AND r.dst = k.dst)"


def metrics(preds: str, hits: str, source: str = "edges") -> str:
    heads = f"(SELECT count(*) FROM {of_type(BOUGHT_FROM, source)})"
    return f"({hits})::BIGINT AS support, round(CASE WHEN {preds} > 0 THEN ({hits}) / ({preds}) ELSE 0 END, 9) AS confidence, round(({hits}) / {heads}, 9) AS head_coverage, ({preds})::BIGINT AS num_predictions"


def cyclic(chain) -> str:
    return f"SELECT {metrics('count(*)', 'coalesce(sum(known), 0)')} FROM {flagged(chain)}"


def ac1(chain, side: str, node_type: str) -> str:
    return f"""SELECT n.id AS entity_id, {metrics("coalesce(preds, 0)", "coalesce(hits, 0)")}
FROM (SELECT id FROM nodes WHERE node_type = '{node_type}') n
LEFT JOIN (SELECT {side} AS id, count(*) AS preds, sum(known) AS hits FROM {flagged(chain)} GROUP BY 1) f USING (id)"""


def ac2(bound: str, side: str, other: str) -> str:
    preds = f"(SELECT count(*) FROM {bound}) * (SELECT count(*) FROM nodes WHERE node_type = '{other}')"
    hits = f"(SELECT count(*) FROM {of_type(BOUGHT_FROM)} h WHERE h.{side} IN (SELECT id FROM {bound}))"
    return f"SELECT {metrics(preds, hits)}"


AC2_SUBJECT = ac2(f"(SELECT DISTINCT src AS id FROM {of_type(NATION[0])})", "src", "supplier")
AC2_OBJECT = ac2(f"(SELECT DISTINCT dst AS id FROM {of_type(PART[1])})", "dst", "customer")
BATCH = ",\nbatch AS (" + "\nUNION ALL ".join(f"SELECT {i}::BIGINT AS ord, * FROM ({sql})" for i, sql in enumerate((cyclic(NATION), cyclic(PART), AC2_SUBJECT, AC2_OBJECT, cyclic(PEERS)))) + ")"

#: Rules for prediction: the nation chain whole, and with each supplier as its constant, as learned from a source of edges.
LEARNED = """,
{name}_pairs AS MATERIALIZED (SELECT * FROM {flagged}),
{name}_all AS (SELECT coalesce(sum(known) / count(*), 0) AS c FROM {name}_pairs),
{name}_one AS (SELECT dst, sum(known) / count(*) AS c FROM {name}_pairs GROUP BY dst),
{name} AS (SELECT p.src AS head_id, p.dst AS tail_id, round(1 - (1 - a.c) * (1 - o.c), 9) AS score FROM {name}_pairs p JOIN {name}_one o USING (dst), {name}_all a)"""
SCORED = LEARNED.format(name="scored", flagged=flagged(NATION))
#: A held-out split: one pair in twenty is a test link and is not learned from.
SPLIT = """,
held AS (SELECT DISTINCT src, dst FROM {head} WHERE (src * 31 + dst) % 20 = 0),
train AS MATERIALIZED (SELECT e.* FROM edges e WHERE NOT (e.relation = 'bought_from' AND (e.src * 31 + e.dst) % 20 = 0)),
known AS (SELECT DISTINCT src AS head_id, dst AS tail_id FROM {train})""".format(head=of_type(BOUGHT_FROM), train=of_type(BOUGHT_FROM, "train"))
TRAINED = SPLIT + LEARNED.format(name="scored", flagged=flagged(NATION, "train"))


def ranked(side: str, filtered: bool) -> str:
    given, sought = ("head_id", "tail_id") if side == "tail" else ("tail_id", "head_id")
    rivals = "(SELECT s.* FROM scored s ANTI JOIN known k ON s.head_id = k.head_id AND s.tail_id = k.tail_id)" if filtered else "scored"
    return f"""SELECT h.head_id, h.tail_id, '{side}' AS side, 1 + count(r.score) AS rank
FROM (SELECT src AS head_id, dst AS tail_id, coalesce(s.score, 0) AS own FROM held LEFT JOIN scored s ON s.head_id = src AND s.tail_id = dst) h
LEFT JOIN {rivals} r ON r.{given} = h.{given} AND r.score > h.own AND r.{sought} <> h.{sought}
GROUP BY h.head_id, h.tail_id"""


def link_metrics(filtered: bool, scored: str | None = None) -> str:
    return f"""{scored or GRAPH + TRAINED}, ranks AS ({ranked("tail", filtered)} UNION ALL {ranked("head", filtered)})
SELECT round(avg(1.0 / rank), 9) AS mrr, k::INT AS k, round(avg((rank <= k)::INT::DOUBLE), 9) AS hits, count(*) AS num_queries
FROM ranks, (VALUES (1), (3), (10)) v(k) GROUP BY k"""


def draw(*key: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(key)})), 1, 12))::BIGINT"


def sample(n: int, seed: int, weight: str | None, where: str = "true") -> str:
    """``draw_id, head_id, ...`` as the samplers draw them; weight None draws among all edges."""
    numbered = """copied AS (SELECT *, row_number() OVER (PARTITION BY src_type, relation, dst_type, src, dst) > 1 AS again FROM edges),
numbered AS (SELECT *, row_number() OVER (PARTITION BY src_type, relation, dst_type ORDER BY again, src, dst) - 1 AS at FROM copied)"""
    spans = f"eligible AS (SELECT * FROM types WHERE {where}), draws AS (SELECT range AS draw_id FROM range(least({n}, (SELECT sum(edge_count) FROM eligible))::BIGINT))"
    if weight is None:
        placed = f"""spans AS (SELECT *, sum(edge_count) OVER (ORDER BY ordinal) AS hi, (SELECT sum(edge_count) FROM eligible) AS total FROM eligible),
placed AS (SELECT draw_id, s.*, flat - (hi - edge_count) AS at FROM (SELECT draw_id, {draw(f"'{seed}'", "'edge'", "draw_id::VARCHAR")} % (SELECT sum(edge_count) FROM eligible)::BIGINT AS flat FROM draws) d JOIN spans s ON flat >= hi - edge_count AND flat < hi)"""
    else:
        placed = f"""shares AS (SELECT *, sum({weight}) OVER (ORDER BY ordinal) / (SELECT sum({weight}) FROM eligible) AS share, ordinal = (SELECT max(ordinal) FROM eligible) AS last FROM eligible),
spans AS (SELECT *, CASE WHEN last THEN 1.0 ELSE share END AS hi FROM shares),
bounded AS (SELECT *, coalesce(lag(hi) OVER (ORDER BY ordinal), 0.0) AS lo FROM spans),
placed AS (SELECT draw_id, s.*, {draw(f"'{seed}'", "'edge'", "draw_id::VARCHAR")} % edge_count AS at FROM (SELECT draw_id, {draw(f"'{seed}'", "'type'", "draw_id::VARCHAR")} / 281474976710656.0::DOUBLE AS u FROM draws) d JOIN bounded s ON u >= lo AND u < hi)"""
    return f"""{numbered}, {spans}, {placed},
triples AS (SELECT p.draw_id, n.src AS head_id, n.dst AS tail_id, n.src_type AS head_type, n.dst_type AS tail_type, n.relation
FROM placed p JOIN numbered n ON (p.src_type, p.relation, p.dst_type) = (n.src_type, n.relation, n.dst_type) AND p.at = n.at)"""


TARGET = f"(src_type, relation, dst_type) = {BOUGHT_FROM}"


def walks(hops: int, least: int, random: str | None, attempts: int = 1, seed: int = 5) -> str:
    """CTEs up to ``paths``: all paths, or the walks of a random strategy ('uniform' or 'relation_weighted')."""
    ids = "draw_id, attempt" if random else "draw_id"
    out = [f"w0 AS (SELECT {'draw_id, a.range AS attempt' if random else 'draw_id'}, tail_id, tail_type, head_id AS cur, head_type AS cur_type, []::STRUCT(id BIGINT, t VARCHAR, rel VARCHAR)[] AS path FROM triples{f', range({attempts}) a' if random else ''})"]
    if random:
        out.insert(0, "adjacent AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY src_type, relation, dst_type, src ORDER BY dst) - 1 AS at, count(*) OVER (PARTITION BY src_type, relation, dst_type, src) AS degree FROM set_edges)")
        out.insert(1, "choices AS (SELECT *, row_number() OVER (PARTITION BY src_type ORDER BY ordinal) - 1 AS idx, count(*) OVER (PARTITION BY src_type) AS n, sum(1.0 / edge_count) OVER (PARTITION BY src_type ORDER BY ordinal) / sum(1.0 / edge_count) OVER (PARTITION BY src_type) AS share FROM types)")
        out.insert(2, "bounds AS (SELECT *, CASE WHEN idx = n - 1 THEN 1.0 ELSE share END AS hi, coalesce(lag(share) OVER (PARTITION BY src_type ORDER BY ordinal), 0.0) AS lo FROM choices)")
    for h in range(1, hops + 1):
        at = ("draw_id::VARCHAR", "attempt::VARCHAR", f"'{h}'")
        if random is None:
            moved = f"SELECT w.*, e.relation, e.dst, e.dst_type FROM w{h - 1} w JOIN set_edges e ON e.src_type = cur_type AND e.src = cur"
        else:
            pick = f"c.idx = {draw(f"'{seed}'", "'type'", *at)} % c.n" if random == "uniform" else f"{draw(f"'{seed}'", "'type'", *at)} / 281474976710656.0::DOUBLE >= c.lo AND {draw(f"'{seed}'", "'type'", *at)} / 281474976710656.0::DOUBLE < c.hi"
            moved = f"SELECT w.*, e.relation, e.dst, e.dst_type FROM w{h - 1} w JOIN bounds c ON c.src_type = cur_type AND {pick} JOIN adjacent e ON (e.src_type, e.relation, e.dst_type) = (c.src_type, c.relation, c.dst_type) AND e.src = cur AND e.at = {draw(f"'{seed}'", "'edge'", *at)} % e.degree"
        arrives = "dst = tail_id AND dst_type = tail_type" if h >= least else "false"
        out.append(f"m{h} AS (SELECT {ids}, tail_id, tail_type, dst, dst_type, list_append(path, {{'id': cur, 't': cur_type, 'rel': relation}}) AS path FROM ({moved}))")
        out.append(f"w{h} AS (SELECT {ids}, tail_id, tail_type, dst AS cur, dst_type AS cur_type, path FROM m{h} WHERE NOT ({arrives}))")
        out.append(f"d{h} AS (SELECT {ids}, list_append(path, {{'id': dst, 't': dst_type, 'rel': ''}}) AS path FROM m{h} WHERE {arrives})")
    every = " UNION ALL ".join(f"SELECT * FROM d{h}" for h in range(1, hops + 1))
    out.append(f"paths AS (SELECT draw_id, {'min(attempt) AS attempt, ' if random else ''}path FROM ({every}) GROUP BY draw_id, path)" if random else f"paths AS ({every})")
    return ",\n".join(out)


SHOWN_PATH = "array_to_string(list_transform(path, lambda st: concat_ws(':', st.t, st.id, st.rel)), ' ')"

#: Rules of all paths, three to a path, as text.
GENERAL = """named AS (
SELECT p.draw_id, p.path, t.relation, t.head_type, t.tail_type, list_transform(path, lambda s: s.t || ':' || s.id) AS keys FROM paths p JOIN triples t USING (draw_id)),
middle AS (SELECT *, list_filter(keys, lambda k, i: list_position(keys, k) = i AND k <> keys[1] AND k <> keys[-1]) AS z FROM named),
vars AS (SELECT *, list_transform(keys, lambda k: CASE WHEN k = keys[1] THEN 'X' WHEN k = keys[-1] THEN 'Y' ELSE 'Z' || (list_position(z, k) - 1) END) AS v FROM middle),
bodies AS (SELECT *, list_transform(range(1, len(path)), lambda i: path[i].t || '_' || path[i].rel || '_' || path[i + 1].t || '(' || v[i] || ', ' || v[i + 1] || ')') AS body FROM vars),
ruled AS (
SELECT draw_id, path, variant::INT AS variant, v, body, head_type, tail_type, keys,
  CASE variant WHEN 1 THEN keys[1] ELSE 'X' END AS s, CASE variant WHEN 2 THEN keys[-1] ELSE 'Y' END AS o,
  head_type || '_' || relation || '_' || tail_type || '(' || CASE variant WHEN 1 THEN keys[1] ELSE 'X' END || ', ' || CASE variant WHEN 2 THEN keys[-1] ELSE 'Y' END || ')' AS head
FROM bodies, (VALUES (0), (1), (2)) w(variant)),
rules AS (
SELECT *, head || ' :- ' || array_to_string(body, ', ') AS rule, list_contains(body, head) AS tautological,
  CASE WHEN variant > 0 THEN 'ac1' WHEN list_contains(v, 'X') AND list_contains(v, 'Y') THEN 'cyclic' ELSE 'ac2' END AS rule_type
FROM ruled)"""
HOPS, ATTEMPTS = 3, 8
#: Every link as a triple.
LINKS = f"triples AS MATERIALIZED (SELECT row_number() OVER () AS draw_id, src AS head_id, dst AS tail_id, src_type AS head_type, dst_type AS tail_type, relation FROM set_edges WHERE {TARGET})"
FROM_PATHS = f"{GRAPH}, {LINKS}, {walks(HOPS, 1, None)}, {GENERAL}"


def summed(text: str) -> str:
    return f"count(*) AS n, sum({draw(text)}::HUGEINT)::VARCHAR AS checksum"


TRIPLE_COLUMNS = "draw_id, head_id, tail_id, head_type, tail_type, relation"


#: Distinct rules of walks with their metrics: the pairs of all their chains hop by hop, chains as data. A miner over
#: customers and suppliers walks from one type to another, so it finds no AC2 rule.
MINED_HOPS, MINER_ATTEMPTS = 4, 100
MINED = (
    """,
mined AS MATERIALIZED (SELECT DISTINCT rule, rule_type, variant, CASE variant WHEN 1 THEN path[1].id WHEN 2 THEN path[-1].id END AS entity,
  list_transform(range(1, len(path)), lambda i: path[i].t || '|' || path[i].rel || '|' || path[i + 1].t) AS chain FROM rules WHERE NOT tautological),
chains AS MATERIALIZED (SELECT DISTINCT chain FROM mined),
typed AS MATERIALIZED (SELECT src_type || '|' || relation || '|' || dst_type AS t, src, dst FROM set_edges),
h1 AS MATERIALIZED (SELECT DISTINCT chain[1:1] AS prefix, src, dst FROM chains JOIN typed ON t = chain[1])"""
    + "".join(
        f""",
h{n} AS MATERIALIZED (SELECT DISTINCT c.prefix, h.src, e.dst FROM h{n - 1} h JOIN (SELECT DISTINCT chain[1:{n - 1}] AS before, chain[1:{n}] AS prefix, chain[{n}] AS t FROM chains WHERE len(chain) >= {n}) c ON c.before = h.prefix JOIN typed e ON e.t = c.t AND e.src = h.dst)"""
        for n in range(2, MINED_HOPS + 1)
    )
    + """,
reached AS MATERIALIZED (SELECT prefix AS chain, r.src, r.dst, (k.src IS NOT NULL)::INT AS known FROM ("""
    + " UNION ALL ".join(f"SELECT * FROM h{n}" for n in range(1, MINED_HOPS + 1))
    + f""") r SEMI JOIN chains ON chain = prefix LEFT JOIN (SELECT DISTINCT src, dst FROM {of_type(BOUGHT_FROM)}) k ON r.src = k.src AND r.dst = k.dst),
by_pair AS (SELECT chain, 0 AS variant, NULL::BIGINT AS entity, count(*) AS preds, sum(known) AS hits FROM reached GROUP BY chain
  UNION ALL SELECT chain, 1, src, count(*), sum(known) FROM reached GROUP BY chain, src UNION ALL SELECT chain, 2, dst, count(*), sum(known) FROM reached GROUP BY chain, dst),
learned AS MATERIALIZED (SELECT * FROM (SELECT rule, rule_type, m.variant, m.entity, m.chain, coalesce(hits, 0)::BIGINT AS support, coalesce(hits / preds, 0) AS confidence,
  coalesce(hits, 0) / (SELECT count(*) FROM {of_type(BOUGHT_FROM)}) AS head_coverage, coalesce(preds, 0)::BIGINT AS num_predictions
  FROM mined m LEFT JOIN by_pair p ON p.chain = m.chain AND p.variant = m.variant AND p.entity IS NOT DISTINCT FROM m.entity)
  WHERE support >= 2 AND confidence >= 0.01 AND head_coverage >= 0.01),
scored AS MATERIALIZED (SELECT src AS head_id, dst AS tail_id, round(1 - product(1 - confidence), 9) AS score
  FROM reached r JOIN learned l ON l.chain = r.chain AND (l.variant = 0 OR (l.variant = 1 AND l.entity = r.src) OR (l.variant = 2 AND l.entity = r.dst)) GROUP BY ALL)"""
)
FITTED = f", {sample(2000, 42, None, TARGET)}, {walks(MINED_HOPS, 2, 'uniform', MINER_ATTEMPTS, 42)}, {GENERAL}{MINED}"
#: The same from the edges that are not held out.
IS_TEST = "relation = 'bought_from' AND (src * 31 + dst) % 20 = 0"
TRAIN_GRAPH = GRAPH.replace("edges AS MATERIALIZED", "all_edges AS MATERIALIZED").replace("),\nset_edges", f"),\nedges AS MATERIALIZED (SELECT * FROM all_edges WHERE NOT ({IS_TEST})),\nset_edges")
HELD = f", held AS (SELECT DISTINCT src, dst FROM all_edges WHERE {IS_TEST}), known AS (SELECT DISTINCT src AS head_id, dst AS tail_id FROM {of_type(BOUGHT_FROM)})"


def named_ids() -> str:
    return """WITH named AS (
SELECT 'nation' AS src_type, n_name AS src_name, 'in_region' AS relation, 'region' AS dst_type, r_name AS dst_name FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'supplier', s_name, 'in_nation', 'nation', n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey),
ids AS (SELECT node_type, name, dense_rank() OVER (PARTITION BY node_type ORDER BY name) - 1 AS id FROM (SELECT src_type AS node_type, src_name AS name FROM named UNION SELECT dst_type, dst_name FROM named))
SELECT DISTINCT n.src_type, n.relation, n.dst_type, a.id AS src, b.id AS dst FROM named n JOIN ids a ON a.node_type = n.src_type AND a.name = n.src_name JOIN ids b ON b.node_type = n.dst_type AND b.name = n.dst_name"""


def synthetic(nodes: str, degree: int, seed: int) -> str:
    parts = [f"SELECT '{r}' AS relation, {draw(f"'{seed}'", f"'{r}'", "'src'", "range::VARCHAR")} % {nodes} AS src, {draw(f"'{seed}'", f"'{r}'", "'dst'", "range::VARCHAR")} % {nodes} AS dst FROM range({nodes} * {degree})" for r in ("r_ab", "r_bc", "r_ba", "r_ac")]
    return f"SELECT relation, count(*) AS n, sum(src)::BIGINT AS src_sum, sum(dst)::BIGINT AS dst_sum, count(DISTINCT (src, dst)) AS pairs FROM ({' UNION ALL '.join(parts)}) GROUP BY relation"


SQL = {
    "kg_node_counts": f"{GRAPH} SELECT node_type, count(*) AS node_count FROM nodes GROUP BY 1",
    "kg_edge_counts": f"{GRAPH} SELECT src_type, relation, dst_type, edge_count FROM types",
    "kg_total_edges": f"{GRAPH} SELECT count(*) AS total_edges FROM edges",
    "kg_catalog": f"{GRAPH} SELECT src_type, relation, dst_type, ordinal::INT AS ordinal, edge_count = 0 AS empty FROM types",
    "kg_outgoing_types": f"{GRAPH} SELECT src_type, relation, dst_type, (row_number() OVER (PARTITION BY src_type ORDER BY ordinal) - 1)::INT AS type_idx, count(*) OVER (PARTITION BY src_type) AS n_types FROM types",
    "kg_neighbors": f"{GRAPH} SELECT DISTINCT dst FROM {of_type(('nation', 'rev_in_nation', 'customer'))} WHERE src = 7",
    "kg_edge_bag": f"{GRAPH} SELECT src, dst, count(*) AS copies FROM {of_type(BOUGHT_FROM)} GROUP BY ALL",
    "kg_adjacency_distinct": f"{GRAPH} SELECT DISTINCT src, dst FROM {of_type(BOUGHT_FROM)}",
    "kg_dangling": f"{GRAPH} SELECT src_type, relation, dst_type, src, dst FROM edges WHERE (src_type, src) NOT IN (SELECT (node_type, id) FROM nodes) OR (dst_type, dst) NOT IN (SELECT (node_type, id) FROM nodes)",
    "kg_named_ids": named_ids(),
    "kg_activity_edges": "SELECT 'did_' || event_type AS relation, count(*) AS edge_count, count(DISTINCT (user_id, hour(ts))) AS pairs FROM events GROUP BY event_type",
    "kg_synthetic": synthetic("(SELECT count(*) FROM customer)", 10, 0),
    "chain_reach_2hop": f"{GRAPH} SELECT src, dst FROM {reach(PART)}",
    "chain_reach_3hop": f"{GRAPH} SELECT src, dst FROM {reach(PEERS)}",
    "metrics_cyclic": f"{GRAPH} {cyclic(NATION)}",
    "metrics_cyclic_parts": f"{GRAPH} {cyclic(PART)}",
    "metrics_ac1_subject": f"{GRAPH} {ac1(NATION, 'src', 'customer')}",
    "metrics_ac1_object": f"{GRAPH} {ac1(NATION, 'dst', 'supplier')}",
    "metrics_ac2_subject": f"{GRAPH} {AC2_SUBJECT}",
    "metrics_ac2_object": f"{GRAPH} {AC2_OBJECT}",
    "metrics_batch_thresholds": f"{GRAPH}{BATCH} SELECT * FROM batch WHERE support >= 2 AND confidence >= 0.3255 AND head_coverage >= 0.03",
    "metrics_batch_max_results": f"{GRAPH}{BATCH} SELECT * FROM batch WHERE support >= 2 AND confidence >= 0.01 AND head_coverage >= 0.01 ORDER BY ord LIMIT 3",
    "top_rules": f"{GRAPH}{BATCH} SELECT * FROM batch ORDER BY confidence DESC, support DESC, ord LIMIT 3",
    "noisy_or_confidence": "SELECT l_suppkey::BIGINT AS l_suppkey, round(1 - product(1 - l_discount / 10), 9) AS score FROM lineitem GROUP BY 1",
    "chain_groups": f"{GRAPH}{SCORED} SELECT 'cyclic' AS kind, NULL::BIGINT AS entity, round(c, 9) AS confidence FROM scored_all UNION ALL SELECT 'object', id, round(coalesce(c, 0), 9) FROM nodes LEFT JOIN scored_one ON dst = id WHERE node_type = 'supplier'",
    "predict_all": f"{GRAPH}{SCORED} SELECT head_id, tail_id, 'customer' AS head_type, 'supplier' AS tail_type, 'bought_from' AS relation, score FROM scored WHERE score > 0",
    "predict_filter_known": f"{GRAPH}{TRAINED} SELECT s.* FROM scored s ANTI JOIN known k ON s.head_id = k.head_id AND s.tail_id = k.tail_id WHERE score > 0",
    "predict_min_score": f"{GRAPH}{SCORED} SELECT * FROM scored WHERE score > 0.55",
    "top_predictions": f"{GRAPH}{SCORED} SELECT * FROM scored ORDER BY score DESC, head_id, tail_id LIMIT 20",
    "score_tails_dense": f"{GRAPH}{SCORED} SELECT id AS tail_id, coalesce(score, 0.0) AS score FROM nodes LEFT JOIN scored ON tail_id = id AND head_id = 1 WHERE node_type = 'supplier'",
    "score_heads_dense": f"{GRAPH}{SCORED} SELECT id AS head_id, coalesce(score, 0.0) AS score FROM nodes LEFT JOIN scored ON head_id = id AND tail_id = 1 WHERE node_type = 'customer'",
    "tail_ranks_filtered": f"{GRAPH}{TRAINED} {ranked('tail', True)}",
    "head_ranks_filtered": f"{GRAPH}{TRAINED} {ranked('head', True)}",
    "ranks_raw": f"{GRAPH}{TRAINED} {ranked('tail', False)} UNION ALL {ranked('head', False)}",
    "mrr_hits_filtered": link_metrics(True),
    "mrr_hits_raw": link_metrics(False),
    "sample_uniform": f"{GRAPH}, {sample(1000, 3, None)} SELECT {TRIPLE_COLUMNS} FROM triples",
    "sample_relation_proportional": f"{GRAPH}, {sample(1000, 3, '1.0::DOUBLE')} SELECT {TRIPLE_COLUMNS} FROM triples",
    "sample_relation_inverse": f"{GRAPH}, {sample(1000, 3, '1.0::DOUBLE / edge_count')} SELECT {TRIPLE_COLUMNS} FROM triples",
    "sample_target_type": f"{GRAPH}, {sample(1000, 3, None, TARGET)} SELECT {TRIPLE_COLUMNS} FROM triples",
    "walk_enumerate_paths": f"{GRAPH}, {LINKS}, {walks(HOPS, 1, None)} SELECT head_id, tail_id, {summed(SHOWN_PATH)} FROM paths JOIN triples USING (draw_id) GROUP BY head_id, tail_id",
    "walk_uniform": f"{GRAPH}, {sample(1000, 5, None, TARGET)}, {walks(HOPS, 2, 'uniform', ATTEMPTS)} SELECT draw_id, attempt::INT AS attempt, {SHOWN_PATH} AS path FROM paths",
    "walk_relation_weighted": f"{GRAPH}, {sample(1000, 5, None, TARGET)}, {walks(HOPS, 2, 'relation_weighted', ATTEMPTS)} SELECT draw_id, attempt::INT AS attempt, {SHOWN_PATH} AS path FROM paths",
    "generalize_rules": f"{FROM_PATHS} SELECT head_id, tail_id, variant, {summed('rule')} FROM rules JOIN triples USING (draw_id) WHERE NOT tautological GROUP BY head_id, tail_id, variant",
    "classify_rules": f"{FROM_PATHS} SELECT DISTINCT rule, rule_type FROM rules",
    "tautology_filter": f"{FROM_PATHS} SELECT DISTINCT rule, tautological FROM rules",
    "rule_strings": f"{FROM_PATHS} SELECT DISTINCT rule, len(body)::INT AS length FROM rules",
    "rule_variables": f"{FROM_PATHS} SELECT DISTINCT rule, array_to_string(list_sort(list_distinct(list_concat(v, list_filter([s, o], lambda x: x IN ('X', 'Y'))))), ',') AS variables FROM rules",
    "rule_constants": f"{FROM_PATHS} SELECT DISTINCT rule, array_to_string(list_filter([s, o], lambda x: x NOT IN ('X', 'Y')), ',') AS constants FROM rules",
    "pipeline_fit": f"{GRAPH}{FITTED} SELECT rule, rule_type, support, round(confidence, 9) AS confidence, round(head_coverage, 9) AS head_coverage, num_predictions FROM learned",
    "pipeline_predict": f"{GRAPH}{FITTED} SELECT head_id, tail_id, score FROM scored ANTI JOIN (SELECT DISTINCT src, dst FROM {of_type(BOUGHT_FROM)}) k ON head_id = k.src AND tail_id = k.dst WHERE score > 0",
    "pipeline_evaluate": link_metrics(True, f"{TRAIN_GRAPH}{FITTED}{HELD}"),
    "dedup_rules": f"{FROM_PATHS}, firsts AS (SELECT rule, min({{'h': head_id, 't': tail_id}}) AS f FROM rules JOIN triples USING (draw_id) WHERE NOT tautological GROUP BY rule) SELECT rule, f.h AS first_head, f.t AS first_tail FROM firsts",
}
