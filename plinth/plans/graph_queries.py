"""Queries over the property graph: validation, upserts, lookups, traversals, packs."""

from __future__ import annotations

from pyspark.sql import functions as F

from plinth import schema
from plinth.functions import text as fx
from plinth.operators import graph, retrieval
from plinth.plans.base import both, plain, query
from plinth.sources.star import EDGES_SQL, NODES_SQL, star_graph
from plinth.sources.star import plain as star_plain

NODES, EDGES = star_plain(NODES_SQL), star_plain(EDGES_SQL)
ADJ = f"SELECT src AS node, dst AS other, edge_type, 'out' AS direction FROM ({EDGES}) e UNION ALL SELECT dst, src, edge_type, 'in' FROM ({EDGES}) e"

QUESTIONS = """SELECT item_id AS qid, CASE item_id % 4 WHEN 0 THEN 'statute_lookup' WHEN 1 THEN 'generic' WHEN 2 THEN 'precedent_tracing' ELSE 'authority_for_issue' END AS intent,
 CASE WHEN item_id % 3 = 0 THEN concat('m', item_id % 7) END AS matter_scope, text AS question FROM {benchmark}"""
SEEDS = """SELECT item_id AS qid, concat('nation:', item_id % 25) AS node, 1 AS pos FROM {benchmark} UNION ALL SELECT item_id, concat('customer:', 1 + item_id), 2 FROM {benchmark}"""


def bfs_sql(intent: str = "intent", scope: str = "matter_scope", ceiling: str = "CAST(NULL AS INT)", as_of: str = "CAST(NULL AS DATE)", hops: int = schema.MAX_HOPS) -> str:
    """The traversal's levels unrolled into common table expressions ending in ``bfs``."""
    ok = "(q.ceiling IS NULL OR n.tier IS NULL OR n.tier <= q.ceiling) AND (n.matter_id IS NULL OR n.matter_id = q.matter_scope) AND NOT coalesce(TRY_CAST(n.valid_to AS DATE) < q.as_of, false)"
    policy = schema.values_sql(schema.policy_rows(), "intent, edge_type, rank, n, restrictive")
    out = f"""WITH nodes AS ({NODES}), adj AS ({ADJ}), policy AS {policy},
q AS (SELECT qid, CASE WHEN i IN (SELECT intent FROM policy) THEN i ELSE 'generic' END AS policy, matter_scope, ceiling, as_of, i IN (SELECT intent FROM policy WHERE restrictive) AS only_listed
 FROM (SELECT qid, {intent} AS i, {scope} AS matter_scope, {ceiling} AS ceiling, {as_of} AS as_of FROM ({plain(QUESTIONS)}) b) b2),
s0 AS (SELECT s.qid, s.node, row_number() OVER (PARTITION BY s.qid ORDER BY s.pos, s.node) AS disc, n.tier FROM ({plain(SEEDS)}) s JOIN q USING (qid) JOIN nodes n ON n.id = s.node WHERE {ok}),
f0 AS (SELECT qid, node, 0 AS depth, disc, node AS path, row_number() OVER (PARTITION BY qid ORDER BY coalesce(tier, 5), disc) AS ord FROM s0)"""
    for d in range(1, hops + 1):
        seen = " UNION ALL ".join(f"SELECT qid, node FROM f{k}" for k in range(d))
        out += f""",
v{d} AS ({seen}), c{d} AS (SELECT qid, count(*) AS seen FROM v{d} GROUP BY qid),
s{d} AS (SELECT f.qid, f.ord, f.path, a.other, a.edge_type, coalesce(p.rank, 999) AS prank, row_number() OVER (PARTITION BY f.qid, f.node ORDER BY coalesce(p.rank, 999), a.edge_type, a.other, a.direction) AS nrank
 FROM f{d - 1} f JOIN q ON q.qid = f.qid JOIN adj a ON a.node = f.node LEFT JOIN policy p ON p.intent = q.policy AND p.edge_type = a.edge_type WHERE NOT q.only_listed OR p.rank IS NOT NULL),
m{d} AS (SELECT s.*, n.tier, row_number() OVER (PARTITION BY s.qid, s.other ORDER BY s.ord, s.nrank) AS f FROM s{d} s JOIN q ON q.qid = s.qid JOIN nodes n ON n.id = s.other
 WHERE s.nrank <= {schema.FANOUT} AND {ok} AND NOT EXISTS (SELECT 1 FROM v{d} v WHERE v.qid = s.qid AND v.node = s.other)),
r{d} AS (SELECT m.*, c.seen + row_number() OVER (PARTITION BY m.qid ORDER BY m.ord, m.nrank) AS disc FROM m{d} m JOIN c{d} c ON c.qid = m.qid WHERE f = 1),
f{d} AS (SELECT qid, other AS node, {d} AS depth, disc, concat(path, '>', edge_type, '>', other) AS path, row_number() OVER (PARTITION BY qid ORDER BY coalesce(tier, 5), prank, disc) AS ord FROM r{d} WHERE disc <= {schema.MAX_NODES})"""
    return out + ", bfs AS (" + " UNION ALL ".join(f"SELECT qid, node, depth, disc, path FROM f{k}" for k in range(hops + 1)) + ")"


def _bfs(spark, sf_dir, intent=None, scope=None, ceiling=None, as_of=None):
    g = star_graph(spark, sf_dir)
    q = both(spark, sf_dir, QUESTIONS).withColumn("ceiling", F.lit(ceiling).cast("int")).withColumn("as_of", F.lit(as_of).cast("string"))
    if intent:
        q = q.withColumn("intent", F.lit(intent))
    if scope:
        q = q.withColumn("matter_scope", F.lit(scope))
    return graph.typed_bfs(g.nodes, g.edges, q, both(spark, sf_dir, SEEDS), schema.dim_policy(spark), store=g), g, q


_BFS_OUT = " SELECT qid, node, depth, disc FROM bfs"


def _bfs_out(found):
    return found.select("qid", "node", "depth", F.col("disc").cast("long").alias("disc"))


@query("bfs_typed_generic", bfs_sql("'generic'") + _BFS_OUT)
def bfs_typed_generic(spark, sf_dir):
    return _bfs_out(_bfs(spark, sf_dir, "generic")[0])


@query("bfs_typed_by_intent", bfs_sql() + _BFS_OUT)
def bfs_typed_by_intent(spark, sf_dir):
    return _bfs_out(_bfs(spark, sf_dir)[0])


@query("bfs_crosswalk_restrictive", bfs_sql("'crosswalk_old_new'") + _BFS_OUT)
def bfs_crosswalk_restrictive(spark, sf_dir):
    return _bfs_out(_bfs(spark, sf_dir, "crosswalk_old_new")[0])


@query("bfs_ceiling", bfs_sql("'generic'", ceiling="3") + _BFS_OUT)
def bfs_ceiling(spark, sf_dir):
    return _bfs_out(_bfs(spark, sf_dir, "generic", ceiling=3)[0])


@query("bfs_scoped", bfs_sql("'generic'", scope="'m3'") + _BFS_OUT)
def bfs_scoped(spark, sf_dir):
    return _bfs_out(_bfs(spark, sf_dir, "generic", scope="m3")[0])


@query("bfs_as_of", bfs_sql("'generic'", as_of="DATE '1996-01-01'") + _BFS_OUT)
def bfs_as_of(spark, sf_dir):
    return _bfs_out(_bfs(spark, sf_dir, "generic", as_of="1996-01-01")[0])


@query("bfs_paths", bfs_sql() + " SELECT qid, node, path, depth FROM bfs WHERE depth > 0")
def bfs_paths(spark, sf_dir):
    return _bfs(spark, sf_dir)[0].filter("depth > 0").select("qid", "node", F.array_join("path", ">").alias("path"), "depth")


@query("path_parts", bfs_sql() + """ SELECT qid, node, CASE depth WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 4 END AS n_nodes, depth AS n_edges, replace(path, '>', ' → ') AS narrative FROM bfs WHERE depth > 0""")
def path_parts(spark, sf_dir):
    found = _bfs(spark, sf_dir)[0].filter("depth > 0")
    return found.select("qid", "node", F.size(graph.path_nodes(F.col("path"))).alias("n_nodes"), F.size(graph.path_edges(F.col("path"))).alias("n_edges"), F.array_join("path", " → ").alias("narrative"))


_TOKENS = r"greatest(1, CAST(floor(length({0}) / 4) AS INT), CAST(floor(len(regexp_extract_all({0}, '[^ \t\n\r\f\v]+')) * 0.8) AS INT))"
_CANDS = bfs_sql() + ", cand AS (SELECT b.qid, b.node, n.tier, round(1.0 / (1 + b.depth), 6) AS score, 0.0 AS sem, n.yr, n.body, n.label, n.node_type, n.matter_id FROM bfs b JOIN nodes n ON n.id = b.node)"
_RANKED = _CANDS + ", ranked AS (SELECT * FROM (SELECT c.*, row_number() OVER (PARTITION BY qid ORDER BY coalesce(tier, 9), score DESC, sem DESC, node) AS rank FROM cand c) x WHERE rank <= {k})"


def pack_sql(k: int, spans: int = schema.PACK_SPANS, tokens: int = schema.PACK_TOKENS, tier: int = schema.PACK_TIER) -> str:
    return _RANKED.replace("{k}", str(k)) + f""", p1 AS (SELECT r.*, body AS excerpt, {_TOKENS.format('body')} AS tokens, row_number() OVER (PARTITION BY qid, tier ORDER BY rank, node) AS t FROM ranked r),
p2 AS (SELECT p1.*, row_number() OVER (PARTITION BY qid ORDER BY rank, node) AS n FROM p1 WHERE t <= {tier}),
p3 AS (SELECT p2.*, sum(tokens) OVER (PARTITION BY qid ORDER BY rank, node ROWS UNBOUNDED PRECEDING) AS s FROM p2 WHERE n <= {spans}),
pack AS (SELECT qid, concat('S', n) AS marker, n AS pos, node, tier, score, excerpt, tokens, label, node_type, CASE WHEN matter_id IS NULL THEN 'public' ELSE 'private' END AS kind FROM p3 WHERE s <= {tokens} OR n = 1)"""


def candidates(spark, sf_dir):
    found, g, q = _bfs(spark, sf_dir)
    detail = g.nodes.select(F.col("id").alias("node"), "tier", "yr", "body", "label", "node_type", "matter_id")
    return found.join(detail, "node").select("qid", "node", "tier", F.round(1.0 / (1 + F.col("depth")), 6).alias("score"), F.lit(0.0).alias("sem"), "yr", "body", "label", "node_type", "matter_id"), q


def packs(spark, sf_dir, k: int, **limits):
    cand, q = candidates(spark, sf_dir)
    ranked = retrieval.cut(retrieval.rank_default(cand), k)
    kind = F.when(F.col("matter_id").isNull(), "public").otherwise("private")
    return retrieval.evidence_pack(ranked.withColumn("excerpt", F.col("body")).withColumn("kind", kind), **limits), ranked, q


@query("flagship_evidence_pack", pack_sql(schema.RERANK_K) + " SELECT qid, marker, node, tier, excerpt, tokens FROM pack")
def flagship_evidence_pack(spark, sf_dir):
    """Questions -> seeds -> traversal -> rank -> cut -> budgeted pack."""
    return packs(spark, sf_dir, schema.RERANK_K)[0].select("qid", "marker", "node", "tier", "excerpt", "tokens")


@query("pack_tight_budget", pack_sql(200, tokens=60, spans=40, tier=9) + " SELECT qid, marker, node, tokens FROM pack")
def pack_tight_budget(spark, sf_dir):
    return packs(spark, sf_dir, 200, max_tokens=60, max_spans=40, tier_cap=9)[0].select("qid", "marker", "node", "tokens")


@query("pack_tier_histogram", pack_sql(100) + " SELECT qid, tier, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens FROM pack GROUP BY qid, tier")
def pack_tier_histogram(spark, sf_dir):
    return retrieval.tier_histogram(packs(spark, sf_dir, 100)[0])


_STATUTE = ", ".join(schema.sql_literal(i) for i in schema.STATUTE_INTENTS)


@query("pack_sufficiency_confidence", pack_sql(100) + f""", a AS (SELECT qid, count(*) AS n_spans, CAST(sum(tokens) AS BIGINT) AS tokens, min(tier) AS best, list_sort(list(tier))[1:3] AS top FROM pack GROUP BY qid)
SELECT b.qid, coalesce(n_spans, 0) AS n_spans, coalesce(tokens, 0) AS tokens, coalesce(n_spans > 0, false) AND (b.intent NOT IN ({_STATUTE}) OR coalesce(best, 9) <= 3) AS sufficient,
 CASE WHEN n_spans IS NULL THEN 'low' WHEN b.intent IN ({_STATUTE}) AND best <> 1 THEN 'low' WHEN list_avg(top) <= 2.5 AND n_spans >= 2 THEN 'high' WHEN list_avg(top) <= 4.5 THEN 'medium' ELSE 'low' END AS confidence
FROM ({plain(QUESTIONS)}) b LEFT JOIN a ON a.qid = b.qid""")
def pack_sufficiency_confidence(spark, sf_dir):
    pack, _, q = packs(spark, sf_dir, 100)
    return retrieval.pack_summary(pack, q)


@query("pack_conflicts", pack_sql(400, spans=100, tier=50, tokens=100000) + """ SELECT qid, topic, array_to_string(list_sort(list(DISTINCT tier)), ',') AS tiers, string_agg(marker, ',' ORDER BY pos) AS markers, CASE WHEN min(tier) = 1 THEN 'high' ELSE 'medium' END AS severity
FROM (SELECT p.*, lower(substr(label, 1, 1)) AS topic FROM pack p) x GROUP BY qid, topic HAVING count(*) > 1 AND count(DISTINCT tier) > 1 AND min(tier) <= 3""")
def pack_conflicts(spark, sf_dir):
    pack = packs(spark, sf_dir, 400, max_spans=100, tier_cap=50, max_tokens=100000)[0]
    found = retrieval.conflicts(pack.withColumn("label", F.substring("label", 1, 1)))
    return found.select("qid", "topic", F.array_join("tiers", ",").alias("tiers"), F.array_join("markers", ",").alias("markers"), "severity")


@query("pack_forced_tier1", pack_sql(200, spans=8, tier=8).replace("ORDER BY coalesce(tier, 9), score DESC", "ORDER BY coalesce(tier, 9) DESC, score DESC") + f""",
lack AS (SELECT qid FROM ({plain(QUESTIONS)}) b WHERE intent IN ({_STATUTE}) AND qid NOT IN (SELECT qid FROM pack WHERE tier = 1)),
best AS (SELECT * FROM (SELECT r.*, {_TOKENS.format('body')} AS tokens, row_number() OVER (PARTITION BY qid ORDER BY rank, node) AS k FROM ranked r WHERE tier = 1 AND qid IN (SELECT qid FROM lack)) x WHERE k = 1),
al AS (SELECT qid, node, tier, excerpt, pos FROM pack UNION ALL SELECT qid, node, tier, body, 1000000 FROM best)
SELECT qid, concat('S', row_number() OVER (PARTITION BY qid ORDER BY pos, node)) AS marker, node, tier FROM al""")
def pack_forced_tier1(spark, sf_dir):
    cand, q = candidates(spark, sf_dir)
    ranked = retrieval.cut(retrieval._ranked(cand, F.desc(F.coalesce("tier", F.lit(9))), F.desc("score"), F.desc("sem")), 200).withColumn("excerpt", F.col("body"))
    pack = retrieval.evidence_pack(ranked, max_spans=8, tier_cap=8)
    return retrieval.force_tier1(pack, ranked, q).select("qid", "marker", "node", "tier")


@query("rank_default", _CANDS + " SELECT qid, node, row_number() OVER (PARTITION BY qid ORDER BY coalesce(tier, 9), score DESC, sem DESC, node) AS rank FROM cand")
def rank_default(spark, sf_dir):
    return retrieval.rank_default(candidates(spark, sf_dir)[0]).select("qid", "node", F.col("rank").cast("long").alias("rank"))


_AUTH = "round(1.0 / greatest(coalesce(tier, 8), 1) + 0.1 * sem + 0.05 * CASE WHEN yr >= 1950 THEN least(1.0, (yr - 1950) / 80.0) ELSE 0.0 END, 9)"


@query("rank_authority", _CANDS + f" SELECT qid, node, {_AUTH} AS score, row_number() OVER (PARTITION BY qid ORDER BY {_AUTH} DESC, node) AS rank FROM cand")
def rank_authority(spark, sf_dir):
    out = retrieval.rank_authority(candidates(spark, sf_dir)[0])
    return out.select("qid", "node", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("neighbors_any", f"SELECT a.node, a.edge_type, a.direction, a.other, n.node_type FROM ({ADJ}) a JOIN ({NODES}) n ON n.id = a.other WHERE a.node LIKE 'supplier:%'")
def neighbors_any(spark, sf_dir):
    g = star_graph(spark, sf_dir)
    ids = g.nodes.filter("node_type = 'Subsection'").select(F.col("id").alias("node"))
    return graph.neighbors(g.nodes, g.edges, ids)


@query("neighbors_out_limited", f"SELECT node, edge_type, direction, other, n.node_type FROM (SELECT a.*, row_number() OVER (PARTITION BY node ORDER BY edge_type, other, direction) AS k FROM ({ADJ}) a WHERE direction = 'out' AND node LIKE 'customer:%') x JOIN ({NODES}) n ON n.id = x.other WHERE k <= 5")
def neighbors_out_limited(spark, sf_dir):
    g = star_graph(spark, sf_dir)
    return graph.neighbors(g.nodes, g.edges, g.nodes.filter("node_type = 'Case'").select(F.col("id").alias("node")), "out", limit=5)


@query("neighbors_in_typed", f"SELECT a.node, a.edge_type, a.direction, a.other, n.node_type FROM ({ADJ}) a JOIN ({NODES}) n ON n.id = a.other WHERE a.node LIKE 'nation:%' AND direction = 'in' AND edge_type = 'CHAPTER_CONTAINS_SECTION'")
def neighbors_in_typed(spark, sf_dir):
    g = star_graph(spark, sf_dir)
    return graph.neighbors(g.nodes, g.edges, g.nodes.filter("node_type = 'Section'").select(F.col("id").alias("node")), "in", ["CHAPTER_CONTAINS_SECTION"])


@query("subgraph_neighborhood", f"""WITH RECURSIVE n AS ({NODES}), a AS (SELECT DISTINCT node, other FROM ({ADJ}) x WHERE other IN (SELECT id FROM n WHERE matter_id IS NULL AND tier <= 4)),
r(node, depth) AS (SELECT 'region:1' AS node, 0 AS depth UNION SELECT a.other, r.depth + 1 FROM r JOIN a ON a.node = r.node WHERE r.depth < 3) SELECT node, min(depth) AS depth FROM r GROUP BY node""")
def subgraph_neighborhood(spark, sf_dir):
    g = star_graph(spark, sf_dir)
    seeds = schema.inline(spark, [("region:1",)], "node")
    return graph.neighborhood(g.nodes.filter("matter_id is null"), g.edges, seeds, 3, ceiling=4)


@query("graph_counts", f"SELECT 'node' AS what, node_type AS kind, count(*) AS n FROM ({NODES}) x GROUP BY node_type UNION ALL SELECT 'edge', edge_type, count(*) FROM ({EDGES}) y GROUP BY edge_type")
def graph_counts(spark, sf_dir):
    g = star_graph(spark, sf_dir)
    return graph.counts_by_type(g.nodes, g.edges)


# ---- validation and upserts -------------------------------------------------------------------

_PROPS = """SELECT concat('n', o_orderkey) AS id, CASE o_orderkey % 4 WHEN 0 THEN 'Section' WHEN 1 THEN 'Case' WHEN 2 THEN 'Witness' ELSE 'SourceSpan' END AS node_type,
 CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'x' END AS number, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'act' END AS act_ref, o_orderpriority AS title, CASE WHEN o_orderkey % 2 = 0 THEN 'court' END AS court_ref, o_orderstatus AS name FROM {orders}"""


@query("node_validation_rejects", f"""SELECT id, node_type, prop FROM (SELECT x.id, x.node_type, r.prop, CASE r.prop WHEN 'number' THEN number WHEN 'act_ref' THEN act_ref WHEN 'title' THEN title WHEN 'court_ref' THEN court_ref WHEN 'name' THEN name END AS v
 FROM ({plain(_PROPS)}) x JOIN {schema.values_sql([(t, p) for t, ps in schema.REQUIRED.items() for p in ps], 'node_type, prop')} r ON r.node_type = x.node_type) y WHERE coalesce(v, '') = ''""")
def node_validation_rejects(spark, sf_dir):
    rows = both(spark, sf_dir, _PROPS)
    keys = ("number", "act_ref", "title", "court_ref", "name")
    props = F.create_map(*(x for k in keys for x in (F.lit(k), F.col(k))))
    return graph.missing_properties(rows.select("id", "node_type", props.alias("props")), schema.dim_required(spark))


_TYPED = """SELECT CASE o_orderkey % 6 WHEN 0 THEN 'CASE_CITES_CASE' WHEN 1 THEN 'SECTION_AMENDED_BY' WHEN 2 THEN 'NODE_HAS_VALIDITY' WHEN 3 THEN 'NODE_SUMMARIZES_NEIGHBORHOOD' WHEN 4 THEN 'NO_SUCH_EDGE' ELSE 'CASE_INTERPRETS_SECTION' END AS edge_type,
 concat('a', o_orderkey) AS src, concat('b', o_custkey) AS dst, CASE o_orderkey % 4 WHEN 0 THEN 'Case' WHEN 1 THEN 'Section' WHEN 2 THEN 'SummaryNode' ELSE 'Paragraph' END AS src_type,
 CASE o_orderkey % 5 WHEN 0 THEN 'Case' WHEN 1 THEN 'Amendment' WHEN 2 THEN 'ValidityPeriod' WHEN 3 THEN 'Section' ELSE 'Fact' END AS dst_type, o_orderstatus = 'F' AS dated FROM {orders}"""


@query("edge_validation_rejects", f"""WITH legal AS {schema.values_sql(schema.edge_legality_rows(), 'edge_type, src_type, dst_type, temporal')},
x AS (SELECT e.*, (SELECT max(temporal) FROM legal l WHERE l.edge_type = e.edge_type) AS temporal, EXISTS (SELECT 1 FROM legal l WHERE l.edge_type = e.edge_type AND (l.src_type = e.src_type OR l.src_type = '*') AND (l.dst_type = e.dst_type OR l.dst_type = '*')) AS ok FROM ({plain(_TYPED)}) e)
SELECT edge_type, src, dst, reason FROM (SELECT x.*, CASE WHEN temporal IS NULL THEN 'unknown_type' WHEN NOT ok THEN 'endpoints' WHEN temporal AND NOT dated THEN 'undated' END AS reason FROM x) y WHERE reason IS NOT NULL""")
def edge_validation_rejects(spark, sf_dir):
    rows = both(spark, sf_dir, _TYPED).withColumn("props", F.when(F.col("dated"), F.create_map(F.lit("as_of"), F.lit("2020"))).otherwise(F.create_map(F.lit("note"), F.lit("-"))))
    return graph.edge_violations(rows, schema.dim_edge_schema(spark))


_WRITES = """SELECT concat('case:', o_custkey) AS id, 'Case' AS node_type, o_orderkey AS seq, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS title, CASE WHEN o_orderkey % 3 = 0 THEN concat('court', o_orderkey % 5) END AS court_ref FROM {orders}"""


@query("node_upsert_merge", f"SELECT id, max_by(node_type, seq) AS node_type, max_by(title, seq) FILTER (WHERE title IS NOT NULL) AS title, max_by(court_ref, seq) FILTER (WHERE court_ref IS NOT NULL) AS court_ref FROM ({plain(_WRITES)}) w GROUP BY id")
def node_upsert_merge(spark, sf_dir):
    return graph.merge_nodes(both(spark, sf_dir, _WRITES), ["title", "court_ref"])


_EDGE_WRITES = """SELECT 'CASE_CITES_CASE' AS edge_type, concat('customer:', o_custkey) AS src, concat('customer:', o_custkey + 700) AS dst, o_orderkey AS seq, o_orderpriority AS props FROM {orders}"""


@query("edge_merge_dedup", f"SELECT edge_type, src, dst, max_by(props, seq) AS props, count(*) AS n_writes FROM ({plain(_EDGE_WRITES)}) w WHERE src IN (SELECT concat('customer:', c_custkey) FROM customer) AND dst IN (SELECT concat('customer:', c_custkey) FROM customer) GROUP BY edge_type, src, dst")
def edge_merge_dedup(spark, sf_dir):
    return graph.merge_edges(both(spark, sf_dir, _EDGE_WRITES), star_graph(spark, sf_dir).nodes)


@query("unique_id_violations", "SELECT 'Case' AS node_type, concat('case:', o_custkey) AS id, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def unique_id_violations(spark, sf_dir):
    return graph.duplicate_ids(both(spark, sf_dir, _WRITES))


_LEVELS = [*schema.COURT_LEVEL_TIER, "sc", "UNKNOWN"]
_TIERED = f"SELECT o_orderkey AS qid, t.node_type, CASE WHEN l.level IS NULL AND o_orderkey % 2 = 0 THEN o_orderstatus ELSE l.level END AS level FROM {{orders}} o JOIN {schema.values_sql(list(enumerate(schema.NODE_TYPES)), 'k, node_type')} t ON t.k = o_orderkey % {len(schema.NODE_TYPES)} LEFT JOIN {schema.values_sql(list(enumerate(_LEVELS)), 'k, level')} l ON l.k = o_custkey % {len(_LEVELS) + 1}"


@query("authority_tier_assign", f"""SELECT qid, x.node_type, coalesce(level, '-') AS level, coalesce(f.tier, CASE WHEN x.node_type IN ({", ".join(map(schema.sql_literal, schema.NODE_FAMILIES["judicial"]))}) THEN coalesce(c.tier, 3) END, 8) AS tier FROM ({plain(_TIERED)}) x
 LEFT JOIN {schema.values_sql(list(schema.TIER_BY_TYPE.items()), 'node_type, tier')} f ON f.node_type = x.node_type LEFT JOIN {schema.values_sql(list(schema.COURT_LEVEL_TIER.items()), 'lv, tier')} c ON c.lv = upper(x.level)""")
def authority_tier_assign(spark, sf_dir):
    rows = both(spark, sf_dir, _TIERED)
    return rows.select("qid", "node_type", F.coalesce("level", F.lit("-")).alias("level"), graph.authority_tier(F.col("node_type"), F.col("level")).alias("tier"))


@query("unknown_types_dropped", f"SELECT x.node_type, count(*) AS n FROM (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'Date' WHEN 1 THEN 'Case' ELSE 'Section' END AS node_type FROM orders) x JOIN {schema.values_sql([(t,) for t in schema.NODE_TYPES], 'node_type')} t ON t.node_type = x.node_type GROUP BY x.node_type")
def unknown_types_dropped(spark, sf_dir):
    rows = both(spark, sf_dir, "SELECT CASE o_orderkey % 3 WHEN 0 THEN 'Date' WHEN 1 THEN 'Case' ELSE 'Section' END AS node_type FROM {orders}")
    return rows.join(schema.dim_node_type(spark).select("node_type"), "node_type", "left_semi").groupBy("node_type").agg(F.count("*").alias("n"))


# ---- lookups -----------------------------------------------------------------------------------


@query("span_for_node_first", "SELECT node, span_id, text FROM (SELECT concat('order:', l_orderkey) AS node, concat('part:', l_partkey) AS span_id, p_name AS text, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, concat('part:', l_partkey)) AS k FROM lineitem JOIN part ON p_partkey = l_partkey) x WHERE k = 1")
def span_for_node_first(spark, sf_dir):
    edges = both(spark, sf_dir, "SELECT concat('order:', l_orderkey) AS src, concat('part:', l_partkey) AS dst, l_linenumber AS seq FROM {lineitem}")
    spans = both(spark, sf_dir, "SELECT concat('part:', p_partkey) AS id, p_name AS text FROM {part}")
    return graph.first_span(edges, spans)


# nodes o<key>: some derived from a span, some mentioned by an episode, some ids of relations between entities c<custkey>, which episodes mention
_BACKED = """SELECT 'NODE_DERIVED_FROM_SOURCE' AS edge_type, concat('o', o_orderkey) AS src, concat('s', o_orderkey % 50) AS dst, CAST(NULL AS VARCHAR) AS id FROM {orders} WHERE o_orderkey % 2 = 0
 UNION ALL SELECT 'MENTIONS', concat('ep', o_orderkey % 40), concat('o', o_orderkey), NULL FROM {orders} WHERE o_orderkey % 3 = 0
 UNION ALL SELECT 'RELATES_TO', concat('c', o_custkey), 'c-none', concat('o', o_orderkey) FROM {orders} WHERE o_orderkey % 5 = 0
 UNION ALL SELECT 'MENTIONS', concat('ep', 100 + c_custkey % 40), concat('c', c_custkey), NULL FROM {customer}"""
_EPISODES = "SELECT concat('ep', CAST(p_partkey - 1 AS VARCHAR)) AS id, p_name AS content, CASE WHEN p_partkey % 4 <> 1 THEN concat('provenance_span:s', p_partkey - 1) ELSE 'mail' END AS source_description FROM {part} WHERE p_partkey <= 140"


@query("span_for_node_coalesce", f"""WITH e AS ({plain(_BACKED)}), ep AS ({plain(_EPISODES)}), sp AS (SELECT concat('s', p_partkey - 1) AS id, p_type AS text FROM part WHERE p_partkey <= 60),
 ids AS (SELECT concat('o', o_orderkey) AS node FROM orders), m AS (SELECT dst AS entity, src AS episode FROM e WHERE edge_type = 'MENTIONS'),
 named AS (SELECT node, episode, 1 AS pos, 'mention' AS via FROM ids JOIN m ON m.entity = ids.node UNION ALL SELECT e.id, m.episode, 2, 'relation' FROM e JOIN m ON m.entity = e.src OR m.entity = e.dst WHERE e.edge_type = 'RELATES_TO'),
 c AS (SELECT e.src AS node, 0 AS pos, 'direct' AS via, sp.id AS span_id, sp.text FROM e JOIN sp ON sp.id = e.dst WHERE e.edge_type = 'NODE_DERIVED_FROM_SOURCE'
  UNION ALL SELECT node, CASE WHEN sp.id IS NULL THEN 3 ELSE pos END, CASE WHEN sp.id IS NULL THEN 'synthetic' ELSE via END, coalesce(sp.id, ep.id), coalesce(sp.text, ep.content) FROM named JOIN ep ON ep.id = named.episode LEFT JOIN sp ON concat('provenance_span:', sp.id) = ep.source_description)
 SELECT node, span_id, text, via FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY pos, span_id, via, text) AS k FROM c) x WHERE k = 1""")
def span_for_node_coalesce(spark, sf_dir):
    spans = both(spark, sf_dir, "SELECT concat('s', p_partkey - 1) AS id, p_type AS text FROM {part} WHERE p_partkey <= 60")
    ids = both(spark, sf_dir, "SELECT concat('o', o_orderkey) AS node FROM {orders}")
    return graph.span_with_fallbacks(ids, both(spark, sf_dir, _BACKED), spans, both(spark, sf_dir, _EPISODES))


@query("find_nodes_props", f"SELECT id, label FROM ({NODES}) n WHERE node_type = 'Proviso' AND lower(coalesce(CAST(tier AS VARCHAR), '')) = '4' ORDER BY id LIMIT 25")
def find_nodes_props(spark, sf_dir):
    return graph.find_by_properties(star_graph(spark, sf_dir).nodes, "Proviso", {"tier": "4"}, 25).select("id", "label")


@query("lookup_case_alias", "SELECT upper(concat('air ', c_custkey % 900)) AS citation, min(concat('customer:', c_custkey)) AS case_id FROM customer GROUP BY 1")
def lookup_case_alias(spark, sf_dir):
    cases = both(spark, sf_dir, "SELECT concat('customer:', c_custkey) AS id, array(concat('Air ', c_custkey % 900), c_name) AS aliases FROM {customer}")
    wanted = both(spark, sf_dir, "SELECT DISTINCT concat('AIR ', c_custkey % 1200) AS citation FROM {customer}")
    return graph.case_by_alias(cases, wanted)


# ---- crosswalks and seeds ------------------------------------------------------------------------

_CW = schema.values_sql(schema.crosswalk_rows(), "name, source_act, target_act, source_section, target_section, mapping_type")
_REFS = "SELECT o_orderkey AS qid, CASE o_orderkey % 4 WHEN 0 THEN 'Indian Penal Code, 1860' WHEN 1 THEN 'Bharatiya Nyaya Sanhita, 2023' WHEN 2 THEN 'Indian Evidence Act, 1872' ELSE 'Code of Criminal Procedure, 1973' END AS act, CAST(o_orderkey % 600 AS VARCHAR) AS section FROM {orders}"


@query("crosswalk_lookup_forward", f"SELECT r.qid, c.name, c.target_section, c.mapping_type FROM ({plain(_REFS)}) r JOIN {_CW} c ON c.source_act = r.act AND lower(c.source_section) = r.section")
def crosswalk_lookup_forward(spark, sf_dir):
    refs, cw = both(spark, sf_dir, _REFS), schema.dim_crosswalk(spark)
    return refs.join(cw, (cw["source_act"] == refs["act"]) & (F.lower(F.trim(cw["source_section"])) == F.lower(F.trim(refs["section"])))).select("qid", "name", "target_section", "mapping_type")


@query("crosswalk_lookup_backward", f"SELECT r.qid, c.name, c.source_section, c.mapping_type FROM ({plain(_REFS)}) r JOIN {_CW} c ON c.target_act = r.act AND lower(c.target_section) = r.section")
def crosswalk_lookup_backward(spark, sf_dir):
    refs, cw = both(spark, sf_dir, _REFS), schema.dim_crosswalk(spark)
    return refs.join(cw, (cw["target_act"] == refs["act"]) & (F.lower(F.trim(cw["target_section"])) == F.lower(F.trim(refs["section"])))).select("qid", "name", "source_section", "mapping_type")


_TOK = "CASE {0} WHEN 'Indian Penal Code, 1860' THEN 'ipc' WHEN 'Bharatiya Nyaya Sanhita, 2023' THEN 'bns' WHEN 'Indian Evidence Act, 1872' THEN 'iea' WHEN 'Code of Criminal Procedure, 1973' THEN 'crpc' WHEN 'Bharatiya Sakshya Adhiniyam, 2023' THEN 'bsa' ELSE 'bnss' END"


@query("seeds_crosswalk", f"""SELECT qid, concat('section:', {_TOK.format('target_act')}, ':', lower(target_section)) AS node, concat('crosswalk:', name, ':', section, '->', target_section) AS reason FROM ({plain(_REFS)}) r JOIN {_CW} c ON c.source_act = r.act AND lower(c.source_section) = r.section
UNION ALL SELECT qid, concat('section:', {_TOK.format('source_act')}, ':', lower(source_section)), concat('crosswalk:', name, ':', source_section, '<-', section) FROM ({plain(_REFS)}) r JOIN {_CW} c ON c.target_act = r.act AND lower(c.target_section) = r.section""")
def seeds_crosswalk(spark, sf_dir):
    cw = schema.dim_crosswalk(spark)
    ids = cw.select(F.concat(F.lit("section:"), fx.act_token(F.col("target_act")), F.lit(":"), F.lower("target_section")).alias("id")).unionByName(cw.select(F.concat(F.lit("section:"), fx.act_token(F.col("source_act")), F.lit(":"), F.lower("source_section")).alias("id")))
    return graph.crosswalk_seeds(both(spark, sf_dir, _REFS), cw, ids)


@query("crosswalk_edges_of_document", f"SELECT DISTINCT r.qid, concat('section:', {_TOK.format('c.source_act')}, ':', lower(source_section)) AS src, concat('section:', {_TOK.format('c.target_act')}, ':', lower(target_section)) AS dst FROM ({plain(_REFS)}) r JOIN {_CW} c ON (c.source_act = r.act AND c.source_section = r.section) OR (c.target_act = r.act AND c.target_section = r.section)")
def crosswalk_edges_of_document(spark, sf_dir):
    """Two equi-joins united, instead of a nested loop over a disjunction."""
    refs, cw = both(spark, sf_dir, _REFS), schema.dim_crosswalk(spark)
    one = refs.join(cw, (cw["source_act"] == refs["act"]) & (cw["source_section"] == refs["section"]))
    two = refs.join(cw, (cw["target_act"] == refs["act"]) & (cw["target_section"] == refs["section"]))
    node = lambda act, sec: fx.section_node(F.col(act), F.col(sec))
    return one.unionByName(two).select("qid", node("source_act", "source_section").alias("src"), node("target_act", "target_section").alias("dst")).distinct()


@query("seeds_union_distinct", "SELECT qid, node, reason FROM (SELECT *, row_number() OVER (PARTITION BY qid, node ORDER BY strategy, reason) AS k FROM (SELECT o_orderkey AS qid, concat('customer:', o_custkey) AS node, 1 AS strategy, 'ref' AS reason FROM orders UNION ALL SELECT l_orderkey, concat('supplier:', l_suppkey), 3, 'citation' FROM lineitem UNION ALL SELECT o_orderkey, concat('customer:', o_custkey), 4, 'mention' FROM orders) u) x WHERE k = 1")
def seeds_union_distinct(spark, sf_dir):
    a = both(spark, sf_dir, "SELECT o_orderkey AS qid, concat('customer:', o_custkey) AS node, 1 AS strategy, 'ref' AS reason FROM {orders}")
    b = both(spark, sf_dir, "SELECT l_orderkey AS qid, concat('supplier:', l_suppkey) AS node, 3 AS strategy, 'citation' AS reason FROM {lineitem}")
    c = both(spark, sf_dir, "SELECT o_orderkey AS qid, concat('customer:', o_custkey) AS node, 4 AS strategy, 'mention' AS reason FROM {orders}")
    return graph.first_seen(a.unionByName(b).unionByName(c), ["qid", "node"], ["strategy", "reason"]).select("qid", "node", "reason")


@query("seed_existence", "SELECT o_orderkey AS qid, concat('customer:', o_custkey + 50) AS node FROM orders WHERE o_custkey + 50 IN (SELECT c_custkey FROM customer)")
def seed_existence(spark, sf_dir):
    seeds = both(spark, sf_dir, "SELECT o_orderkey AS qid, concat('customer:', o_custkey + 50) AS node FROM {orders}")
    return seeds.join(star_graph(spark, sf_dir).nodes.select(F.col("id").alias("node")), "node", "left_semi").select("qid", "node")


@query("candidate_full_outer", """WITH g AS (SELECT o_custkey AS qid, concat('order:', o_orderkey) AS node, 5 AS tier, round(o_totalprice, 2) AS score, o_orderpriority AS excerpt FROM orders), s AS (SELECT l_suppkey AS qid, concat('order:', l_orderkey) AS node, 3 AS tier, max(l_discount) AS sem, 'sem' AS excerpt FROM lineitem GROUP BY 1, 2)
SELECT coalesce(g.qid, s.qid) AS qid, coalesce(g.node, s.node) AS node, coalesce(g.tier, s.tier) AS tier, coalesce(g.score, 0.0) AS score, coalesce(s.sem, 0.0) AS sem, coalesce(g.excerpt, s.excerpt) AS excerpt FROM g FULL JOIN s ON g.qid = s.qid AND g.node = s.node""")
def candidate_full_outer(spark, sf_dir):
    g = both(spark, sf_dir, "SELECT o_custkey AS qid, concat('order:', o_orderkey) AS node, 5 AS tier, round(o_totalprice, 2) AS score, o_orderpriority AS excerpt FROM {orders}")
    s = both(spark, sf_dir, "SELECT l_suppkey AS qid, concat('order:', l_orderkey) AS node, 3 AS tier, l_discount AS sem, 'sem' AS excerpt FROM {lineitem}")
    return retrieval.merge_candidates(g, s)
