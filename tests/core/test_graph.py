"""Traversal against a direct sequential restatement, and the write and validation operators."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from plinth import schema
from plinth.operators import graph
from plinth.schema import inline

POLICY = [("p", "A", 0, 2, False), ("p", "B", 1, 2, False), ("only", "A", 0, 1, True), ("generic", "B", 0, 1, False)]


def sequential(nodes, edges, seeds, intent, scope, ceiling, hops, most, fanout):
    """One question at a time with a priority queue, as the level form must match."""
    rank = {e: r for i, e, r, _, _ in POLICY if i == intent}
    only = intent == "only"
    near = {}
    for kind, s, d in edges:
        near.setdefault(s, []).append((kind, d, "out"))
        near.setdefault(d, []).append((kind, s, "in"))
    fits = lambda n: n in nodes and (ceiling is None or nodes[n][0] is None or nodes[n][0] <= ceiling) and nodes[n][1] in (None, scope)
    found, heap, count = {}, [], 0
    tier = lambda n: 5 if nodes[n][0] is None else nodes[n][0]
    for n in sorted(set(seeds), key=lambda n: (seeds.index(n), n)):
        if fits(n) and n not in found and len(found) < most:
            found[n] = (0, len(found) + 1)
            heapq.heappush(heap, (0, tier(n), 0, len(found), n))
    while heap:
        depth, _, _, _, node = heapq.heappop(heap)
        if depth >= hops:
            continue
        options = sorted((rank.get(k, 999), k, o, d) for k, o, d in near.get(node, []) if not only or k in rank)
        for r, _, other, _ in options[:fanout]:
            if other not in found and fits(other) and len(found) < most:
                found[other] = (depth + 1, len(found) + 1)
                heapq.heappush(heap, (depth + 1, tier(other), r, len(found), other))
    return found


@pytest.mark.parametrize("seed", range(4))
def test_levels_equal_the_queue(spark, seed):
    rng = random.Random(seed)
    nodes = {f"n{i}": (rng.choice([1, 2, 3, None]), rng.choice([None, None, "m1", "m2"])) for i in range(40)}
    edges = sorted({(rng.choice("ABC"), f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(110)})
    edges = [e for e in edges if e[1] != e[2]]
    asked = {1: ("p", "m1", None), 2: ("only", None, 2), 3: ("other", "m2", 3)}
    seeds = {q: [f"n{rng.randrange(40)}" for _ in range(3)] for q in asked}
    node_df = spark.createDataFrame([(i, t, m, None) for i, (t, m) in nodes.items()], "id string, tier int, matter_id string, valid_to string")
    edge_df = spark.createDataFrame(edges, "edge_type string, src string, dst string")
    q_df = spark.createDataFrame([(q, i, s, c, None) for q, (i, s, c) in asked.items()], "qid int, intent string, matter_scope string, ceiling int, as_of string")
    seed_df = spark.createDataFrame([(q, n, p) for q, ns in seeds.items() for p, n in enumerate(dict.fromkeys(ns))], "qid int, node string, pos int")
    policy = inline(spark, POLICY, "intent, edge_type, rank, n, restrictive")
    got = graph.typed_bfs(node_df, edge_df, q_df, seed_df, policy, max_hops=3, max_nodes=15, fanout=4).collect()
    for q, (intent, scope, ceiling) in asked.items():
        plan = intent if intent in ("p", "only") else "generic"
        truth = sequential(nodes, edges, list(dict.fromkeys(seeds[q])), plan, scope, ceiling, 3, 15, 4)
        assert {r.node: (r.depth, r.disc) for r in got if r.qid == q} == truth
    for r in got:
        assert r.path[-1] == r.node and len(r.path) == 2 * r.depth + 1
        assert nodes[r.node][1] in (None, asked[r.qid][1])


def test_unscoped_question_sees_no_private_row(spark):
    nodes = spark.createDataFrame([("a", 1, None, None), ("b", 6, "m1", None), ("c", 1, None, "2001-01-01")], "id string, tier int, matter_id string, valid_to string")
    edges = spark.createDataFrame([("A", "a", "b"), ("A", "a", "c")], "edge_type string, src string, dst string")
    seeds = spark.createDataFrame([(1, "a", 0)], "qid int, node string, pos int")
    policy = inline(spark, POLICY, "intent, edge_type, rank, n, restrictive")
    ask = lambda scope, as_of: spark.createDataFrame([(1, "p", scope, None, as_of)], "qid int, intent string, matter_scope string, ceiling int, as_of string")
    nodes_of = lambda scope, as_of: sorted(r.node for r in graph.typed_bfs(nodes, edges, ask(scope, as_of), seeds, policy).collect())
    assert nodes_of(None, None) == ["a", "c"]
    assert nodes_of("m1", None) == ["a", "b", "c"]
    assert nodes_of(None, "2005-01-01") == ["a"]
    assert nodes_of(None, "no date") == ["a", "c"]


def test_validation(spark):
    rows = spark.createDataFrame([("a", "Section", {"number": "1", "act_ref": ""}), ("b", "Section", {"number": "1", "act_ref": "x"}), ("c", "Bench", {})], "id string, node_type string, props map<string,string>")
    assert [(r.id, r.prop) for r in graph.missing_properties(rows, schema.dim_required(spark)).collect()] == [("a", "act_ref")]
    edges = spark.createDataFrame([
        ("CASE_CITES_CASE", "1", "2", "Case", "Case", {}), ("CASE_CITES_CASE", "3", "4", "Paragraph", "Case", {}), ("SECTION_AMENDED_BY", "5", "6", "Section", "Amendment", {}),
        ("SECTION_AMENDED_BY", "7", "8", "Section", "Amendment", {"as_of": "2020"}), ("NODE_DERIVED_FROM_SOURCE", "9", "10", "Fact", "SourceSpan", {}), ("X", "11", "12", "Case", "Case", {}),
    ], "edge_type string, src string, dst string, src_type string, dst_type string, props map<string,string>")
    assert sorted((r.src, r.reason) for r in graph.edge_violations(edges, schema.dim_edge_schema(spark)).collect()) == [("11", "unknown_type"), ("3", "endpoints"), ("5", "undated")]


def test_merge_keeps_the_latest_present_property(spark):
    writes = spark.createDataFrame([("a", "Case", 1, "old", "x"), ("a", "Case", 2, "new", None), ("b", "Case", 1, None, None)], "id string, node_type string, seq int, title string, court string")
    assert {r.id: (r.title, r.court) for r in graph.merge_nodes(writes, ["title", "court"]).collect()} == {"a": ("new", "x"), "b": (None, None)}


def test_vocabulary_sizes():
    assert len(schema.NODE_TYPES) == 65 == len(set(schema.NODE_TYPES)) and len(schema.EDGES) == 42 and len(schema.INDEXABLE) == 26
    assert len(schema.crosswalk_rows()) == 38 and len(schema.REQUIRED) == 24 and sum(t for *_, t in schema.EDGES) == 4
    assert {t for _, s, d, _ in schema.EDGES for t in s + d} - {"*"} <= set(schema.NODE_TYPES)


def test_neighbourhood_reads_two_levels_alone(spark):
    """Against plain breadth-first search, with cycles, loops, several seeds and inadmissible nodes on the way."""
    from collections import defaultdict

    rng = random.Random(4)
    nodes = [(k, rng.choice([None, 1, 3, 8]), rng.choice([None, None, "m1", "m2"])) for k in range(120)]
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(150)] + [(5, 5), (1, 2), (1, 2)]
    n = spark.createDataFrame([(f"n{k}", t, m) for k, t, m in nodes], "id string, tier int, matter_id string")
    e = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in edges], "src string, dst string").withColumn("edge_type", F.lit("X"))
    fine = {k for k, t, m in nodes if (t is None or t <= 3) and m in (None, "m1")}
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    for hops in (0, 1, 4, 50):
        want, front = {k: 0 for k in (0, 1, 7) if k in fine}, {k for k in (0, 1, 7) if k in fine}
        for depth in range(1, hops + 1):
            front = {o for k in front for o in near[k] if o in fine and o not in want}
            want |= dict.fromkeys(front, depth)
        seeds = spark.createDataFrame([("n0",), ("n1",), ("n7",), ("n0",), ("absent",)], "node string")
        got = graph.neighborhood(n, e, seeds, hops, scope="m1", ceiling=3).collect()
        assert len(got) == len(want) and {int(r.node[1:]): r.depth for r in got} == want


def test_adjacency_leaves_other_edges_where_they_are_read(spark):
    """Only edges of the asked nodes are met, each node's first ones by type, whatever else the graph holds."""
    edges = spark.createDataFrame([("A", "a", f"n{i}") for i in range(6)] + [("B", "x", "y"), ("B", "n1", "a")], "edge_type string, src string, dst string").distinct()
    found = graph.adjacency(edges, F.broadcast(spark.createDataFrame([("a",)], "node string")), 3)
    assert sorted(map(tuple, found.collect())) == [("a", "n0", "A", "out"), ("a", "n1", "A", "out"), ("a", "n1", "B", "in"), ("a", "n2", "A", "out")]


def test_star_store_finds_by_key_what_the_mapping_has(spark):
    """Nodes and edges at few ids, odd ones among them, equal those of the whole graph."""
    from plinth.sources import star

    g = star.star_graph(spark, "/root/testdata/sf0.001")
    whole = star.GraphTables(g.nodes, g.edges)
    ids = spark.createDataFrame([(i,) for i in ("region:1", "nation:7", "customer:3", "customer:03", "customer: 3", "supplier:2", "supplier:x", "part:11", "order:1", "orders:1", "order:1:2", "order:99999999999999999999", "absent", "", None)], "id string")
    rows = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert rows(g.nodes_of(ids)) == rows(whole.nodes_of(ids)) and g.nodes_of(ids).count() == 6
    for end in ("src", "dst"):
        assert rows(g.edges_at(ids, end)) == rows(whole.edges_at(ids, end)) and g.edges_at(ids, end).count() > 2
    for k, found in ((0, graph.adjacency(g.edges_at, ids.withColumnRenamed("id", "node"), 5)), (1, graph.adjacency(g.edges_at, ids.withColumnRenamed("id", "node"), 5, ["SECTION_HAS_PROVISO"]))):
        want = graph.adjacency(g.edges, ids.withColumnRenamed("id", "node"), 5)
        assert rows(found) == rows(want.filter("edge_type = 'SECTION_HAS_PROVISO'") if k else want) != []


def test_restrictive_questions_read_their_edge_types_alone(spark):
    """Edges of a type that no question may walk are not even asked for."""
    nodes = spark.createDataFrame([(f"n{i}", 1, None, None) for i in range(6)], "id string, tier int, matter_id string, valid_to string")
    kinds = F.udf(lambda kind: 1 // (kind == "A"))
    edges = spark.createDataFrame([("A", "n0", "n1"), ("A", "n1", "n2"), ("B", "n0", "n3"), ("C", "n1", "n4")], "edge_type string, src string, dst string")
    asked = spark.createDataFrame([(1, "only", None, None, None)], "qid int, intent string, matter_scope string, ceiling int, as_of string")
    seeds, policy = spark.createDataFrame([(1, "n0", 0)], "qid int, node string, pos int"), inline(spark, POLICY, "intent, edge_type, rank, n, restrictive")
    seen = []

    class Store:
        def nodes_of(self, ids):
            return nodes.join(ids, "id", "left_semi")

        def edges_at(self, ids, end):
            seen.append(end)
            return edges.join(ids.withColumnRenamed("id", end), end, "left_semi").withColumn("src", F.when(kinds("edge_type") == 1, F.col("src")))

    assert sorted((r.node, r.depth) for r in graph.typed_bfs(nodes, edges, asked, seeds, policy, store=Store()).collect()) == [("n0", 0), ("n1", 1), ("n2", 2)]
    assert set(seen) == {"src", "dst"}
