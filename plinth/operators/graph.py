"""Graph operators over (nodes, edges): validation, upserts, neighbours, seeds and bounded traversals."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plinth import schema
from plinth.session import materialize
from plinth.sizes import bounded


# ---- validation and writing ---------------------------------------------------------------


def missing_properties(nodes: DataFrame, required: DataFrame) -> DataFrame:
    """(id, node_type, prop) of each required property that is absent, null or blank; ``nodes`` has props map<string,string>."""
    wanted = nodes.join(required, "node_type")
    return wanted.filter(F.coalesce(F.try_element_at("props", F.col("prop")), F.lit("")).isin("", "[]")).select("id", "node_type", "prop")


def edge_violations(edges: DataFrame, legality: DataFrame) -> DataFrame:
    """(edge_type, src, dst, reason) of each edge that the schema forbids.

    ``edges`` has edge_type, src, dst, src_type, dst_type, props.
    """
    legal = legality.withColumn("ok", F.lit(True))
    known = legal.groupBy("edge_type").agg(F.max("temporal").alias("temporal"))
    out = edges.join(known, "edge_type", "left")
    for any_src, any_dst in ((False, False), (True, False), (False, True)):
        name = f"ok{int(any_src)}{int(any_dst)}"
        rows = legal.filter(((F.col("src_type") == "*") == any_src) & ((F.col("dst_type") == "*") == any_dst))
        keys = ["edge_type", *["src_type"] * (not any_src), *["dst_type"] * (not any_dst)]
        out = out.join(rows.select(*keys, F.col("ok").alias(name)), keys, "left")
    legal_pair = F.coalesce("ok00", "ok10", "ok01").isNotNull()
    dated = F.map_contains_key("props", F.lit("as_of")) | F.map_contains_key("props", F.lit("validity_period_ref"))
    reason = F.when(F.col("temporal").isNull(), "unknown_type").when(~legal_pair, "endpoints").when(F.col("temporal") & ~dated, "undated")
    return out.withColumn("reason", reason).filter("reason is not null").select("edge_type", "src", "dst", "reason")


def merge_nodes(writes: DataFrame, props: list[str]) -> DataFrame:
    """Property-level upsert: of each id and property the latest write (by ``seq``) that has it wins; one aggregate, combined on the map side."""
    latest = [F.max_by(F.col(p), F.when(F.col(p).isNotNull(), F.col("seq"))).alias(p) for p in props]
    return writes.groupBy("id").agg(F.max_by("node_type", "seq").alias("node_type"), *latest)


def merge_edges(writes: DataFrame, nodes: DataFrame) -> DataFrame:
    """One edge per (edge_type, src, dst) whose endpoints both exist; the latest properties win."""
    ids = nodes.select("id")
    merged = writes.groupBy("edge_type", "src", "dst").agg(F.max_by("props", "seq").alias("props"), F.count("*").alias("n_writes"))
    return merged.join(ids, merged["src"] == ids["id"], "left_semi").join(ids, merged["dst"] == ids["id"], "left_semi")


def duplicate_ids(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("node_type", "id").agg(F.count("*").alias("n")).filter("n > 1")


def authority_tier(node_type: Column, court_level: Column) -> Column:
    """Fixed tier of a type, or the court's tier for judicial types (tier 3 where unknown), else 8."""
    fixed = F.create_map(*(F.lit(x) for pair in schema.TIER_BY_TYPE.items() for x in pair))
    courts = F.create_map(*(F.lit(x) for pair in schema.COURT_LEVEL_TIER.items() for x in pair))
    judicial = node_type.isin(schema.NODE_FAMILIES["judicial"])
    return F.coalesce(F.try_element_at(fixed, node_type), F.when(judicial, F.coalesce(F.try_element_at(courts, F.upper(court_level)), F.lit(schema.TIER_HIGH))), F.lit(schema.TIER_SUMMARY))


# ---- lookups ---------------------------------------------------------------------------------


def both_ways(edges: DataFrame) -> DataFrame:
    """(node, other, edge_type, direction): every edge from both of its ends."""
    out = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), "edge_type", F.lit("out").alias("direction"))
    return out.unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("other"), "edge_type", F.lit("in").alias("direction")))


def adjacency(edges: DataFrame | Callable[[DataFrame, str], DataFrame], ids: DataFrame, fanout: int, types: list[str] | None = None) -> DataFrame:
    """(node, other, edge_type, direction): of each of ``ids`` (node, distinct) and edge type the first ``fanout`` neighbours.

    No traversal looks past ``fanout`` neighbours of a parent, and edges of
    one type rank alike, so what is cut can never be walked; a hub shrinks to
    ``fanout`` rows a type, by partial top lists before the shuffle. Edges of
    other nodes are left out where they are read, and those of other types
    than ``types``, if given. ``edges`` may be a store's way to find the edges
    of which an end is among ids (id).
    """
    ways = []
    for here, there, direction in (("src", "dst", "out"), ("dst", "src", "in")):
        near = edges(ids.select(F.col("node").alias("id")), here) if callable(edges) else edges.join(ids.select(F.col("node").alias(here)), here, "left_semi")
        if types is not None:
            near = near.filter(F.col("edge_type").isin(types))
        ways.append(near.select(F.col(here).alias("node"), F.col(there).alias("other"), "edge_type", F.lit(direction).alias("direction")))
    ranked = ways[0].unionByName(ways[1]).withColumn("k", F.row_number().over(Window.partitionBy("node", "edge_type").orderBy("other", "direction")))
    return ranked.filter(F.col("k") <= fanout).drop("k")


def counts_by_type(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, kind, n): how many nodes and edges of each type there are."""
    count = lambda df, what, kind: df.groupBy(F.lit(what).alias("what"), F.col(kind).alias("kind")).agg(F.count("*").alias("n"))
    return count(nodes, "node", "node_type").unionByName(count(edges, "edge", "edge_type"))


def neighbors(nodes: DataFrame, edges: DataFrame, ids: DataFrame, direction: str = "any", edge_types: list[str] | None = None, limit: int = 1000) -> DataFrame:
    """(node, edge_type, direction, other, node_type) for each of ``ids`` (node), at most ``limit`` each."""
    adjacent = both_ways(edges)
    if direction != "any":
        adjacent = adjacent.filter(F.col("direction") == direction)
    if edge_types:
        adjacent = adjacent.filter(F.col("edge_type").isin(edge_types))
    near = adjacent.join(ids.select("node"), "node", "left_semi")
    ranked = near.withColumn("k", F.row_number().over(Window.partitionBy("node").orderBy("edge_type", "other", "direction"))).filter(F.col("k") <= limit)
    return ranked.join(nodes.select(F.col("id").alias("other"), "node_type"), "other").select("node", "edge_type", "direction", "other", "node_type")


def first_span(edges: DataFrame, spans: DataFrame) -> DataFrame:
    """(node, span_id, text): each node's first backing span by edge order; ``edges`` has src, dst, seq."""
    first = edges.groupBy(F.col("src").alias("node")).agg(F.min(F.struct("seq", "dst")).alias("m"))
    return first.join(spans, F.col("m.dst") == spans["id"]).select("node", spans["id"].alias("span_id"), "text")


#: What an episode's description starts with when it names the span behind it (fixed value).
SPAN_PREFIX = "provenance_span:"


def span_with_fallbacks(ids: DataFrame, edges: DataFrame, spans: DataFrame, episodes: DataFrame) -> DataFrame:
    """(node, span_id, text, via) of each of ``ids`` (node) that has any backing.

    ``edges``: edge_type, src, dst, and id for relations; ``episodes``: id,
    content, source_description. In this order: the span that the node is
    derived from; the span of an episode that mentions it; where the id is a
    relation's, the span of an episode that mentions one of its ends; else
    the content of such an episode itself. Among equals the least id counts.
    """
    typed = lambda name: edges.filter(F.col("edge_type") == name)
    mentions = typed("MENTIONS").select(F.col("dst").alias("entity"), F.col("src").alias("episode"))
    ends = typed("RELATES_TO").select(F.col("id").alias("node"), F.explode(F.array("src", "dst")).alias("entity"))
    direct = ids.join(typed("NODE_DERIVED_FROM_SOURCE").select(F.col("src").alias("node"), F.col("dst").alias("span")), "node").join(spans.select(F.col("id").alias("span"), "text"), "span")
    direct = direct.select("node", F.lit(0).alias("pos"), F.lit("direct").alias("via"), F.col("span").alias("span_id"), "text")
    named = ids.join(mentions.withColumnRenamed("entity", "node"), "node").select("node", "episode", F.lit(1).alias("pos"), F.lit("mention").alias("via"))
    related = ids.join(ends, "node").join(mentions, "entity").select("node", "episode", F.lit(2).alias("pos"), F.lit("relation").alias("via"))
    told = episodes.select(F.col("id").alias("episode"), "content", F.when(F.col("source_description").startswith(SPAN_PREFIX), F.substring("source_description", len(SPAN_PREFIX) + 1, 1_000_000)).alias("span"))
    found = named.unionByName(related).join(told, "episode").join(spans.select(F.col("id").alias("span"), "text"), "span", "left")
    backed = F.col("text").isNotNull()
    episodic = found.select("node", F.when(backed, F.col("pos")).otherwise(3).alias("pos"), F.when(backed, F.col("via")).otherwise("synthetic").alias("via"), F.when(backed, F.col("span")).otherwise(F.col("episode")).alias("span_id"), F.coalesce("text", "content").alias("text"))
    best = direct.unionByName(episodic).groupBy("node").agg(F.min(F.struct("pos", "span_id", "via", "text")).alias("m"))
    return best.select("node", "m.span_id", "m.text", "m.via")


def find_by_properties(nodes: DataFrame, node_type: str, props: dict[str, str], limit: int) -> DataFrame:
    """Case-insensitive equality on each property, an absent one counting as ''."""
    found = nodes.filter(F.col("node_type") == node_type)
    for name, value in props.items():
        found = found.filter(F.lower(F.coalesce(F.col(name).cast("string"), F.lit(""))) == value.lower())
    return found.orderBy("id").limit(limit)


def case_by_alias(cases: DataFrame, citations: DataFrame) -> DataFrame:
    """(citation, case_id): the least case id that carries the citation among its aliases, in any case."""
    keys = cases.select("id", F.explode("aliases").alias("alias")).select(F.lower("alias").alias("key"), "id").groupBy("key").agg(F.min("id").alias("case_id"))
    wanted = citations.withColumn("key", F.lower("citation"))
    return wanted.join(keys, "key").select("citation", "case_id")


# ---- traversal --------------------------------------------------------------------------------


def admissible(tier: Column, matter: Column, valid_to: Column, ceiling: Column, scope: Column, as_of: Column) -> Column:
    """Tier within the ceiling, no foreign private row, still valid at ``as_of``; nulls and unreadable dates pass."""
    open_end = F.coalesce(F.try_to_timestamp(valid_to) < F.try_to_timestamp(as_of), F.lit(False))
    return (ceiling.isNull() | tier.isNull() | (tier <= ceiling)) & (matter.isNull() | (matter == scope)) & ~open_end


class Store(Protocol):
    """A graph store that finds the nodes among ids (id, distinct), and the edges whose src or dst is among them."""

    def nodes_of(self, ids: DataFrame) -> DataFrame: ...

    def edges_at(self, ids: DataFrame, end: str) -> DataFrame: ...


def typed_bfs(nodes: DataFrame, edges: DataFrame, questions: DataFrame, seeds: DataFrame, policy: DataFrame, max_hops: int = schema.MAX_HOPS, max_nodes: int = schema.MAX_NODES, fanout: int = schema.FANOUT, store: Store | None = None) -> DataFrame:
    """(qid, node, depth, disc, path): bounded best-first traversal for a batch of questions, level by level.

    ``questions``: qid, intent, matter_scope, ceiling, as_of. ``seeds``: qid,
    node, pos. A question's frontier is ordered by tier, then policy rank,
    then discovery. Of each parent at most ``fanout`` neighbours by policy
    rank are looked at before admissibility, new nodes join until
    ``max_nodes``. A level reads the edges of its frontier and the nodes that
    it meets, which are few and travel to the tables as they lie, so no level
    shuffles the graph; each level is written once, so its lineage is one table.
    A ``store`` of the same nodes and edges finds few of them by its own keys.
    If no question may walk an edge outside its policy, edges of other types
    are not read.
    """
    spark = nodes.sparkSession
    hot = _details(store.nodes_of if store else lambda ids: nodes.join(ids, "id", "left_semi"))
    known = policy.select("intent").distinct().withColumn("known", F.lit(True))
    asked = questions.join(known, "intent", "left").withColumn("policy", F.when(F.col("known"), F.col("intent")).otherwise("generic")).select("qid", "policy", "matter_scope", "ceiling", "as_of")
    asked = materialize(asked, "bfs-questions")
    only = policy.filter("restrictive").select(F.col("intent").alias("policy")).distinct().withColumn("only", F.lit(True))
    rules = policy.select(F.col("intent").alias("policy"), "edge_type", F.col("rank").alias("prank"))
    types, used = None, asked.select("policy").distinct()
    if not used.join(only, "policy", "left_anti").limit(1).count():
        types = [r.edge_type for r in rules.join(used, "policy").select("edge_type").distinct().collect()]  # of the policies' vocabulary
    ok = admissible(F.col("tier"), F.col("matter_id"), F.col("valid_to"), F.col("ceiling"), F.col("matter_scope"), F.col("as_of"))
    entered = materialize(seeds.join(asked, "qid"), "bfs-seeds")
    start = entered.join(hot(entered.select("node")), F.col("node") == F.col("id")).filter(ok)
    start = start.withColumn("disc", F.row_number().over(Window.partitionBy("qid").orderBy("pos", "node"))).filter(F.col("disc") <= max_nodes)
    frontier = start.select("qid", "node", F.lit(0).alias("depth"), "disc", F.array("node").alias("path"), F.row_number().over(Window.partitionBy("qid").orderBy(F.coalesce("tier", F.lit(5)), "disc")).alias("ord"))
    frontier = materialize(frontier, "bfs-level0")
    levels = [frontier]
    for depth in range(1, max_hops + 1):
        visited = levels[0].select("qid", "node")
        for level in levels[1:]:
            visited = visited.unionByName(level.select("qid", "node"))
        counts = visited.groupBy("qid").agg(F.count("*").alias("seen"))
        front = frontier.join(asked, "qid").join(only, "policy", "left")
        adjacent = adjacency(store.edges_at if store else edges, bounded(materialize(frontier.select("node").distinct(), f"bfs-parents{depth}")), fanout, types)
        # what a parent offers depends on the policy alone, so questions share it
        offers = front.select("policy", "only", "node").distinct().join(adjacent, "node").join(rules, ["policy", "edge_type"], "left").filter(F.col("only").isNull() | F.col("prank").isNotNull())
        offers = offers.withColumn("prank", F.coalesce("prank", F.lit(999)))
        by_parent = Window.partitionBy("policy", "node").orderBy("prank", "edge_type", "other", "direction")
        offers = offers.withColumn("nrank", F.row_number().over(by_parent)).filter(F.col("nrank") <= fanout)
        step = front.join(offers.drop("only", "direction"), ["policy", "node"])
        step = materialize(step.join(visited.select("qid", F.col("node").alias("other")), ["qid", "other"], "left_anti"), f"bfs-step{depth}")
        fresh = step.join(hot(step.select("other")), F.col("other") == F.col("id")).filter(ok)
        first = fresh.withColumn("f", F.row_number().over(Window.partitionBy("qid", "other").orderBy("ord", "nrank"))).filter("f = 1")
        room = first.join(counts, "qid").withColumn("disc", F.col("seen") + F.row_number().over(Window.partitionBy("qid").orderBy("ord", "nrank"))).filter(F.col("disc") <= max_nodes)
        nxt = room.select("qid", F.col("other").alias("node"), F.lit(depth).alias("depth"), F.col("disc").cast("int").alias("disc"), F.concat("path", F.array("edge_type", "other")).alias("path"), F.row_number().over(Window.partitionBy("qid").orderBy(F.coalesce("tier", F.lit(5)), "prank", "disc")).alias("ord"))
        frontier = materialize(nxt, f"bfs-level{depth}")
        levels.append(frontier)
        if not frontier.limit(1).count():
            break
    out = spark.createDataFrame([], frontier.drop("ord").schema) if not levels else levels[0].drop("ord")
    for level in levels[1:]:
        out = out.unionByName(level.drop("ord"))
    return out


def _details(nodes_of: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """What admissibility asks about the nodes among ids (one column)."""

    def of(ids: DataFrame) -> DataFrame:
        few = materialize(ids.select(F.col(ids.columns[0]).alias("id")).distinct(), "bfs-ids")
        return nodes_of(bounded(few)).select("id", "tier", "matter_id", "valid_to")

    return of


def neighborhood(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, max_hops: int, scope: str | None = None, ceiling: int | None = None) -> DataFrame:
    """(node, depth) within ``max_hops`` of any seed (node), over edges both ways, through admissible nodes only.

    A level is one table of its new nodes. As edges go both ways, a neighbour
    of a level lies in that level, the one before, or is new: only these two
    are read to tell, so what is read and written is linear in what is found.
    A small level travels to the edges and what it meets to the nodes, which
    then are not shuffled.
    """
    allowed = nodes.select(F.col("id").alias("node"), "tier", "matter_id")
    if ceiling:
        allowed = allowed.filter(F.col("tier").isNull() | (F.col("tier") <= ceiling))
    if scope:
        allowed = allowed.filter(F.col("matter_id").isNull() | (F.col("matter_id") == scope))
    allowed = allowed.select("node")
    both = both_ways(edges).select("node", "other")
    levels = [materialize(seeds.select("node").distinct().join(allowed, "node", "left_semi"), "near0")]
    for depth in range(1, max_hops + 1):
        front = bounded(levels[-1])
        met = both.join(front, "node", "left_semi").select(F.col("other").alias("node")).distinct()
        for level in levels[-2:]:
            met = met.join(level, "node", "left_anti")
        met = bounded(materialize(met, f"near{depth}-met"))
        levels.append(materialize(allowed.join(met, "node", "left_semi").distinct(), f"near{depth}"))
        if not levels[-1].limit(1).count():
            break
    out = levels[0].withColumn("depth", F.lit(0))
    for depth, level in enumerate(levels[1:], 1):
        out = out.unionByName(level.withColumn("depth", F.lit(depth)))
    return out


def path_nodes(path: Column) -> Column:
    return F.filter(path, lambda _, i: i % 2 == 0)


def path_edges(path: Column) -> Column:
    return F.filter(path, lambda _, i: i % 2 == 1)


def crosswalk_seeds(refs: DataFrame, crosswalk: DataFrame, nodes: DataFrame) -> DataFrame:
    """(qid, node, reason): the other side of each (qid, act, section) reference whose section node exists.

    The act's name up to its comma picks the direction: from the source act
    first, else from the target act.
    """
    head = lambda c: F.substring_index(F.lower(c), ",", 1)
    key = lambda c: F.regexp_replace(F.lower(F.trim(c)), " ", "")
    cw = crosswalk.withColumn("s_act", head(F.col("source_act"))).withColumn("t_act", head(F.col("target_act")))
    forward = head(F.col("act")).startswith(F.col("s_act")) & (key(F.col("section")) == key(F.col("source_section")))
    backward = ~head(F.col("act")).startswith(F.col("s_act")) & head(F.col("act")).startswith(F.col("t_act")) & (key(F.col("section")) == key(F.col("target_section")))
    one = refs.join(cw, forward).select("qid", "target_act", F.col("target_section").alias("to"), F.concat(F.lit("crosswalk:"), "name", F.lit(":"), "section", F.lit("->"), "target_section").alias("reason"))
    two = refs.join(cw, backward).select("qid", F.col("source_act").alias("target_act"), F.col("source_section").alias("to"), F.concat(F.lit("crosswalk:"), "name", F.lit(":"), "source_section", F.lit("<-"), "section").alias("reason"))
    from plinth.functions.text import act_token

    found = one.unionByName(two).select("qid", F.concat(F.lit("section:"), act_token(F.col("target_act")), F.lit(":"), F.lower(F.trim("to"))).alias("node"), "reason")
    return found.join(nodes.select(F.col("id").alias("node")), "node", "left_semi").select("qid", "node", "reason")


def first_seen(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Distinct rows by ``keys``, the first by ``order`` of each."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_k = 1").drop("_k")
