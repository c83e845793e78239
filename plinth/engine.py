"""The engine's front: ingest documents into a graph, answer batches of questions, evaluate the answers.

Everything is a set operation: documents, questions and results are tables,
and each step returns tables.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plinth import schema
from plinth.functions import extract
from plinth.functions import text as fx
from plinth.operators import graph, grounding, metrics, retrieval, segment, vector
from plinth.session import materialize
from plinth.sizes import bounded
from plinth.sources.sinks import Mirror
from plinth.streaming import trace

_PROPS = ("number", "act_ref", "section_ref", "parent_ref", "case_ref", "document_ref", "matter_ref", "label", "name", "level", "title", "filename", "kind", "short_title", "jurisdiction", "heading")


@dataclass
class Corpus:
    """What ingestion yields: provenance, graph, index points, and what the schema rejected."""

    episodes: DataFrame
    spans: DataFrame
    nodes: DataFrame
    edges: DataFrame
    points: DataFrame
    rejected_nodes: DataFrame
    rejected_edges: DataFrame


def _hash_id(prefix: str, *parts: str) -> Column:
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 24))


def spans_of(documents: DataFrame) -> DataFrame:
    """Source spans with stable ids from documents (id, kind, text, matter_id)."""
    cut = segment.segment(documents)
    return cut.join(documents.select("id", "kind", "matter_id"), "id").withColumn("span_id", _hash_id("span", "id", "pos"))


def nodes_of(spans: DataFrame) -> DataFrame:
    """One node per span: acts and sections under their canonical ids, the rest under their document's."""
    private = F.coalesce(F.col("matter_id"), F.lit("public"))
    act = F.first(F.when(F.col("node_type") == "Act", F.col("extra")), ignorenulls=True)
    acts = spans.groupBy("id").agg(act.alias("act"))
    rows = spans.join(acts, "id")
    number = F.regexp_extract("label", r"([0-9]+[A-Za-z]?)\)?$", 1)
    own = F.concat(F.lower("node_type"), F.lit(":"), "id", F.lit(":"), F.col("pos").cast("string"))
    section = F.concat(F.lit("section:"), F.coalesce("act", F.col("id")), F.lit(":"), F.lower(number))
    node_id = F.when((F.col("node_type") == "Act") & F.col("extra").isNotNull(), F.concat(F.lit("act:"), "extra")).when(F.col("node_type") == "Section", section).otherwise(own)
    is_ = lambda *t: F.col("node_type").isin(*t)
    return rows.select(
        node_id.alias("id"), "node_type", graph.authority_tier(F.col("node_type"), F.lit(None).cast("string")).alias("tier"), "matter_id", F.lit(None).cast("string").alias("valid_to"),
        F.substring("text", 1, 2000).alias("text"), "span_id",
        F.when(is_("Section", "Subsection", "Paragraph"), number).alias("number"), F.when(is_("Section"), F.col("act")).alias("act_ref"), F.when(is_("Subsection"), F.col("parent")).alias("section_ref"),
        F.when(is_("Proviso", "Explanation", "Illustration"), F.col("parent")).alias("parent_ref"), F.when(is_("Paragraph"), F.col("id")).alias("case_ref"), F.when(is_("Exhibit"), F.col("id")).alias("document_ref"),
        F.when(is_("Document", "Witness", "Fact"), private).alias("matter_ref"), F.col("label"), F.when(is_("Witness", "Party"), F.col("label")).alias("name"), F.lit(None).cast("string").alias("level"),
        F.lit(None).cast("string").alias("title"), F.when(is_("Document"), F.col("id")).alias("filename"), F.when(is_("Document"), F.col("kind")).alias("kind"),
        F.when(is_("Act"), F.col("label")).alias("short_title"), F.when(is_("Act"), F.lit("IN")).alias("jurisdiction"), F.when(is_("Chapter", "Section"), F.col("label")).alias("heading"),
    )


def entity_nodes(spans: DataFrame, recogniser=None) -> DataFrame:
    """Courts, judges and parties that the spans name, those that a model finds too (``recogniser`` loads it).

    What a public span names is public, whoever else names it; what only
    private spans name belongs to their matter and has an id of its own there.
    """
    text = spans.select(F.col("span_id").alias("id"), "text")
    found = extract.extract_entities(text, recogniser).filter(F.col("kind").isin("Court", "Judge", "Party")).withColumnRenamed("id", "span_id").join(spans.select("span_id", "matter_id"), "span_id")
    key = F.concat(F.lower("kind"), F.lit(":"), fx.slug(F.col("raw")))
    named = found.withColumn("key", key).withColumn("public", F.max(F.col("matter_id").isNull()).over(Window.partitionBy("key")))
    own = F.when(F.col("public"), F.col("key")).otherwise(F.concat("key", F.lit("@"), "matter_id"))
    none = F.lit(None).cast("string")
    props = {"name": F.col("raw"), "level": F.when((F.col("kind") == "Court") & ~F.col("extra").startswith("model"), F.col("extra")), "label": F.col("raw")}
    rows = named.select(own.alias("id"), F.col("kind").alias("node_type"), graph.authority_tier(F.col("kind"), F.col("extra")).alias("tier"), F.when(~F.col("public"), F.col("matter_id")).alias("matter_id"), none.alias("valid_to"), F.col("raw").alias("text"), "span_id", *(props.get(p, none).alias(p) for p in _PROPS), F.col("matter_id").isNotNull().alias("private_span"))
    return graph.first_seen(rows, ["id"], ["private_span", "span_id"]).drop("private_span")


def edges_of(spans: DataFrame, nodes: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """Provenance, hierarchy, reference, citation and crosswalk edges, typed by their ends."""
    origin = nodes.select(F.lit("NODE_DERIVED_FROM_SOURCE").alias("edge_type"), F.col("id").alias("src"), F.col("span_id").alias("dst"), F.col("node_type").alias("src_type"), F.lit("SourceSpan").alias("dst_type"), F.lit(None).cast("string").alias("as_of"))
    sections = nodes.filter("node_type = 'Section' and act_ref is not null")
    holds = sections.select(F.lit("CHAPTER_CONTAINS_SECTION").alias("edge_type"), F.concat(F.lit("act:"), "act_ref").alias("src"), F.col("id").alias("dst"), F.lit("Act").alias("src_type"), F.lit("Section").alias("dst_type"), F.lit(None).cast("string").alias("as_of"))
    refs = nodes.filter("node_type = 'Paragraph'").select("id", F.explode(fx.section_refs(F.col("text"))).alias("r"))
    names = refs.select(F.lit("CASE_INTERPRETS_SECTION").alias("edge_type"), F.col("id").alias("src"), fx.section_node(F.col("r.act"), F.col("r.section")).alias("dst"), F.lit("Paragraph").alias("src_type"), F.lit("Section").alias("dst_type"), F.lit(None).cast("string").alias("as_of"))
    cites = nodes.filter("node_type = 'Paragraph'").select("id", F.explode(fx.citations(F.col("text"))).alias("c"))
    cited = cites.select(F.lit("CASE_CITES_CASE").alias("edge_type"), F.col("id").alias("src"), F.col("c.canonical_id").alias("dst"), F.lit("Paragraph").alias("src_type"), F.lit("Case").alias("dst_type"), F.lit(None).cast("string").alias("as_of"))
    own = F.concat(F.lit("section:"), fx.act_token(F.col("source_act")), F.lit(":"), F.lower("source_section"))
    base = F.concat(F.lit("section:"), fx.act_token(F.col("target_act")), F.lit(":"), F.lower(F.regexp_replace("target_section", r"\(.*$", "")))
    ids = sections.select(F.col("id").alias("sid")).distinct()
    cw = crosswalk.select(own.alias("src"), base.alias("dst"))
    touched = cw.join(ids, F.col("src") == F.col("sid")).drop("sid").unionByName(cw.join(ids, F.col("dst") == F.col("sid")).drop("sid")).distinct()
    mapped = touched.select(F.lit("SECTION_CROSSWALK_TO").alias("edge_type"), "src", "dst", F.lit("Section").alias("src_type"), F.lit("Section").alias("dst_type"), F.lit("2024-07-01").alias("as_of"))
    out = origin.unionByName(holds).unionByName(names).unionByName(cited).unionByName(mapped).distinct()
    return out.withColumn("props", F.when(F.col("as_of").isNotNull(), F.create_map(F.lit("as_of"), F.col("as_of"))).otherwise(F.create_map().cast("map<string,string>")))


def ingest(documents: DataFrame, crosswalk: DataFrame | None = None, recogniser=None, mirror: Mirror | None = None) -> Corpus:
    """Documents (id, kind, text, matter_id) to graph and index; what the schema forbids is set aside, not lost.

    ``recogniser`` loads a model that finds entities beside the patterns;
    ``mirror`` gets a copy of the episodes.
    """
    spark = documents.sparkSession
    trace.emit("ingest", "start", "ingest")
    crosswalk = crosswalk if crosswalk is not None else schema.dim_crosswalk(spark)
    episodes = documents.select(_hash_id("ep", "id").alias("id"), F.when(F.col("matter_id").isNull(), "public").otherwise("private").alias("kind"), F.col("id").alias("file_id"), F.sha2("text", 256).alias("hash"), "matter_id")
    spans = materialize(spans_of(documents), "ingest-spans")
    made = materialize(nodes_of(spans).unionByName(entity_nodes(spans, recogniser)), "ingest-nodes")
    props = F.create_map(*(x for p in _PROPS for x in (F.lit(p), F.col(p))))
    missing = graph.missing_properties(made.select("id", "node_type", F.map_filter(props, lambda k, v: v.isNotNull()).alias("props")), schema.dim_required(spark)).filter("prop <> 'decision_date'")
    nodes = made.join(missing.select("id").distinct(), "id", "left_anti")
    nodes = materialize(graph.first_seen(nodes, ["id"], ["span_id"]), "ingest-valid-nodes")
    edges = edges_of(spans, nodes, crosswalk)
    bad = graph.edge_violations(edges, schema.dim_edge_schema(spark))
    good = edges.join(bad.select("edge_type", "src", "dst"), ["edge_type", "src", "dst"], "left_anti")
    ends = nodes.select("id").unionByName(spans.select(F.col("span_id").alias("id"))).distinct()
    both = good.join(ends, good["src"] == ends["id"], "left_semi").join(ends, good["dst"] == ends["id"], "left_semi")
    points = vector.points_of(nodes.withColumn("seq", F.lit(0)))
    if mirror is not None:
        group = F.coalesce("matter_id", F.lit("public"))
        mirror.add(spans.select(F.col("label").alias("name"), F.col("text").alias("body"), F.concat(F.lit(graph.SPAN_PREFIX), "span_id").alias("source_description"), group.alias("group_id")))
    trace.emit("ingest", "done", "ingest")
    return Corpus(episodes, spans, nodes, materialize(both, "ingest-edges"), points, missing, bad)


#: (questions, corpus, k) to (qid, node): what proposes seeds where a question names nothing.
SeedProvider = Callable[[DataFrame, Corpus, int], DataFrame]


def seeds(questions: DataFrame, corpus: Corpus, crosswalk: DataFrame, semantic_k: int = schema.SEED_K, provider: SeedProvider | None = None) -> DataFrame:
    """(qid, node, pos, reason): where each question enters the graph.

    In order: section references, their crosswalk twins, acts it names, its
    matter's witnesses and exhibits; similar points (or what ``provider``
    proposes) only where all of that finds less than SEED_MIN.
    """
    ids = corpus.nodes.select(F.col("id").alias("node"))
    refs = questions.select("qid", F.explode(fx.section_refs(F.col("question"))).alias("r")).select("qid", "r.*")
    direct = refs.select("qid", fx.section_node(F.col("act"), F.col("section")).alias("node"), F.lit(1).alias("pos"), F.concat(F.lit("section_ref:"), "raw").alias("reason"))
    twins = graph.crosswalk_seeds(refs.select("qid", "act", "section"), crosswalk, corpus.nodes).select("qid", "node", F.lit(2).alias("pos"), "reason")
    acts = questions.select("qid", F.explode(fx.act_mentions(F.col("question"))).alias("node"), F.lit(4).alias("pos"), F.lit("act_mention").alias("reason"))
    labels = questions.filter("matter_scope is not null").select("qid", "matter_scope", F.explode(F.concat(fx.witness_labels(F.col("question")), fx.exhibit_labels(F.col("question")))).alias("wanted"))
    named = corpus.nodes.filter(F.col("node_type").isin("Witness", "Exhibit")).select(F.col("id").alias("node"), F.lower("label").alias("key"), "matter_id")
    private = labels.join(named, F.lower("wanted") == F.col("key")).filter(F.col("matter_id").isNull() | (F.col("matter_id") == F.col("matter_scope"))).select("qid", "node", F.lit(5).alias("pos"), F.concat(F.lit("entity:"), "wanted").alias("reason"))
    found = direct.unionByName(twins).unionByName(acts).unionByName(private).join(ids, "node", "left_semi")
    thin = questions.join(found.groupBy("qid").count().filter(F.col("count") >= schema.SEED_MIN), "qid", "left_anti")
    near = (provider or recall)(thin, corpus, semantic_k).select("qid", "node", F.lit(6).alias("pos"), F.lit("semantic_seed").alias("reason"))
    every = found.select("qid", "node", "pos", "reason").unionByName(near)
    return graph.first_seen(every, ["qid", "node"], ["pos", "reason"])


def recall(questions: DataFrame, corpus: Corpus, k: int = schema.RECALL_K, models: Sequence[Callable[[], vector.Embedder]] = ()) -> DataFrame:
    """(qid, node, tier, sem, excerpt) of the ``k`` most similar points within each question's scope.

    Both sides are embedded by the first of ``models`` that works, by hash
    where none does.
    """
    points = corpus.points.select(F.col("id").alias("node"), "tier", "matter_id", F.substring("text", 1, 800).alias("excerpt"), vector.index_text(F.col("label"), F.col("text")).alias("body"))
    stored = vector.embed(points, "node", "body", models, keep=["matter_id"]).withColumnRenamed("node", "id")
    asked = vector.embed(questions, "qid", "question", models, keep=["matter_scope"]).withColumnRenamed("matter_scope", "scope")
    found = bounded(materialize(vector.nearest(materialize(asked, "recall-questions"), stored, k), "recall-found"))  # vectors are never shuffled
    return found.join(points, found["id"] == points["node"]).select("qid", "node", "tier", F.col("sim").alias("sem"), "excerpt")


#: Candidates (qid, node, tier, score, sem, question, title, body, yr) to the same rows with their ``rank``.
Reranker = Callable[[DataFrame], DataFrame]


def evidence(
    questions: DataFrame, corpus: Corpus, crosswalk: DataFrame | None = None, mode: str = "graph_semantic_rerank", reranker: Reranker = retrieval.rank_composite,
    models: Sequence[Callable[[], vector.Embedder]] = (), seed_provider: SeedProvider | None = None, mirror: Mirror | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(packs, summaries, questions with intent) for questions (qid, question, matter_scope, ceiling, as_of).

    ``mode``: graph_only, graph_semantic or graph_semantic_rerank. ``mirror``
    may add hits of an outside search for nodes that the graph did not give.
    """
    spark = questions.sparkSession
    crosswalk = crosswalk if crosswalk is not None else schema.dim_crosswalk(spark)
    asked = questions.withColumn("intent", fx.intent(F.col("question"), F.col("matter_scope").isNotNull()))
    near = lambda q, c, k: recall(q, c, k, models)
    trace.emit("retrieve", "start", "retrieve", mode=mode)
    found = graph.typed_bfs(corpus.nodes, corpus.edges, asked, seeds(asked, corpus, crosswalk, provider=seed_provider or near), schema.dim_policy(spark))
    detail = corpus.nodes.select(F.col("id").alias("node"), "tier", "text", "label", "node_type", "matter_id", "span_id")
    cand = found.join(detail.select("node", "tier", F.col("text").alias("excerpt")), "node").select("qid", "node", "tier", F.round(1.0 / (1 + F.col("depth")), 6).alias("score"), "excerpt")
    if mode == "graph_only":
        merged = cand.withColumn("sem", F.lit(0.0))
    else:
        merged = retrieval.merge_candidates(cand, near(asked, corpus, schema.RECALL_K))
    full = merged.drop("excerpt").join(detail.drop("tier"), "node").join(asked.select("qid", "question", "matter_scope"), "qid")
    full = full.filter(F.col("matter_id").isNull() | (F.col("matter_id") == F.col("matter_scope")))
    if mirror is not None and mirror.available:
        full = full.unionByName(retrieval.outside_hits(mirror.search(asked), full, asked))
    full = full.withColumn("body", F.col("text")).withColumn("title", F.col("label")).withColumn("yr", F.lit(None).cast("int"))
    ranked = retrieval.cut(reranker(full) if mode == "graph_semantic_rerank" else retrieval.rank_default(full))
    ready = ranked.withColumn("excerpt", F.col("text")).withColumn("kind", F.when(F.col("matter_id").isNull(), "public").otherwise("private"))
    packs = materialize(retrieval.evidence_pack(ready), "packs")
    trace.emit("retrieve", "done", "retrieve")
    return packs, retrieval.pack_summary(packs, asked), asked


#: Prompts (qid, question, prompt) to drafts (qid, text).
Provider = Callable[[DataFrame], DataFrame]


def provider_for(name: str | None, providers: dict[str, Provider | None], preferred: Sequence[str] = ("remote", "local")) -> Provider | None:
    """The provider of that name, of ``auto`` the first preferred one that is set up; None is the stub, for unknown names too."""
    if (name or "auto").lower() == "auto":
        return next((providers[p] for p in preferred if providers.get(p)), None)
    return providers.get(name.lower())


def answer(questions: DataFrame, corpus: Corpus, provider: Provider | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(answers, packs): one enforced answer per question.

    ``provider`` drafts from prompts; where it fails, or has no draft for a
    question, the stub answers. ``options`` go to :func:`evidence`.
    """
    packs, summary, asked = evidence(questions, corpus, **options)
    lists = packs.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "marker"))), lambda x: x.marker).alias("allowed"))
    base = asked.select("qid", "question", "intent").join(lists, "qid", "left").join(summary.select("qid", "sufficient"), "qid")
    base = base.withColumn("allowed", F.coalesce("allowed", F.array().cast("array<string>"))).withColumn("stub", grounding.stub_answer(F.col("allowed")))
    drafts = base.withColumn("text", F.col("stub"))
    if provider is not None:
        prompts = grounding.prompt_text(packs.withColumn("label", F.coalesce("label", F.lit(""))))
        wanted = asked.select("qid", "question").join(prompts, "qid").withColumn("prompt", grounding.user_prompt(F.col("question"), F.col("prompt")))
        try:
            made = materialize(provider(wanted).select("qid", F.col("text").alias("made")), "drafts")
            drafts = base.join(made.groupBy("qid").agg(F.max("made").alias("made")), "qid", "left").withColumn("text", F.coalesce("made", "stub")).drop("made")
        except Exception as problem:
            trace.emit("generate", "warn", "generate", message=f"provider failed: {type(problem).__name__}")
    refused = ~F.col("sufficient") | (F.size("allowed") == 0)
    drafts = drafts.withColumn("text", F.when(refused, F.lit(grounding.REFUSAL)).otherwise(F.coalesce("text", F.lit(grounding.REFUSAL))))
    enforced = grounding.enforce(drafts.select("qid", "text", "allowed"))
    final = enforced.join(base.select("qid", "question", "intent"), "qid")
    insufficient = F.col("insufficient") | (F.size("used") == 0)
    return final.withColumn("insufficient", insufficient).withColumn("confidence", F.when(insufficient, "low").otherwise(F.col("confidence"))), packs


def evaluate(answers: DataFrame, packs: DataFrame, gold: DataFrame, dataset: str, latency_s: float = 0.0) -> DataFrame:
    """The 18 figures for answered questions against gold (qid, expected_sections, expected_nodes, expected_target, expected_tier1)."""
    listed = packs.groupBy("qid").agg(F.collect_list("marker").alias("pack_spans"), F.collect_list("tier").alias("pack_tiers"), F.collect_list("node").alias("pack_nodes"))
    cited = answers.select("qid", F.explode("used").alias("marker")).join(packs, ["qid", "marker"]).groupBy("qid").agg(F.collect_list(F.coalesce("label", F.lit(""))).alias("cite_labels"), F.collect_list((F.length("excerpt") > 0) & F.col("span_id").isNotNull()).alias("cite_ok"))
    rows = answers.join(listed, "qid", "left").join(cited, "qid", "left").join(gold, "qid", "left")
    empty = lambda c, t: F.coalesce(c, F.array().cast(f"array<{t}>")).alias(c)
    results = rows.select(F.lit(dataset).alias("dataset"), F.col("qid").alias("item_id"), "answer", empty("pack_spans", "string"), empty("pack_tiers", "int"), empty("pack_nodes", "string"), empty("cite_labels", "string"), empty("cite_ok", "boolean"), F.col("insufficient").alias("refused"), F.lit(latency_s).alias("latency"), "expected_sections", "expected_nodes", "expected_target", "expected_tier1")
    return metrics.summarise(results)


def services(spark: SparkSession) -> DataFrame:
    """The stages as a small table: what each listens to and publishes."""
    rows = [
        ("ingest", "ingest.request", "ingest.completed"), ("segment", "ingest.completed", "segment.completed"), ("enrich", "segment.completed", "enrich.completed"), ("graph_write", "enrich.completed", "graph.written"),
        ("index", "graph.written", "index.completed"), ("retrieve", "query.request", "retrieval.completed"), ("generate", "retrieval.completed", "generation.completed"), ("evaluate", "eval.request", "eval.completed"),
    ]
    return schema.inline(spark, rows, "id, listens, publishes")
