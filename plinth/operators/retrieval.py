"""Ranking and evidence packs for batches of questions, as window plans per question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plinth import schema
from plinth.functions import text as fx
from plinth.operators import lexical


def merge_candidates(graph: DataFrame, semantic: DataFrame) -> DataFrame:
    """Graph rows (qid, node, tier, score, excerpt) and semantic rows (same with ``sem``), one row per node: the graph's fields first, the best semantic score."""
    best = semantic.groupBy("qid", "node").agg(F.max("sem").alias("sem"), F.max_by("tier", "sem").alias("s_tier"), F.max_by("excerpt", "sem").alias("s_excerpt"))
    joined = graph.join(best, ["qid", "node"], "full_outer")
    return joined.select("qid", "node", F.coalesce("tier", "s_tier").alias("tier"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("sem", F.lit(0.0)).alias("sem"), F.coalesce("excerpt", "s_excerpt").alias("excerpt"))


def outside_hits(hits: DataFrame, known: DataFrame, questions: DataFrame) -> DataFrame:
    """Rows like ``known`` for hits (qid, node, tier, score, excerpt) of an outside search whose node the question does not have yet; tier 8 where none is given."""
    fresh = hits.dropDuplicates(["qid", "node"]).join(known.select("qid", "node"), ["qid", "node"], "left_anti").join(questions.select("qid", "question", "matter_scope"), "qid")
    none = F.lit(None).cast("string")
    given = {"qid": F.col("qid"), "node": F.col("node"), "tier": F.coalesce("tier", F.lit(schema.TIER_SUMMARY)), "score": F.coalesce("score", F.lit(0.0)), "sem": F.lit(0.0), "text": F.col("excerpt"), "label": F.col("node"), "node_type": F.lit("SummaryNode"), "question": F.col("question"), "matter_scope": F.col("matter_scope")}
    return fresh.select(*(given.get(c, none).cast(known.schema[c].dataType).alias(c) for c in known.columns))


def _ranked(candidates: DataFrame, *order: Column) -> DataFrame:
    return candidates.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order, F.col("node"))))


def rank_default(candidates: DataFrame) -> DataFrame:
    """Tier, then score, then semantic score; the node id breaks ties."""
    return _ranked(candidates, F.coalesce("tier", F.lit(9)), F.desc("score"), F.desc("sem"))


def authority_score(tier: Column, sem: Column, year: Column) -> Column:
    return F.lit(1.0) / F.greatest(F.coalesce(tier, F.lit(8)), F.lit(1)) + F.lit(0.1) * F.coalesce(sem, F.lit(0.0)) + F.lit(0.05) * fx.recency_bonus(year)


def rank_authority(candidates: DataFrame) -> DataFrame:
    scored = candidates.withColumn("score", authority_score(F.col("tier"), F.col("sem"), F.col("yr")))
    return _ranked(scored, F.desc(F.round("score", 9)))


def lexical_score(question: Column, body: Column, title: Column) -> Column:
    """0.7 Jaccard of the word sets and 0.3 of the share of question words in the title."""
    return lexical.score(fx.lexical_tokens(question), fx.lexical_tokens(body), fx.lexical_tokens(F.coalesce(title, F.lit(""))))


def rank_lexical(candidates: DataFrame) -> DataFrame:
    scored = candidates.withColumn("sem", lexical_score(F.col("question"), F.col("body"), F.col("title")))
    return rank_scored(scored)


def rank_scored(scored: DataFrame) -> DataFrame:
    return _ranked(scored, F.desc(F.round("sem", 9)))


def lexical_best(docs: DataFrame, questions: DataFrame, k: int = schema.RERANK_K, authority: bool = False) -> DataFrame:
    """The ``k`` best of all ``docs`` (node, body, title, tier, yr) for each of ``questions`` (qid, question), as :func:`rank_lexical` or :func:`rank_composite` orders all pairs; an inverted index finds them."""
    static = authority_score(F.col("tier"), F.lit(0.0), F.col("yr")) if authority else F.lit(0.0)
    words = docs.withColumn("static", static).withColumn("words", fx.lexical_tokens(F.coalesce("body", F.lit("")))).withColumn("title", fx.lexical_tokens(F.coalesce("title", F.lit(""))))
    asked = questions.select("qid", fx.lexical_tokens(F.coalesce("question", F.lit(""))).alias("words"))
    found = lexical.candidates(words.select("node", "words", "title", "static", "tier", "yr"), asked, k, 0.1 if authority else 1.0)
    return cut(rank_authority(found) if authority else rank_scored(found), k)


def rank_composite(candidates: DataFrame) -> DataFrame:
    """Lexical scores feed the authority order."""
    return rank_authority(candidates.withColumn("sem", lexical_score(F.col("question"), F.col("body"), F.col("title"))))


def cut(ranked: DataFrame, k: int = schema.RERANK_K) -> DataFrame:
    return ranked.filter(F.col("rank") <= k)


def label_of(node_type: Column, number: Column, act: Column, section_ref: Column) -> Column:
    """``Section N act``, ``para N``, or the section reference; "section" also fits subsections."""
    kind = F.lower(node_type)
    return F.when(kind.contains("section") & number.isNotNull(), F.trim(F.concat_ws(" ", F.lit("Section"), number, act))).when(kind.contains("paragraph") & number.isNotNull(), F.concat(F.lit("para "), number)).otherwise(section_ref)


def evidence_pack(ranked: DataFrame, max_spans: int = schema.PACK_SPANS, max_tokens: int = schema.PACK_TOKENS, tier_cap: int = schema.PACK_TIER) -> DataFrame:
    """Spans of each question's pack, numbered S1..Sn.

    ``ranked``: qid, node, tier, rank, excerpt (null rows cannot be evidence).
    At most ``tier_cap`` of a tier, then ``max_spans``, then the longest prefix
    within ``max_tokens``; the first span always stays.
    """
    usable = ranked.filter("excerpt is not null").withColumn("tier", F.coalesce("tier", F.lit(schema.TIER_SUMMARY))).withColumn("excerpt", F.substring("excerpt", 1, 1200)).withColumn("tokens", fx.token_estimate(F.col("excerpt")))
    by_tier = Window.partitionBy("qid", "tier").orderBy("rank", "node")
    by_rank = Window.partitionBy("qid").orderBy("rank", "node")
    kept = usable.withColumn("_t", F.row_number().over(by_tier)).filter(F.col("_t") <= tier_cap)
    kept = kept.withColumn("_n", F.row_number().over(by_rank)).filter(F.col("_n") <= max_spans)
    kept = kept.withColumn("_sum", F.sum("tokens").over(by_rank.rowsBetween(Window.unboundedPreceding, 0)))
    kept = kept.filter((F.col("_sum") <= max_tokens) | (F.col("_n") == 1))
    return kept.withColumn("marker", F.concat(F.lit("S"), F.col("_n").cast("string"))).withColumn("pos", F.col("_n")).drop("_t", "_n", "_sum")


def force_tier1(packs: DataFrame, ranked: DataFrame, questions: DataFrame, max_tokens: int = schema.PACK_TOKENS) -> DataFrame:
    """Statute questions whose pack lacks a tier-1 span get their best one; over budget, the weakest span leaves for it.

    ``packs`` as from :func:`evidence_pack` with ``score``; ``questions``: qid, intent.
    """
    statute = questions.filter(F.col("intent").isin(*schema.STATUTE_INTENTS)).select("qid")
    lacking = statute.join(packs.filter("tier = 1").select("qid").distinct(), "qid", "left_anti")
    best = ranked.filter("tier = 1 and excerpt is not null").join(lacking, "qid", "left_semi")
    best = best.withColumn("_k", F.row_number().over(Window.partitionBy("qid").orderBy("rank", "node"))).filter("_k = 1").drop("_k")
    best = best.withColumn("excerpt", F.substring("excerpt", 1, 1200)).withColumn("tokens", fx.token_estimate(F.col("excerpt")))
    spent = packs.groupBy("qid").agg(F.sum("tokens").alias("spent"))
    over = best.join(spent, "qid").filter(F.col("spent") + F.col("tokens") > max_tokens).select("qid")
    weakest = packs.join(over, "qid", "left_semi").withColumn("_w", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("tier"), "score", "pos"))).filter("_w = 1").select("qid", "node")
    names = ["qid", "node", "tier", "score", "excerpt", "tokens"]
    left = packs.join(weakest, ["qid", "node"], "left_anti").select(*names, "pos")
    added = best.select(*names, F.lit(10**6).alias("pos"))
    return left.unionByName(added).withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy("pos", "node"))).withColumn("marker", F.concat(F.lit("S"), F.col("pos").cast("string")))


def pack_summary(packs: DataFrame, questions: DataFrame) -> DataFrame:
    """qid, n_spans, tokens, sufficient, confidence of every question, from one aggregate."""
    agg = packs.groupBy("qid").agg(F.count("*").alias("n_spans"), F.sum("tokens").alias("tokens"), F.min("tier").alias("best"), F.slice(F.sort_array(F.collect_list("tier")), 1, 3).alias("top"))
    joined = questions.select("qid", "intent").join(agg, "qid", "left")
    statute = F.col("intent").isin(*schema.STATUTE_INTENTS)
    mean = F.aggregate("top", F.lit(0.0), lambda a, x: a + x) / F.size("top")
    confidence = F.when(F.col("n_spans").isNull(), "low").when(statute & (F.col("best") != 1), "low").when((mean <= 2.5) & (F.col("n_spans") >= 2), "high").when(mean <= 4.5, "medium").otherwise("low")
    sufficient = F.coalesce(F.col("n_spans") > 0, F.lit(False)) & (~statute | (F.coalesce("best", F.lit(9)) <= schema.TIER_HIGH))
    return joined.select("qid", F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("tokens", F.lit(0)).alias("tokens"), sufficient.alias("sufficient"), confidence.alias("confidence"))


def conflicts(packs: DataFrame) -> DataFrame:
    """(qid, topic, tiers, markers, severity): one label under two tiers or more, at least one of them binding."""
    keyed = packs.withColumn("topic", F.lower(F.trim(F.coalesce("label", F.lit(""))))).filter("topic <> ''")
    grouped = keyed.groupBy("qid", "topic").agg(F.array_sort(F.collect_set("tier")).alias("tiers"), F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "marker"))), lambda x: x.marker).alias("markers"))
    found = grouped.filter((F.col("n") > 1) & (F.size("tiers") > 1) & (F.array_min("tiers") <= schema.TIER_HIGH))
    return found.select("qid", "topic", "tiers", "markers", F.when(F.array_min("tiers") == 1, "high").otherwise("medium").alias("severity"))


def tier_histogram(packs: DataFrame) -> DataFrame:
    return packs.groupBy("qid", "tier").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))
