"""Evaluation metrics, one aggregate per dataset, and their thresholds.

Result rows: dataset, item_id, answer, pack_spans array<string>, pack_tiers
array<int>, pack_nodes array<string>, cite_labels array<string>, cite_ok
array<boolean> (excerpt and span id present), refused boolean, latency double,
and the gold columns expected_sections, expected_nodes, expected_target,
expected_tier1 (null where there is none).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth import schema
from plinth.functions import text as fx
from plinth.operators.grounding import HEADERS
from plinth.session import materialize
from plinth.sizes import bounded

# ---- fixed values: thresholds of the evaluation gate; None lifts a default ------------------------
THRESHOLDS = {
    "_default": {"min": {"citation_faithfulness": 0.95, "span_citation_correctness": 0.80, "retrieval_coverage": 0.50, "retrieval_hit_rate": 0.80, "tier1_anchor_rate": 0.50}, "max": {"fabricated_marker_rate": 0.02, "latency_p95_s": 8.0}},
    "offence_ingredients_ipc_bns": {"min": {"grounding_rate": 0.75, "retrieval_hit_rate": 0.90, "retrieval_coverage": 0.75, "tier1_anchor_rate": 0.75, "crosswalk_mapping_accuracy": 0.80, "true_refusal_rate": 0.90}, "max": {"false_refusal_rate": 0.20, "refusal_rate": 0.25}},
    "procedure_crpc_bnss": {"min": {"grounding_rate": 0.70, "retrieval_hit_rate": 0.80, "retrieval_coverage": 0.70, "tier1_anchor_rate": 0.70}, "max": {"false_refusal_rate": 0.30}},
    "evidence_iea_bsa": {"min": {"grounding_rate": 0.75, "retrieval_hit_rate": 0.80, "retrieval_coverage": 0.80, "tier1_anchor_rate": 0.70}, "max": {"false_refusal_rate": 0.20}},
    "private_matter_qa": {"min": {"citation_faithfulness": 0.95, "retrieval_coverage": 0.15, "tier1_anchor_rate": None, "retrieval_hit_rate": None, "span_citation_correctness": 0.80}, "max": {"fabricated_marker_rate": 0.02, "false_refusal_rate": 0.90}},
}
METRICS = (
    "items", "grounding_rate", "unsupported_claim_rate", "fabricated_marker_rate", "citation_faithfulness", "span_citation_correctness", "pack_utilisation", "tier1_anchor_rate",
    "retrieval_hit_rate", "retrieval_coverage", "refusal_rate", "false_refusal_rate", "true_refusal_rate", "crosswalk_mapping_accuracy", "latency_mean_s", "latency_p50_s", "latency_p95_s",
    "latency_max_s",
)


def claim_sentences(answer: Column) -> Column:
    """Sentences of the answer's lines without their section labels; the next one starts after white space."""
    def unlabel(line: Column) -> Column:
        bare = F.trim(line)
        out = bare
        for h in HEADERS:
            out = F.when(F.lower(bare).startswith(h + ":"), F.trim(F.substring(bare, len(h) + 2, 1_000_000))).otherwise(out)
        return out

    lines = F.filter(F.transform(F.split(F.coalesce(answer, F.lit("")), "\r?\n"), unlabel), lambda x: x != "")
    marked = F.regexp_replace(F.array_join(lines, " "), r"([.!?])\s+", "$1\u0001")
    parts = F.filter(F.transform(F.split(marked, "\u0001"), lambda s: F.trim(s)), lambda s: s != "")
    return F.filter(parts, lambda s: ~F.regexp_replace(F.lower(s), ":+$", "").isin(*HEADERS))


def norm(text: Column) -> Column:
    return F.replace(F.replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), F.lit(" "), F.lit("")), F.lit("."), F.lit(""))


def item_facts(results: DataFrame) -> DataFrame:
    """One row of counts per item; every metric is a ratio of their sums."""
    claims = claim_sentences(F.col("answer"))
    found = fx.markers(F.col("answer"))
    known = F.transform(F.coalesce("pack_spans", F.array().cast("array<string>")), lambda s: F.concat(F.lit("S"), F.regexp_replace(s, "^S", "")))
    staged = results.withColumn("claims", claims).withColumn("found", found).withColumn("known", known)
    sections = F.filter(F.transform(F.coalesce("expected_sections", F.array().cast("array<string>")), norm), lambda s: s != "")
    wanted = F.transform(F.coalesce("expected_nodes", F.array().cast("array<string>")), norm)
    by_node = F.arrays_overlap(F.transform("pack_nodes", norm), wanted)
    labels = F.transform("cite_labels", norm)
    by_label = F.exists(labels, lambda a: F.exists(sections, lambda e: a.contains(e) | e.contains(a)))
    expects = (F.size(F.coalesce("expected_sections", F.array().cast("array<string>"))) > 0) | (F.size(wanted) > 0)
    answerable = expects | F.col("expected_target").isNotNull() | F.coalesce("expected_tier1", F.lit(False))
    return staged.select(
        "dataset", "item_id", F.size("claims").alias("claims"), F.size(F.filter("claims", lambda s: s.rlike(r"\[S\d+\]"))).alias("cited"), F.size("found").alias("marks"),
        F.size(F.filter("found", lambda m: ~F.array_contains(F.col("known"), m))).alias("foreign"), F.size("cite_ok").alias("cites"), F.size(F.filter("cite_ok", lambda x: x)).alias("cites_ok"),
        F.when(F.size("known") > 0, F.size(F.array_intersect(F.array_distinct("found"), "known")) / F.size(F.array_distinct("known"))).alias("used_share"),
        F.array_contains("pack_tiers", 1).cast("int").alias("anchored"), F.when(expects, (by_node | by_label).cast("int")).alias("hit"), (F.size("known") > 0).cast("int").alias("covered"),
        F.col("refused").cast("int").alias("refused"), answerable.alias("answerable"),
        F.when(F.col("expected_target").isNotNull(), F.exists("cite_labels", lambda x: F.lower(x).contains(F.lower("expected_target"))).cast("int")).alias("mapped"), "latency",
    )


#: Parts that a range of values is cut into, and values that are ranked at once.
BINS, RANKED = 1024, 10_000


def nearest_ranks(rows: DataFrame, group: str, value: str, shares: tuple[float, ...]) -> DataFrame:
    """(group, share, picked): the value at round-half-even(share * (n - 1)) of each group's values in order, nulls left out.

    No task meets all values of a group: counts of BINS equal parts of a
    group's range tell which part holds the rank, that part is cut again, and
    so on until a part holds RANKED values at most, or one alone.
    """
    spark = rows.sparkSession
    values = rows.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).filter("v is not null")
    spans = values.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    share = F.explode(F.array(*map(F.lit, shares))).alias("share")
    open_spans = materialize(spans.select("g", "n", "low", "high", share).withColumn("rank", F.rint(F.col("share") * (F.col("n") - 1)).cast("long")), "rank-spans")
    wide = (F.col("n") > RANKED) & (F.col("low") < F.col("high"))
    closed = []
    while open_spans.filter(wide).limit(1).count():
        closed.append(open_spans.filter(~wide))
        part = F.least(F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * BINS), F.lit(BINS - 1))
        met = values.join(bounded(open_spans.filter(wide).drop("n")), "g").filter(F.col("v").between(F.col("low"), F.col("high")))
        bins = met.groupBy("g", "share", "rank", part.alias("part")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        before = F.sum("n").over(Window.partitionBy("g", "share").orderBy("part")) - F.col("n")
        found = bins.withColumn("before", before).filter((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n")))
        open_spans = materialize(found.select("g", "n", "low", "high", "share", (F.col("rank") - F.col("before")).alias("rank")), "rank-spans")
    for part in closed:
        open_spans = open_spans.unionByName(part)
    single = open_spans.filter("low = high").select("g", "share", F.col("low").alias("picked"))
    few = values.join(bounded(open_spans.filter("low < high").drop("n")), "g").filter(F.col("v").between(F.col("low"), F.col("high")))
    placed = few.withColumn("at", F.row_number().over(Window.partitionBy("g", "share").orderBy("v")) - 1).filter("at = rank")
    return single.unionByName(placed.select("g", "share", F.col("v").alias("picked"))).withColumnRenamed("g", group)


def summarise(results: DataFrame) -> DataFrame:
    """The 18 figures of each dataset; empty denominators give 0."""
    ratio = lambda a, b: F.coalesce(F.sum(a).cast("double") / F.nullif(F.sum(b).cast("double"), F.lit(0.0)), F.lit(0.0))
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    facts = item_facts(results)
    out = facts.groupBy("dataset").agg(
        F.count("*").cast("double").alias("items"), ratio("cited", "claims").alias("grounding_rate"), (1 - ratio("cited", "claims")).alias("unsupported_claim_rate"),
        ratio("foreign", "marks").alias("fabricated_marker_rate"), ratio(F.col("marks") - F.col("foreign"), "marks").alias("citation_faithfulness"), ratio("cites_ok", "cites").alias("span_citation_correctness"),
        mean("used_share").alias("pack_utilisation"), mean("anchored").alias("tier1_anchor_rate"), mean("hit").alias("retrieval_hit_rate"), mean("covered").alias("retrieval_coverage"),
        mean("refused").alias("refusal_rate"), mean(F.when(F.col("answerable"), F.col("refused"))).alias("false_refusal_rate"), mean(F.when(~F.col("answerable"), F.col("refused"))).alias("true_refusal_rate"),
        mean("mapped").alias("crosswalk_mapping_accuracy"), mean("latency").alias("latency_mean_s"), F.coalesce(F.max("latency"), F.lit(0.0)).alias("latency_max_s"),
    )
    ranks = nearest_ranks(facts, "dataset", "latency", (0.5, 0.95)).groupBy("dataset").agg(F.max(F.when(F.col("share") == 0.5, F.col("picked"))).alias("p50"), F.max(F.when(F.col("share") == 0.95, F.col("picked"))).alias("p95"))
    joined = out.join(ranks, "dataset", "left")
    return joined.select(*METRICS[:15], "dataset", F.coalesce("p50", F.lit(0.0)).alias("latency_p50_s"), F.coalesce("p95", F.lit(0.0)).alias("latency_p95_s"), "latency_max_s")


def threshold_rows(thresholds: dict = THRESHOLDS) -> list[tuple[str, str, str, float | None]]:
    return [(d, kind, m, v) for d, spec in thresholds.items() for kind, wanted in spec.items() for m, v in wanted.items()]


def violations(summary: DataFrame, thresholds: dict = THRESHOLDS) -> DataFrame:
    """(dataset, metric, kind, observed, required): defaults, overridden or lifted by the dataset's own."""
    spark = summary.sparkSession
    table = schema.inline(spark, threshold_rows(thresholds), "name, kind, metric, value").withColumn("value", F.col("value").cast("double"))
    pairs = ", ".join(f"'{m}', {m}" for m in METRICS)
    long = summary.select("dataset", F.expr(f"stack({len(METRICS)}, {pairs}) as (metric, observed)"))
    default = table.filter("name = '_default'").select("metric", "kind", F.col("value").alias("d"))
    own = table.filter("name <> '_default'").select(F.col("name").alias("dataset"), "metric", "kind", F.col("value").alias("o"), F.lit(True).alias("given"))
    kinds = long.withColumn("kind", F.explode(F.array(F.lit("min"), F.lit("max"))))
    joined = kinds.join(default, ["metric", "kind"], "left").join(own, ["dataset", "metric", "kind"], "left")
    required = F.when(F.col("given"), F.col("o")).otherwise(F.col("d"))
    bad = F.when(F.col("kind") == "min", F.col("observed") + 1e-9 < F.col("required")).otherwise(F.col("observed") > F.col("required") + 1e-9)
    return joined.withColumn("required", required).filter(F.col("required").isNotNull() & bad).select("dataset", "metric", "kind", "observed", "required")
