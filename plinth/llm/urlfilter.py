"""URL filter: a rule list first, gradient-boosted trees on lexical features for the rest.

Trees are grown from histograms: every level is one aggregate over a bounded
sample of labelled URLs, binned by quantiles and summed into distinct bin
vectors, and only the (node, feature, bin) sums reach the driver. The model
is emitted as one native expression.

Defined cases: a null URL or one without ``://`` has empty host and path and is
judged by the model on empty features; a URL of any length is read whole;
repeated rows get equal verdicts;
without labelled rows of both classes the model is the constant base rate; a
null page_id is kept; an empty table gives no rows; extra columns, whatever
their names, are left out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.llm.sizes import bounded
from plinth.session import materialize

#: (host, path, verdict); fixed values of the rule list.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Host words that mark a labelled URL as unwanted when no labels are given (fixed values).
SEED_WORDS = ("ads", "adult", "bets", "casino", "pills", "porn", "spam", "track", "viagra", "win", "xxx")
#: Labelled URLs used at most for training, by the smallest hash of the URL.
TRAIN_ROWS = 50_000
#: Rules that one expression holds at most; longer lists are tables that the hosts are joined with.
MAX_RULES = 40
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789-_."
FEATURES = ("url_length", "host_length", "host_labels", "depth", "digit_ratio", "entropy", "n_hyphens", "n_params", "suffix_rate", "suffix_count", "longest_label")


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first ``://``; the host's A-Z in lower case."""
    text = F.coalesce(url, F.lit(""))
    tail = F.regexp_extract(text, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(tail, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(tail, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does. For MAX_RULES rules at most."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, said in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name, verdict = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name), F.when(fits, F.lit(said)).otherwise(verdict)
    return name, verdict


def with_rules(urls: DataFrame, rules=RULES) -> DataFrame:
    """``urls`` (host, path) with ``rule`` and ``said`` of the longest rule that fits, among equals the last in (host, path, verdict) order.

    ``rules`` is a list or a table (host, path, verdict) of any length. Beyond
    MAX_RULES each distinct host meets the rules of its own name and of the
    domains above it; a host's few rules then stand beside its URLs.
    """
    if not isinstance(rules, DataFrame):
        if len(rules) <= MAX_RULES:
            name, said = rule_of(F.col("host"), F.col("path"), rules)
            return urls.select("*", name.alias("rule"), said.alias("said"))
        rules = urls.sparkSession.createDataFrame(list(rules), "host string, path string, verdict string")
    listed = rules.select(F.col("host").alias("above"), F.struct(F.length(F.concat("host", "path")).alias("n"), "host", "path", "verdict").alias("r"))
    labels = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, 10_000), "."))
    met = urls.select("host").distinct().select("host", F.explode(domains).alias("above")).join(bounded(listed), "above").groupBy("host").agg(F.collect_list("r").alias("rs"))
    met = bounded(materialize(met.withColumnRenamed("host", "rule_host"), "url-host-rules"))
    best = F.array_max(F.filter("rs", lambda r: F.col("path").startswith(r["path"])))
    joined = urls.join(met, urls["host"] == met["rule_host"], "left").withColumn("best", best)
    return joined.select(*urls.columns, F.concat("best.host", "best.path").alias("rule"), F.col("best.verdict").alias("said"))


def lexical(urls: DataFrame) -> DataFrame:
    """``urls`` (with url, host, path) plus its lexical features and ``suffix``, the last label of the host."""
    text, n = F.coalesce(F.col("url"), F.lit("")), F.length("host")
    share = [(n - F.length(F.translate("host", c, ""))) / F.greatest(n, F.lit(1)) for c in ALPHABET]
    entropy = F.lit(0.0)
    for p in share:
        entropy = entropy - F.when(p > 0, p * F.log2(p)).otherwise(0.0)
    query = F.regexp_extract(text, r"(?s)\?([^#]*)", 1)
    labels = F.split("host", r"\.")
    return urls.select(
        "*", F.length(text).cast("double").alias("url_length"), n.cast("double").alias("host_length"), F.size(labels).cast("double").alias("host_labels"),
        (F.length("path") - F.length(F.translate("path", "/", ""))).cast("double").alias("depth"),
        ((F.length(text) - F.length(F.translate(text, "0123456789", ""))) / F.greatest(F.length(text), F.lit(1))).cast("double").alias("digit_ratio"),
        entropy.alias("entropy"), (n - F.length(F.translate("host", "-_", ""))).cast("double").alias("n_hyphens"),
        F.when(query == "", 0.0).otherwise(F.size(F.split(query, "&")).cast("double")).alias("n_params"),
        F.array_max(F.transform(labels, lambda x: F.length(x))).cast("double").alias("longest_label"), F.element_at(labels, -1).alias("suffix"),
    )


def _bin(feature: str, edges: list[float]) -> Column:
    """The least edge at or above the value; past the last edge, one more bin."""
    at_or_above = F.filter(F.array(*map(F.lit, edges)), lambda e: e >= F.col(feature))
    return F.coalesce(F.array_min(at_or_above), F.lit(edges[-1] + 1.0))


@dataclass
class Tree:
    """Splits by node number (root 1, children 2k and 2k + 1) and the value of each leaf."""

    splits: dict[int, tuple[str, float]] = field(default_factory=dict)
    leaves: dict[int, float] = field(default_factory=dict)

    def column(self, node: int = 1) -> Column:
        if node not in self.splits:
            return F.lit(self.leaves.get(node, 0.0))
        feature, cut = self.splits[node]
        return F.when(F.col(feature) <= cut, self.column(2 * node)).otherwise(self.column(2 * node + 1))

    def node_column(self, node: int = 1) -> Column:
        if node not in self.splits:
            return F.lit(node)
        feature, cut = self.splits[node]
        return F.when(F.col(feature) <= cut, self.node_column(2 * node)).otherwise(self.node_column(2 * node + 1))


@dataclass
class Model:
    base: float
    trees: list[Tree]
    suffixes: DataFrame
    default_rate: float

    def with_features(self, urls: DataFrame) -> DataFrame:
        """The lexical features plus the statistics of each host's suffix; suffixes number TRAIN_ROWS at most."""
        stats = self.suffixes.select("suffix", F.col("rate").alias("suffix_rate"), F.col("n").alias("suffix_count"))
        joined = lexical(urls).join(F.broadcast(stats), "suffix", "left")
        return joined.fillna({"suffix_rate": self.default_rate, "suffix_count": 0.0})

    def probability(self) -> Column:
        raw = F.lit(self.base)
        for tree in self.trees:
            raw = raw + tree.column()
        return 1 / (1 + F.exp(-raw))


def seed_labels(urls: DataFrame, words=SEED_WORDS) -> DataFrame:
    """(url, label): label 1 where a word of the host is a seed word."""
    host, _ = split_url(F.col("url"))
    found = F.arrays_overlap(F.split(host, r"[^a-z0-9]+"), F.array(*map(F.lit, words)))
    return urls.filter(F.col("url").contains("://")).select("url", found.cast("int").alias("label"))


def train(labelled: DataFrame, rows: int = TRAIN_ROWS, trees: int = 10, depth: int = 3, bins: int = 16, rate: float = 0.5, ridge: float = 1.0) -> Model:
    """Fit on the ``rows`` labelled URLs with the smallest hashes."""
    sample = labelled.filter(F.col("url").isNotNull() & F.col("label").isNotNull()).groupBy("url").agg(F.max("label").alias("label"))
    sample = sample.withColumn("h", F.xxhash64("url")).orderBy("h", "url").limit(rows)
    host, path = split_url(F.col("url"))
    raw = materialize(lexical(sample.select("url", "label", host.alias("host"), path.alias("path"))), "url-sample")
    count, positive = raw.agg(F.count("*"), F.sum("label")).first()
    prior = (positive or 0) / count if count else 0.0
    suffixes = materialize(raw.groupBy("suffix").agg(((F.sum("label") + 20 * prior) / (F.count("*") + 20)).alias("rate"), F.count("*").cast("double").alias("n")), "url-suffixes")
    base = math.log((prior + 1e-6) / (1 - prior + 1e-6))
    model = Model(base, [], suffixes, prior)
    if not count or not positive or positive == count:
        return model
    rows_in = model.with_features(raw.select("url", "host", "path", "label"))
    cuts = rows_in.agg(*(F.percentile_approx(f, [(i + 1) / bins for i in range(bins - 1)], 1000).alias(f) for f in FEATURES)).first()
    edges = {f: sorted(set(cuts[f])) for f in FEATURES}
    # a feature that is constant but for a tail below the last quantile still gets cuts from the rarer class
    rare = rows_in.filter("label = 1").agg(*(F.percentile_approx(f, [0.1, 0.3, 0.5, 0.7, 0.9], 1000).alias(f) for f in FEATURES)).first()
    edges = {f: sorted({*edges[f], *rare[f], *(x - 1e-9 for x in rare[f])}) for f in FEATURES}
    binned = [_bin(f, edges[f]).alias(f) for f in FEATURES]
    vectors = materialize(rows_in.select(*binned, "label").groupBy(*FEATURES).agg(F.count("*").cast("double").alias("n"), F.sum("label").cast("double").alias("pos")).coalesce(4), "url-vectors")
    for _ in range(trees):
        tree, p, best_gain = Tree(), model.probability(), 0.0
        scored = vectors.withColumn("p", p)
        grad = scored.withColumn("g", F.col("pos") - F.col("n") * F.col("p")).withColumn("hs", F.col("n") * F.col("p") * (1 - F.col("p")))
        for level in range(depth):
            at = grad.withColumn("node", tree.node_column()).filter(F.col("node") >= 2**level)
            long = at.select("node", "g", "hs", F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.col(f).alias("v")) for f in FEATURES))).alias("x"))
            sums: dict[int, dict[str, list[tuple[float, float, float]]]] = {}
            for r in long.groupBy("node", F.col("x.f").alias("f"), F.col("x.v").alias("v")).agg(F.sum("g").alias("g"), F.sum("hs").alias("hs")).collect():
                sums.setdefault(r.node, {}).setdefault(r.f, []).append((r.v, r.g, r.hs))
            for node in sorted(sums):
                found = None
                for f in FEATURES:
                    values = sorted(sums[node][f])
                    g_all, h_all, g, h = sum(v[1] for v in values), sum(v[2] for v in values), 0.0, 0.0
                    for v, dg, dh in values[:-1]:
                        g, h = g + dg, h + dh
                        gain = g * g / (h + ridge) + (g_all - g) ** 2 / (h_all - h + ridge) - g_all * g_all / (h_all + ridge)
                        if found is None or gain > found[0] + 1e-9:
                            found = (gain, f, v, rate * g / (h + ridge), rate * (g_all - g) / (h_all - h + ridge))
                if found and found[0] > 1e-3:
                    gain, f, v, left, right = found
                    tree.splits[node] = (f, v)
                    tree.leaves[2 * node], tree.leaves[2 * node + 1] = left, right
                    best_gain = max(best_gain, gain)
        if not tree.splits:
            break
        model.trees.append(tree)
        if best_gain < 0.5:
            break
    return model


def judge(pages: DataFrame, model: Model, rules=RULES, cut: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's probability of each row."""
    host, path = split_url(F.col("url"))
    base = pages.select("page_id", "url").select("page_id", "url", host.alias("host"), path.alias("path"))
    scored = model.with_features(with_rules(base, rules)).withColumn("probability", model.probability())
    return scored.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(F.col("probability") >= cut, "block").otherwise("allow")).alias("verdict"), "probability")
