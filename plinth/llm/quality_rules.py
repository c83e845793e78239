"""Quality rules as a learned decision list.

Statistics of every whole text feed a list of interpretable rules, each a
conjunction of thresholds. Sequential covering learns the list from labelled
statistics: a rule grows by the threshold with the best information gain on
two thirds of the rows, is pruned against the last third, is kept while its
pruned precision stands, and the rows it covers leave before the next rule. Every
growth step reads one histogram of the features over the rows still covered.
Documents whose crc32(doc_id as text) mod 3 is 1 teach nothing and measure
the list. The list is emitted as one ordered conditional expression.

Defined cases: a null text has no words (all statistics 0, base_failed); texts
without words likewise; without labelled rows, or with labels of one class,
the list is empty and the base rules alone decide; rows repeat as they come,
and a labelled id that repeats teaches with each of its rows; an empty table
gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.llm.textfeatures import fold
from plinth.session import materialize

WHITE = " \t\n\x0b\f\r"
BREAK = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
GRAM = 3
#: Windows up to which a position fits the low bits beside 48 bits of hash.
PACKED_BITS = 16
PACKED = 1 << PACKED_BITS
#: Labelled rows used at most to learn the rules, by the smallest hash of their id.
TRAIN_ROWS = 40_000
FEATURES = ("symbol_ratio", "bang_ratio", "bar_ratio", "upper_ratio", "repeat_ratio", "dup_line_ratio", "distinct_ratio", "mean_word", "line_words", "n_words")


def _repeat_words() -> tuple[Column, Column, Column]:
    """(packed, paired, count): both forms of the sorted windows, and from the one that is there, the words inside 3-word windows that occur twice or more in the text, from its words ``w``.

    Sorting the windows' hashes brings equal windows together, neighbours are
    compared word by word, and the spans of the repeated ones are merged.
    Texts whose windows are all distinct stop at the first comparison of
    sizes. Up to PACKED windows, hash and position share one long while
    sorting; longer texts sort pairs, so that no bit of a hash is lost.
    """
    word = lambda k: F.get("w", k)
    same = lambda a, b: (word(a) == word(b)) & (word(a + 1) == word(b + 1)) & (word(a + 2) == word(b + 2))
    spot = lambda x: x.bitwiseAND(F.lit(PACKED - 1)).cast("int")
    top = lambda x: F.call_function("shiftrightunsigned", x, F.lit(PACKED_BITS))
    packed = F.sort_array(F.transform("hashes", lambda h, i: F.call_function("shiftleft", h, F.lit(PACKED_BITS)).bitwiseOR(i.cast("long"))))
    paired = F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def spots(ordered: Column, key, at) -> Column:
        near = lambda x, y: y.isNotNull() & (key(x) == key(y)) & same(at(x), at(y))
        hits = F.filter(ordered, lambda x, i: near(x, F.get(ordered, i - 1)) | near(x, F.get(ordered, i + 1)))
        return F.array_sort(F.transform(hits, at))

    found = F.when(F.col("packed").isNotNull(), spots(F.col("packed"), top, spot)).otherwise(spots(F.col("paired"), lambda x: x["h"], lambda x: x["i"]))
    merged = F.aggregate(found, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-GRAM).alias("last")), lambda acc, p: F.struct((acc.n + F.least(F.lit(GRAM), p - acc.last)).alias("n"), p.alias("last")), lambda acc: acc.n)
    return packed, paired, F.when(F.size("hashes") == F.col("n_distinct"), F.lit(0).cast("long")).otherwise(merged)


def statistics(docs: DataFrame) -> DataFrame:
    """The statistics of each row's whole text; no shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # what is counted by character goes through one pass; the rest of the text has none of these
    marks = F.regexp_replace("t", f"[^{SYMBOLS}!A-Z]+", "")
    body = docs.select("doc_id", text.alias("t"), F.btrim(text, F.lit(WHITE)).alias("body"))
    words = body.select("doc_id", F.length("t").alias("n_chars"), marks.alias("marks"), F.when(F.col("body") == "", F.array().cast("array<string>")).otherwise(F.split("body", BREAK)).alias("w"), F.filter(F.split("t", "\n", -1), lambda x: F.btrim(x, F.lit(WHITE)) != "").alias("lines"))
    windows = F.transform(F.sequence(F.lit(0), F.size("w") - GRAM), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))
    hashed = words.withColumn("hashes", F.when(F.size("w") < GRAM, F.array().cast("array<bigint>")).otherwise(windows))
    hashed = hashed.withColumn("n_distinct", F.size(F.array_distinct("hashes")))
    packed, paired, repeat_words = _repeat_words()
    repeats = F.col("n_distinct") < F.size("hashes")
    hashed = hashed.withColumn("packed", F.when(repeats & (F.size("hashes") <= PACKED), packed)).withColumn("paired", F.when(repeats & (F.size("hashes") > PACKED), paired))
    gone = lambda chars: F.length("marks") - F.length(F.translate("marks", chars, ""))
    base = hashed.select(
        "doc_id", F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        gone(SYMBOLS).cast("long").alias("n_symbols"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words.alias("n_repeat_words"), F.size("lines").alias("n_lines"), gone("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"), gone("!").alias("n_bangs"), gone("|").alias("n_bars"),
        F.size(F.array_distinct("w")).alias("n_vocab"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return base.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", share("word_chars", "n_words").alias("mean_word"), share("n_symbols", "n_words").alias("symbol_ratio"),
        share("n_dup_lines", "n_lines").alias("dup_line_ratio"), share("n_repeat_words", "n_words").alias("repeat_ratio"), share("n_upper", "word_chars").alias("upper_ratio"),
        share("n_bangs", "n_words").alias("bang_ratio"), share("n_bars", "n_words").alias("bar_ratio"), share("n_vocab", "n_words").alias("distinct_ratio"), share("n_words", "n_lines").alias("line_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        return F.col(self.feature) > self.cut if self.above else F.col(self.feature) <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


@dataclass(frozen=True)
class Rule:
    """Rows that pass all tests are rejected."""

    tests: tuple[Test, ...]
    precision: float

    def column(self) -> Column:
        out = F.lit(True)
        for test in self.tests:
            out = out & test.column()
        return out


def _counts(rows: DataFrame, conditions: list[Column]) -> list[tuple[int, int]]:
    """(bad, good) of the rows that meet each of a few conditions, in one pass."""
    found = rows.agg(*(F.sum(F.when(c & (F.col("bad") == b), 1).otherwise(0)).alias(f"c{i}_{b}") for i, c in enumerate(conditions) for b in (1, 0))).first()
    return [(found[2 * i] or 0, found[2 * i + 1] or 0) for i in range(len(conditions))]


def _bins(cuts: dict[str, list[float]]) -> list[Column]:
    """How many of its cuts lie below each feature's value."""
    below = lambda f: lambda cut: F.col(f) > cut
    return [F.size(F.filter(F.array(*map(F.lit, cuts[f])), below(f))).alias(f"bin_{f}") for f in FEATURES]


def _histogram(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[str, list[list[int]]]:
    """For each feature, (good, bad) by the number of its cuts below the value: one aggregate of a few hundred rows."""
    each = rows.select("bad", F.posexplode(F.array(*(F.col(f"bin_{f}") for f in FEATURES))).alias("f", "bin")).groupBy("f", "bin", "bad").agg(F.count("*").alias("n"))
    out = {f: [[0, 0] for _ in range(len(cuts[f]) + 1)] for f in FEATURES}
    for r in each.collect():
        out[FEATURES[r.f]][r.bin][r.bad] += r.n
    return out


def _tried(histogram: dict[str, list[list[int]]], cuts: dict[str, list[float]]) -> list[tuple[Test, int, int]]:
    """(test, bad, good) of every threshold, from the running sums of the histogram."""
    out = []
    for f in FEATURES:
        bad, good = (sum(h[k] for h in histogram[f]) for k in (1, 0))
        p = n = 0
        for cut, (g, b) in zip(cuts[f], histogram[f], strict=False):
            p, n = p + b, n + g
            out += [(Test(f, True, cut), bad - p, good - n), (Test(f, False, cut), p, n)]
    return out


def learn(labelled: DataFrame, max_rules: int = 8, max_tests: int = 3, cuts: int = 24, min_precision: float = 0.9, min_cover: int = 5) -> list[Rule]:
    """A decision list that rejects; ``labelled`` has the features, ``bad`` 0/1 and ``part`` 0..2 (2 prunes)."""
    grow = labelled.filter("part < 2")
    quantiles = grow.filter("bad = 1").agg(*(F.percentile_approx(f, [(i + 0.5) / cuts for i in range(cuts)], 1000).alias(f"b_{f}") for f in FEATURES)).first()
    overall = grow.filter("bad = 0").agg(*(F.percentile_approx(f, [0.001, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 0.999, 1.0], 1000).alias(f"g_{f}") for f in FEATURES)).first()
    if quantiles[0] is None or overall[0] is None:
        return []
    at = {f: sorted({*map(float, quantiles[f"b_{f}"]), *map(float, overall[f"g_{f}"])}) for f in FEATURES}
    rows = materialize(labelled.select("*", *_bins(at)), "quality-bins")
    rules: list[Rule] = []
    rest = rows
    for _ in range(max_rules):
        tests: list[Test] = []
        covered = rest.filter("part < 2")
        bad = good = None
        while len(tests) < max_tests and (bad is None or (bad >= min_cover and good)):
            histogram = _histogram(covered, at)
            bad, good = (sum(h[k] for h in histogram[FEATURES[0]]) for k in (1, 0))
            if bad < min_cover or not good:
                break
            gain = lambda p, n, b=bad, g=good: p * (math.log2(p / (p + n)) - math.log2(b / (b + g))) if p else 0.0
            tried = _tried(histogram, at)
            best = max(range(len(tried)), key=lambda i: (gain(*tried[i][1:]), -i))
            test, p, n = tried[best]
            if gain(p, n) <= 0:
                break
            tests.append(test)
            covered = covered.filter(test.column())
            bad, good = p, n
        if not tests:
            break
        heads = [tests[: k + 1] for k in range(len(tests))]
        scored = _counts(rest.filter("part = 2"), [Rule(tuple(h), 0).column() for h in heads])
        worth = [(p - n) / (p + n) if p + n else -1.0 for p, n in scored]
        keep = max(range(len(heads)), key=lambda i: (worth[i], -i))
        p, n = scored[keep]
        if p + n == 0 or p / (p + n) < min_precision:
            break
        rule = Rule(tuple(heads[keep]), p / (p + n))
        rules.append(rule)
        rest = rest.filter(~rule.column())
    return rules


def decision(rules: list[Rule]) -> Column:
    """The number of the first rule that fits, as an ordered conditional; null where none does."""
    out = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules))):
        out = F.when(rule.column(), F.lit(k)).otherwise(out)
    return out


def training_rows(stats: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """Labelled statistics of the ``rows`` ids with the smallest hashes outside the held-out fold; label 0 in ``quality`` is bad."""
    graded = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = graded.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(rows)
    part = F.pmod(F.shiftright("h", 8), F.lit(3))
    joined = stats.join(F.broadcast(sample), "doc_id").filter(~base_failed())
    return joined.select(*FEATURES, (F.col("quality") == 0).cast("int").alias("bad"), part.alias("part"))


def judge(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, **options) -> tuple[DataFrame, list[Rule]]:
    """Statistics, base_failed, the rule that fired and ``kept`` of each row, and the list learned."""
    stats = materialize(statistics(docs), "quality-stats", spread=True)
    train = materialize(training_rows(stats, labels, rows), "quality-train")
    rules = learn(train, **options)
    fired = decision(rules)
    out = stats.withColumn("base_failed", base_failed()).withColumn("rule", F.when(~F.col("base_failed"), fired))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()), rules
