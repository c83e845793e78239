"""Native texts for people: runs of markers, durations, sizes, tiers and what a question signals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plinth import schema

# ---- fixed values: signals of a question, in order: label, tone -----------------------------------------
SIGNALS = {
    "matter": ("Matter-scoped retrieval", "accent"), "statute": ("Statute anchor detected", "accent"), "punishment": ("Punishment lookup", "neutral"), "crosswalk": ("Crosswalk-sensitive question", "warn"),
    "precedent": ("Precedent retrieval likely", "neutral"), "generic": ("Generic research query", "neutral"),
}
MOST_SIGNALS = 4


def marker_runs(text: Column) -> Column:
    """array<struct<kind, value>>: the text between markers as ``text``, each marker as ``marker`` without its brackets."""
    parts = F.split(F.regexp_replace(text, r"\[S(\d+)\]", "\u0001S$1\u0002"), "\u0001")
    run = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    marked = lambda p: F.array(run("marker", F.substring_index(p, "\u0002", 1)), run("text", F.substring_index(p, "\u0002", -1)))
    each = F.transform(parts, lambda p: F.when(p.contains("\u0002"), marked(p)).otherwise(F.array(run("text", p))))
    return F.filter(F.flatten(each), lambda r: r["value"] != "")


def elapsed_text(ms: Column) -> Column:
    """Whole milliseconds under a second, else seconds with two places."""
    return F.when(ms < 1000, F.concat(F.format_string("%.0f", ms.cast("double")), F.lit(" ms"))).otherwise(F.concat(F.format_string("%.2f", ms / F.lit(1000.0)), F.lit(" s")))


def bytes_text(size: Column) -> Column:
    kb = lambda x, unit: F.concat(F.format_string("%.1f", x), F.lit(unit))
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1024 * 1024, kb(size / F.lit(1024.0), " KB")).otherwise(kb(size / F.lit(1048576.0), " MB"))


def tier_text(tier: Column) -> Column:
    labels = F.create_map(*(F.lit(x) for pair in schema.TIER_LABELS.items() for x in pair))
    return F.coalesce(F.try_element_at(labels, tier), F.lit("Unknown"))


def signals(question: Column, matter_scope: Column) -> Column:
    """array<struct<label, tone>>: up to four things that a question's words tell; the generic one where there is none."""
    text = F.lower(question)
    acts = r"\b(ipc|crpc|iea|bns|bnss|bsa)\b"
    tests = {
        "matter": F.trim(F.coalesce(matter_scope, F.lit(""))) != "", "statute": text.rlike(r"\bsection\s+\d+\b") | text.rlike(acts), "punishment": text.rlike(r"\bpunishment|sentence|penalty|imprisonment\b"),
        "crosswalk": text.rlike(r"\b(map|crosswalk|equivalent)\b") | (text.rlike(r"\bipc\b") & text.rlike(r"\bbns\b")), "precedent": text.rlike(r"\bversus\b|\bv\.\b|\bcitation\b|\bjudgment\b|\bprecedent\b"),
    }
    made = lambda name: F.struct(F.lit(SIGNALS[name][0]).alias("label"), F.lit(SIGNALS[name][1]).alias("tone"))
    found = F.filter(F.array(*(F.when(test, made(name)) for name, test in tests.items())), lambda s: s.isNotNull())
    return F.when(F.size(found) == 0, F.array(made("generic"))).otherwise(F.slice(found, 1, MOST_SIGNALS))
