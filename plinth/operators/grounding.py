"""Prompt, stub answer and grounding enforcement, natively over tables of packs and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions import text as fx

# ---- fixed values: section headers of an answer ------------------------------------------------
HEADERS = ("answer", "legal basis", "supporting private material", "conflicts", "confidence", "insufficient evidence")
REFUSAL = "Answer: Insufficient evidence was retrieved.\nLegal basis:\nConfidence: LOW\nInsufficient evidence: YES"


#: What a drafting model is told; an answer in this form is what :func:`enforce` reads.
SYSTEM_PROMPT = """You answer questions of law from numbered excerpts only.
Each excerpt [S1], [S2], ... has a tier: 1 constitution and statutes, 2 the highest court, 3 high courts, 4 tribunals, 5 lower courts, 6 private documents, 7 private notes, 8 machine summaries.
Put at least one [S#] into every sentence that claims something. Name no authority that is not among the excerpts.
Keep apart: the words of a statute and how courts read them; public authority and private evidence; what binds and what only persuades; what is alleged and what was found.
Speak of conflicts between excerpts. If the excerpts do not suffice, say so and stop.
Write these sections, each once: "Answer:" one paragraph; "Legal basis:" bullets; "Supporting private material:" bullets; "Conflicts:" bullets; "Confidence:" HIGH, MEDIUM or LOW; "Insufficient evidence:" YES or NO."""


def user_prompt(question: Column, excerpts: Column) -> Column:
    return F.concat(F.lit("Question:\n"), question, F.lit("\n\nExcerpts:\n"), excerpts, F.lit("\n\nAnswer in the sections named above."))


def prompt_text(packs: DataFrame) -> DataFrame:
    """(qid, prompt): a header line, the excerpt and a rule for each span, in order."""
    line = F.concat(F.lit("["), "marker", F.lit("] tier="), F.col("tier").cast("string"), F.lit(" kind="), "kind", F.coalesce(F.concat(F.lit(" | "), "label"), F.lit("")), F.lit("\n"), F.trim("excerpt"), F.lit("\n---"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", line.alias("line"))))
    return packs.groupBy("qid").agg(F.array_join(F.transform(ordered, lambda x: x.line), "\n").alias("prompt"))


def stub_answer(marker_list: Column) -> Column:
    """A deterministic answer that cites every marker of a pack; a refusal for an empty one."""
    tags = F.transform(marker_list, lambda m: F.concat(F.lit("["), m, F.lit("]")))
    lines = F.array_join(F.transform(tags, lambda t: F.concat(F.lit("- "), t, F.lit(" cited excerpt, see pack."))), "\n")
    body = F.concat(F.lit("Answer: The retrieved authorities "), F.array_join(tags, ", "), F.lit(" bear on the question. "), F.array_join(tags, " "), F.lit("\nLegal basis:\n"), lines, F.lit("\nConfidence: LOW\nInsufficient evidence: NO"))
    return F.when(F.size(marker_list) == 0, F.lit(REFUSAL)).otherwise(body)


def split_sections(text: Column) -> Column:
    """map<header, text>: lines go to the last header seen, those before any header to ``answer``."""
    start = F.struct(F.lit("answer").alias("now"), F.array().cast("array<struct<h:string,line:string>>").alias("rows"))

    def step(acc, line):
        header, rest = F.lit(None).cast("string"), F.lit(None).cast("string")
        for h in reversed(HEADERS):
            here = F.lower(F.trim(line)).startswith(h + ":")
            header = F.when(here, F.lit(h)).otherwise(header)
            rest = F.when(here, F.trim(F.substring(F.trim(line), len(h) + 2, 1_000_000))).otherwise(rest)
        now = F.coalesce(header, acc.now)
        piece = F.when(header.isNull(), line).otherwise(F.nullif(rest, F.lit("")))
        row = F.struct(now.alias("h"), piece.alias("line"))
        return F.struct(now.alias("now"), F.when(piece.isNull(), acc.rows).otherwise(F.concat(acc.rows, F.array(row))).alias("rows"))

    rows = F.aggregate(F.split(text, "\r?\n"), start, step, lambda acc: acc.rows)
    return F.map_from_arrays(F.array(*map(F.lit, HEADERS)), F.array(*(F.trim(F.array_join(F.transform(_of(rows, h), lambda r: r.line), "\n")) for h in HEADERS)))


def _of(rows: Column, header: str) -> Column:
    return F.filter(rows, lambda r: r.h == header)


def sentences(text: Column) -> Column:
    """Sentences with the markers that follow their full stop; the next one starts with a capital, digit, bullet or bracket."""
    marked = F.regexp_replace(F.trim(text), r"([.!?])((?:\s*\[S\d+\])*)\s+(?=[A-Z0-9\-*•\[])", "$1$2\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda s: F.trim(s)), lambda s: s != "")


def _checked(sentence: Column, allowed: Column) -> Column:
    """struct<kept, fabricated>: the sentence without foreign markers, or null if it has no valid one."""
    found = F.array_distinct(fx.markers(sentence))
    foreign = F.array_except(found, allowed)
    good = F.array_intersect(found, allowed)
    cleaned = F.aggregate(foreign, sentence, lambda acc, m: F.replace(acc, F.concat(F.lit("["), m, F.lit("]")), F.lit("")))
    tidy = F.when(F.size(foreign) == 0, sentence).otherwise(F.trim(F.regexp_replace(cleaned, r"\s{2,}", " ")))
    return F.struct(F.when(F.size(good) > 0, tidy).alias("kept"), foreign.alias("foreign"), good.alias("good"))


def _bullets(text: Column, allowed: Column, require: bool) -> Column:
    lines = F.filter(F.transform(F.split(text, "\r?\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^[-* •]+", ""))), lambda x: x != "")
    checked = F.transform(lines, lambda x: F.struct(_checked(x, allowed).alias("c"), x.alias("line")))
    if require:
        return F.filter(F.transform(checked, lambda x: x.c.kept), lambda x: x.isNotNull())
    stripped = F.transform(checked, lambda x: F.when(F.size(x.c.foreign) == 0, x.line).otherwise(F.trim(F.regexp_replace(F.aggregate(x.c.foreign, x.line, lambda a, m: F.replace(a, F.concat(F.lit("["), m, F.lit("]")), F.lit(""))), r"\s{2,}", " "))))
    return F.filter(stripped, lambda x: x != "")


def enforce(answers: DataFrame) -> DataFrame:
    """Keep only what the pack supports; ``answers``: qid, text, allowed array<string>.

    Sentences without a valid marker go, foreign markers are cut out, bullets
    likewise (conflicts need no citation); an answer left empty is a refusal.
    """
    parts = answers.withColumn("parts", split_sections(F.col("text")))
    get = lambda h: F.try_element_at("parts", F.lit(h))
    checked = parts.withColumn("checked", F.transform(sentences(get("answer")), lambda s: _checked(s, F.col("allowed"))))
    kept = F.filter(F.transform("checked", lambda c: c.kept), lambda s: s.isNotNull())
    confidence = F.lower(F.trim(get("confidence")))
    out = checked.select(
        "qid", F.array_join(kept, " ").alias("answer"), F.size("checked").alias("total"), F.size(kept).alias("n_kept"),
        _bullets(get("legal basis"), F.col("allowed"), True).alias("legal"), _bullets(get("supporting private material"), F.col("allowed"), True).alias("private"),
        _bullets(get("conflicts"), F.col("allowed"), False).alias("conflicts"),
        F.when(confidence.isin("low", "medium", "high"), confidence).otherwise("low").alias("stated"), F.lower(get("insufficient evidence")).contains("yes").alias("said_insufficient"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("checked", lambda c: c.foreign)))).alias("fabricated"),
        F.array_distinct(F.flatten(F.transform(F.filter("checked", lambda c: c.kept.isNotNull()), lambda c: c.good))).alias("used_answer"),
    )
    cited = F.transform(F.concat("legal", "private"), lambda x: fx.markers(x))
    used = F.array_sort(F.array_union("used_answer", F.array_distinct(F.flatten(cited))))
    empty = F.trim("answer") == ""
    return out.select(
        "qid", "answer", "legal", "private", "conflicts", F.when(empty, "low").otherwise(F.col("stated")).alias("confidence"), (empty | F.col("said_insufficient")).alias("insufficient"),
        used.alias("used"), "fabricated", "total", "n_kept", F.when(F.col("total") > 0, (F.col("total") - F.col("n_kept")) / F.col("total")).otherwise(0.0).alias("rejection_rate"),
    )


def layout(enforced: DataFrame) -> DataFrame:
    """(qid, text): the enforced answer in its six sections."""
    listed = lambda title, c: F.when(F.size(c) > 0, F.concat(F.lit(f"\n{title}:\n"), F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x)), "\n")))
    head = F.concat(F.lit("Answer:\n"), F.when(F.col("answer") == "", "No grounded answer could be produced.").otherwise(F.col("answer")))
    tail = F.concat(F.lit("\nConfidence: "), F.upper("confidence"), F.lit("\nInsufficient evidence: "), F.when(F.col("insufficient"), "YES").otherwise("NO"))
    return enforced.select("qid", F.concat_ws("\n", head, listed("Legal basis", F.col("legal")), listed("Supporting private material", F.col("private")), listed("Conflicts", F.col("conflicts")), tail).alias("text"))


def citation_type(node_type: Column, kind: Column) -> Column:
    t = F.lower(node_type)
    statute = t.contains("act") | t.contains("section") | t.contains("chapter") | t.contains("proviso") | t.contains("schedule")
    return F.when(kind == "private", "private_document").when(statute, "statute").when(t.contains("notification"), "notification").when(t.contains("regulation"), "regulation").when(t.contains("rule"), "rule").when(t.contains("summary") | t.contains("extracted"), "summary").otherwise("judgment")


def resolve_citations(answers: DataFrame, packs: DataFrame) -> DataFrame:
    """(qid, marker, node, type, is_private) of each distinct marker that the pack has."""
    used = answers.select("qid", F.explode(F.array_distinct(fx.markers(F.col("answer")))).alias("marker"))
    return used.join(packs, ["qid", "marker"]).select("qid", "marker", "node", citation_type(F.col("node_type"), F.col("kind")).alias("type"), (F.col("kind") == "private").alias("is_private"))
