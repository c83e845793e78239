"""Segmenters: one document to typed segments with offsets, by document kind.

Statutes and judgments are cut natively by lines and windows where only
line-level units are wanted (:func:`statute_lines`, :func:`judgment_lines`,
:func:`blocks`); the full segmenters with offsets run in Arrow batches.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plinth.functions.text import ACTS

STATUTE_KINDS = ("statute", "act", "amendment", "rule", "regulation", "notification")
JUDGMENT_KINDS = ("judgment", "order")
# ---- fixed values: rhetorical roles and the phrases that announce them -----------------------------
ROLES = {
    "facts": r"FACTS?\s+OF\s+THE\s+CASE|BACKGROUND|PROSECUTION\s+CASE|FACTUAL\s+MATRIX",
    "issues": r"ISSUES?\s+FOR\s+(?:CONSIDERATION|DETERMINATION)|POINTS?\s+FOR\s+DETERMINATION|QUESTIONS?\s+OF\s+LAW",
    "arguments": r"CONTENTIONS?|SUBMISSIONS?|ARGUED\s+THAT",
    "analysis": r"ANALYSIS|DISCUSSION|REASONING|OUR\s+VIEW",
    "ratio": r"RATIO\s+DECIDENDI",
    "obiter": r"OBITER\s+DICTA?|IN\s+PASSING",
    "holding": r"HELD|WE\s+HOLD",
    "ingredients": r"INGREDIENTS?\s+OF|ESSENTIAL\s+ELEMENTS?",
    "order": r"ORDER|DISPOSAL|IN\s+(?:FINE|THE\s+RESULT)|(?:APPEAL|PETITION)\s+IS\s+(?:DISMISSED|ALLOWED|PARTLY\s+ALLOWED)|CONVICTION\s+IS\s+(?:SET\s+ASIDE|UPHELD|CONFIRMED)",
}
DISPOSAL = r"(?i)\b(?:allowed|dismissed|set\s+aside|remanded|quashed|confirmed|upheld|acquitted|convicted)\b"

# ---- fixed values: the patterns that mark the parts of statutes, judgments, reports and contracts ----------
_HEAD = re.compile(r"(?im)^[ \t]*(?P<kind>PART|CHAPTER)[ \t]+(?P<num>[IVXLCDM]+|\d+)\b[.\- ]?[ \t]*(?P<title>[^\n]*)$")
_SECTION = re.compile(r"(?m)^[ \t]*(?:Section[ \t]+)?(?P<num>\d+[A-Za-z]?)\.[ \t]*(?P<title>[^\n]{0,200})")
_SUBUNITS = (
    ("Subsection", re.compile(r"(?m)^[ \t]*\((\d+[A-Za-z]?)\)\s")),
    ("Proviso", re.compile(r"(?im)^[ \t]*Provided\s+(?:further\s+|also\s+)?that\b")),
    ("Explanation", re.compile(r"(?im)^[ \t]*Explanation(?:\s+\d+)?\.")),
    ("Illustration", re.compile(r"(?im)^[ \t]*Illustrations?\.")),
)
_ACT = re.compile(r"(?i)\bTHE\s+([A-Z][A-Z&\-\s]{3,80}?(?:ACT|CODE|SANHITA|ADHINIYAM|CONSTITUTION))(?:\s*,\s*(\d{4}))?")
_PARA = re.compile(r"(?m)^[ \t]*(?P<num>\d+)\.\s+(?=[A-Z\"‘“])")
_FIR_NO = re.compile(r"(?i)(?:FIR\s*No\.?|First\s+Information\s+Report\s+No\.?)\s*[:.]?\s*(\S+)")
_FIR_SECTIONS = re.compile(r"(?i)(?:Sections?|u/s|under\s+sections?)\s*[:.]?\s*([\dA-Za-z,\s()/&]+?)(?=\b(?:of|IPC|CrPC|BNS|BNSS|BSA)\b)")
_CHARGE = re.compile(r"(?i)(?:Charge[-\s]?sheet|Final\s+Report|Final\s+Form)\s*(?:No\.?)?\s*[:.]?")
_ACCUSED = re.compile(r"\bAccused\b\s*(?:No\.?)?\s*(\d+)?\s*[:.\-]?\s*([A-Z][A-Za-z.\- ]{2,})")
_PW = re.compile(r"\b(P\.?W\.?|D\.?W\.?|C\.?W\.?)\s*[-:\s]*(\d+)\b")
_CLAUSE = re.compile(r"(?m)^[ \t]*(?P<num>\d+(?:\.\d+)*)\.\s+(?=[A-Z])")
_DEFINITION = re.compile(r"(?m)^[ \t]*\"([^\"]+)\"\s+(?:means|shall mean)\b")
_SCHEDULE = re.compile(r"(?im)^[ \t]*SCHEDULE\s+[A-Z0-9]+\b")
_EXHIBIT = re.compile(r"(?i)\b(Ex(?:hibit)?\.?\s*[PDC]?-?\s*\d+[A-Za-z]?)\b")
_STATEMENT = re.compile(r"\b(?:Statement|Deposition|Cross[-\s]?examination|Examination[-\s]?in[-\s]?chief)\s+of\s+([A-Z][A-Za-z.\- ]+)\b")

_BOUNDARY = re.compile(r"(?im)^\s*(?:\(\d+[A-Za-z]?\)\s|Provided\b|Explanation(?:\s+\d+)?\.|Illustration)")
#: Characters at the start of a text that stand for its act (fixed value).
ACT_SPAN = 2000

COLUMNS = "id string, pos int, node_type string, label string, text string, char_start int, char_end int, parent string, extra string"


def detect_act(text: str) -> tuple[str | None, str | None]:
    """(display name, token) of the act named in the first 4,000 characters."""
    m = _ACT.search(text[:4000])
    if not m:
        return None, None
    slug = re.sub("[^a-z0-9]+", "_", m[1].lower()).strip("_")
    token = next((ACTS[k] for k in sorted(ACTS, key=len, reverse=True) if slug == k or slug.startswith(k + "_")), re.sub("_(act|code|sanhita|adhiniyam)$", "", slug))
    return re.sub(r"\s+", " ", m[1].strip()) + (f", {m[2]}" if m[2] else ""), token


def statute(text: str) -> list[tuple]:
    """Act, parts and chapters (their heading lines), sections under the chapter they stand in, and their sub-units.

    An act spans the first ACT_SPAN characters. A sub-unit ends where any
    other begins, or with its section.
    """
    out: list[tuple] = []
    name, token = detect_act(text)
    if name:
        out.append(("Act", name, name, 0, min(len(text), ACT_SPAN), None, token))
    heads = [(m.start(), m["kind"].capitalize(), f"{m['kind'].capitalize()} {m['num']}", m) for m in _HEAD.finditer(text)]
    sections = [(m.start(), "Section", f"Section {m['num']}", m) for m in _SECTION.finditer(text)]
    anchors = sorted(heads + sections, key=lambda a: a[0])
    starts = [a[0] for a in anchors] + [len(text)]
    inside = {"Part": None, "Chapter": None}
    for k, (start, kind, label, m) in enumerate(anchors):
        end = starts[k + 1]
        if kind in inside:
            inside[kind] = label
            out.append((kind, label, m[0].strip(), start, m.end(), name if kind == "Part" else inside["Part"] or name, m["title"].strip() or None))
            continue
        number = m["num"].lower()
        body = text[start:end].rstrip()
        out.append((kind, label, body.strip(), start, end, inside["Chapter"] or inside["Part"] or name, f"{token}:{number}" if token else number))
        units = sorted((u.start(), u.end(), unit, u[1] if u.groups() else None) for unit, pattern in _SUBUNITS for u in pattern.finditer(body) if u.start() > 0)
        for at, after, unit, sub in units:
            edge = _BOUNDARY.search(body, after)
            stop = start + edge.start() if edge else end
            out.append((unit, f"{label}({sub})" if sub else f"{label} - {unit.lower()}", text[start + at : stop].strip(), start + at, stop, label, sub))
    return out


def judgment(text: str) -> list[tuple]:
    """Numbered paragraphs with rhetorical roles; one paragraph where none is numbered."""
    found = list(_PARA.finditer(text))
    if not found:
        cuts = [(0, len(text), "1")] if text.strip() else []
    else:
        ends = [m.start() for m in found[1:]] + [len(text)]
        cuts = [(m.start(), e, m["num"]) for m, e in zip(found, ends, strict=True)]
    roles: list[list[str]] = [[] for _ in cuts]
    ends = [e for _, e, _ in cuts]
    for role, pattern in ROLES.items():
        for m in re.finditer(rf"(?i)\b(?:{pattern})\b", text):
            k = bisect_left(ends, m.start())  # the first paragraph whose closed range holds the hit
            if k < len(cuts) and cuts[k][0] <= m.start() and role not in roles[k]:
                roles[k].append(role)
    if cuts and re.search(DISPOSAL, text[cuts[-1][0] : cuts[-1][1]]) and "order" not in roles[-1]:
        roles[-1].append("order")
    return [("Paragraph", f"Paragraph {num}", text[s:e].strip(), s, e, None, ",".join(r) or None) for (s, e, num), r in zip(cuts, roles, strict=True)]


def fir(text: str) -> list[tuple]:
    cut = min(1600, len(text))
    number, sections = _FIR_NO.search(text[:cut]), _FIR_SECTIONS.search(text[:cut])
    head = f"no={number[1] if number else ''};sections={re.sub(r'\s+', ' ', sections[1]).strip() if sections else ''}"
    out = [("Document", "FIR header", text[:cut].strip(), 0, cut, None, head)]
    if text[cut:].strip():
        out.append(("Document", "FIR narrative", text[cut:].strip(), cut, len(text), None, None))
    return out


def chargesheet(text: str) -> list[tuple]:
    out = []
    head = _CHARGE.search(text)
    if head:
        end = min(len(text), head.start() + 1200)
        out.append(("Document", "Chargesheet header", text[head.start() : end].strip(), head.start(), end, None, None))
    for m in _ACCUSED.finditer(text):
        out.append(("Party", f"Accused {m[1] or ''}".strip(), text[m.start() : m.end() + 160].strip(), m.start(), min(len(text), m.end() + 160), None, m[2].strip()))
    for m in _PW.finditer(text):
        label = m[1].replace(".", "").upper() + "-" + m[2]
        out.append(("Witness", label, text[m.start() : m.end() + 120].strip(), m.start(), min(len(text), m.end() + 120), None, None))
    return out or ([("Document", "Chargesheet", text.strip(), 0, len(text), None, None)] if text.strip() else [])


def _to_blank(text: str, start: int, most: int) -> int:
    blank = re.search(r"\n\s*\n", text[start:])
    return start + blank.start() if blank else min(len(text), start + most)


def contract(text: str) -> list[tuple]:
    out = [("ContractClause", f"Definition: {m[1]}", text[m.start() : _to_blank(text, m.start(), 400)].strip(), m.start(), _to_blank(text, m.start(), 400), None, "definition") for m in _DEFINITION.finditer(text)]
    clauses = list(_CLAUSE.finditer(text))
    for m, nxt in zip(clauses, [*clauses, None][1:], strict=True):
        end = nxt.start() if nxt else len(text)
        out.append(("ContractClause", f"Clause {m['num']}", text[m.start() : end].strip(), m.start(), end, None, m["num"]))
    out += [("Document", re.sub(r"\s+", " ", m[0]).strip(), text[m.start() : _to_blank(text, m.start(), 2000)].strip(), m.start(), _to_blank(text, m.start(), 2000), None, "schedule") for m in _SCHEDULE.finditer(text)]
    return sorted(out, key=lambda s: (s[3], s[4])) or ([("Document", "Contract", text.strip(), 0, len(text), None, None)] if text.strip() else [])


def generic(text: str, kind: str) -> list[tuple]:
    """Blocks between blank lines, typed by exhibit and witness mentions, then by the document's kind."""
    out, at = [], 0
    for piece in re.split(r"(\n\s*\n)", text):
        start, at = at, at + len(piece)
        if not piece.strip():
            continue
        exhibit, said, pw = _EXHIBIT.search(piece), _STATEMENT.search(piece), _PW.search(piece)
        node = "Exhibit" if exhibit else "Statement" if said or pw else {"notice": "Notice", "email": "Communication", "letter": "Communication"}.get(kind, "Document")
        label = exhibit[1] if exhibit else said[1].strip() if said else pw[0] if pw else f"Block {len(out) + 1}"
        out.append((node, label, piece.strip(), start, at, None, None))
    return out


def segments(text: str | None, kind: str) -> list[tuple]:
    if not text:
        return []
    if kind in STATUTE_KINDS:
        return statute(text)
    if kind in JUDGMENT_KINDS:
        return judgment(text)
    return {"fir": fir, "chargesheet": chargesheet, "contract": contract}.get(kind, lambda t: generic(t, kind))(text)


def segment(documents: DataFrame) -> DataFrame:
    """Segments of rows (id, kind, text), one document's whole text at a time."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in COLUMNS.split(", ")]
        for f in frames:
            yield pd.DataFrame([(i, k, *s) for i, kind, t in zip(f["id"], f["kind"], f["text"], strict=True) for k, s in enumerate(segments(t, kind))], columns=names)

    return documents.select("id", "kind", "text").mapInPandas(run, COLUMNS)


# ---- native, line-level variants ---------------------------------------------------------------------


def _lines(documents: DataFrame) -> DataFrame:
    """(id, no, line, start, size): every line with its character offset."""
    split = documents.select("id", F.split("text", "\n", -1).alias("ls"), F.length("text").alias("size"))
    rows = split.select("id", "size", F.posexplode("ls").alias("no", "line"))
    ahead = Window.partitionBy("id").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(ahead), F.lit(0)).cast("int"))


def statute_lines(documents: DataFrame) -> DataFrame:
    """(id, kind, number, char_start, char_end, chapter): parts, chapters and sections; a section carries the chapter it stands in."""
    p = r"(?i)^[ \t]*(PART|CHAPTER)[ \t]+([IVXLCDM]+|[0-9]+)\b"
    s = r"^[ \t]*(?:Section[ \t]+)?([0-9]+[A-Za-z]?)\."
    line = F.col("line")
    kind = F.when(line.rlike(p), F.initcap(F.lower(F.regexp_extract(line, p, 1)))).when(line.rlike(s), "Section")
    number = F.when(line.rlike(p), F.regexp_extract(line, p, 2)).otherwise(F.regexp_extract(line, s, 1))
    rows = _lines(documents).withColumn("kind", kind).filter("kind is not null").withColumn("number", number)
    by = Window.partitionBy("id").orderBy("no")
    chapter = F.last(F.when(F.col("kind") == "Chapter", F.col("number")), ignorenulls=True).over(by)
    return rows.select("id", "kind", "number", F.col("start").alias("char_start"), F.coalesce(F.lead("start").over(by), "size").alias("char_end"), F.when(F.col("kind") == "Section", chapter).alias("chapter"))


def judgment_lines(documents: DataFrame) -> DataFrame:
    """(id, number, char_start, char_end) of numbered paragraphs."""
    p = r"^[ \t]*([0-9]+)\.[ \t]+[A-Z\"]"
    rows = _lines(documents).filter(F.col("line").rlike(p)).withColumn("number", F.regexp_extract("line", p, 1))
    by = Window.partitionBy("id").orderBy("no")
    return rows.select("id", "number", F.col("start").alias("char_start"), F.coalesce(F.lead("start").over(by), "size").alias("char_end"))


def blocks(documents: DataFrame) -> DataFrame:
    """(id, pos, text) of the blocks between blank lines."""
    parts = F.filter(F.transform(F.split("text", "\n[ \t\r\f\x0b]*\n"), lambda x: F.btrim(x, F.lit(" \t\n\r\f\x0b"))), lambda x: x != "")
    return documents.select("id", F.posexplode(parts).alias("pos", "text"))


def page_of(offset: Column, pages: Column) -> Column:
    """The number of the first page [start, end) that holds the offset; pages: array<struct<start,end>>."""
    inside = F.transform(pages, lambda p, i: F.when((p.start <= offset) & (offset < p.end), i + 1))
    return F.try_element_at(F.filter(inside, lambda x: x.isNotNull()), F.lit(1))


#: Characters of a bin in which role hits meet paragraphs.
BIN = 2048


def attach_roles(paragraphs: DataFrame, hits: DataFrame) -> DataFrame:
    """(id, role, number): each role hit (id, role, at) with the first paragraph whose closed range holds it.

    Both sides are cut into bins of BIN characters: a hit meets the paragraphs
    of its bin alone, a paragraph stands in each bin that it reaches into.
    """
    cut = lambda c: F.floor(F.col(c) / BIN)
    placed = paragraphs.filter("char_start <= char_end").withColumn("bin", F.explode(F.sequence(cut("char_start"), cut("char_end"))))
    met = hits.withColumn("bin", cut("at")).join(placed, ["id", "bin"]).filter(F.col("at").between(F.col("char_start"), F.col("char_end")))
    first = met.groupBy("id", "role", "at").agg(F.min(F.struct("char_start", "number")).alias("f"))
    return first.select("id", "role", "f.number").distinct()
