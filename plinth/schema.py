"""Fixed vocabularies of the legal property graph, as plain values and as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---- fixed values: node types by family -------------------------------------------------
NODE_FAMILIES = {
    "public_law": [
        "Constitution", "Act", "Amendment", "Part", "Chapter", "Section", "Subsection", "Proviso", "Explanation", "Illustration", "Rule", "Regulation", "Notification", "Circular", "Schedule",
    ],
    "judicial": [
        "Case", "Court", "Bench", "Judge", "Party", "Citation", "Paragraph", "Holding", "Ratio", "Obiter", "Issue", "LegalTest", "Doctrine", "Precedent", "ProceduralStage", "Relief", "Outcome",
    ],
    "offence": [
        "Offence", "Ingredient", "Punishment", "Procedure", "Requirement", "StandardOfProof", "EvidenceRule", "EvidentiaryIssue",
    ],
    "private": [
        "Matter", "Document", "Witness", "Statement", "Exhibit", "Fact", "TimelineEvent", "Allegation", "Defense", "Argument", "Contradiction", "MedicalRecord", "ForensicRecord", "Notice",
        "ContractClause", "Communication",
    ],
    "system": [
        "SourceEpisode", "SourceSpan", "File", "Chunk", "ExtractedClaim", "SummaryNode", "Crosswalk", "Jurisdiction", "ValidityPeriod",
    ],
}
NODE_TYPES = [t for types in NODE_FAMILIES.values() for t in types]

# ---- fixed values: authority tiers --------------------------------------------------------
TIER_STATUTE, TIER_SUPREME, TIER_HIGH, TIER_TRIBUNAL, TIER_LOWER, TIER_PRIVATE, TIER_NOTE, TIER_SUMMARY = range(1, 9)
TIER_BY_TYPE = {
    **dict.fromkeys(NODE_FAMILIES["public_law"], TIER_STATUTE),
    **dict.fromkeys(["Offence", "Ingredient", "Punishment", "Procedure", "EvidenceRule"], TIER_STATUTE),
    **dict.fromkeys([t for t in NODE_FAMILIES["private"] if t != "Argument"], TIER_PRIVATE),
    "Argument": TIER_NOTE,
    "SummaryNode": TIER_SUMMARY,
    "ExtractedClaim": TIER_SUMMARY,
}
COURT_LEVEL_TIER = {"SC": 2, "SUPREME_COURT": 2, "HC": 3, "HIGH_COURT": 3, "TRIBUNAL": 4, "NCLAT": 4, "NGT": 4, "ITAT": 4, "CAT": 4, "LOWER": 5, "DISTRICT": 5, "SESSIONS": 5, "MAGISTRATE": 5}

# ---- fixed values: required properties per node type --------------------------------------
REQUIRED = {
    "Act": ["short_title", "jurisdiction"],
    "Amendment": ["amending_act", "date_enforced"],
    "Section": ["number", "act_ref"],
    "Subsection": ["number", "section_ref"],
    "Proviso": ["parent_ref"],
    "Explanation": ["parent_ref"],
    "Illustration": ["parent_ref"],
    "Case": ["title", "court_ref", "decision_date"],
    "Court": ["name", "level"],
    "Judge": ["name"],
    "Citation": ["text"],
    "Paragraph": ["number", "case_ref"],
    "Offence": ["name", "governing_section_ref"],
    "Ingredient": ["description", "offence_ref"],
    "Punishment": ["kind", "section_ref"],
    "Matter": ["matter_id", "title"],
    "Document": ["matter_ref", "filename", "kind"],
    "Witness": ["name", "matter_ref"],
    "Exhibit": ["label", "document_ref"],
    "Fact": ["description", "matter_ref"],
    "SourceEpisode": ["kind", "origin", "ingested_at", "hash"],
    "SourceSpan": ["episode_ref", "file_ref", "char_start", "char_end"],
    "File": ["storage_uri", "sha256"],
    "ValidityPeriod": ["start"],
}

# ---- fixed values: edge type, source types, target types, temporal ("*" is any type) -------
EDGES = [
    ("ACT_CONTAINS_PART", ["Act"], ["Part"], False),
    ("ACT_CONTAINS_CHAPTER", ["Act", "Part"], ["Chapter"], False),
    ("CHAPTER_CONTAINS_SECTION", ["Chapter", "Part", "Act"], ["Section"], False),
    ("SECTION_CONTAINS_SUBSECTION", ["Section"], ["Subsection"], False),
    ("SECTION_HAS_PROVISO", ["Section", "Subsection"], ["Proviso"], False),
    ("SECTION_HAS_EXPLANATION", ["Section", "Subsection"], ["Explanation"], False),
    ("SECTION_HAS_ILLUSTRATION", ["Section", "Subsection"], ["Illustration"], False),
    ("ACT_HAS_SCHEDULE", ["Act"], ["Schedule"], False),
    ("SECTION_AMENDED_BY", ["Section", "Subsection"], ["Amendment"], True),
    ("SECTION_REPEALED_BY", ["Section", "Subsection", "Act"], ["Amendment", "Act"], True),
    ("SECTION_CROSSWALK_TO", ["Section"], ["Section"], True),
    ("NODE_HAS_VALIDITY", ["*"], ["ValidityPeriod"], True),
    ("CASE_CITES_CASE", ["Case"], ["Case"], False),
    ("CASE_DISTINGUISHES_CASE", ["Case"], ["Case"], False),
    ("CASE_FOLLOWS_CASE", ["Case"], ["Case"], False),
    ("CASE_OVERRULES_CASE", ["Case"], ["Case"], False),
    ("CASE_INTERPRETS_SECTION", ["Case", "Paragraph", "Holding"], ["Section", "Subsection", "Proviso"], False),
    ("CASE_APPLIES_STATUTE", ["Case"], ["Act"], False),
    ("CASE_REFERENCES_DOCTRINE", ["Case"], ["Doctrine"], False),
    ("PARAGRAPH_SUPPORTS_HOLDING", ["Paragraph"], ["Holding"], False),
    ("HOLDING_RESOLVES_ISSUE", ["Holding"], ["Issue"], False),
    ("ISSUE_INVOLVES_DOCTRINE", ["Issue"], ["Doctrine"], False),
    ("OFFENCE_HAS_INGREDIENT", ["Offence"], ["Ingredient"], False),
    ("SECTION_PRESCRIBES_PUNISHMENT", ["Section", "Subsection"], ["Punishment"], False),
    ("PROCEDURE_GOVERNED_BY_SECTION", ["Procedure"], ["Section", "Subsection"], False),
    ("EVIDENCE_RULE_GOVERNED_BY_SECTION", ["EvidenceRule"], ["Section", "Subsection"], False),
    ("DOCUMENT_BELONGS_TO_MATTER", ["Document"], ["Matter"], False),
    ("DOCUMENT_HAS_CONFIDENTIALITY", ["Document"], ["Document"], False),
    ("DOCUMENT_CONTAINS_FACT", ["Document"], ["Fact"], False),
    ("WITNESS_STATES_FACT", ["Witness", "Statement"], ["Fact"], False),
    ("EXHIBIT_SUPPORTS_FACT", ["Exhibit"], ["Fact"], False),
    ("EXHIBIT_CONTRADICTS_FACT", ["Exhibit"], ["Fact"], False),
    ("FACT_RELEVANT_TO_ISSUE", ["Fact"], ["Issue", "Ingredient"], False),
    ("FACT_LINKED_TO_OFFENCE", ["Fact"], ["Offence"], False),
    ("FACT_LINKED_TO_INGREDIENT", ["Fact"], ["Ingredient"], False),
    ("FACT_OCCURS_AT_TIME", ["Fact"], ["TimelineEvent"], False),
    ("ARGUMENT_SUPPORTS_POSITION", ["Argument"], ["Issue", "Allegation", "Defense"], False),
    ("ARGUMENT_CONTRADICTS_ARGUMENT", ["Argument"], ["Argument"], False),
    ("SOURCE_SPAN_SUPPORTS_CLAIM", ["SourceSpan"], ["ExtractedClaim"], False),
    ("CLAIM_TRACED_TO_EPISODE", ["ExtractedClaim"], ["SourceEpisode"], False),
    ("NODE_DERIVED_FROM_SOURCE", ["*"], ["SourceSpan", "SourceEpisode"], False),
    ("NODE_SUMMARIZES_NEIGHBORHOOD", ["SummaryNode"], ["*"], False),
]

# ---- fixed values: ordered edge policy per intent; the first field says whether only these are walked
POLICIES = {
    "statute_lookup": (False, [
        "CHAPTER_CONTAINS_SECTION", "SECTION_CONTAINS_SUBSECTION", "SECTION_HAS_PROVISO", "SECTION_HAS_EXPLANATION", "SECTION_HAS_ILLUSTRATION", "SECTION_CROSSWALK_TO", "SECTION_AMENDED_BY",
    ]),
    "crosswalk_old_new": (True, [
        "SECTION_CROSSWALK_TO", "SECTION_CONTAINS_SUBSECTION", "CHAPTER_CONTAINS_SECTION",
    ]),
    "offence_ingredient": (False, [
        "OFFENCE_HAS_INGREDIENT", "SECTION_PRESCRIBES_PUNISHMENT", "CASE_INTERPRETS_SECTION",
    ]),
    "punishment_lookup": (False, [
        "SECTION_PRESCRIBES_PUNISHMENT", "SECTION_CONTAINS_SUBSECTION", "SECTION_HAS_PROVISO", "CASE_INTERPRETS_SECTION",
    ]),
    "procedure_lookup": (False, [
        "PROCEDURE_GOVERNED_BY_SECTION", "CASE_APPLIES_STATUTE", "CHAPTER_CONTAINS_SECTION",
    ]),
    "evidence_rule_lookup": (False, [
        "EVIDENCE_RULE_GOVERNED_BY_SECTION", "SECTION_HAS_EXPLANATION", "CASE_INTERPRETS_SECTION",
    ]),
    "case_law_retrieval": (False, [
        "CASE_INTERPRETS_SECTION", "PARAGRAPH_SUPPORTS_HOLDING", "HOLDING_RESOLVES_ISSUE", "CASE_CITES_CASE", "CASE_FOLLOWS_CASE", "CASE_OVERRULES_CASE", "CASE_DISTINGUISHES_CASE",
    ]),
    "precedent_tracing": (False, [
        "CASE_CITES_CASE", "CASE_FOLLOWS_CASE", "CASE_DISTINGUISHES_CASE", "CASE_OVERRULES_CASE", "PARAGRAPH_SUPPORTS_HOLDING",
    ]),
    "private_evidence_cross_analysis": (False, [
        "DOCUMENT_CONTAINS_FACT", "EXHIBIT_SUPPORTS_FACT", "EXHIBIT_CONTRADICTS_FACT", "WITNESS_STATES_FACT", "FACT_LINKED_TO_INGREDIENT", "FACT_LINKED_TO_OFFENCE", "FACT_RELEVANT_TO_ISSUE",
        "FACT_OCCURS_AT_TIME",
    ]),
    "contradiction_detection": (False, [
        "EXHIBIT_CONTRADICTS_FACT", "ARGUMENT_CONTRADICTS_ARGUMENT", "WITNESS_STATES_FACT", "DOCUMENT_CONTAINS_FACT",
    ]),
    "timeline_reconstruction": (False, [
        "FACT_OCCURS_AT_TIME", "DOCUMENT_CONTAINS_FACT", "WITNESS_STATES_FACT",
    ]),
    "generic": (False, [
        "CHAPTER_CONTAINS_SECTION", "SECTION_CONTAINS_SUBSECTION", "SECTION_HAS_PROVISO", "SECTION_HAS_EXPLANATION", "SECTION_HAS_ILLUSTRATION", "SECTION_CROSSWALK_TO", "SECTION_AMENDED_BY",
        "SECTION_PRESCRIBES_PUNISHMENT", "OFFENCE_HAS_INGREDIENT", "CASE_INTERPRETS_SECTION", "CASE_CITES_CASE", "CASE_APPLIES_STATUTE", "PARAGRAPH_SUPPORTS_HOLDING", "HOLDING_RESOLVES_ISSUE",
        "DOCUMENT_CONTAINS_FACT", "EXHIBIT_SUPPORTS_FACT", "WITNESS_STATES_FACT", "FACT_LINKED_TO_INGREDIENT",
    ]),
}
STATUTE_INTENTS = ("statute_lookup", "offence_ingredient", "punishment_lookup", "procedure_lookup", "evidence_rule_lookup", "crosswalk_old_new")

# ---- fixed values: node types that are indexed for vector search -----------------------------
INDEXABLE = [
    "Section", "Subsection", "Proviso", "Explanation", "Illustration", "Paragraph", "Holding", "Ratio", "Obiter", "Issue", "LegalTest", "Doctrine", "Offence", "Ingredient", "Punishment",
    "Procedure", "EvidenceRule", "Statement", "Fact", "Allegation", "Defense", "Contradiction", "ContractClause", "Argument", "Exhibit", "SummaryNode",
]

# ---- fixed values: crosswalks, (source section, target section, mapping type) -----------------
CROSSWALKS = {
    "ipc_bns": ("Indian Penal Code, 1860", "Bharatiya Nyaya Sanhita, 2023", [
        ("299", "100", "one_to_one"), ("300", "101", "one_to_one"), ("302", "103", "one_to_one"), ("304", "105", "partial"), ("304A", "106", "one_to_one"), ("304B", "80", "one_to_one"),
        ("306", "108", "one_to_one"), ("307", "109", "one_to_one"), ("354", "74", "one_to_one"), ("376", "64", "one_to_one"), ("378", "303", "one_to_one"), ("379", "303", "one_to_one"),
        ("390", "309", "one_to_one"), ("392", "309(4)", "partial"), ("415", "318", "one_to_one"), ("420", "318(4)", "partial"), ("499", "356", "one_to_one"), ("500", "356(2)", "one_to_one"),
    ]),
    "crpc_bnss": ("Code of Criminal Procedure, 1973", "Bharatiya Nagarik Suraksha Sanhita, 2023", [
        ("41", "35", "one_to_one"), ("50", "47", "one_to_one"), ("154", "173", "one_to_one"), ("161", "180", "one_to_one"), ("164", "183", "one_to_one"), ("167", "187", "partial"),
        ("173", "193", "one_to_one"), ("202", "225", "one_to_one"), ("437", "480", "one_to_one"), ("438", "482", "one_to_one"), ("482", "528", "one_to_one"),
    ]),
    "iea_bsa": ("Indian Evidence Act, 1872", "Bharatiya Sakshya Adhiniyam, 2023", [
        ("3", "2", "one_to_one"), ("24", "22", "one_to_one"), ("25", "23(1)", "one_to_one"), ("27", "23(2)", "partial"), ("45", "39", "one_to_one"), ("65A", "62", "one_to_one"),
        ("65B", "63", "one_to_one"), ("114", "119", "one_to_one"), ("114A", "120", "one_to_one"),
    ]),
}

# ---- work bounds per query (fixed defaults) ----------------------------------------------------
MAX_HOPS, MAX_NODES, FANOUT = 3, 400, 40
RECALL_K, SEED_K, SEED_MIN = 20, 8, 1
RERANK_K, PACK_SPANS, PACK_TOKENS, PACK_TIER = 10, 12, 3500, 6
MIN_YEAR, MAX_YEAR = 1800, 2027

SPAN_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("episode_id", T.StringType()), T.StructField("file_id", T.StringType()), T.StructField("page", T.IntegerType()),
    T.StructField("char_start", T.IntegerType()), T.StructField("char_end", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("matter_id", T.StringType()),
])
EVENT_SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("event_id", T.LongType()), ("ts", T.TimestampType()), ("user_id", T.LongType()), ("event_type", T.StringType()), ("value", T.DoubleType()), ("props", T.StringType()))])


def edge_legality_rows() -> list[tuple[str, str, str, bool]]:
    """(edge_type, src_type, dst_type, temporal), one row for each legal pair; "*" stays as it is."""
    return [(e, s, d, t) for e, src, dst, t in EDGES for s in src for d in dst]


def policy_rows() -> list[tuple[str, str, int, int, bool]]:
    """(intent, edge_type, rank, n, restrictive)."""
    return [(intent, e, k, len(edges), only) for intent, (only, edges) in POLICIES.items() for k, e in enumerate(edges)]


def crosswalk_rows() -> list[tuple[str, str, str, str, str, str]]:
    return [(name, a, b, s, t, m) for name, (a, b, rows) in CROSSWALKS.items() for s, t, m in rows]


def sql_literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    return str(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"


def values_sql(rows, columns: str) -> str:
    """An inline table for plain SQL in either engine."""
    body = ", ".join("(" + ", ".join(map(sql_literal, r)) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS v({columns}))"


def inline(spark: SparkSession, rows, columns: str) -> DataFrame:
    """An inline table as a local relation: no Python rows reach the executors."""
    return spark.sql(f"SELECT * FROM {values_sql(rows, columns)}")


#: Display names of the authority tiers (fixed values).
TIER_LABELS = {1: "Constitution / Statute", 2: "Supreme Court", 3: "High Court", 4: "Tribunal", 5: "Lower Court", 6: "Private Document", 7: "Private Note", 8: "AI Summary"}


def dim_edge_schema(spark: SparkSession) -> DataFrame:
    return inline(spark, edge_legality_rows(), "edge_type, src_type, dst_type, temporal")


def dim_policy(spark: SparkSession) -> DataFrame:
    return inline(spark, policy_rows(), "intent, edge_type, rank, n, restrictive")


def dim_crosswalk(spark: SparkSession) -> DataFrame:
    return inline(spark, crosswalk_rows(), "name, source_act, target_act, source_section, target_section, mapping_type")


def dim_required(spark: SparkSession) -> DataFrame:
    return inline(spark, [(t, p) for t, props in REQUIRED.items() for p in props], "node_type, prop")


def dim_node_type(spark: SparkSession) -> DataFrame:
    return inline(spark, [(t, family, TIER_BY_TYPE.get(t), t in INDEXABLE) for family, types in NODE_FAMILIES.items() for t in types], "node_type, family, tier, indexable")
