"""Queries over text functions: citations, references, slugs, intents, keys, sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from plinth import schema
from plinth.functions import text as fx
from plinth.plans.base import both, dealt, plain, query

_PICK = "CASE o_orderkey % 4 WHEN 0 THEN '{0}' WHEN 1 THEN '{1}' WHEN 2 THEN '{2}' ELSE '{3}' END"
_YEAR = "year(o_orderdate)"


def _cite(name: str, text_sql: str, id_sql: str, where: str = "true"):
    """Citations written into text from order rows and found again: the oracle knows the parts, not the pattern."""
    source = f"SELECT o_orderkey AS qid, {text_sql} AS body FROM {{orders}}"

    @query(f"cite_{name}", f"SELECT o_orderkey AS qid, {id_sql} AS canonical_id, CAST({_YEAR} AS INT) AS year FROM orders WHERE {where}")
    def plan(spark, sf_dir):
        found = both(spark, sf_dir, source).select("qid", F.explode(fx.citations_of(F.col("body"), name)).alias("c"))
        return found.select("qid", "c.canonical_id", "c.year")

    return plan


_C = _PICK.format("SC", "Del", "Bombay", "P&H")
_CID = _PICK.format("sc", "del", "bom", "ph")
_cite("insc", f"concat('As held in ', {_YEAR}, ' INSC ', o_orderkey, ' and later')", f"concat('case:sc:insc:', {_YEAR}, ':', o_orderkey)")
_cite("neutral", f"concat('see ', {_YEAR}, ':', {_PICK.format('DHC', 'BHC-AS', 'ZZZ', 'KHC')}, ':', o_orderkey, '.')", f"concat('case:', {_PICK.format('del', 'bom', '-', 'kar')}, ':neutral:', {_YEAR}, ':', o_orderkey)", "o_orderkey % 4 <> 2")
_cite("scc", f"concat('per (', {_YEAR}, ') ', o_orderkey % 20 + 1, {_PICK.format(' SCC ', ' SCC (Cri) ', ' SCC (L&S) ', ' SCC (Civ) ')}, o_orderkey, ' it is')", f"concat('case:sc:', {_PICK.format('scc', 'scc_cri', 'scc_ls', 'scc_civ')}, ':', {_YEAR}, ':', o_orderkey % 20 + 1, ':', o_orderkey)")
_cite("scr", f"concat('in ', CASE WHEN o_orderkey % 2 = 0 THEN '[' ELSE '(' END, {_YEAR}, CASE WHEN o_orderkey % 2 = 0 THEN ']' ELSE ')' END, ' 3 SCR ', o_orderkey)", f"concat('case:sc:scr:', {_YEAR}, ':3:', o_orderkey)")
_cite("scc_online", f"concat({_YEAR}, ' SCC OnLine ', {_C}, ' ', o_orderkey)", f"concat('case:', {_CID}, ':scc_online:', {_YEAR}, ':', o_orderkey)")
_cite("air", f"concat('Reported as AIR ', {_YEAR}, ' ', {_C}, ' ', o_orderkey, '; AIR 1492 SC 7')", f"concat('case:', {_CID}, ':air:', {_YEAR}, ':', o_orderkey)")
_cite("manu", f"concat('MANU/', {_PICK.format('SC', 'DE', 'MH', 'XX')}, '/', 100 + o_orderkey, '/', {_YEAR})", f"concat('case:', {_PICK.format('sc', 'del', 'bom', 'unknown')}, ':manu:', 100 + o_orderkey, ':', {_YEAR})")
_cite("ilr", f"concat('ILR ', CASE WHEN o_orderkey % 2 = 0 THEN concat('(', {_YEAR}, ')') ELSE concat({_YEAR}, ' (2)') END, ' ', {_C}, ' ', o_orderkey)", f"concat('case:', {_CID}, ':ilr:', {_YEAR}, ':', o_orderkey)")
_cite("crilj", f"concat({_YEAR}, ' ', {_PICK.format('Cri LJ', 'CrLJ', 'Cri. LJ', 'CRI LJ')}, ' ', o_orderkey)", f"concat('case:unknown:crilj:', {_YEAR}, ':', o_orderkey)", "o_orderkey % 4 <> 1")


@query("cite_union", f"SELECT o_orderkey AS qid, 3 AS n, concat('case:{{c}}:air:', {_YEAR}, ':', o_orderkey, '|case:sc:insc:', {_YEAR}, ':9|case:unknown:crilj:', {_YEAR}, ':5') AS ids FROM orders".replace("{c}", "sc"))
def cite_union(spark, sf_dir):
    rows = both(spark, sf_dir, f"SELECT o_orderkey AS qid, concat({_YEAR}, ' Cri LJ 5; AIR ', {_YEAR}, ' SC ', o_orderkey, ', ', {_YEAR}, ' INSC 9') AS body FROM {{orders}}")
    ids = F.array_sort(F.transform(fx.citations(F.col("body")), lambda c: c.canonical_id))
    return rows.select("qid", F.size(ids).alias("n"), F.array_join(ids, "|").alias("ids"))


_SEC_TEXT = f"SELECT o_orderkey AS qid, concat('Under Section ', o_orderkey % 600, CASE WHEN o_orderkey % 3 = 0 THEN '(2)' ELSE '' END, ' of ', {_PICK.format('IPC', 'BNSS', 'Indian Evidence Act', 'CrPC')}, ' and Article ', o_orderkey % 300) AS body FROM {{orders}}"
_SEC_ACT = _PICK.format("Indian Penal Code, 1860", "Bharatiya Nagarik Suraksha Sanhita, 2023", "Indian Evidence Act", "Code of Criminal Procedure, 1973")


@query("section_refs", f"SELECT o_orderkey AS qid, {_SEC_ACT} AS act, CAST(o_orderkey % 600 AS VARCHAR) AS section, CASE WHEN o_orderkey % 3 = 0 THEN '2' END AS subsection, false AS is_article FROM orders UNION ALL SELECT o_orderkey, 'Constitution of India', CAST(o_orderkey % 300 AS VARCHAR), NULL, true FROM orders")
def section_refs(spark, sf_dir):
    found = both(spark, sf_dir, _SEC_TEXT).select("qid", F.explode(fx.section_refs(F.col("body"))).alias("r"))
    return found.select("qid", "r.act", "r.section", "r.subsection", "r.is_article")


@query("section_nodes", f"SELECT o_orderkey AS qid, concat('section:', {_PICK.format('ipc', 'bnss', 'iea', 'crpc')}, ':', o_orderkey % 600) AS node FROM orders UNION ALL SELECT o_orderkey, concat('section:constitution:', o_orderkey % 300) FROM orders")
def section_nodes(spark, sf_dir):
    found = both(spark, sf_dir, _SEC_TEXT).select("qid", F.explode(fx.section_refs(F.col("body"))).alias("r"))
    return found.select("qid", fx.section_node(F.col("r.act"), F.col("r.section")).alias("node"))


@query("slug", "SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM documents")
def slug(spark, sf_dir):
    return both(spark, sf_dir, "SELECT doc_id, text FROM {documents}").select("doc_id", fx.slug(F.col("text")).alias("slug"))


_ACTS = [(n, t) for n, t in (("Indian Penal Code, 1860", "ipc"), ("IPC", "ipc"), ("Bharatiya Nyaya Sanhita 2023", "bns"), ("BNSS", "bnss"), ("Indian Evidence Act, 1872", "iea"), ("Code of Criminal Procedure (Amended)", "crpc"), ("Some Other Act, 1999", "some_other_act"), ("Constitution of India", "constitution"), ("cr pc", "crpc"))]


_NAMED = dealt(_ACTS, "name, token")


@query("act_token", plain(f"SELECT o_orderkey AS qid, CASE WHEN name IS NULL THEN trim(regexp_replace(lower(concat(o_orderpriority, ' Rules ', o_orderkey)), '[^a-z0-9]+', '_', 'g'), '_') ELSE token END AS token FROM {_NAMED}"))
def act_token(spark, sf_dir):
    """Act names as they are written, in other letters, and names of no known act, over the orders; those bear a year too, as a bare order number would be read as one."""
    rows = both(spark, sf_dir, f"SELECT o_orderkey AS qid, CASE WHEN name IS NULL THEN concat(o_orderpriority, ' Rules ', o_orderkey, ', ', {_YEAR}) WHEN o_orderkey % 2 = 0 THEN upper(name) ELSE name END AS name FROM {_NAMED}")
    return rows.select("qid", fx.act_token(F.col("name")).alias("token"))


_CODES = [("SC", "sc"), ("Supreme Court of India", "sc"), (" delhi ", "del"), ("P&H.", "ph"), ("BHC-AS", "bom"), ("Nowhere", "unknown"), ("MH", "bom"), ("J&K", "jk"), ("Madhya Pradesh", "mp")]


_CODED = dealt(_CODES, "raw, code")


@query("court_normalise", plain(f"SELECT o_orderkey AS qid, coalesce(code, 'unknown') AS code FROM {_CODED}"))
def court_normalise(spark, sf_dir):
    rows = both(spark, sf_dir, f"SELECT o_orderkey AS qid, CASE WHEN raw IS NULL THEN o_orderpriority WHEN o_orderkey % 2 = 0 THEN concat(' ', raw, ' ') ELSE raw END AS raw FROM {_CODED}")
    return rows.select("qid", fx.court_code(F.col("raw")).alias("code"))


_QUESTIONS = [
    ("What are the ingredients of the offence of theft?", "offence_ingredient"), ("Punishment for murder", "punishment_lookup"), ("What is the process to file an appeal", "procedure_lookup"),
    ("burden of proof in civil cases", "evidence_rule_lookup"), ("Which BNS section replaces IPC 302", "crosswalk_old_new"), ("leading case on privacy", "precedent_tracing"), ("Statements contradict each other", "contradiction_detection"),
    ("give a timeline of the matter", "timeline_reconstruction"), ("the witness said", "private_evidence_cross_analysis"), ("which judgments interpret it", "case_law_retrieval"), ("what is the law on bail", "statute_lookup"),
    ("section 9 of the act", "statute_lookup"), ("Is this admissible", "generic"), ("hello", "generic"),
]


_POSED = dealt(_QUESTIONS, "question, intent")


@query("intent_fixed_questions", plain(f"SELECT o_orderkey AS qid, coalesce(intent, 'generic') AS intent FROM {_POSED}"))
def intent_fixed_questions(spark, sf_dir):
    rows = both(spark, sf_dir, f"SELECT o_orderkey AS qid, concat(coalesce(question, 'nothing of the kind'), ' ', o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN ' ?' ELSE '' END) AS question FROM {_POSED}")
    return rows.select("qid", fx.intent(F.col("question")).alias("intent"))


_INTENT_SQL = "CASE " + " ".join(f"WHEN regexp_matches(body, '(?is){p}') THEN '{n}'" for n, p in fx.INTENTS) + " ELSE 'generic' END"
_ASK = f"SELECT o_orderkey AS qid, concat({_PICK.format('Punishment under section ', 'Which case follows ', 'IPC to BNS for ', 'My document mentions ')}, o_orderkey % 10, ' for ', o_orderpriority) AS body FROM {{orders}}"


@query("intent_classify", f"SELECT qid, {_INTENT_SQL} AS intent FROM ({plain(_ASK)}) x")
def intent_classify(spark, sf_dir):
    return both(spark, sf_dir, _ASK).select("qid", fx.intent(F.col("body")).alias("intent"))


@query("intent_with_matter", f"SELECT qid, CASE WHEN {_INTENT_SQL} = 'generic' AND qid % 2 = 0 AND regexp_matches(body, '(?i)\\b(my|this|our)\\b') THEN 'private_evidence_cross_analysis' ELSE {_INTENT_SQL} END AS intent FROM ({plain(_ASK)}) x")
def intent_with_matter(spark, sf_dir):
    return both(spark, sf_dir, _ASK).select("qid", fx.intent(F.col("body"), F.col("qid") % 2 == 0).alias("intent"))


@query("act_and_entity_mentions", "SELECT o_orderkey AS qid, 'act:ipc|act:crpc' AS acts, concat('PW-', o_orderkey % 9) AS witnesses, concat('Ex. P-', o_orderkey % 7) AS exhibits FROM orders")
def act_and_entity_mentions(spark, sf_dir):
    rows = both(spark, sf_dir, "SELECT o_orderkey AS qid, concat('Under the IPC and the Code of Criminal Procedure, pw', o_orderkey % 9, ' proved Ex. P-', o_orderkey % 7, ' fully') AS body FROM {orders}")
    return rows.select("qid", F.array_join(fx.act_mentions(F.col("body")), "|").alias("acts"), F.array_join(fx.witness_labels(F.col("body")), "|").alias("witnesses"), F.array_join(fx.exhibit_labels(F.col("body")), "|").alias("exhibits"))


_TOKENS = r"CASE WHEN length(coalesce(text, '')) = 0 THEN 0 ELSE greatest(1, CAST(floor(length(text) / 4) AS INT), CAST(floor(len(regexp_extract_all(text, '[^ \t\n\r\f\v]+')) * 0.8) AS INT)) END"


@query("token_estimate", f"SELECT doc_id, {_TOKENS} AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return both(spark, sf_dir, "SELECT doc_id, text FROM {documents}").select("doc_id", fx.token_estimate(F.col("text")).alias("tokens"))


@query("excerpt_cut", "SELECT doc_id, substr(text, 1, 1200) AS excerpt, length(substr(text, 1, 1200)) AS n FROM documents")
def excerpt_cut(spark, sf_dir):
    cut = F.substring("text", 1, 1200)
    return both(spark, sf_dir, "SELECT doc_id, text FROM {documents}").select("doc_id", cut.alias("excerpt"), F.length(cut).alias("n"))


@query("sha_key", "SELECT doc_id, sha256(text) AS sha FROM documents")
def sha_key(spark, sf_dir):
    return both(spark, sf_dir, "SELECT doc_id, text FROM {documents}").select("doc_id", F.sha2("text", 256).alias("sha"))


@query("object_key", "SELECT doc_id, concat('raw/', substr(h, 1, 2), '/', substr(h, 3, 2), '/', substr(h, 1, 12), '_', source, '_file_', doc_id, '.txt') AS key FROM (SELECT *, sha256(text) AS h FROM documents) d")
def object_key(spark, sf_dir):
    rows = both(spark, sf_dir, "SELECT doc_id, source, text FROM {documents}")
    name = F.concat("source", F.lit(" file/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return rows.select("doc_id", fx.object_key(F.lit("/raw/"), F.sha2("text", 256), name).alias("key"))


@query("year_of_name", "SELECT o_orderkey AS qid, CAST(year(o_orderdate) AS INT) AS year FROM orders")
def year_of_name(spark, sf_dir):
    return both(spark, sf_dir, "SELECT o_orderkey AS qid, concat('sci_12_', year(o_orderdate), '.x_', o_orderkey + 20000, '.pdf') AS name FROM {orders}").select("qid", fx.year_of_name(F.col("name")).alias("year"))


@query("date_before", "SELECT o_orderkey AS qid, CASE WHEN o_orderkey % 5 = 0 THEN false ELSE CAST(o_orderdate AS DATE) < DATE '1996-06-01' END AS before FROM orders")
def date_before(spark, sf_dir):
    rows = both(spark, sf_dir, "SELECT o_orderkey AS qid, CASE WHEN o_orderkey % 5 = 0 THEN 'not a date' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS d FROM {orders}")
    return rows.select("qid", fx.date_before(F.col("d"), F.lit("1996-06-01")).alias("before"))


@query("authority_bonus_recency", "SELECT o_orderkey AS qid, round(1.0 / greatest(o_orderkey % 9, 1), 9) AS bonus, round(CASE WHEN year(o_orderdate) >= 1950 THEN least(1.0, (year(o_orderdate) - 1950) / 80.0) ELSE 0.0 END, 9) AS recency, round(CASE WHEN o_orderkey % 6 = 5 THEN 0.1 ELSE 1 - (o_orderkey % 6) / 5.0 * 0.8 END, 9) AS edge_bonus FROM orders")
def authority_bonus_recency(spark, sf_dir):
    rows = both(spark, sf_dir, "SELECT o_orderkey AS qid, o_orderkey % 9 AS tier, year(o_orderdate) AS yr, o_orderkey % 6 AS rank FROM {orders}")
    return rows.select("qid", F.round(F.lit(1.0) / F.greatest("tier", F.lit(1)), 9).alias("bonus"), F.round(fx.recency_bonus(F.col("yr")), 9).alias("recency"), F.round(F.when(F.col("rank") == 5, 0.1).otherwise(1 - F.col("rank") / 5.0 * 0.8), 9).alias("edge_bonus"))


_HTML = r"(?is)<(script|style|noscript|nav|header|footer|aside|form|iframe|svg|button)\b[^>]*>.*?</(script|style|noscript|nav|header|footer|aside|form|iframe|svg|button)>"


@query("html_to_text_fallback", f"SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '{_HTML}', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS body FROM pages")
def html_to_text_fallback(spark, sf_dir):
    return both(spark, sf_dir, "SELECT page_id, html FROM {pages}").select("page_id", fx.html_to_text(F.col("html")).alias("body"))


@query("parser_dispatch", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'html' WHEN 2 THEN 'docx' WHEN 3 THEN 'pdf' ELSE 'text' END AS parser FROM documents")
def parser_dispatch(spark, sf_dir):
    from plinth.sources.files import parser_for

    rows = both(spark, sf_dir, "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'text/html; charset=utf-8' ELSE '' END AS mime, CASE doc_id % 5 WHEN 2 THEN 'a.DOCX' WHEN 3 THEN 'b.pdf' ELSE 'c.bin' END AS name FROM {documents}")
    return rows.select("doc_id", parser_for(F.col("mime"), F.col("name")).alias("parser"))


@query("ocr_gate", "SELECT doc_id FROM documents WHERE doc_id % 2 = 0 AND length(trim(text)) < 80")
def ocr_gate(spark, sf_dir):
    from plinth.sources.files import needs_ocr

    rows = both(spark, sf_dir, "SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN 'application/pdf' ELSE 'text/plain' END AS mime FROM {documents}")
    return rows.filter(needs_ocr(F.col("mime"), F.col("text"))).select("doc_id")


@query("document_kind_of_name", "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'judgment' WHEN 1 THEN 'fir' WHEN 2 THEN 'chargesheet' WHEN 3 THEN 'contract' WHEN 4 THEN 'judgment' ELSE 'statute' END AS kind FROM documents")
def document_kind_of_name(spark, sf_dir):
    from plinth.sources.files import kind_of_name

    rows = both(spark, sf_dir, "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'SCI_12.txt' WHEN 1 THEN 'fir_4.txt' WHEN 2 THEN 'Chargesheet-1.txt' WHEN 3 THEN 'lease agreement.txt' WHEN 4 THEN 'landmark case.txt' ELSE 'ipc excerpt.txt' END AS name FROM {documents}")
    return rows.select("doc_id", kind_of_name(F.col("name")).alias("kind"))


@query("upload_verification", "SELECT doc_id, doc_id % 7 <> 0 AS ok, CASE WHEN length(text) = 0 THEN 'empty' WHEN n_chars > 20000 THEN 'too_large' ELSE 'accepted' END AS verdict FROM documents")
def upload_verification(spark, sf_dir):
    from plinth.sources.files import upload_verdict, verified

    rows = both(spark, sf_dir, "SELECT doc_id, text, n_chars FROM {documents}")
    claimed = F.when(F.col("doc_id") % 7 == 0, F.lit("0")).otherwise(F.upper(F.sha2("text", 256)))
    return verified(rows.withColumn("content", F.col("text")).withColumn("claimed", claimed)).select("doc_id", "ok", upload_verdict(F.length("text"), F.col("n_chars"), 20000).alias("verdict"))


@query("seeded_minus_files", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1)")
def seeded_minus_files(spark, sf_dir):
    seeds = both(spark, sf_dir, "SELECT o_orderkey AS id FROM {orders}")
    return seeds.join(both(spark, sf_dir, "SELECT l_orderkey AS id FROM {lineitem} WHERE l_linenumber = 1"), "id", "left_anti")


@query("pick_text_field", "SELECT doc_id, CASE WHEN length(trim(text)) >= 200 THEN text WHEN length(source) >= 200 THEN source ELSE CASE WHEN length(text) >= length(source) THEN text ELSE source END END AS body, substr(sha256(text), 1, 16) AS id FROM documents")
def pick_text_field(spark, sf_dir):
    from plinth.sources.files import pick_text

    rows = both(spark, sf_dir, "SELECT doc_id, text, source FROM {documents}")
    return rows.select("doc_id", pick_text(["text", "source"]).alias("body"), F.substring(F.sha2("text", 256), 1, 16).alias("id"))


_STRIP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query("pick_text_fetched", f"SELECT doc_id, CASE WHEN length(body) > 60000 THEN concat(substr(body, 1, 60000), chr(10), chr(10), '[... truncated by fetch_hf_corpora ...]') ELSE body END AS body, substr(sha256(text), 1, 16) AS id FROM (SELECT doc_id, text, trim(CASE WHEN length(trim(text)) >= 200 THEN text WHEN length(source) >= 200 THEN source ELSE CASE WHEN length(text) >= length(source) THEN text ELSE source END END, {_STRIP}) AS body FROM documents) x")
def pick_text_fetched(spark, sf_dir):
    from plinth.sources.files import fetched_text

    rows = both(spark, sf_dir, "SELECT doc_id, text, source FROM {documents}")
    return rows.select("doc_id", fetched_text(["text", "source"]).alias("body"), F.substring(F.sha2("text", 256), 1, 16).alias("id"))


@query("fetch_precedence", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 4 = 0 THEN 'file' WHEN o_orderkey % 3 = 0 THEN 'cache' WHEN o_orderkey % 5 = 0 THEN 'http' ELSE 'missing' END AS via, CASE WHEN o_orderkey % 7 = 0 THEN concat('/in/', o_orderkey) WHEN o_orderkey % 4 = 0 THEN concat('local', o_orderkey) WHEN o_orderkey % 3 = 0 THEN concat('cache', o_orderkey) WHEN o_orderkey % 5 = 0 THEN concat('http', o_orderkey) END AS path FROM orders")
def fetch_precedence(spark, sf_dir):
    from plinth.sources.files import fetch_route

    refs = both(spark, sf_dir, "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN concat('file:///in/', o_orderkey) ELSE concat('https://x.org/', o_orderkey) END AS url FROM {orders}")
    side = lambda n, name: refs.filter(F.col("id") % n == 0).select("id", F.concat(F.lit(name), F.col("id").cast("string")).alias("path"))
    return fetch_route(refs, side(4, "local"), side(3, "cache"), side(5, "http")).select("id", "via", "path")
