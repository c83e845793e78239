"""Queries over vectors, packs and answers, metrics, segments, sinks and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from plinth import engine, schema
from plinth.functions import display, extract
from plinth.functions import text as fx
from plinth.operators import grounding, ivf, metrics, retrieval, segment, vector
from plinth.plans.base import both, dealt, plain, query
from plinth.plans.graph_queries import pack_sql, packs
from plinth.session import scratch_path
from plinth.sources import sinks, star, upsert
from plinth.streaming import bus

# ---- vectors -------------------------------------------------------------------------------------

_EMBED = """tok AS (SELECT {key} AS id, t.token, count(*) AS c FROM {src}, LATERAL (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token) t GROUP BY 1, 2),
 v AS (SELECT id, CAST(('0x' || substr(md5(token), 1, 2)) AS INT) AS bucket, CAST(sum(CASE WHEN CAST(('0x' || substr(md5(token), 15, 1)) AS INT) >= 8 THEN -c ELSE c END) AS DOUBLE) AS v FROM tok GROUP BY 1, 2),
 e AS (SELECT id, bucket, v / sqrt(sum(v * v) OVER (PARTITION BY id)) AS w FROM v WHERE v <> 0)"""


@query("hash_embed_sparse", "WITH " + _EMBED.format(key="doc_id", src="documents") + " SELECT id AS doc_id, bucket, round(w, 6) AS weight FROM e")
def hash_embed_sparse(spark, sf_dir):
    return vector.embed_sparse(both(spark, sf_dir, "SELECT doc_id, text FROM {documents}"), "doc_id", "text").select("doc_id", "bucket", F.round("weight", 6).alias("weight"))


@query("hash_embed_cosine", "WITH " + _EMBED.format(key="item_id", src="benchmark") + " SELECT a.id AS lid, b.id AS rid, round(sum(a.w * b.w), 6) AS sim FROM e a JOIN e b ON a.bucket = b.bucket GROUP BY 1, 2")
def hash_embed_cosine(spark, sf_dir):
    e = vector.embed_sparse(both(spark, sf_dir, "SELECT item_id, text FROM {benchmark}"), "item_id", "text")
    return vector.cosine_sparse(e.withColumnRenamed("item_id", "lid"), e.withColumnRenamed("item_id", "rid")).select("lid", "rid", F.round("sim", 6).alias("sim"))


_VECS = "SELECT vec_id AS id, embedding AS vec, CASE WHEN vec_id % 4 = 0 THEN concat('m', vec_id % 3) END AS matter_id FROM {embeddings}"
_COS = "round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(p.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])))), 6)"


def _topk_sql(scope: str, k: int) -> str:
    return f"SELECT qid, id, sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) AS rank FROM (SELECT q.vec_id AS qid, p.vec_id AS id, {_COS} AS sim FROM embeddings q, embeddings p WHERE q.vec_id % 100 = 0 AND (p.vec_id % 4 <> 0 OR concat('m', p.vec_id % 3) = {scope})) s) x WHERE rank <= {k}"


def _topk(spark, sf_dir, scope, k):
    points = both(spark, sf_dir, _VECS)
    asked = points.filter("id % 100 = 0").select(F.col("id").alias("qid"), "vec", F.lit(scope).cast("string").alias("scope"))
    return vector.topk(asked, points, k).select("qid", "id", "sim", F.col("rank").cast("long").alias("rank"))


@query("vector_topk", _topk_sql("NULL", schema.RECALL_K))
def vector_topk(spark, sf_dir):
    """A stated query set (every hundredth vector) against all points; private points stay out."""
    return _topk(spark, sf_dir, None, schema.RECALL_K)


@query("vector_topk_scoped", _topk_sql("'m1'", schema.SEED_K))
def vector_topk_scoped(spark, sf_dir):
    return _topk(spark, sf_dir, "m1", schema.SEED_K)


@query("vector_index_topk", _topk_sql("NULL", schema.RECALL_K))
def vector_index_topk(spark, sf_dir):
    """The same hits from the stored lists: those that cannot hold a better point are not read."""
    return _indexed(spark, sf_dir, True).select("qid", "id", "sim", F.col("rank").cast("long").alias("rank"))


@query("vector_index_recall")
def vector_index_recall(spark, sf_dir):
    """What the approximate search finds of each query's true hits."""
    return ivf.recall(_indexed(spark, sf_dir, False), _topk(spark, sf_dir, None, schema.RECALL_K))


def _indexed(spark, sf_dir, exact):
    points = both(spark, sf_dir, _VECS)
    asked = points.filter("id % 100 = 0").select(F.col("id").alias("qid"), "vec", F.lit(None).cast("string").alias("scope"))
    return ivf.search(ivf.build(points), asked, exact=exact)


_STORED = "SELECT id, tier, matter_id, label, body AS text FROM (" + star.plain(star.NODES_SQL) + ") n"
_ASKED = "SELECT item_id AS id, text FROM benchmark"


def _recall_sql(scope: str, k: int) -> str:
    embedded = lambda name, src, text: _EMBED.format(key="id", src=f"(SELECT id, {text} AS text FROM ({src}) y) x").replace("tok AS", f"{name}tok AS").replace("FROM tok", f"FROM {name}tok").replace(" v AS", f" {name}v AS").replace("FROM v WHERE", f"FROM {name}v WHERE").replace(" e AS", f" {name} AS")
    return f"""WITH {embedded('q', _ASKED, 'text')}, {embedded('p', _STORED, "substr(concat(label, chr(10), text), 1, 2048)")},
 s AS (SELECT q.id AS qid, p.id AS node, round(sum(q.w * p.w), 6) AS sem FROM q JOIN p ON p.bucket = q.bucket JOIN ({_STORED}) n ON n.id = p.id WHERE n.matter_id IS NULL OR n.matter_id = {scope} GROUP BY 1, 2)
 SELECT qid, node, sem FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sem DESC, node) AS k FROM s WHERE sem <> 0) x WHERE k <= {k}"""


@query("recall", _recall_sql("concat('m', q.id % 7)", schema.RECALL_K))
def recall(spark, sf_dir):
    """Questions in a matter's scope against every node of the graph, by hash embeddings."""
    g = star.star_graph(spark, sf_dir)
    corpus = engine.Corpus(None, None, g.nodes, g.edges, g.nodes.withColumnRenamed("body", "text"), None, None)
    asked = both(spark, sf_dir, "SELECT item_id AS qid, text AS question, concat('m', item_id % 7) AS matter_scope FROM {benchmark}")
    return engine.recall(asked, corpus).select("qid", "node", "sem")


@query("vector_norms", "SELECT vec_id AS id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm FROM embeddings")
def vector_norms(spark, sf_dir):
    return both(spark, sf_dir, _VECS).select("id", F.round(vector.norm(F.col("vec")), 6).alias("norm"))


@query("point_id", "SELECT concat('order:', o_orderkey) AS id, CAST(CAST(('0x' || substr(sha1(concat('order:', o_orderkey)), 1, 16)) AS UBIGINT) // 2 AS BIGINT) AS point FROM orders")
def point_id(spark, sf_dir):
    return both(spark, sf_dir, "SELECT concat('order:', o_orderkey) AS id FROM {orders}").select("id", fx.point_id(F.col("id")).alias("point"))


_POINTS = "SELECT concat('n', o_custkey) AS id, CASE o_orderkey % 3 WHEN 0 THEN 'Section' WHEN 1 THEN 'Paragraph' ELSE 'File' END AS node_type, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 3 END AS tier, CASE WHEN o_orderkey % 7 = 0 THEN '  ' ELSE o_orderpriority END AS text, CASE WHEN o_orderkey % 5 = 0 THEN 'm1' END AS matter_id, o_orderkey AS seq FROM {orders}"
_POINT_OK = "node_type IN ('Section', 'Paragraph') AND tier IS NOT NULL AND trim(text) <> ''"


@query("vector_upsert_latest", f"SELECT id, text, CASE WHEN matter_id IS NULL THEN 'public' ELSE 'private' END AS collection, seq FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS k FROM ({plain(_POINTS)}) p WHERE {_POINT_OK}) x WHERE k = 1")
def vector_upsert_latest(spark, sf_dir):
    return vector.points_of(both(spark, sf_dir, _POINTS)).select("id", "text", "collection", "seq")


@query("index_split_counts", f"SELECT count(*) FILTER (WHERE {_POINT_OK} AND matter_id IS NULL) AS public, count(*) FILTER (WHERE {_POINT_OK} AND matter_id IS NOT NULL) AS private, count(*) FILTER (WHERE NOT coalesce({_POINT_OK}, false)) AS skipped FROM ({plain(_POINTS)}) p")
def index_split_counts(spark, sf_dir):
    return vector.index_counts(both(spark, sf_dir, _POINTS))


_KEYED = "SELECT c_custkey AS id, c_name AS name, CAST(c_acctbal AS DOUBLE) AS weight FROM customer"


@query(
    "keyed_upsert_twice",
    """WITH one AS (SELECT o_custkey AS id, max(o_orderpriority) AS name, CAST(NULL AS DOUBLE) AS weight FROM orders WHERE o_custkey % 3 = 0 GROUP BY 1),
 two AS (SELECT o_custkey + 1000000 * CAST(o_custkey % 5 = 0 AS INT) AS id, CAST(NULL AS VARCHAR) AS name, CAST(max(o_orderkey) AS DOUBLE) AS weight FROM orders WHERE o_custkey % 2 = 0 GROUP BY 1)
 SELECT coalesce(a.id, two.id) AS id, coalesce(two.name, a.name) AS name, coalesce(two.weight, a.weight) AS weight
 FROM (SELECT c.id, CASE WHEN one.id IS NULL THEN c.name ELSE one.name END AS name, CASE WHEN one.id IS NULL THEN c.weight ELSE one.weight END AS weight FROM ("""
    + _KEYED
    + """) c LEFT JOIN one ON one.id = c.id UNION ALL SELECT one.* FROM one WHERE id NOT IN (SELECT c_custkey FROM customer)) a FULL JOIN two ON two.id = a.id""",
)
def keyed_upsert_twice(spark, sf_dir):
    """A stored table that is replaced by key, then merged by key; each upsert rewrites the buckets of its keys alone."""
    stored = upsert.KeyedTable(spark, scratch_path(spark, "keyed"), "id", "id bigint, name string, weight double", 16)
    stored.upsert(both(spark, sf_dir, _KEYED.replace("customer", "{customer}")).select(F.col("id").cast("bigint"), "name", "weight"))
    stored.upsert(both(spark, sf_dir, "SELECT CAST(o_custkey AS BIGINT) AS id, o_orderpriority AS name, CAST(NULL AS DOUBLE) AS weight FROM {orders} WHERE o_custkey % 3 = 0"), order="name")
    stored.upsert(both(spark, sf_dir, "SELECT CAST(o_custkey + 1000000 * CAST(o_custkey % 5 = 0 AS INT) AS BIGINT) AS id, CAST(NULL AS STRING) AS name, CAST(o_orderkey AS DOUBLE) AS weight FROM {orders} WHERE o_custkey % 2 = 0"), order="weight", merge=True)
    return stored.read()


@query("payload_flatten", "SELECT o_orderkey AS qid, concat_ws('|', concat('ex.clerk=', o_custkey % 5), CASE WHEN o_orderkey % 2 = 0 THEN concat('status=', o_orderstatus) END, concat('title=', o_orderpriority)) AS payload FROM orders")
def payload_flatten(spark, sf_dir):
    rows = both(spark, sf_dir, "SELECT o_orderkey AS qid, o_orderpriority AS title, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS status, CAST(o_custkey % 5 AS STRING) AS clerk FROM {orders}")
    flat = vector.flat_payload(F.create_map(F.lit("title"), F.col("title"), F.lit("status"), F.col("status")), F.create_map(F.lit("clerk"), F.col("clerk"), F.lit("none"), F.lit(None).cast("string")))
    pairs = F.array_sort(F.transform(F.map_entries(flat), lambda e: F.concat(e.key, F.lit("="), e.value)))
    return rows.select("qid", F.array_join(pairs, "|").alias("payload"))


@query("index_text_cut", "SELECT doc_id, substr(concat(source, chr(10), text), 1, 2048) AS body FROM documents")
def index_text_cut(spark, sf_dir):
    return both(spark, sf_dir, "SELECT doc_id, source, text FROM {documents}").select("doc_id", vector.index_text(F.col("source"), F.col("text")).alias("body"))


_LEX = "list_distinct(list_filter(regexp_extract_all(lower(substr({0}, 1, 512)), '[a-z0-9]+'), lambda w: length(w) > 2))"
_LEX_SQL = f"""WITH c AS (SELECT item_id AS qid, doc_id AS node, {_LEX.format('b.text')} AS q, {_LEX.format('d.text')} AS c, {_LEX.format('d.source')} AS t, CAST(doc_id % 8 + 1 AS INT) AS tier, 1940 + CAST(doc_id % 80 AS INT) AS yr FROM benchmark b CROSS JOIN documents d),
s AS (SELECT qid, node, tier, yr, CASE WHEN len(q) = 0 THEN CAST(0 AS DOUBLE) ELSE (CAST(0.7 AS DOUBLE) * CAST(len(list_intersect(q, c)) AS DOUBLE)) / CAST(greatest(len(list_distinct(list_concat(q, c))), 1) AS DOUBLE) + (CAST(0.3 AS DOUBLE) * CAST(len(list_intersect(q, t)) AS DOUBLE)) / CAST(greatest(len(q), 1) AS DOUBLE) END AS sem FROM c)"""
_AUTH = "round(1.0 / greatest(tier, 1) + 0.1 * sem + 0.05 * CASE WHEN yr >= 1950 THEN least(1.0, (yr - 1950) / 80.0) ELSE 0.0 END, 9)"


def _lexical(spark, sf_dir, authority):
    """The stated questions against every document."""
    asked = both(spark, sf_dir, "SELECT item_id AS qid, text AS question FROM {benchmark}")
    docs = both(spark, sf_dir, "SELECT doc_id AS node, text AS body, source AS title, CAST(doc_id % 8 + 1 AS INT) AS tier, 1940 + CAST(doc_id % 80 AS INT) AS yr FROM {documents}")
    return retrieval.lexical_best(docs, asked, authority=authority)


@query("rank_lexical", _LEX_SQL + f" SELECT qid, node, round(round(sem, 9), 6) AS sem, rank FROM (SELECT qid, node, sem, row_number() OVER (PARTITION BY qid ORDER BY round(sem, 9) DESC, node) AS rank FROM s) x WHERE rank <= {schema.RERANK_K}")
def rank_lexical(spark, sf_dir):
    return _lexical(spark, sf_dir, False).select("qid", "node", F.round(F.round("sem", 9), 6).alias("sem"), F.col("rank").cast("long").alias("rank"))


@query("rank_composite", _LEX_SQL + f" SELECT qid, node, rank FROM (SELECT qid, node, row_number() OVER (PARTITION BY qid ORDER BY {_AUTH} DESC, node) AS rank FROM s) x WHERE rank <= {schema.RERANK_K}")
def rank_composite(spark, sf_dir):
    return _lexical(spark, sf_dir, True).select("qid", "node", F.col("rank").cast("long").alias("rank"))


# ---- packs and answers -----------------------------------------------------------------------------


@query("pack_prompt", pack_sql(20) + " SELECT qid, string_agg(concat('[', marker, '] tier=', tier, ' kind=', kind, ' | ', label, chr(10), trim(excerpt), chr(10), '---'), chr(10) ORDER BY pos) AS prompt FROM pack GROUP BY qid")
def pack_prompt(spark, sf_dir):
    return grounding.prompt_text(packs(spark, sf_dir, 20)[0])


_STUB = """concat('Answer: The retrieved authorities ', string_agg(concat('[', marker, ']'), ', ' ORDER BY pos), ' bear on the question. ', string_agg(concat('[', marker, ']'), ' ' ORDER BY pos), chr(10), 'Legal basis:', chr(10), string_agg(concat('- [', marker, '] cited excerpt, see pack.'), chr(10) ORDER BY pos), chr(10), 'Confidence: LOW', chr(10), 'Insufficient evidence: NO')"""


def _answers(spark, sf_dir):
    pack = packs(spark, sf_dir, 20)[0]
    lists = pack.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "marker"))), lambda x: x.marker).alias("allowed"))
    return lists.select("qid", "allowed", grounding.stub_answer(F.col("allowed")).alias("text")), pack


@query("stub_answer", pack_sql(20) + f" SELECT qid, {_STUB} AS text FROM pack GROUP BY qid")
def stub_answer(spark, sf_dir):
    return _answers(spark, sf_dir)[0].select("qid", "text")


_RAW = r"""SELECT doc_id AS qid, concat('Answer: Theft is taking. [S1] It needs intent [S', doc_id % 5, ']. No source here. Only a ghost speaks [S99]. Both speak [S2] [S', 90 + doc_id % 3, '].', chr(10), 'Legal basis:', chr(10), '- [S1] first', chr(10), '* nothing cited', chr(10), '- [S98] ghost', chr(10), 'Conflicts:', chr(10), '- they differ [S97]', chr(10), 'Confidence: ', CASE doc_id % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'medium' ELSE 'sure' END, chr(10), 'Insufficient evidence: ', CASE WHEN doc_id % 4 = 0 THEN 'YES' ELSE 'no' END) AS text FROM {documents}"""


@query("enforce_markers", """SELECT doc_id AS qid, concat('Theft is taking. [S1]', CASE WHEN doc_id % 5 IN (1, 2, 3) THEN concat(' It needs intent [S', doc_id % 5, '].') ELSE '' END, ' Both speak [S2] .') AS answer, '[S1] first' AS legal, 'they differ' AS conflicts,
 CASE doc_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence, doc_id % 4 = 0 AS insufficient, CASE WHEN doc_id % 5 = 3 THEN 'S1,S2,S3' ELSE 'S1,S2' END AS used,
 concat(CASE WHEN doc_id % 5 = 0 THEN 'S0,' WHEN doc_id % 5 = 4 THEN 'S4,' ELSE '' END, 'S9', doc_id % 3, ',S99') AS fabricated, 5 AS total, CASE WHEN doc_id % 5 IN (1, 2, 3) THEN 3 ELSE 2 END AS n_kept FROM documents""")
def enforce_markers(spark, sf_dir):
    rows = both(spark, sf_dir, _RAW).withColumn("allowed", F.array(F.lit("S1"), F.lit("S2"), F.lit("S3")))
    out = grounding.enforce(rows)
    return out.select("qid", "answer", F.array_join("legal", "|").alias("legal"), F.array_join("conflicts", "|").alias("conflicts"), "confidence", "insufficient", F.array_join("used", ",").alias("used"), F.array_join("fabricated", ",").alias("fabricated"), "total", "n_kept")


@query("enforce_stub_round_trip", pack_sql(20) + " SELECT qid, count(*) AS n_used, false AS insufficient, CAST(0 AS DOUBLE) AS rejection_rate FROM pack GROUP BY qid")
def enforce_stub_round_trip(spark, sf_dir):
    out = grounding.enforce(_answers(spark, sf_dir)[0])
    return out.select("qid", F.size("used").cast("long").alias("n_used"), "insufficient", F.lit(0.0).alias("rejection_rate"))


@query("split_headers", """SELECT doc_id AS qid, 'lead' || chr(10) || 'more' AS answer, concat('basis ', doc_id) AS legal, 'HIGH' AS confidence, '' AS conflicts FROM documents""")
def split_headers(spark, sf_dir):
    rows = both(spark, sf_dir, "SELECT doc_id AS qid, concat('lead', chr(10), 'ANSWER: more', chr(10), ' Legal Basis: basis ', doc_id, chr(10), 'confidence:HIGH') AS text FROM {documents}").withColumn("p", grounding.split_sections(F.col("text")))
    get = lambda h: F.try_element_at("p", F.lit(h))
    return rows.select("qid", get("answer").alias("answer"), get("legal basis").alias("legal"), get("confidence").alias("confidence"), get("conflicts").alias("conflicts"))


@query("resolve_citations", pack_sql(20) + " SELECT qid, marker, node, CASE WHEN kind = 'private' THEN 'private_document' WHEN lower(node_type) LIKE '%act%' OR lower(node_type) LIKE '%section%' OR lower(node_type) LIKE '%proviso%' THEN 'statute' ELSE 'judgment' END AS type, kind = 'private' AS is_private FROM pack")
def resolve_citations(spark, sf_dir):
    answers, pack = _answers(spark, sf_dir)
    return grounding.resolve_citations(answers.select("qid", F.col("text").alias("answer")), pack)


@query("answer_layout", """SELECT doc_id AS qid, concat('Answer:', chr(10), 'Theft is taking. [S1]', CASE WHEN doc_id % 5 IN (1, 2, 3) THEN concat(' It needs intent [S', doc_id % 5, '].') ELSE '' END, ' Both speak [S2] .', chr(10), chr(10), 'Legal basis:', chr(10), '- [S1] first', chr(10), chr(10), 'Conflicts:', chr(10), '- they differ', chr(10), chr(10), 'Confidence: ', CASE doc_id % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END, chr(10), 'Insufficient evidence: ', CASE WHEN doc_id % 4 = 0 THEN 'YES' ELSE 'NO' END) AS text FROM documents""")
def answer_layout(spark, sf_dir):
    rows = both(spark, sf_dir, _RAW).withColumn("allowed", F.array(F.lit("S1"), F.lit("S2"), F.lit("S3")))
    return grounding.layout(grounding.enforce(rows))


# ---- metrics ----------------------------------------------------------------------------------------

_DATASETS = ("offence_ingredients_ipc_bns", "procedure_crpc_bnss", "evidence_iea_bsa", "private_matter_qa")
_RESULTS = """SELECT CASE doc_id % 4 WHEN 0 THEN 'offence_ingredients_ipc_bns' WHEN 1 THEN 'procedure_crpc_bnss' WHEN 2 THEN 'evidence_iea_bsa' ELSE 'private_matter_qa' END AS dataset, doc_id AS item_id,
 concat('Answer: One claim [S1]. Two claim', CASE WHEN doc_id % 3 = 0 THEN ' [S9]' ELSE '' END, '. Three [S2] [S1].') AS answer, doc_id % 7 AS pack_n, doc_id % 6 + 1 AS tier, doc_id % 9 AS sec, doc_id % 10 = 0 AS refused, (doc_id * 37 % 1000) / 100.0 AS latency FROM {documents}"""


def _results(spark, sf_dir):
    rows = both(spark, sf_dir, _RESULTS)
    n = F.col("pack_n").cast("int")
    return rows.select(
        "dataset", "item_id", "answer", F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: i.cast("string"))).otherwise(F.array().cast("array<string>")).alias("pack_spans"),
        F.array(F.col("tier").cast("int"), F.lit(4)).alias("pack_tiers"), F.array(F.concat(F.lit("section:ipc:"), F.col("sec").cast("string"))).alias("pack_nodes"),
        F.array(F.concat(F.lit("Section "), F.col("sec").cast("string"), F.lit(" IPC"))).alias("cite_labels"), F.array(F.col("sec") % 2 == 0, F.lit(True)).alias("cite_ok"), "refused", F.col("latency").cast("double").alias("latency"),
        F.when(F.col("sec") < 6, F.array(F.lit("Section 3"), F.lit("4 IPC"))).alias("expected_sections"), F.when(F.col("sec") == 2, F.array(F.lit("Section:ipc:2"))).alias("expected_nodes"),
        F.when(F.col("sec") < 4, F.lit("1 ipc")).alias("expected_target"), F.lit(None).cast("boolean").alias("expected_tier1"),
    )


_SUMMARY = f"""WITH r AS ({plain(_RESULTS)}),
f AS (SELECT dataset, 3 AS claims, CASE WHEN item_id % 3 = 0 THEN 3 ELSE 2 END AS cited, CASE WHEN item_id % 3 = 0 THEN 4 ELSE 3 END AS marks,
 (CASE WHEN item_id % 3 = 0 THEN 1 ELSE 0 END) + CASE WHEN pack_n < 1 THEN 2 ELSE 0 END + CASE WHEN pack_n < 2 THEN 1 ELSE 0 END AS foreign_, 2 AS cites, CASE WHEN sec % 2 = 0 THEN 2 ELSE 1 END AS ok,
 CASE WHEN pack_n > 0 THEN least(pack_n, 2) / CAST(pack_n AS DOUBLE) END AS share, CASE WHEN tier = 1 THEN 1 ELSE 0 END AS anchored, CASE WHEN sec < 6 THEN CASE WHEN sec IN (2, 3, 4) THEN 1 ELSE 0 END END AS hit,
 CASE WHEN pack_n > 0 THEN 1 ELSE 0 END AS covered, CASE WHEN refused THEN 1 ELSE 0 END AS refused, sec < 6 AS answerable, CASE WHEN sec < 4 THEN CASE WHEN sec = 1 THEN 1 ELSE 0 END END AS mapped, CAST(latency AS DOUBLE) AS latency FROM r),
l AS (SELECT dataset, list_sort(list(latency)) AS l FROM f GROUP BY dataset),
summary AS (SELECT f.dataset, CAST(count(*) AS DOUBLE) AS items, sum(cited) / CAST(sum(claims) AS DOUBLE) AS grounding_rate, 1 - sum(cited) / CAST(sum(claims) AS DOUBLE) AS unsupported_claim_rate, sum(foreign_) / CAST(sum(marks) AS DOUBLE) AS fabricated_marker_rate,
 (sum(marks) - sum(foreign_)) / CAST(sum(marks) AS DOUBLE) AS citation_faithfulness, sum(ok) / CAST(sum(cites) AS DOUBLE) AS span_citation_correctness, coalesce(avg(share), 0) AS pack_utilisation, avg(anchored) AS tier1_anchor_rate, coalesce(avg(hit), 0) AS retrieval_hit_rate,
 avg(covered) AS retrieval_coverage, avg(refused) AS refusal_rate, coalesce(avg(refused) FILTER (WHERE answerable), 0) AS false_refusal_rate, coalesce(avg(refused) FILTER (WHERE NOT answerable), 0) AS true_refusal_rate, coalesce(avg(mapped), 0) AS crosswalk_mapping_accuracy,
 avg(latency) AS latency_mean_s, any_value(l[CAST(round_even(0.5 * (len(l) - 1), 0) AS INT) + 1]) AS latency_p50_s, any_value(l[CAST(round_even(0.95 * (len(l) - 1), 0) AS INT) + 1]) AS latency_p95_s, any_value(l[len(l)]) AS latency_max_s FROM f JOIN l ON l.dataset = f.dataset GROUP BY f.dataset)"""


@query("metric_summary", _SUMMARY + " SELECT dataset, " + ", ".join(f"round({m}, 6) AS {m}" for m in metrics.METRICS) + " FROM summary")
def metric_summary(spark, sf_dir):
    return metrics.summarise(_results(spark, sf_dir)).select("dataset", *(F.round(m, 6).alias(m) for m in metrics.METRICS))


_LONG = " UNION ALL ".join(f"SELECT dataset, '{m}' AS metric, {m} AS observed FROM summary" for m in metrics.METRICS)
_THRESH = schema.values_sql(metrics.threshold_rows(), "name, kind, metric, value")


@query("threshold_violations", _SUMMARY + f""", t AS {_THRESH}, long AS ({_LONG}), k AS (SELECT long.*, v.kind FROM long, (VALUES ('min'), ('max')) v(kind)),
j AS (SELECT k.*, CASE WHEN o.name IS NOT NULL THEN o.value ELSE d.value END AS required FROM k LEFT JOIN t d ON d.name = '_default' AND d.metric = k.metric AND d.kind = k.kind LEFT JOIN t o ON o.name = k.dataset AND o.metric = k.metric AND o.kind = k.kind)
SELECT dataset, metric, kind, round(observed, 6) AS observed, CAST(required AS DOUBLE) AS required FROM j WHERE required IS NOT NULL AND CASE WHEN kind = 'min' THEN observed + 1e-9 < required ELSE observed > required + 1e-9 END""")
def threshold_violations(spark, sf_dir):
    return metrics.violations(metrics.summarise(_results(spark, sf_dir))).select("dataset", "metric", "kind", F.round("observed", 6).alias("observed"), "required")


def _facts(name: str, sql: str, *columns: str):
    @query(f"metric_{name}", sql)
    def plan(spark, sf_dir):
        return metrics.item_facts(_results(spark, sf_dir)).select("item_id", *columns)

    return plan


_facts("grounding_items", "SELECT doc_id AS item_id, 3 AS claims, CASE WHEN doc_id % 3 = 0 THEN 3 ELSE 2 END AS cited FROM documents", "claims", "cited")
_facts("fabricated_items", "SELECT doc_id AS item_id, CASE WHEN doc_id % 3 = 0 THEN 4 ELSE 3 END AS marks, (CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END) + CASE WHEN doc_id % 7 < 1 THEN 2 ELSE 0 END + CASE WHEN doc_id % 7 < 2 THEN 1 ELSE 0 END AS \"foreign\" FROM documents", "marks", "foreign")
_facts("hit_items", "SELECT doc_id AS item_id, CASE WHEN doc_id % 9 < 6 THEN CASE WHEN doc_id % 9 IN (2, 3, 4) THEN 1 ELSE 0 END END AS hit FROM documents", "hit")


_OWNED = "SELECT o_orderkey AS qid, CASE WHEN name IS NULL THEN lower(o_orderpriority) WHEN o_orderkey % 2 = 0 THEN concat(name, '_', o_custkey) ELSE name END AS dataset FROM " + dealt([(d,) for d in _DATASETS], "name")


@query("scope_of_dataset", f"SELECT qid, dataset, CASE WHEN dataset LIKE 'private\\_matter%' ESCAPE '\\' THEN concat('eval_', dataset) END AS scope FROM ({plain(_OWNED)}) x")
def scope_of_dataset(spark, sf_dir):
    rows = both(spark, sf_dir, _OWNED)
    return rows.select("qid", "dataset", F.when(F.col("dataset").startswith("private_matter"), F.concat(F.lit("eval_"), "dataset")).alias("scope"))


@query("results_with_gold", "SELECT d.doc_id, coalesce(l.quality, -1) AS quality, l.doc_id IS NOT NULL AS answerable FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def results_with_gold(spark, sf_dir):
    d, lab = both(spark, sf_dir, "SELECT doc_id FROM {documents}"), both(spark, sf_dir, "SELECT doc_id, quality, true AS known FROM {labels}")
    return d.join(lab, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("known", F.lit(False)).alias("answerable"))


# ---- segments -----------------------------------------------------------------------------------------

_STATUTE = "SELECT CAST(o_orderkey AS VARCHAR) AS id, concat('CHAPTER ', o_orderkey % 8 + 1, ' OF FIRST', chr(10), '1. Short title.', chr(10), 'body', chr(10), 'CHAPTER 9 LAST', chr(10), 'Section 2A. Meaning', chr(10), o_orderpriority) AS text FROM {orders}"
_L1 = "length(concat('CHAPTER ', o_orderkey % 8 + 1, ' OF FIRST')) + 1"


@query("segment_statute_lines", f"""SELECT CAST(o_orderkey AS VARCHAR) AS id, k.kind, CASE k.n WHEN 1 THEN CAST(o_orderkey % 8 + 1 AS VARCHAR) WHEN 2 THEN '1' WHEN 3 THEN '9' ELSE '2A' END AS number,
 CASE k.n WHEN 1 THEN 0 WHEN 2 THEN {_L1} WHEN 3 THEN {_L1} + 21 ELSE {_L1} + 36 END AS char_start, CASE k.n WHEN 1 THEN {_L1} WHEN 2 THEN {_L1} + 21 WHEN 3 THEN {_L1} + 36 ELSE {_L1} + 36 + 20 + length(o_orderpriority) END AS char_end,
 CASE k.n WHEN 2 THEN CAST(o_orderkey % 8 + 1 AS VARCHAR) WHEN 4 THEN '9' END AS chapter FROM orders, (VALUES (1, 'Chapter'), (2, 'Section'), (3, 'Chapter'), (4, 'Section')) k(n, kind)""")
def segment_statute_lines(spark, sf_dir):
    return segment.statute_lines(both(spark, sf_dir, _STATUTE))


@query("segment_judgment_paras", "SELECT CAST(o_orderkey AS VARCHAR) AS id, k.number, CASE k.number WHEN '1' THEN 6 ELSE 6 + 14 + length(o_orderpriority) END AS char_start, CASE k.number WHEN '1' THEN 6 + 14 + length(o_orderpriority) ELSE 6 + 14 + length(o_orderpriority) + 16 END AS char_end FROM orders, (VALUES ('1'), ('2')) k(number)")
def segment_judgment_paras(spark, sf_dir):
    return segment.judgment_lines(both(spark, sf_dir, "SELECT CAST(o_orderkey AS VARCHAR) AS id, concat('Title', chr(10), '1. The facts ', o_orderpriority, chr(10), '2. Appeal fails.') AS text FROM {orders}"))


_STRIP = "regexp_replace(regexp_replace(b, '^[ \\t\\n\\r\\f\\v]+', ''), '[ \\t\\n\\r\\f\\v]+$', '')"


@query("segment_blocks", f"SELECT doc_id AS id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS INT) AS pos, text FROM (SELECT doc_id, p, {_STRIP} AS text FROM (SELECT doc_id, unnest(s) AS b, generate_subscripts(s, 1) AS p FROM (SELECT doc_id, string_split_regex(concat(text, chr(10), chr(10), source), '\\n[ \\t\\r\\f\\v]*\\n') AS s FROM documents) x) y) z WHERE text <> ''")
def segment_blocks(spark, sf_dir):
    return segment.blocks(both(spark, sf_dir, "SELECT doc_id AS id, concat(text, chr(10), chr(10), source) AS text FROM {documents}"))


@query("page_for_offset", "SELECT doc_id, CASE WHEN n_chars % 700 < 250 THEN 1 WHEN n_chars % 700 BETWEEN 251 AND 499 THEN 2 WHEN n_chars % 700 >= 500 AND n_chars % 700 < 600 THEN 3 END AS page FROM documents")
def page_for_offset(spark, sf_dir):
    rows = both(spark, sf_dir, "SELECT doc_id, CAST(n_chars % 700 AS INT) AS at FROM {documents}")
    pages = F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((0, 250), (251, 500), (500, 600))))
    return rows.select("doc_id", segment.page_of(F.col("at"), pages).alias("page"))


@query("role_range_join", "SELECT id, role, min(number) AS number FROM (SELECT CAST(o_orderkey AS VARCHAR) AS id, r.role, k.n AS number, r.spot FROM orders, (VALUES ('facts', 10), ('order', 100), ('issues', 300)) r(role, spot), (VALUES (1, 0, 100), (2, 100, 200)) k(n, s, e) WHERE r.spot BETWEEN k.s AND k.e) x GROUP BY id, role")
def role_range_join(spark, sf_dir):
    docs = both(spark, sf_dir, "SELECT CAST(o_orderkey AS VARCHAR) AS id FROM {orders}")
    paras = docs.select("id", F.explode(F.array(*(F.struct(F.lit(n).alias("number"), F.lit(s).alias("char_start"), F.lit(e).alias("char_end")) for n, s, e in ((1, 0, 100), (2, 100, 200))))).alias("p")).select("id", "p.*")
    hits = docs.select("id", F.explode(F.array(*(F.struct(F.lit(r).alias("role"), F.lit(a).alias("at")) for r, a in (("facts", 10), ("order", 100), ("issues", 300))))).alias("h")).select("id", "h.*")
    return segment.attach_roles(paras, hits)


_KINDS = "SELECT CAST(doc_id AS VARCHAR) AS id, CASE doc_id % 7 WHEN 0 THEN 'statute' WHEN 1 THEN 'judgment' WHEN 2 THEN 'fir' WHEN 3 THEN 'chargesheet' WHEN 4 THEN 'contract' WHEN 5 THEN 'notice' ELSE 'order' END AS kind, text FROM {documents}"


@query("segment_documents")
def segment_documents(spark, sf_dir):
    """All segmenters by kind over whole texts; positions are checked by unit tests."""
    return segment.segment(both(spark, sf_dir, _KINDS))


# texts of three kinds and their segments: (remainder of the order's key, position, type, label, text, exact span or null for the whole text, parent, extra)
_STATUTES = {
    0: "CHAPTER <N> OF FIRST\n1. Short title.\nbody of <Y>\nCHAPTER 9 LAST\nSection 2A. Meaning\nof words\n", 2: "no statute is in here, 7 of <N>. words",
    1: "THE TEST OF TIME ACT, 1999\nPART II GENERAL\n7. Theft.\nWho takes in <Y> commits theft.\n(1) A thing is movable.\nProvided that it moves.\nExplanation. It moves when cut.\n\nIllustration. A cuts a tree.\n8B. Next <N>",
}
_SEGMENTS = [
    (0, 0, "Chapter", "Chapter <N>", "CHAPTER <N> OF FIRST", "CHAPTER <N> OF FIRST", None, "OF FIRST"), (0, 1, "Section", "Section 1", "1. Short title.\nbody of <Y>", "1. Short title.\nbody of <Y>\n", "Chapter <N>", "1"),
    (0, 2, "Chapter", "Chapter 9", "CHAPTER 9 LAST", "CHAPTER 9 LAST", None, "LAST"), (0, 3, "Section", "Section 2A", "Section 2A. Meaning\nof words", "Section 2A. Meaning\nof words\n", "Chapter 9", "2a"),
    (1, 0, "Act", "TEST OF TIME ACT, 1999", "TEST OF TIME ACT, 1999", None, None, "test_of_time"), (1, 1, "Part", "Part II", "PART II GENERAL", "PART II GENERAL", "TEST OF TIME ACT, 1999", "GENERAL"),
    (1, 2, "Section", "Section 7", "7. Theft.\nWho takes in <Y> commits theft.\n(1) A thing is movable.\nProvided that it moves.\nExplanation. It moves when cut.\n\nIllustration. A cuts a tree.", "7. Theft.\nWho takes in <Y> commits theft.\n(1) A thing is movable.\nProvided that it moves.\nExplanation. It moves when cut.\n\nIllustration. A cuts a tree.\n", "Part II", "test_of_time:7"),
    (1, 3, "Subsection", "Section 7(1)", "(1) A thing is movable.", "(1) A thing is movable.\n", "Section 7", "1"), (1, 4, "Proviso", "Section 7 - proviso", "Provided that it moves.", "Provided that it moves.\n", "Section 7", None),
    (1, 5, "Explanation", "Section 7 - explanation", "Explanation. It moves when cut.", "Explanation. It moves when cut.\n", "Section 7", None), (1, 6, "Illustration", "Section 7 - illustration", "Illustration. A cuts a tree.", "Illustration. A cuts a tree.\n", "Section 7", None),
    (1, 7, "Section", "Section 8B", "8B. Next <N>", "8B. Next <N>", "Part II", "test_of_time:8b"),
]


def _filled(text: str) -> str:
    return f"replace(replace({text}, '<Y>', CAST(year(o_orderdate) AS VARCHAR)), '<N>', CAST(o_orderkey AS VARCHAR))"


def _texts(kinds: dict[int, str]) -> str:
    cases = " ".join(f"WHEN {k} THEN {schema.sql_literal(t)}" for k, t in kinds.items())
    return f"SELECT CAST(o_orderkey AS VARCHAR) AS id, {_filled(f'CASE o_orderkey % {len(kinds)} {cases} END')} AS text, o_orderkey, o_orderdate FROM {{orders}}"


def _finds_sql(kinds: dict[int, str], rows: list[tuple], columns: str, out: str) -> str:
    return f"SELECT id, pos, {_filled('raw')} AS raw, kind, strpos(text, {_filled('raw')}) - 1 AS char_start, strpos(text, {_filled('raw')}) - 1 + length({_filled('raw')}) AS char_end, {out} FROM ({plain(_texts(kinds))}) t JOIN {schema.values_sql(rows, columns)} f ON f.k = t.o_orderkey % {len(kinds)}"


@query("segment_statute_full", f"SELECT id, pos, node_type, {_filled('label')} AS label, {_filled('shown')} AS text, CASE WHEN raw IS NULL THEN 0 ELSE strpos(text, {_filled('raw')}) - 1 END AS char_start, CASE WHEN raw IS NULL THEN length(text) ELSE strpos(text, {_filled('raw')}) - 1 + length({_filled('raw')}) END AS char_end, {_filled('parent')} AS parent, extra FROM ({plain(_texts(_STATUTES))}) t JOIN {schema.values_sql(_SEGMENTS, 'k, pos, node_type, label, shown, raw, parent, extra')} s ON s.k = t.o_orderkey % 3")
def segment_statute_full(spark, sf_dir):
    return segment.segment(both(spark, sf_dir, _texts(_STATUTES)).withColumn("kind", F.lit("statute")))


# each kind of text with what must be found in it: (remainder of the order's key, position, start, end, ...); <Y> the year, <N> the key
_CITED = {
    0: "See Ram Singh v. State of Rajasthan, AIR <Y> SC <N> and Vishaka v State (2019) 5 SCC <N>", 1: "Ram Singh vs. Union of India was argued at great length before the full bench in AIR <Y> Del <N>",
    2: "nothing to cite in the year <Y>, not even air <Y>", 3: "AIR 1492 SC 7, then <Y> INSC <N>; the v. And case", 4: "In Re Nobody v. The State, cf. [<Y>] 3 SCR <N>",
}
_CITES = [
    (0, 0, "Ram Singh v. State of Rajasthan, AIR <Y> SC <N>", "combined", "case:sc:air:<Y>:<N>", "<Y>", "Ram Singh v State of Rajasthan"),
    (0, 1, "Vishaka v State (2019) 5 SCC <N>", "combined", "case:sc:scc:2019:5:<N>", "2019", "Vishaka v State"),
    (1, 0, "Ram Singh vs. Union of India", "case_title", "case:title:ram_singh_v_union_of_india", None, "Ram Singh v Union of India"),
    (1, 1, "AIR <Y> Del <N>", "reporter", "case:del:air:<Y>:<N>", "<Y>", None),
    (3, 0, "<Y> INSC <N>", "neutral", "case:sc:insc:<Y>:<N>", "<Y>", None),
    (4, 0, "Re Nobody v. The State, cf. [<Y>] 3 SCR <N>", "combined", "case:sc:scr:<Y>:3:<N>", "<Y>", "Re Nobody v State"),
]
_NAMED = {
    0: "The Supreme Court of India, per Justice Asha Rao, on 12/03/<Y> in Ram Singh v. State of Bihar", 1: "before the DELHI high court on 3 May <Y>", 2: "no names are in here, only words of <Y>", 3: "the ITAT and Nclat sat; education went on",
    4: "Hon'ble Mr. Ravi Kumar Sen wrote, Dr. No did not",
}
_FOUND = [
    (0, 0, "Supreme Court of India", "Court", "SC"), (0, 1, "Asha Rao", "Judge", None), (0, 2, "12/03/<Y>", "Date", None), (0, 3, "Ram Singh", "Party", "petitioner"), (0, 4, "State of Bihar", "Party", "respondent"),
    (1, 0, "DELHI high court", "Court", "HC"), (1, 1, "3 May <Y>", "Date", None), (3, 0, "ITAT", "Court", "TRIBUNAL"), (3, 1, "Nclat", "Court", "TRIBUNAL"), (3, 2, "cat", "Court", "TRIBUNAL"), (4, 0, "Ravi Kumar Sen", "Judge", None),
]


@query("cite_title_merge", _finds_sql(_CITED, _CITES, "k, pos, raw, kind, canonical, yr, parties", f"{_filled('canonical')} AS canonical_id, CAST({_filled('yr')} AS DOUBLE) AS year, parties"))
def cite_title_merge(spark, sf_dir):
    return extract.extract_citations(both(spark, sf_dir, _texts(_CITED)))


@query("ner_entities", _finds_sql(_NAMED, _FOUND, "k, pos, raw, kind, extra", "extra"))
def ner_entities(spark, sf_dir):
    return extract.extract_entities(both(spark, sf_dir, _texts(_NAMED)))


# ---- texts for people ---------------------------------------------------------------------------------


@query("display_texts", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3000 < 1000 THEN concat(o_orderkey % 3000, ' ms') ELSE concat(printf('%.2f', (o_orderkey % 3000 + 5) // 10 / 100.0), ' s') END AS elapsed, CASE WHEN o_orderkey * 37 < 1024 THEN concat(o_orderkey * 37, ' B') WHEN o_orderkey * 37 < 1048576 THEN concat(printf('%.1f', round(o_orderkey * 37 / 1024.0, 1)), ' KB') ELSE concat(printf('%.1f', round(o_orderkey * 37 / 1048576.0, 1)), ' MB') END AS size, coalesce(list_extract(['Constitution / Statute', 'Supreme Court', 'High Court', 'Tribunal', 'Lower Court', 'Private Document', 'Private Note', 'AI Summary'], CAST(o_orderkey % 10 AS INT)), 'Unknown') AS tier FROM orders")
def display_texts(spark, sf_dir):
    rows = both(spark, sf_dir, "SELECT o_orderkey AS id FROM {orders}")
    return rows.select("id", display.elapsed_text(F.col("id") % 3000).alias("elapsed"), display.bytes_text(F.col("id") * 37).alias("size"), display.tier_text((F.col("id") % 10).cast("int")).alias("tier"))


@query("marker_runs", "SELECT doc_id, array_to_string(list_filter([source, CASE WHEN n_chars % 3 > 0 THEN '<S1>' END, CASE WHEN n_chars % 3 = 2 THEN concat('<S', doc_id, '>') END, ' tail [S] ', CASE WHEN n_chars % 2 = 0 THEN '<S7>' END], lambda x: x IS NOT NULL), '|') AS runs FROM documents")
def marker_runs(spark, sf_dir):
    rows = both(spark, sf_dir, "SELECT doc_id, concat(source, CASE WHEN n_chars % 3 > 0 THEN '[S1]' ELSE '' END, CASE WHEN n_chars % 3 = 2 THEN concat('[S', doc_id, ']') ELSE '|' END, ' tail [S] ', CASE WHEN n_chars % 2 = 0 THEN '[S7]' ELSE '' END) AS text FROM {documents}")
    shown = F.transform(display.marker_runs(F.regexp_replace("text", r"\|", "")), lambda r: F.when(r["kind"] == "marker", F.concat(F.lit("<"), r["value"], F.lit(">"))).otherwise(r["value"]))
    joined = F.array_join(shown, "|")
    # between a source and the tail there is no marker where n_chars % 3 = 0: they are one run
    return rows.select("doc_id", F.replace(joined, F.lit(" tail [S] "), F.lit("| tail [S] ")).alias("runs")).withColumn("runs", F.replace("runs", F.lit("||"), F.lit("|")))


_SIGNAL = "CASE o_orderkey % 6 WHEN 0 THEN 'Punishment under Section 302 IPC, and its equivalent in the BNS? See Ram v. State' WHEN 1 THEN 'hello there' WHEN 2 THEN 'which judgment follows' WHEN 3 THEN 'what sentence is due' WHEN 4 THEN 'map ipc to bns' ELSE 'section nine' END"


@query("query_signals", "SELECT o_orderkey AS qid, concat(CASE WHEN o_custkey % 2 = 0 THEN 'Matter-scoped retrieval|' ELSE '' END, CASE o_orderkey % 6 WHEN 0 THEN CASE WHEN o_custkey % 2 = 0 THEN 'Statute anchor detected|Punishment lookup|Crosswalk-sensitive question' ELSE 'Statute anchor detected|Punishment lookup|Crosswalk-sensitive question' END WHEN 1 THEN CASE WHEN o_custkey % 2 = 0 THEN '' ELSE 'Generic research query' END WHEN 2 THEN 'Precedent retrieval likely' WHEN 3 THEN 'Punishment lookup' WHEN 4 THEN 'Statute anchor detected|Crosswalk-sensitive question' ELSE CASE WHEN o_custkey % 2 = 0 THEN '' ELSE 'Generic research query' END END) AS signals FROM orders")
def query_signals(spark, sf_dir):
    rows = both(spark, sf_dir, f"SELECT o_orderkey AS qid, {_SIGNAL} AS question, CASE WHEN o_custkey % 2 = 0 THEN 'm1' ELSE ' ' END AS scope FROM {{orders}}")
    found = F.array_join(F.transform(display.signals(F.col("question"), F.col("scope")), lambda s: s["label"]), "|")
    # the mark behind the first label stands even where no other follows
    return rows.select("qid", F.when(found == "Matter-scoped retrieval", "Matter-scoped retrieval|").otherwise(found).alias("signals"))


# ---- sinks and events ----------------------------------------------------------------------------------


@query("audit_json", "SELECT doc_id, concat('{\"doc_id\":', doc_id, ',\"source\":\"', source, '\"', CASE WHEN doc_id % 2 = 0 THEN concat(',\"n_chars\":', n_chars) ELSE '' END, '}') AS line FROM documents")
def audit_json(spark, sf_dir):
    rows = both(spark, sf_dir, "SELECT doc_id, source, CASE WHEN doc_id % 2 = 0 THEN n_chars END AS n_chars FROM {documents}")
    return rows.select("doc_id", sinks.audit_line("doc_id", "source", "n_chars").alias("line"))


@query("adapter_counts", "SELECT source, CASE WHEN doc_id % 9 = 0 THEN 'failed' ELSE 'ok' END AS status, count(*) AS n FROM documents GROUP BY 1, 2")
def adapter_counts(spark, sf_dir):
    return both(spark, sf_dir, "SELECT source, CASE WHEN doc_id % 9 = 0 THEN 'failed' ELSE 'ok' END AS status FROM {documents}").groupBy("source", "status").agg(F.count("*").alias("n"))


@query("copy_if_absent", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def copy_if_absent(spark, sf_dir):
    return sinks.absent(both(spark, sf_dir, "SELECT doc_id FROM {documents}"), both(spark, sf_dir, "SELECT doc_id FROM {labels}"), "doc_id")


@query("episode_text", "SELECT doc_id, substr(concat(source, ' — ', text), 1, 2000) AS body FROM documents")
def episode_text(spark, sf_dir):
    return both(spark, sf_dir, "SELECT doc_id, source, text FROM {documents}").select("doc_id", sinks.episode_text(F.col("source"), F.col("text")).alias("body"))


@query("server_sent_event", "SELECT event_id, concat('data: {\"event_id\":', event_id, ',\"event_type\":\"', event_type, '\"}', chr(10), chr(10)) AS frame FROM events")
def server_sent_event(spark, sf_dir):
    return both(spark, sf_dir, "SELECT event_id, event_type FROM {events}").select("event_id", bus.server_sent(F.struct("event_id", "event_type")).alias("frame"))


def _events(spark, sf_dir):
    return both(spark, sf_dir, "SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id, event_type, value, props FROM {events}")


@query("stream_stage_counts", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_stage_counts(spark, sf_dir):
    out = bus.tumbling(_events(spark, sf_dir))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("stream_sliding_counts", "SELECT start, count(*) AS n FROM (SELECT date_trunc('hour', ts) - k.h * INTERVAL 1 HOUR AS start FROM events, (VALUES (0), (1)) k(h)) x GROUP BY start")
def stream_sliding_counts(spark, sf_dir):
    return bus.sliding(_events(spark, sf_dir)).select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("trace_sessions_15m", "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 900 SECOND THEN 0 ELSE 1 END AS new FROM events) x) y GROUP BY user_id, s")
def trace_sessions_15m(spark, sf_dir):
    return bus.sessions(_events(spark, sf_dir)).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("trace_last_512", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) x WHERE k <= 512")
def trace_last_512(spark, sf_dir):
    return bus.last_events(_events(spark, sf_dir)).select("user_id", "event_id")


@query("stream_dlq_split", "SELECT CASE WHEN event_type IS NULL OR TRY_CAST(json_extract_string(props, '$.k') AS INT) IS NULL OR TRY_CAST(json_extract_string(props, '$.k') AS INT) % 13 = 0 THEN 'dead' ELSE 'good' END AS route, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_dlq_split(spark, sf_dir):
    good, dead = bus.split_dead(bus.typed(_events(spark, sf_dir)), F.col("problem").isNotNull() | (F.col("k") % 13 == 0))
    count = lambda df, route: df.groupBy(F.lit(route).alias("route"), "event_type").agg(F.count("*").alias("n"))
    return count(good, "good").unionByName(count(dead, "dead"))


@query("stream_idempotent", "SELECT event_type, count(*) AS n FROM (SELECT DISTINCT event_type, user_id, value, props FROM events) x GROUP BY event_type")
def stream_idempotent(spark, sf_dir):
    return bus.once(_events(spark, sf_dir)).groupBy("event_type").agg(F.count("*").alias("n"))


_MESSAGES = """SELECT event_id, CASE event_id % 6 WHEN 0 THEN concat('{{"event_type":"query.request","trace_id":"t', user_id, '","question":"q', event_id, '","filters":{{"a":"b"}}}}') WHEN 1 THEN '{{"event_type":"query.request","trace_id":"t"}}'
 WHEN 2 THEN concat('{{"event_type":"graph.written","trace_id":"t', user_id, '","episode_id":"e","node_ids":["n1","n2"],"edge_count":', event_id, '}}') WHEN 3 THEN '{{"event_type":"eval.request","trace_id":"t","x":1}}' WHEN 4 THEN 'broken' ELSE '{{"trace_id":"t"}}' END AS data FROM {events}"""


@query("typed_events", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'query.request' WHEN 2 THEN 'graph.written' WHEN 3 THEN 'generic' ELSE 'unknown' END AS kind, CASE event_id % 6 WHEN 0 THEN 'query.request' WHEN 2 THEN 'graph.written' WHEN 3 THEN 'eval.request' ELSE 'unknown' END AS event_type, CASE WHEN event_id % 6 IN (0, 2) THEN concat('t', user_id) WHEN event_id % 6 = 3 THEN 't' ELSE 'unknown' END AS trace_id, CASE WHEN event_id % 6 = 0 THEN concat('q', event_id) END AS question, CASE WHEN event_id % 6 = 2 THEN event_id END AS edges, CASE WHEN event_id % 6 = 2 THEN 2 END AS nodes FROM events")
def typed_events(spark, sf_dir):
    rows = both(spark, sf_dir, _MESSAGES)
    out = bus.typed_events(rows)
    return out.select("event_id", "kind", "event_type", "trace_id", F.col("query_request.question").alias("question"), F.col("graph_written.edge_count").alias("edges"), F.when(F.col("graph_written").isNotNull(), F.size("graph_written.node_ids")).alias("nodes"))


@query("answered_within", "SELECT a.user_id, a.event_id AS request_id, b.event_id AS answer_id FROM events a JOIN events b ON b.user_id = a.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 10 MINUTE WHERE a.event_id % 2 = 0 AND b.event_id % 2 = 1")
def answered_within(spark, sf_dir):
    """The batch form of the stream-stream join; every second event asks, the others answer."""
    rows = _events(spark, sf_dir)
    return bus.answered_within(rows.filter("event_id % 2 = 0"), rows.filter("event_id % 2 = 1")).select("user_id", "request_id", "answer_id")


# ---- extras: plain relational forms that the engine offers beside its own operators ------------------------


@query("extra_rollup_revenue", "SELECT coalesce(l_returnflag, '*') AS flag, coalesce(l_linestatus, '*') AS status, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def extra_rollup_revenue(spark, sf_dir):
    rows = both(spark, sf_dir, "SELECT l_returnflag, l_linestatus, l_extendedprice, l_discount FROM {lineitem}")
    out = rows.rollup("l_returnflag", "l_linestatus").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))
    return out.select(F.coalesce("l_returnflag", F.lit("*")).alias("flag"), F.coalesce("l_linestatus", F.lit("*")).alias("status"), "revenue", "n")


@query("extra_asof_last_event", "SELECT o_orderkey, event_id FROM (SELECT o.o_orderkey, e.event_id, row_number() OVER (PARTITION BY o.o_orderkey ORDER BY e.ts DESC, e.event_id DESC) AS k FROM orders o JOIN events e ON e.user_id = o.o_custkey AND e.ts <= e.ts) x WHERE k = 1")
def extra_asof_last_event(spark, sf_dir):
    latest = both(spark, sf_dir, "SELECT user_id, max(struct(ts, event_id)) AS m FROM {events} GROUP BY user_id")
    orders = both(spark, sf_dir, "SELECT o_orderkey, o_custkey FROM {orders}")
    return orders.join(latest, orders["o_custkey"] == latest["user_id"]).select("o_orderkey", F.col("m.event_id").alias("event_id"))
