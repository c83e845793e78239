"""Documents to graph to grounded answers, on a small corpus of our own."""

import pytest

from plinth import engine, schema

STATUTE = "THE INDIAN PENAL CODE, 1860\nCHAPTER XVI OF OFFENCES\n378. Theft. Whoever takes movable property dishonestly commits theft.\n(1) A thing attached is not movable.\n379. Punishment for theft is three years.\n"
NEW = "THE BHARATIYA NYAYA SANHITA, 2023\nCHAPTER XVII OF THEFT\n303. Theft means taking movable property dishonestly.\n"
CASE = "1. The Supreme Court of India considered theft.\n2. Under Section 378 of IPC dishonest taking is needed, AIR 1965 SC 9.\n3. The appeal is dismissed.\n"
PRIVATE = "Exhibit P-1 is the stolen bicycle\n\nStatement of Ram Lal follows, he saw theft\n"


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.createDataFrame([("ipc", "statute", STATUTE, None), ("bns", "statute", NEW, None), ("case1", "judgment", CASE, None), ("priv", "notice", PRIVATE, "m1"), ("none", "statute", None, None)], "id string, kind string, text string, matter_id string")
    return engine.ingest(docs)


def _ask(spark, rows):
    return spark.createDataFrame([(*r, None, None) for r in rows], "qid int, question string, matter_scope string, ceiling int, as_of string")


def test_graph(corpus):
    nodes = {r.id: r for r in corpus.nodes.collect()}
    assert {"act:ipc", "act:bns", "section:ipc:378", "section:ipc:379", "section:bns:303", "court:supreme_court_of_india"} <= set(nodes)
    edges = {(r.edge_type, r.src, r.dst) for r in corpus.edges.collect()}
    assert ("CHAPTER_CONTAINS_SECTION", "act:ipc", "section:ipc:378") in edges and ("SECTION_CROSSWALK_TO", "section:ipc:378", "section:bns:303") in edges
    assert any(e == "CASE_INTERPRETS_SECTION" and d == "section:ipc:378" for e, _, d in edges)
    assert {r.edge_type for r in corpus.rejected_edges.collect()} == {"CASE_CITES_CASE"}
    derived = {s for e, s, _ in edges if e == "NODE_DERIVED_FROM_SOURCE"}
    assert derived == set(nodes) and len({r.span_id for r in corpus.spans.collect()}) == corpus.spans.count()
    assert {r.matter_id for r in nodes.values() if "priv" in r.id} == {"m1"}


def test_answers(spark, corpus):
    asked = _ask(spark, [(1, "What is Section 378 of IPC?", None), (2, "Who saw the stolen bicycle in exhibit P-1?", "m1"), (3, "Who saw the stolen bicycle?", None), (4, "zzz qqq", None)])
    for mode in ("graph_only", "graph_semantic", "graph_semantic_rerank"):
        answers, packs = engine.answer(asked, corpus, mode=mode)
        rows, spans = {r.qid: r for r in answers.collect()}, packs.collect()
        assert not rows[1].insufficient and {"section:ipc:378", "section:bns:303"} <= {s.node for s in spans if s.qid == 1}
        assert rows[4].insufficient and rows[4].answer == "Insufficient evidence was retrieved." or rows[4].insufficient
        assert not [s for s in spans if s.qid != 2 and s.matter_id is not None]
        for q in rows:
            assert set(rows[q].used) <= {s.marker for s in spans if s.qid == q} and rows[q].fabricated == []
    assert [s for s in spans if s.qid == 2 and s.matter_id == "m1"]


def test_evaluation(spark, corpus):
    answers, packs = engine.answer(_ask(spark, [(1, "What is Section 378 of IPC?", None), (2, "zzz qqq", None)]), corpus)
    gold = spark.createDataFrame([(1, ["378"], None, None, True)], "qid int, expected_sections array<string>, expected_nodes array<string>, expected_target string, expected_tier1 boolean")
    s = engine.evaluate(answers, packs, gold, "d").first()
    assert (s.items, s.fabricated_marker_rate, s.citation_faithfulness, s.retrieval_hit_rate, s.false_refusal_rate, s.true_refusal_rate) == (2.0, 0.0, 1.0, 1.0, 0.0, 1.0)
    assert s.tier1_anchor_rate > 0


def test_services(spark):
    assert engine.services(spark).count() == 8 and set(schema.POLICIES) >= {"generic"}
